import pytest
from pyspark.sql import functions as F

from millrace.operators import align
from millrace.streaming import streams


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "instruction string, input string, output string"
    df = spark.createDataFrame([(f"q{i}", "", f"a{i}") for i in range(30)], schema)
    df.repartition(3).write.parquet(src)
    stream = streams.aligned_stream(streams.file_stream(spark, src, schema), align.Columns())
    own = stream.select("_prompt", "_response")
    streams.drained(own, str(tmp_path / "cp"), streams.by_batch(str(tmp_path / "out")))
    got = sorted(map(str, spark.read.schema(own.schema).parquet(str(tmp_path / "out")).select("_prompt", "_response").collect()))
    assert got == sorted(map(str, align.align(df, align.Columns()).select("_prompt", "_response").collect()))


def test_once_by_id(spark, tmp_path):
    write = streams.once_by_id(spark, str(tmp_path / "out"), "id")
    df = spark.range(10).select("id", F.lit("x").alias("v"))
    write(df, 0)
    write(df.union(spark.createDataFrame([(99, "y")], "id long, v string")), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11


def test_split_and_rules(spark):
    a, b = streams.split_stream(spark.range(100), "id", 20)
    assert a.count() + b.count() == 100 and 5 < a.count() < 40
    for bad in ((0.1, None, False, "x"), (0, 5, False, "x"), (0, None, True, "x"), (0, None, False, "concat")):
        with pytest.raises(ValueError):
            streams.check_streaming(*bad)


def test_event_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:10", 1.0), (1, "2024-01-01 00:00:50", 2.0), (1, "2024-01-01 00:05:00", 3.0)], "user_id int, t string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    own = streams.with_event_time(e)
    assert sorted(r["n"] for r in streams.tumbling(own, "1 minute", ["user_id"]).collect()) == [1, 2]
    assert sorted(r["n"] for r in streams.sessions(own, "2 minutes", ["user_id"]).collect()) == [1, 2]
    assert streams.sliding(own, "2 minutes", "1 minute", ["user_id"]).count() == 4
