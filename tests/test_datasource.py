"""Sources of Spark's own interface: several tasks a file, filters that leave out ranges, streams, writes, loaders."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.sources import datasource, readers
from millrace.streaming import streams


def arrow_file(path, lo, hi, step=5, stream=False):
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])
    new = pa.ipc.new_stream if stream else pa.ipc.new_file
    with new(str(path), schema) as w:
        for i in range(lo, hi, step):
            n = min(step, hi - i)
            w.write_batch(pa.record_batch([pa.array(range(i, i + n)), pa.array([None if x % 9 == 0 else f"t{x}" for x in range(i, i + n)])], schema=schema))


def want(lo, hi):
    return [(x, None if x % 9 == 0 else f"t{x}") for x in range(lo, hi)]


def tasks(df):
    return df.select(F.spark_partition_id()).distinct().count()


@pytest.mark.parametrize("stream", [False, True])
def test_one_arrow_file_in_several_tasks(spark, tmp_path, stream):
    arrow_file(tmp_path / "a.arrow", 0, 103, stream=stream)
    df = datasource.read(spark, datasource.ArrowFiles, str(tmp_path / "a.arrow"), unitsAtask=4)
    assert df.dtypes == [("id", "bigint"), ("text", "string")]
    assert sorted(map(tuple, df.collect())) == want(0, 103)
    assert tasks(df) == df.rdd.getNumPartitions() == 6  # 21 batches


def test_arrow_folder_and_writes(spark, tmp_path):
    df = spark.range(40).select("id", F.when(F.col("id") % 3 > 0, F.array("id", F.lit(None))).alias("xs"), F.struct(F.col("id").cast("string").alias("s")).alias("r")).repartition(3)
    path = str(tmp_path / "out")
    datasource.write_arrow(df, path)
    rows = lambda: sorted(map(str, datasource.read(spark, datasource.ArrowFiles, path).collect()))
    assert rows() == sorted(map(str, df.collect()))
    datasource.write_arrow(df.where("id < 5"), path)
    assert len(rows()) == 45
    datasource.write_arrow(df.where("id < 7"), path, "overwrite")
    assert rows() == sorted(map(str, df.where("id < 7").collect()))
    assert sorted(map(str, readers.arrow_files(spark, f"file://{path}/*.arrow").collect())) == rows()
    failing = df.select(F.raise_error(F.lit("no")).cast("long").alias("id"), "xs", "r")
    with pytest.raises(Exception, match="no"):
        datasource.write_arrow(failing, path)
    assert len(rows()) == 7


def pages_of(raw, lo, hi):
    return raw.decode().split("\f")[lo:hi]


def test_paged_binaries_and_filters(spark, tmp_path):
    for name, n in (("a", 25), ("b", 3)):
        (tmp_path / f"{name}.doc").write_text("\f".join(f"{name}{i}" for i in range(n)))
    (tmp_path / "_hidden").write_text("x")
    source = datasource.paged_source("form_feeds", lambda raw: raw.count(b"\f") + 1, pages_of)
    df = datasource.read(spark, source, str(tmp_path), unitsAtask=10)
    assert sorted(r["text"] for r in df.collect()) == sorted([f"a{i}" for i in range(25)] + [f"b{i}" for i in range(3)])
    assert df.rdd.getNumPartitions() == 4
    docs = readers.page_documents(df, "text", "source", 2, 4)
    assert sorted((r["page_content"], r["page"]) for r in docs.collect()) == [("a2", 3), ("a3", 4), ("a4", 5), ("b2", 3)]
    for condition, texts, parts in (
        ("page_index >= 12 AND page_index < 18", [f"a{i}" for i in range(12, 18)], 1),
        ("page_index = 21", ["a21"], 1),
        ("page_index IN (1, 24)", ["a1", "a24", "b1"], 3),
        ("page_index > 100", [], 1),
        (f"source = '{tmp_path}/b.doc'", ["b0", "b1", "b2"], 1),
    ):
        own = datasource.read(spark, source, str(tmp_path), unitsAtask=10).where(condition)
        assert sorted(r["text"] for r in own.collect()) == texts, condition
        assert own.rdd.getNumPartitions() == parts, condition


def test_streams_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arrow_file(tmp_path / "in" / "b.arrow", 0, 20)
    for k, (lo, hi) in enumerate([(20, 33), (33, 40)]):
        stream = datasource.read_stream(spark, datasource.ArrowFiles, str(tmp_path / "in"), unitsAtask=2)
        streams.drained(stream, str(tmp_path / "cp"), streams.by_batch(str(tmp_path / "out")))
        arrow_file(tmp_path / "in" / f"a{k}.arrow", lo, hi)
    stream = datasource.read_stream(spark, datasource.ArrowFiles, str(tmp_path / "in"))
    streams.drained(stream, str(tmp_path / "cp"), streams.by_batch(str(tmp_path / "out")))
    got = spark.read.schema("id long, text string").parquet(str(tmp_path / "out"))
    assert sorted((r["id"], r["text"]) for r in got.collect()) == want(0, 40)


def test_loaders(spark, tmp_path):
    def load(options, part):
        yield from ((f"{options['name']}-{part}-{i}", i) for i in range(part))

    source = datasource.loader_source("own_hub", "text string, n int", lambda options: [1, 2, 3] if options["split"] == "train" else [], load)
    (entry,) = readers.resolve({"x": {"hf_hub_url": "some/set"}}, ["x"])
    df = readers.load_dataset(spark, entry, "", datasource.hub(spark, source))
    assert sorted(r["text"] for r in df.collect()) == [f"some/set-{p}-{i}" for p in (1, 2, 3) for i in range(p)]
    assert df.rdd.getNumPartitions() == 3
    assert datasource.read(spark, source, name="x", split="test").count() == 0


def test_missing_files(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFound"):
        datasource.read(spark, datasource.ArrowFiles, str(tmp_path))
