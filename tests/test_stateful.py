"""Streams with state over batches, stopped and started again."""

import datetime

import pytest

from millrace.streaming import stateful, streams

SCHEMA = "id long, text string, weight double"


def rows(lo, hi):
    return [(i, None if i % 7 == 0 else f"t{i}", None if i % 5 == 0 else i / 2) for i in range(lo, hi)]


def arrive(spark, path, data, name):
    """A new file in a stream's folder."""
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def run(spark, tmp, shape, out="out"):
    stream = shape(streams.file_stream(spark, f"{tmp}/in/*", SCHEMA))
    streams.drained(stream, f"{tmp}/cp", each=streams.by_batch(f"{tmp}/{out}"))
    return stream.schema


def test_shuffle_buffer_over_restarts(spark, tmp_path):
    shape = lambda s: stateful.shuffled(s, "id", buffer=40, lanes=4, seed=3)
    for k in range(3):
        arrive(spark, f"{tmp_path}/in", rows(100 * k, 100 * k + 100), f"f{k}")
        schema = run(spark, tmp_path, shape)  # a query of its own each time, from the last one's checkpoint
    sent = spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()
    held = stateful.rest(spark, f"{tmp_path}/cp").collect()
    assert len(held) == 40 and len(sent) == 260
    assert sorted((r["id"], r["text"], r["weight"]) for r in [*sent, *held]) == rows(0, 300)
    for lane in range(4):
        own = sorted((r["place"], r["id"]) for r in sent if r["lane"] == lane)
        assert [p for p, _ in own] == list(range(len(own)))
        order = [i for _, i in own]
        assert order != sorted(order)
        moved = [i for i in order[-20:] if i < 200]
        assert moved or len(order) < 20  # rows of earlier files go out among later ones


def test_shuffle_names(spark, tmp_path):
    with pytest.raises(ValueError):
        stateful.shuffled(spark.range(3).selectExpr("id", "id AS lane"), "id")


def test_once_with_known_keys_and_restarts(spark, tmp_path):
    known = spark.createDataFrame([(3,), (4,), (4,)], "id long")
    shape = lambda s: stateful.once_within(s, "id", order="weight", known=known)
    arrive(spark, f"{tmp_path}/in", [(1, "late", 2.0), (1, "early", 1.0), (3, "old", 0.0), (None, "n", 1.0)], "a")
    schema = run(spark, tmp_path, shape)
    arrive(spark, f"{tmp_path}/in", [(1, "again", 0.0), (5, "new", 0.0), (4, "old", 0.0), (None, "m", 0.0)], "b")
    run(spark, tmp_path, shape)
    got = sorted((r["text"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()))
    assert got == ["early", "n", "new"]


def test_once_forgets(spark, tmp_path):
    """Ten seconds after a key went out it counts as new; what the watermark has passed is forgotten."""
    schema = "id long, text string, ts timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    batches = [[(1, "a", at(0)), (1, "b", at(9)), (1, "c", at(11)), (2, "d", at(5))], [(1, "e", at(20)), (2, "f", at(16)), (9, "k", at(4))], [(3, "g", at(500))], [(3, "h", at(505)), (1, "i", at(501))]]
    known = spark.createDataFrame([(9, at(0))], "id long, ts timestamp")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
        stream = streams.file_stream(spark, f"{tmp_path}/in/*", schema).withWatermark("ts", "30 seconds")
        own = stateful.once_within(stream, "id", time="ts", seconds=10, known=known)
        streams.drained(own, f"{tmp_path}/cp", each=streams.by_batch(f"{tmp_path}/out"))
    assert sorted(r["text"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()) == ["a", "c", "d", "f", "g", "i"]
    with pytest.raises(ValueError):
        stateful.once_within(spark.range(2), "id", seconds=3)
