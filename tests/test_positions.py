"""Positions and running totals on more rows than any sample of bounds holds, and the callers that rest on them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import encode, sampling

N = 500_000


@pytest.fixture(scope="module")
def wide(spark):
    """Three columns, one with nulls and one with many equal values."""
    return spark.range(N).select(F.md5(F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 1000).alias("a"), "id")


@pytest.mark.parametrize("order", [["k"], ["id"], ["a", "id"], ["a", "k"]])
def test_positions_are_exact(wide, order):
    got = sampling.numbered(wide, order)
    assert got.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.sum("id")).first()[:] == (N, N, 0, N - 1, N * (N - 1) // 2)
    assert got.orderBy("pos").select(*order).limit(3000).collect() == wide.orderBy(*order).select(*order).limit(3000).collect()


def test_range_number_is_the_same_on_any_partitioning(wide):
    number = sampling.range_number(wide, ["a", "k"])
    one = wide.select("id", number.alias("n"))
    other = wide.repartition(13).select("id", number.alias("n"))
    assert one.select("n").distinct().count() > 1
    assert one.exceptAll(other).isEmpty()


def test_running_total(wide):
    got = sampling.running_total(wide, ["k"], "id", "total")
    rows = wide.orderBy("k").limit(1000).toPandas()
    assert [r["total"] for r in got.orderBy("k").limit(1000).collect()] == rows["id"].cumsum().tolist()
    assert got.agg(F.max("total")).first()[0] == N * (N - 1) // 2


def test_round_robin_and_divided(wide):
    small, large = wide.where("id % 5 = 0"), wide.where("id % 5 <> 0")
    mixed = sampling.round_robin([small, large], ["id"], "all_exhausted")
    size = large.count()
    assert mixed.agg(F.count("*"), F.count_distinct("mix_pos"), F.max("mix_pos")).first()[:] == (2 * size, 2 * size, 2 * size - 1)
    assert mixed.where("mix_pos % 2 = 1").count() == mixed.where("mix_pos % 2 = 1").select("id").distinct().count() == size
    parts = {r["count"] for r in sampling.divided(wide, 7, ["k"]).groupBy("part").count().collect()}
    assert parts <= {N // 7, N // 7 + 1}


def test_block_pack_keeps_order(wide):
    tokens = wide.where("id < 50000").select("id", F.array(F.col("id").cast("int"), (F.col("id") + 1).cast("int")).alias("ids"))
    got = encode.block_pack(tokens, "id", "ids", 100)
    assert got.count() == 50 * 20
    firsts = got.orderBy("batch", "block_no").select(F.element_at("input_ids", 1)).limit(1000).collect()
    assert [r[0] for r in firsts] == list(range(0, 50_000, 50))


def test_few_shots_are_always_enough(spark, wide):
    targets = spark.range(200).select(F.col("id").alias("t"))
    for pool, n, want in ((wide, 5, 5), (wide.where("id < 7"), 5, 5), (wide.where("id < 3"), 5, 3)):
        got = sampling.few_shot(targets, pool.select("id", "k"), n, "t", "id")
        rows = got.groupBy("t").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.count_distinct("shot").alias("s")).collect()
        assert len(rows) == 200 and {tuple(r)[1:] for r in rows} == {(want,) * 3}
    assert sampling.few_shot(targets, wide.limit(0).select("id"), 5, "t", "id").count() == 0


def test_empty(spark):
    assert sampling.numbered(spark.range(0), ["id"]).collect() == []


def test_mixes_equal_their_sql_on_more_rows(spark):
    """The registered mixes on the largest table set, where the loss of rows once showed."""
    from millrace.plans import catalogue

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("u2_mix_round_robin", "u2_mix_all_exhausted"):
        want = con.execute(f"SELECT count(*), sum(mix_pos), count(DISTINCT mix_pos) FROM ({catalogue.oracle_sql()[name]})").fetchone()
        got = catalogue.queries()[name](spark, sf).agg(F.count("*"), F.sum("mix_pos"), F.count_distinct("mix_pos")).first()
        assert tuple(got) == tuple(want), name
