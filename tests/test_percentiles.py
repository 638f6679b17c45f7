"""Percentiles by counts against sorted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics

AT = [0.0, 0.25, 0.5, 0.95, 1.0]


def rows():
    rng = np.random.default_rng(2)
    groups = {"even": rng.random(500), "wide": 10.0 ** rng.uniform(-12, 12, 200) * rng.choice([-1, 1], 200), "same": np.full(90, 3.5), "two": np.array([1.0, 2.0]), None: rng.integers(0, 5, 300).astype(float), "one": np.array([-0.0])}
    return [(g, float(x)) for g, xs in groups.items() for x in xs], groups


@pytest.mark.parametrize("exact_rows", [10**6, 100, 0])
def test_percentiles(spark, exact_rows):
    data, groups = rows()
    df = spark.createDataFrame([*data, ("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)], "g string, v double").repartition(4)
    got = {r["g"]: r["percentiles"] for r in metrics.percentiles(df, ["g"], "v", AT, exact_rows).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.percentile(xs, np.array(AT) * 100).tolist(), rel=1e-12), g


def test_latency_over_large_groups(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") % 97).cast("double").alias("ms"), F.lit(2).alias("tokens"))
    want = sorted(map(tuple, metrics.latency(df, ["k"], "ms", "tokens").collect()))
    monkeypatch.setattr(metrics, "EXACT_ROWS", 10)
    assert sorted(map(tuple, metrics.latency(df, ["k"], "ms", "tokens").collect())) == want


def test_without_rows(spark):
    assert metrics.percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", AT, 0).count() == 0
