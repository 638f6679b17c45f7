"""Each query against its SQL oracle on the smallest tables, and searches against plain scoring."""

import os
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from millrace.operators import scoring, vector_index
from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalogue.oracle_sql())


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr([clean(r[i]) for i in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


ODD = [(1, "", "en", "src1"), (2, "  two\n", "fr", "src2"), (4, None, "de", "src1"), (5, "Five", None, "src3"), (7, "Seven", "es", None), (8, "   ", "", ""), (10, "未提及", "未提及", "src1"), (11, "\t\r\x01 \"q\" \\ \u2028 😀", "en", "src1"), (13, None, None, None), (15, "", "", "")]


@pytest.mark.parametrize("name", ["st1_aligned_stream", "x14_model_json"])
def test_oracle_on_odd_texts(spark, tmp_path, name):
    """Empty texts, nulls, white space at the ends, control characters and refusals as answers."""
    spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered_once():
    assert len(entry.queries()) >= 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


def embedded(spark, path):
    """A fixture of 160 vectors whose ids start at 1,000, and its query rows."""
    rng = np.random.default_rng(3)
    v = rng.integers(-4, 5, (160, 6)).astype(float)
    rows = [(1000 + i, [float(x) for x in v[i]], int(i % 3)) for i in range(160)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return v, [i for i in range(160) if (1000 + i) % 50 == 0]


@pytest.mark.parametrize("block", [scoring.BLOCK_QUERIES, 2])
def test_dense_searches_ask_every_50th_vector(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(scoring, "BLOCK_QUERIES", block)
    v, asked = embedded(spark, tmp_path)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    scores = {"r7_dense_ip_topk": (v @ v.T, -1, 10), "r8_dense_l2_topk": (((v[:, None] - v[None]) ** 2).sum(2), 1, 10), "j8_dense_cosine": (unit @ unit.T, -1, 3)}
    best = lambda s, sign, k, q: np.lexsort((np.arange(160), sign * np.round(s[q], 9)))[:k]
    for name, (s, sign, k) in scores.items():
        got = sorted((r["query_id"], r["rank"], r["unique_id"]) for r in entry.queries()[name](spark, str(tmp_path)).collect())
        assert got == [(1000 + q, n + 1, 1000 + e) for q in asked for n, e in enumerate(best(s, sign, k, q))], name
    pairs = [(q % 3, q % 3 == e % 3) for q in asked for e in best(v @ v.T, -1, 6, q) if e != q]
    got = {r["category"]: (r["n"], r["accuracy"]) for r in entry.queries()["a10_accuracy_rollup"](spark, str(tmp_path)).collect()}
    want = {str(c): [ok for y, ok in pairs if y == c] for c in {y for y, _ in pairs}} | {"Average": [ok for _, ok in pairs]}
    assert got == {c: (len(x), round(float(np.mean(x)), 6)) for c, x in want.items()}


def test_overlap_scores_of_long_texts(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(n)) for n in (5, 7, 700, 900)]
    rows = [(i, 2 * t + j, role, x) for i in range(2) for t in range(1) for j, (role, x) in enumerate(zip(("user", "assistant"), texts[2 * i : 2 * i + 2], strict=True))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def lcs(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        return int(table[-1, -1])

    got = {r["conv_id"]: r["rouge_l"] for r in entry.queries()["a12_overlap_scores"](spark, str(tmp_path)).collect()}
    want = {i: round(200 * lcs(a.split(), b.split()) / (len(a.split()) + len(b.split())), 4) for i, (a, b) in enumerate((texts[:2], texts[2:]))}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-3) for i in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_vector_index_recall(spark, tmp_path, metric):
    """Every vector is indexed, and a search finds at least nine tenths of what an exact one does."""
    from millrace.operators import retrieval

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS unique_id", "embedding")
    vector_index.build(e, metric, 10).save(str(tmp_path))
    index = vector_index.load(spark, str(tmp_path))
    assert index.rows.select("unique_id").distinct().count() == index.rows.count() == e.count()
    asked = e.where("unique_id % 50 = 0").withColumnRenamed("unique_id", "query_id")
    pairs = lambda df: {(r["query_id"], r["unique_id"]) for r in df.collect()}
    exact, found = pairs(retrieval.dense(e, asked, 10, metric)), pairs(vector_index.search(index, asked, 10, metric))
    assert len(found) == len(exact) and len(exact & found) >= 0.9 * len(exact)
    assert index.probes <= len(index.centroids)
    print(metric, len(exact & found) / len(exact), index.probes, len(index.centroids))
