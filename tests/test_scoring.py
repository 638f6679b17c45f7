"""Searches that leave the corpus where it is, against plain scoring of all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.operators import retrieval, scoring

WORDS = [f"w{i}" for i in range(30)] + ["é", "中"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    # words of falling frequency, one that every text and query has, ties and empty texts
    draw = lambda n: ["the"] + [WORDS[min(int(rng.expovariate(0.2)), len(WORDS) - 1)] for _ in range(n)]
    docs = [(f"d{i:03}", draw(rng.randint(0, 30)) if i % 9 else []) for i in range(90)]
    return docs + [("e1", docs[1][1]), ("e2", docs[1][1])], [(i, draw(rng.randint(0, 6)) + ["unknown"] * (i % 2)) for i in range(11)]


def frames(spark, texts):
    docs, queries = texts
    return spark.createDataFrame(docs, "unique_id string, words array<string>").repartition(3), spark.createDataFrame(queries, "query_id int, words array<string>")


def ranked(scores, k):
    """scores: (query, id) -> score"""
    out = []
    for q in sorted({q for q, _ in scores}):
        own = sorted((-round(s, 9), d) for (p, d), s in scores.items() if p == q)[:k]
        out += [(q, d, n + 1) for n, (_, d) in enumerate(own)]
    return sorted(out)


def plain(texts):
    docs, queries = texts
    n, df = len(docs), Counter(w for _, d in docs for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    smooth = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    avg = sum(len(d) for _, d in docs) / n
    unit = lambda ws: (lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()})({w: c * smooth[w] for w, c in Counter(ws).items() if w in smooth})
    top = lambda ws, dims: dict(sorted(((w, math.log1p(c)) for w, c in Counter(ws).items()), key=lambda x: (-x[1], x[0]))[:dims])
    bm, cos, dot = {}, {}, {}
    for q, qs in queries:
        for d, ds in docs:
            if common := set(qs) & set(ds):
                tf, times = Counter(ds), Counter(qs)
                bm[q, d] = sum(times[w] * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (1 - 0.75 + 0.75 * len(ds) / avg)) for w in common)
                a, b = unit(qs), unit(ds)
                cos[q, d] = sum(a[w] * b[w] for w in common)
                a, b = top(qs, 3), top(ds, 3)
                if set(a) & set(b):
                    dot[q, d] = sum(a[w] * b[w] for w in set(a) & set(b))
    return bm, cos, dot


@pytest.mark.parametrize("small", [False, True])
def test_lexical_searches(spark, texts, monkeypatch, small):
    if small:
        monkeypatch.setattr(scoring, "BLOCK_QUERIES", 4)
        monkeypatch.setattr(scoring, "CELLS", 50)
        monkeypatch.setattr(scoring, "HELD", 10)
        monkeypatch.setattr(retrieval, "FREQUENT_TERMS", 7)
    docs, queries = frames(spark, texts)
    index = retrieval.LexicalIndex(docs)
    got = lambda df: sorted((r["query_id"], r["unique_id"], r["rank"]) for r in df.collect())
    bm, cos, dot = plain(texts)
    assert got(retrieval.bm25(index, queries, 7)) == ranked(bm, 7)
    assert got(retrieval.tfidf(index, queries, 7)) == ranked(cos, 7)
    assert got(retrieval.sparse_texts(docs, queries, 7, 3)) == ranked(dot, 7)
    rows = retrieval.sparse(retrieval.sparse_vectors(docs, "unique_id", docs["words"], 3), retrieval.sparse_vectors(queries, "query_id", queries["words"], 3), 7)
    assert got(rows) == ranked(dot, 7)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_vectors(spark, monkeypatch, metric):
    monkeypatch.setattr(scoring, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(scoring, "HELD", 20)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (70, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "unique_id long, embedding array<float>").repartition(4)
    q = df.where("unique_id % 10 = 0").withColumnRenamed("unique_id", "query_id")
    got = sorted((r["query_id"], r["unique_id"], r["rank"]) for r in retrieval.dense(df, q, 6, metric).collect())
    scores = {(int(a), b): -float(v[a] @ v[b]) if metric == "ip" else float(((v[a] - v[b]) ** 2).sum()) for a in range(0, 70, 10) for b in range(70)}
    want = []
    for a in range(0, 70, 10):
        want += [(a, b, n + 1) for n, (_, b) in enumerate(sorted((scores[a, b], b) for b in range(70))[:6])]
    assert got == sorted(want)
    assert retrieval.dense(df, q.limit(0), 6, metric).count() == 0 and retrieval.dense(df.limit(0), q, 6, metric).count() == 0
