"""What failed on larger tables or odd values: each test would have failed before its finding was mended."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import chunking, metrics, retrieval, scoring, segmentation, vector_index


def test_change_after_zero_is_null(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0), (1, 3, 10.0)], "u int, e int, value double")
    out = metrics.with_previous(rows, ["u"], "e", "value").orderBy("e").collect()
    assert [(r["previous"], r["change_percent"]) for r in out] == [(None, None), (0.0, None), (5.0, 100.0)]


def test_scores_of_common_words_take_bounded_memory():
    """Every row and every query has every word: 8 million products."""
    queries, terms, rows = 80, 50, 2000
    weights = np.random.default_rng(1).random((queries, terms))
    table = pa.table({"query_id": np.repeat(np.arange(queries), terms), "term": [f"w{i % terms}" for i in range(queries * terms)], "weight": weights.ravel()})
    postings, own = scoring.Postings(table), np.random.default_rng(2).random((rows, terms))
    tracemalloc.start()
    scores, there = postings.scores(np.repeat(np.arange(rows), terms), np.tile(np.arange(terms), rows), own.ravel(), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and there.all()
    np.testing.assert_allclose(scores, own @ weights.T)


def test_batches_are_scored_in_slices_of_so_many_words(monkeypatch):
    monkeypatch.setattr(scoring, "WORDS", 10)
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([["a"] * n for n in (4, 6, 1, 30, 0)] + [None, ["b"]], pa.list_(pa.string()))], ["unique_id", "words"])
    assert [p.column(0).to_pylist() for p in scoring.slices(b, 4)] == [[0, 1], [2], [3], [4, 5, 6]]
    assert [p.num_rows for p in scoring.slices(b, 1)] == [1] * 7


def test_generation_cites_a_first_line_of_any_length(spark, tmp_path):
    from millrace.plans import catalogue

    line = "needle " + "x" * 12_000 + "\x0bmore\x85end"
    spark.createDataFrame([(i, f"{line} {i}\nsecond" if i == 3 else f"word {i}") for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "needle")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["response"] for r in catalogue.queries()["r17_generation"](spark, str(tmp_path)).collect()] == [f"{line} 3【1】"]


def test_nearest_centroids_take_bounded_memory():
    rng = np.random.default_rng(3)
    x, c = rng.random((4000, 4)), rng.random((3000, 4))
    tracemalloc.start()
    near = vector_index._nearest(x, c, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    d = ((x[:50, None] - c[None]) ** 2).sum(2)
    assert near[:50, 0].tolist() == d.argmin(1).tolist()
    assert vector_index._nearest(x[:50], c, 7).tolist() == np.argsort(d, axis=1, kind="stable")[:, :7].tolist()


def test_a_vector_is_measured_once_and_not_for_each_element(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None])], "id int, v array<float>")
    out = rows.select("id", retrieval.normalised("v").alias("n"))
    assert [r["n"] for r in out.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None, [], [1.0, None]]
    # the function of an element holds no sum over elements
    assert "aggregate" not in out._jdf.queryExecution().analyzed().toString().split("lambdafunction(CASE")[-1].split("namedlambdavariable() END")[0]


def test_texts_are_worked_on_in_pieces_of_a_batch(spark):
    assert [p.tolist() for p in X.pieces(pd.Series(["ab", None, "cdef", "g" * 9, "h"], dtype=object), 5)] == [["ab", None], ["cdef"], ["ggggggggg"], ["h"]]
    assert list(X.pieces(pd.Series([], dtype=object))) == []
    texts = [f"{i}\n{'y' * 3000} {i}" for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    dictionary = segmentation.Dictionary([("yy", 5), ("y", 1)])
    words = segmentation.segmented(rows, "t", segmentation.Segmenter(dictionary, unspaced="[a-z]")).orderBy("id").collect()
    assert [r["id"] for r in words] == list(range(300)) and all("".join(r["words"]) == texts[r["id"]].replace("\n", "").replace(" ", "") for r in words)
    kids = chunking.semantic_chunks(rows.select("id", F.concat(F.lit("a\n\nb\n\n"), "t").alias("page_content")), group_size=2).select("id", F.array_join("chunks", "").alias("c")).collect()
    assert len(kids) == 300 and all(str(r["id"]) in r["c"] for r in kids)


def test_buckets_of_generation_grow_with_the_table(spark, tmp_path, monkeypatch):
    from millrace.operators import generation
    from millrace.plans import models as plans

    spark.range(95).select(F.col("id").alias("doc_id"), F.lit("A").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    asked = []
    monkeypatch.setattr(plans, "BUCKET_ROWS", 5, raising=False)
    monkeypatch.setattr(generation, "generated", lambda todo, text, ask, path, pool=None, buckets=200: asked.append(buckets) or todo.withColumn("raw_resp", F.col(text)))
    assert plans.pooled(spark, str(tmp_path)).count() == 95 and asked == [19, 19]


def test_only_rare_terms_are_shuffled_for_norms(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "b", "c"]), (2, ["a"]), (3, None), (4, ["c", None, "c", "d"])], "unique_id long, words array<string>")
    sent = spark.sparkContext.broadcast((pa.array(["a", "c"]), None))
    assert sorted(tuple(r) for r in retrieval.rare_counts(docs, sent).collect()) == [(1, "b", 2), (4, "d", 1)]
