"""Saved indexes against full searches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import compressed_index, lexical_store, retrieval, scoring
from millrace.sources import sinks

SF = "/root/testdata/sf0.1"


def corpus(spark, n, seed, first=0):
    """Words of a skewed vocabulary; some texts are empty or null."""
    rng = np.random.default_rng(seed)
    words = lambda m: [f"w{int(x)}" for x in rng.zipf(1.4, m) % 300]
    rows = [(first + i, None if i % 41 == 7 else words(int(rng.integers(0, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "unique_id long, words array<string>").repartition(3)


def asked(spark, seed=9):
    rng = np.random.default_rng(seed)
    rows = [(q, [f"w{int(x)}" for x in rng.integers(1, 40, int(rng.integers(0, 8)))]) for q in range(25)] + [(99, ["unknown"]), (100, None)]
    return spark.createDataFrame(rows, "query_id long, words array<string>")


def plain(docs):
    """A null list of words as an empty one, as the store has it."""
    return retrieval.LexicalIndex(docs.select("unique_id", F.coalesce("words", F.array().cast("array<string>")).alias("words")))


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["unique_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize(("shard", "seeds", "block"), [(8192, 64, 2000), (50, 3, 2000), (40, 64, 7)])
def test_lexical_searches_equal_full_ones(spark, tmp_path, monkeypatch, shard, seeds, block):
    monkeypatch.setattr(lexical_store, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_store, "RANGE", 8)
    monkeypatch.setattr(lexical_store, "SEED_SHARDS", seeds)
    monkeypatch.setattr(lexical_store, "BUCKET_POSTINGS", 900)
    monkeypatch.setattr(scoring, "BLOCK_QUERIES", block)
    docs, more, queries = corpus(spark, 400, 1), corpus(spark, 90, 2, 1000), asked(spark)
    store = lexical_store.build_texts(docs, str(tmp_path / "texts"))
    assert ranked(lexical_store.search(store, queries, 5)) == ranked(retrieval.bm25(plain(docs), queries, 5))
    store = lexical_store.append_texts(lexical_store.opened(spark, str(tmp_path / "texts")), more)
    both = docs.union(more)
    want = ranked(retrieval.bm25(plain(both), queries, 5))
    assert ranked(lexical_store.search(lexical_store.opened(spark, str(tmp_path / "texts")), queries, 5)) == want
    read = lexical_store.skips(store, queries, 5).agg(F.sum("ranges"), F.sum("scored")).first()
    assert 0 < read[1] < read[0]
    vectors = retrieval.sparse_vectors(both, "unique_id", F.col("words"), 20)
    weights = retrieval.sparse_vectors(queries, "query_id", F.col("words"), 20)
    own = lexical_store.build_vectors(vectors, str(tmp_path / "vectors"))
    assert ranked(lexical_store.search(own, weights, 5, lexical_store.InnerProduct())) == ranked(retrieval.sparse(vectors, weights, 5))


def test_lexical_search_reads_its_terms_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_store, "BUCKET_POSTINGS", 500)
    store = lexical_store.build_texts(corpus(spark, 300, 1), str(tmp_path))
    terms = spark.createDataFrame([("w3",), ("w17",), ("none",)], "term string")
    rows = store.of_terms("postings", terms)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan
    assert {r["term"] for r in rows.select("term").distinct().collect()} == {"w3", "w17"}
    want = sorted(map(tuple, store.frequencies(terms).collect()))
    monkeypatch.setattr(lexical_store, "FILTER_TERMS", 1)
    assert sorted(map(tuple, store.frequencies(terms).collect())) == want


def test_lexical_store_without_rows(spark, tmp_path):
    store = lexical_store.build_texts(corpus(spark, 0, 1), str(tmp_path))
    assert lexical_store.search(store, asked(spark), 5).count() == 0
    lexical_store.append_texts(store, corpus(spark, 30, 1))
    again = lexical_store.opened(spark, str(tmp_path))
    assert again.totals["n_docs"] == 30
    assert ranked(lexical_store.search(again, asked(spark), 5)) == ranked(retrieval.bm25(plain(corpus(spark, 30, 1)), asked(spark), 5))


def vectors(spark, n, seed=4, dims=16, first=0):
    rng = np.random.default_rng(seed)
    rows = [(first + i, [float(x) for x in rng.normal(size=dims).round(3)]) for i in range(n)]
    return spark.createDataFrame([*rows, (first + n, None), (first + n + 1, [None] * dims)], "unique_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_codes_and_tables(spark, tmp_path, metric):
    """Coded scores are those of the vectors that the codes stand for, and every vector is in the index, appended ones too."""
    index = compressed_index.build(vectors(spark, 300), str(tmp_path), metric, 5, lists=4, subspaces=5)
    compressed_index.append(index, vectors(spark, 40, 5, first=1000))
    index = compressed_index.opened(spark, str(tmp_path))
    assert index.metric == metric and [b.shape[1] for b in index.books] == [4, 3, 3, 3, 3]
    x = np.random.default_rng(1).normal(size=(30, 16))
    lists, codes = index.encoded(x)
    stood = index.centroids[lists] + np.concatenate([b[codes[:, j]] for j, b in enumerate(index.books)], 1)
    q = np.random.default_rng(2).normal(size=(3, 16))
    for i in range(30):
        assert np.allclose(index.inner(index.tables(q), index.centroids[lists[i]] @ q.T, codes[i : i + 1])[0], stood[i] @ q.T)
    assert index.codes.count() == index.codes.select("unique_id").distinct().count() == 340 == index.vectors.count()
    index.probes, index.candidates = 4, 340
    queries = vectors(spark, 6, 8).withColumnRenamed("unique_id", "query_id")
    whole = vectors(spark, 300).union(vectors(spark, 40, 5, first=1000))
    assert ranked(compressed_index.search(index, queries, 5)) == ranked(retrieval.dense(whole, queries, 5, metric))


def test_compressed_index_without_rows(spark, tmp_path):
    index = compressed_index.build(vectors(spark, 5).limit(0), str(tmp_path))
    queries = vectors(spark, 3).withColumnRenamed("unique_id", "query_id")
    assert compressed_index.search(compressed_index.opened(spark, str(tmp_path)), queries, 5).count() == 0
    with pytest.raises(ValueError):
        compressed_index.append(index, vectors(spark, 3))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_compressed_recall(spark, tmp_path, metric):
    """Nine in ten neighbours are found with under a fifth of the bytes."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS unique_id", "embedding")
    index = compressed_index.build(e, str(tmp_path), metric)
    queries = e.where("unique_id % 50 = 0").withColumnRenamed("unique_id", "query_id")
    pairs = lambda df: {(r["query_id"], r["unique_id"]) for r in df.collect()}
    exact, found = pairs(retrieval.dense(e, queries, 10, metric)), pairs(compressed_index.search(index, queries, 10))
    read = compressed_index.bytes_read(index, queries).agg(F.sum(F.col("coded") + F.col("whole")) / F.sum("exact")).first()[0]
    print(metric, len(exact & found) / len(exact), read, index.probes, len(index.centroids), index.candidates)
    assert len(exact & found) >= 0.95 * len(exact) and read < 0.2


def test_null_and_ragged_vectors(spark):
    v = vectors(spark, 20)
    q = vectors(spark, 4, 6).withColumnRenamed("unique_id", "query_id")
    got = retrieval.dense(v, q, 3).collect()
    assert {r["query_id"] for r in got} == set(range(4)) and all(r["unique_id"] < 20 for r in got) and len(got) == 12
    ragged = v.union(spark.createDataFrame([(50, [1.0, 2.0])], "unique_id long, embedding array<float>"))
    with pytest.raises(Exception, match="dimensions"):
        retrieval.dense(ragged, q, 3).collect()
    assert retrieval.dense(v, q.limit(0), 3).count() == 0 == retrieval.dense(v.limit(0), q, 3).count()


def test_many_query_blocks(spark, monkeypatch):
    """Blocks run one after the other give what one does."""
    v = vectors(spark, 60)
    q = v.withColumnRenamed("unique_id", "query_id")
    want = ranked(retrieval.dense(v, q, 3))
    monkeypatch.setattr(scoring, "BLOCK_QUERIES", 7)
    assert ranked(retrieval.dense(v, q, 3)) == want


def test_lexical_build_reads_its_source_once(spark, tmp_path):
    """Neither the words nor the lists are worked out again for the counts, the ranges' bounds or the table of documents."""
    seen = spark.sparkContext.accumulator(0)
    docs = corpus(spark, 200, 1)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    store = lexical_store.build_texts(docs.mapInArrow(counted, docs.schema), str(tmp_path / "texts"))
    assert store.totals["n_docs"] == 200 and seen.value == 200


def test_sparse_vectors_in_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_store, "SHARD_DOCS", 50)
    docs, queries = corpus(spark, 200, 3), asked(spark)
    pairs = retrieval.sparse_rows(docs, 6).select("unique_id", F.explode(F.arrays_zip("terms", "weights")).alias("t"))
    want = retrieval.sparse_vectors(docs, "unique_id", F.col("words"), 6)
    of = lambda df: sorted((r[0], r[1], round(r[2], 12)) for r in df.collect())
    assert of(pairs.select("unique_id", "t.terms", "t.weights")) == of(want.select("unique_id", "term", "weight"))
    weights = retrieval.sparse_vectors(queries, "query_id", F.col("words"))
    store = lexical_store.build_vector_rows(retrieval.sparse_rows(docs, 6), str(tmp_path))
    assert ranked(lexical_store.search(store, weights, 5, lexical_store.InnerProduct())) == ranked(retrieval.sparse(want, weights, 5))


def test_lexical_tables_read_their_source_once(spark, tmp_path):
    """The words are counted once for postings, frequencies and lengths."""
    seen = spark.sparkContext.accumulator(0)
    docs = corpus(spark, 300, 4)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    sinks.lexical(retrieval.LexicalIndex(docs.mapInArrow(counted, docs.schema)), str(tmp_path))
    assert seen.value == 300
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    want = docs.select("unique_id", F.explode("words").alias("term")).groupBy("unique_id", "term").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, read("postings").select("unique_id", "term", "tf").collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, read("frequencies").collect())) == sorted(map(tuple, want.groupBy("term").count().collect()))
    assert dict(map(tuple, read("lengths").collect())) == {r["unique_id"]: None if r["words"] is None else len(r["words"]) for r in docs.collect()}
