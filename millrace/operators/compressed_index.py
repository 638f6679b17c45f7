"""Vectors as short codes: product quantisation over an inverted file, searched by table look-ups and ranked again exactly.

A vector lies in the list of its nearest centroid. What is left of it there is cut into subspaces, and each part becomes the number of the
nearest of CODES part vectors: a byte. The books of part vectors are fitted on a bounded sample of residuals. A search adds up, for each vector
of the lists it reads, entries of a table of inner products between the query's parts and the books; of the best candidates the whole
vectors are read and compared exactly. Distances come from inner products and a stored norm, so the same codes serve both metrics.

How many lists are read and how many candidates compared, is chosen when the index is built, from exact neighbours of a bounded sample.
Vectors are appended with the books as they are. Null vectors are not in the index; those of another length are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scoring
from .retrieval import dot, squared_distance, top_k
from .vector_index import MOST_LISTS, TRIALS, fitted, _nearest, reading

CODES = 256
#: Vectors that lists and books are fitted on, those of least id hash.
MOST_SAMPLED = 20_000
#: Rounds of fitting a book.
ROUNDS = 8


@dataclass
class CompressedIndex:
    """A saved index: lists' centroids, a book of CODES part vectors for each subspace, and how much a search reads."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    books: list[np.ndarray]
    metric: str
    probes: int
    candidates: int

    @property
    def codes(self) -> DataFrame:
        """unique_id, code, norm, list"""
        return self.spark.read.parquet(f"{self.path}/codes")

    @property
    def vectors(self) -> DataFrame:
        """unique_id, embedding, list"""
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def cuts(self) -> np.ndarray:
        """Where subspaces end."""
        return np.cumsum([b.shape[1] for b in self.books])

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of vectors."""
        lists = _nearest(x, self.centroids, 1)[:, 0]
        parts = np.split(x - self.centroids[lists], self.cuts[:-1], axis=1)
        return lists, np.stack([_nearest(p, b, 1)[:, 0] for p, b in zip(parts, self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products by query, subspace and code."""
        parts = np.split(queries, self.cuts[:-1], axis=1)
        return np.stack([p @ b.T for p, b in zip(parts, self.books, strict=True)], 1)

    def inner(self, table: np.ndarray, at_centroid: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """About the inner products of coded vectors of one list (rows) with queries (columns)."""
        out = np.repeat(at_centroid[None], len(codes), 0)
        for j in range(codes.shape[1]):
            out += table[:, j].T[codes[:, j]]
        return out


def _written(index: CompressedIndex, vectors: DataFrame) -> None:
    sent = index.spark.sparkContext.broadcast((index.centroids, index.books))
    plain = CompressedIndex(None, "", index.centroids[:0], [], index.metric, 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain.centroids, plain.books = sent.value
        for b in batches:
            x = scoring.matrix(b.column(1), plain.centroids.shape[1])
            lists, codes = plain.encoded(x)
            binary = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, binary, pa.array((x * x).sum(1).astype(np.float32)), pa.array(lists.astype(np.int32))], ["unique_id", "embedding", "code", "norm", "list"])

    own = vectors.mapInArrow(run, T.StructType([*vectors.schema, *T._parse_datatype_string("code binary, norm float, list int").fields]))
    whole = own.repartitionByRange("list", F.xxhash64(F.col("unique_id").cast("string"))).sortWithinPartitions("list", "unique_id")
    whole.select("unique_id", "embedding", "list").write.mode("append").parquet(f"{index.path}/vectors")
    whole.select("unique_id", "code", "norm", "list").write.mode("append").parquet(f"{index.path}/codes")


def _saved(index: CompressedIndex) -> None:
    parts = [("centroid", i, [float(v) for v in c]) for i, c in enumerate(index.centroids)]
    parts += [(f"book {j}", i, [float(v) for v in row]) for j, b in enumerate(index.books) for i, row in enumerate(b)]
    parts.append((f"{index.metric} search", 0, [float(index.probes), float(index.candidates)]))
    index.spark.createDataFrame(parts, "part string, number int, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/model")


def opened(spark: SparkSession, path: str) -> CompressedIndex:
    parts: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/model").orderBy("part", "number").collect():  # MOST_LISTS centroids and CODES rows a subspace at most
        parts.setdefault(r["part"], []).append(r["value"])
    metric, (probes, candidates) = next((p.split()[0], v[0]) for p, v in parts.items() if p.endswith(" search"))
    books = [np.array(parts[f"book {j}"]) for j in range(sum(p.startswith("book ") for p in parts))]
    return CompressedIndex(spark, path, np.array(parts.get("centroid", np.zeros((0, 0)))), books, metric, int(probes), int(candidates))


def build(vectors: DataFrame, path: str, metric: str = "ip", k: int = 10, recall: float = 0.97, lists: int | None = None, subspaces: int | None = None) -> CompressedIndex:
    """A new index over vectors (unique_id, embedding) at path. subspaces: bytes of a code, half the dimensions by default.

    recall: what searches for k neighbours shall find, of which probes and candidates each take a part.
    """
    spark = vectors.sparkSession
    own = scoring.whole(vectors.select("unique_id", "embedding"))
    n = own.count()
    sample = own.orderBy(F.xxhash64(F.col("unique_id").cast("string")), "unique_id").limit(MOST_SAMPLED).toArrow()
    x = scoring.matrix(sample["embedding"].combine_chunks())
    if not len(x):
        index = CompressedIndex(spark, path, np.zeros((0, 0)), [], metric, 1, k)
        own.withColumn("list", F.lit(0)).write.mode("overwrite").parquet(f"{path}/vectors")
        _saved(index)
        return index
    centroids = fitted(x, min(lists or max(1, min(MOST_LISTS, round(n**0.5 / 2))), len(x)))
    residuals = x - centroids[_nearest(x, centroids, 1)[:, 0]]
    books = [fitted(p, min(CODES, len(x)), ROUNDS) for p in np.array_split(residuals, subspaces or -(-x.shape[1] // 2), axis=1)]
    index = CompressedIndex(spark, path, centroids, books, metric, len(centroids), 8 * k)
    _written(index, own)
    trials = spark.createDataFrame(sample.slice(0, TRIALS), own.schema).withColumnRenamed("unique_id", "query_id")
    exact = top_k(scoring.nearest_vectors(own, trials, k, metric), k, metric == "l2").select("query_id", "unique_id")
    coded = candidates(index, trials).select("query_id", "unique_id", F.col("rank").alias("place"))
    found = exact.join(index.codes.select("unique_id", "list"), "unique_id").join(coded, ["query_id", "unique_id"], "left").collect()  # TRIALS * k rows
    place = {q: {c: i for i, c in enumerate(r)} for q, r in zip(sample["unique_id"].to_pylist()[:TRIALS], _nearest(x[:TRIALS], centroids, len(centroids)).tolist(), strict=True)}
    share = 1 - (1 - recall) / 2
    enough = lambda needed: sorted(needed)[min(len(needed) - 1, int(np.ceil(share * len(needed))))] + 1
    index.probes = enough([place[r["query_id"]][r["list"]] for r in found])
    index.candidates = min(8 * k, max(2 * k, enough([r["place"] if r["place"] is not None else 8 * k for r in found])))
    _saved(index)
    return index


def append(index: CompressedIndex, vectors: DataFrame) -> None:
    """More vectors, with the lists and books as they are. Ids that are there already are there twice."""
    if not len(index.centroids):
        raise ValueError("an index that was built without vectors has no books; build it anew")
    _written(index, scoring.whole(vectors.select("unique_id", "embedding")))


def candidates(index: CompressedIndex, queries: DataFrame) -> DataFrame:
    """RANKED rows by coded scores: index.candidates a query, from the lists that it reads."""
    dims, metric = index.centroids.shape[1], index.metric
    centroids, books = index.centroids, index.books

    def block(own: DataFrame) -> DataFrame:
        asked = own.toArrow()
        wanted = scoring.matrix(asked["embedding"].combine_chunks(), dims)
        reads = reading(wanted, centroids, index.probes)
        sent = index.spark.sparkContext.broadcast((centroids, books, wanted, reads))

        def make() -> scoring.Score:
            centroids, books, wanted, reads = sent.value
            plain = CompressedIndex(None, "", centroids, books, metric, 0, 0)
            tables, squares = plain.tables(wanted).astype(np.float32), (wanted * wanted).sum(1)
            at_centroids = (centroids @ wanted.T).astype(np.float32)

            def score(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                norms, lists = b.column(2).to_numpy(), b.column(3).to_numpy()
                scores, there = np.zeros((b.num_rows, len(wanted)), np.float64), reads[lists]
                for i in np.unique(lists):
                    rows, asking = np.flatnonzero(lists == i), np.flatnonzero(reads[i])
                    inner = plain.inner(tables[asking], at_centroids[i, asking], codes[rows])
                    scores[np.ix_(rows, asking)] = inner if metric == "ip" else np.maximum(norms[rows, None] + squares[asking] - 2 * inner, 0)
                return scores, there

            return score

        rows = index.codes.where(F.col("list").isin(np.flatnonzero(reads.any(1)).tolist()))
        return scoring.best_rows(rows.select("unique_id", "code", "norm", "list"), asked["query_id"].combine_chunks(), index.candidates, make, metric == "l2")

    queries = scoring.whole(queries.select("query_id", "embedding"))
    return top_k(scoring.by_block(queries, dims * queries.count(), block), index.candidates, ascending=metric == "l2")


def search(index: CompressedIndex, queries: DataFrame, k: int) -> DataFrame:
    """RANKED rows (query_id, unique_id, score, rank) of queries (query_id, embedding), with exact scores."""
    if not len(index.centroids):
        return top_k(scoring.nearest_vectors(index.vectors, queries, k, index.metric), k)
    near = candidates(index, queries).select("query_id", "unique_id")
    both = index.vectors.select("unique_id", "embedding").join(near, "unique_id").join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")
    score = dot("embedding", "asked") if index.metric == "ip" else squared_distance("embedding", "asked")
    return top_k(both.select("query_id", "unique_id", score.alias("score")), k, ascending=index.metric == "l2")


def bytes_read(index: CompressedIndex, queries: DataFrame) -> DataFrame:
    """(query_id, coded, whole, exact): bytes of codes and norms in the lists a query reads, of the vectors it compares whole, and of all vectors."""
    dims, width = index.centroids.shape[1], len(index.books) + 4
    sizes = {r["list"]: r["n"] for r in index.codes.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    own, total = np.array([sizes.get(i, 0) for i in range(len(index.centroids))]), sum(sizes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reads = reading(scoring.matrix(b.column(1), dims), index_centroids, probes)
            coded = (own[:, None] * reads).sum(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coded * width), pa.array(np.minimum(most, coded) * 4 * dims), pa.array(np.full(b.num_rows, total * 4 * dims))], ["query_id", "coded", "whole", "exact"])

    index_centroids, probes, most = index.centroids, index.probes, index.candidates
    queries = scoring.whole(queries.select("query_id", "embedding"))
    return queries.mapInArrow(run, T.StructType([queries.schema["query_id"], *T._parse_datatype_string("coded long, whole long, exact long").fields]))
