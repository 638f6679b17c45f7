"""An inverted-file index over vectors: lists around centroids, built, saved, loaded and searched.

The centroids are fitted on a bounded sample (SAMPLE_A_LIST vectors a list, those of least id hash); every vector is put in the list of its
nearest centroid. A search reads the lists nearest to each query. How many, is chosen when the index is built: as few as reach the wanted
recall on a bounded sample of its own vectors, measured against an exact search of that sample's neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scoring
from .retrieval import top_k

#: Sampled vectors for each list, and the most of them.
SAMPLE_A_LIST, MOST_SAMPLED = 64, 200_000
#: Lists at most; their centroids go to every task.
MOST_LISTS = 4096
#: Vectors whose neighbours are searched exactly to choose how many lists a search reads.
TRIALS = 64


@dataclass
class VectorIndex:
    """rows: unique_id, embedding, list; centroids: lists x dimensions; probes: lists that a search reads."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int

    def save(self, path: str) -> None:
        """Rows by list, so that a search reads only the lists it asks for."""
        spark = self.rows.sparkSession
        self.rows.repartitionByRange("list").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/rows")
        own = [(i, [float(x) for x in c], self.probes) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(own, "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> VectorIndex:
    own = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
    return VectorIndex(spark.read.parquet(f"{path}/rows"), np.array([r["centroid"] for r in own]), own[0]["probes"] if own else 1)


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first; scoring.CELLS distances are held at once."""
    out, squares = np.empty((len(x), min(n, len(centroids))), np.int64), (centroids * centroids).sum(1)[None]
    step = max(1, scoring.CELLS // max(1, len(centroids)))
    for i in range(0, len(x), step):
        d = squares - 2 * x[i : i + step] @ centroids.T
        out[i : i + step] = d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def fitted(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; an empty list takes the row farthest from its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, centroids, 1)[:, 0]
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        far = np.argsort(-((x - centroids[own]) ** 2).sum(1), kind="stable")
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], 0.0)
        for i, j in zip(np.flatnonzero(count == 0).tolist(), far.tolist(), strict=False):
            centroids[i] = x[j]
    return centroids


def build(vectors: DataFrame, metric: str = "ip", k: int = 10, recall: float = 0.95, lists: int | None = None) -> VectorIndex:
    """vectors: (unique_id, embedding); null vectors, and those with nulls in them, are not in the index."""
    own = scoring.whole(vectors.select("unique_id", "embedding"))
    n = own.count()
    lists = lists or max(1, min(MOST_LISTS, round(n**0.5 / 2)))
    sample = own.orderBy(F.xxhash64(F.col("unique_id").cast("string"))).limit(min(MOST_SAMPLED, lists * SAMPLE_A_LIST)).toArrow()
    x = scoring.matrix(sample["embedding"].combine_chunks())
    if not len(x):
        return VectorIndex(own.withColumn("list", F.lit(0)), np.zeros((0, 0)), 1)
    centroids = fitted(x, min(lists, len(x)))
    sent = own.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):  # noqa: ANN001, ANN202
        for b in batches:
            v = scoring.matrix(b.column(1), sent.value.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_nearest(v, sent.value, 1)[:, 0].astype(np.int32))], ["unique_id", "embedding", "list"])

    rows = own.mapInArrow(assign, T.StructType([*own.schema, T.StructField("list", T.IntegerType())]))
    index = VectorIndex(rows, centroids, len(centroids))
    trials = own.sparkSession.createDataFrame(sample.slice(0, TRIALS).select(["unique_id", "embedding"]), own.schema)
    exact = top_k(scoring.nearest_vectors(own, trials.withColumnRenamed("unique_id", "query_id"), k, metric), k)
    found = exact.join(rows.select("unique_id", "list"), "unique_id").select("query_id", "list").collect()  # TRIALS * k rows
    place = {q: {c: i for i, c in enumerate(r)} for q, r in zip(sample["unique_id"].to_pylist()[:TRIALS], _nearest(x[:TRIALS], centroids, len(centroids)).tolist(), strict=True)}
    needed = sorted(place[r["query_id"]][r["list"]] for r in found)
    index.probes = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1 if needed else 1
    return index


def search(index: VectorIndex, queries: DataFrame, k: int, metric: str = "ip", probes: int | None = None) -> DataFrame:
    """RANKED rows of the k nearest in the lists read; queries: (query_id, embedding). The vectors stay where they stand, and a task scores
    those of a list only against the queries that read it."""
    probes = probes or index.probes
    if not len(index.centroids):
        return top_k(scoring.nearest_vectors(index.rows, queries, k, metric), k)
    queries, dims = scoring.whole(queries.select("query_id", "embedding")), index.centroids.shape[1]

    def block(own: DataFrame) -> DataFrame:
        asked = own.toArrow()
        wanted = scoring.matrix(asked["embedding"].combine_chunks(), dims)
        reads = reading(wanted, index.centroids, probes)

        def make() -> scoring.Score:
            def score(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
                x, lists = scoring.matrix(b.column(1), dims), b.column(2).to_numpy()
                scores, there = np.zeros((len(x), len(wanted))), reads[lists]
                for i in np.unique(lists):
                    rows, asking = np.flatnonzero(lists == i), np.flatnonzero(reads[i])
                    inner = x[rows] @ wanted[asking].T
                    if metric == "l2":
                        inner = np.maximum((x[rows] ** 2).sum(1)[:, None] + (wanted[asking] ** 2).sum(1)[None] - 2 * inner, 0.0)
                    scores[np.ix_(rows, asking)] = inner
                return scores, there

            return score

        rows = index.rows.where(F.col("list").isin(np.flatnonzero(reads.any(1)).tolist()))
        return scoring.best_rows(rows.select("unique_id", "embedding", "list"), asked["query_id"].combine_chunks(), k, make, metric == "l2")

    return top_k(scoring.by_block(queries, dims * queries.count(), block), k, ascending=metric == "l2")


def reading(queries: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """By list and query: whether the query reads the list."""
    reads = np.zeros((len(centroids), len(queries)), bool)
    reads[_nearest(queries, centroids, probes), np.arange(len(queries))[:, None]] = True
    return reads
