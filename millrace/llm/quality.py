"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

1. Words and marks, lower-cased, with their pairs, are hashed into ``buckets``. Two multinomial models are counted, with add-one
   smoothing: target over the labelled good rows (at most ``max_examples`` by id hash, default 20,000, a documented bound) and raw over
   every row of the corpus. Map tasks sum their own counts, so a task hands on at most two numbers a bucket.
2. The log weight of a text is the mean log ratio of its n-grams times ``span``: texts of all lengths are weighed as texts of so many
   n-grams, and the whole text counts. With ``span`` None it is the log ratio of the two models itself, the sum over all n-grams.
   Labels enter the target model only.
3. Sampling without replacement in proportion to the weights: each row gets Gumbel noise from a hash of its id and text and the
   rows of the greatest sums stay, ``keep`` of all. The k-th sum is found by counting digits of its fixed-point form (at most
   65,536 counts a round to the driver), so nothing is sorted as a whole.

A null or empty text has weight 0. Rows that repeat an id and text get equal sums; ties at the edge go to the smaller id (or the smaller
hash of an id that is no integer), and rows that are equal throughout stay or go together (then the sample may be larger by these repeats).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words of which a worker keeps the hash.
HELD_WORDS = 400_000
_held: dict[str, int] = {}


def ngram_buckets(text: str | None, buckets: int) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours."""
    words = TOKEN.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.int64)
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _held.get(w)
        if h is None:
            if len(_held) >= HELD_WORDS:
                _held.clear()
            h = xxhash.xxh64_intdigest(w)
            if len(w) <= 64:
                _held[w] = h
        hashes[i] = h
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[1:]
    pairs ^= pairs >> np.uint64(31)
    return (np.concatenate([hashes, pairs * np.uint64(0xBF58476D1CE4E5B9)]) >> np.uint64(20)).astype(np.int64) % buckets


def _counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """(2, buckets): n-gram counts of all rows and of those with target = true, from docs (text, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                own = [ngram_buckets(t, buckets) for t in part.column(0).to_pylist()]
                total[0] += np.bincount(np.concatenate(own), minlength=buckets)
                if good := [x for x, y in zip(own, part.column(1).to_pylist(), strict=True) if y]:
                    total[1] += np.bincount(np.concatenate(good), minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    summed = docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, buckets), np.int64)
    for r in summed.collect():  # buckets rows at most
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def importance_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = 10_000, span: int | None = 100, seed: int = 0, max_examples: int = 20_000) -> DataFrame:
    """(id, log_weight, gumbel_sum) for each row of docs."""
    spark = docs.sparkSession
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    good = good.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_examples).withColumn("target", F.lit(True))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    raw, target = _counts(texts.join(F.broadcast(good), "id", "left"), buckets)  # max_examples ids
    ratio = spark.sparkContext.broadcast(np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets)) if target.sum() else np.zeros(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for b in batches:
            weights, sums = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = ngram_buckets(t, buckets)
                w = float(table[at].sum() if span is None else table[at].mean() * span) if len(at) else 0.0
                u = (xxhash.xxh64_intdigest(f"{i}\0{t or ''}", seed) + 0.5) / 2**64
                weights.append(w)
                sums.append(w - float(np.log(-np.log(u))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights, pa.float64()), pa.array(sums, pa.float64())], ["id", "log_weight", "gumbel_sum"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_sum", T.DoubleType())])
    return texts.mapInArrow(run, schema)


def top_k(rows: DataFrame, score: str, tie: str, k: int) -> F.Column:
    """A condition that holds for the k rows of greatest score (a double), ties going to the smaller tie; rows: staged.

    Counts by 16 bits of the score, in steps of 2**-40 or as fine as its size allows, in each of four rounds, and of the tie's (a long; null is
    the least) only where the edge has ties.
    """
    if k <= 0:
        return F.lit(False)
    if not isinstance(rows.schema[tie].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        ties = F.when(F.col(tie).isNotNull(), F.xxhash64(F.col(tie).cast("string")))
    else:
        ties = F.col(tie).cast("long")
    size = rows.agg(F.max(F.abs(F.col(score)))).first()[0] or 0.0
    step = 2 ** min(40, 61 - math.frexp(size)[1])

    def edge(rows: DataFrame, key: F.Column, k: int) -> tuple[int, int]:
        """The key (as unsigned, by falling order) of the k-th row, and how many of that key are taken."""
        prefix, left = 0, k
        at = rows.select(key.alias("key"))
        for shift in (48, 32, 16, 0):
            digits = at.groupBy(F.shiftrightunsigned("key", shift).bitwiseAND(0xFFFF).alias("d")).count().collect()
            for r in sorted(digits, key=lambda r: -r["d"]):
                if r["count"] >= left:
                    prefix |= r["d"] << shift
                    at = at.where(F.shiftrightunsigned("key", shift).bitwiseAND(0xFFFF) == r["d"])
                    break
                left -= r["count"]
            else:
                return 0, k  # fewer than k rows
        return prefix, left

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    key = F.round(F.col(score) * float(step)).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    last, taken = edge(rows, key, k)
    above = key.bitwiseXOR(F.lit(-(1 << 63))) > F.lit(signed(last ^ (1 << 63)))
    tied = rows.where(key == F.lit(signed(last)))
    if last == 0 or tied.count() == taken:
        return above | (key == F.lit(signed(last)))
    order = F.bitwise_not(F.coalesce(ties, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63))))
    last_tie, _ = edge(tied, order, taken)
    return above | ((key == F.lit(signed(last))) & (order.bitwiseXOR(F.lit(-(1 << 63))) >= F.lit(signed(last_tie ^ (1 << 63)))))


def resample(docs: DataFrame, labels: DataFrame, keep: float = 0.85, id_col: str = "doc_id", **how: object) -> DataFrame:
    """A row for each row of docs: <id_col>, log_weight, gumbel_sum, kept."""
    rows = stage(importance_weights(docs, labels, id_col, **how), "quality-weights")
    k = round(keep * rows.count())
    return rows.select(F.col("id").alias(id_col), "log_weight", "gumbel_sum", top_k(rows, "gumbel_sum", "id", k).alias("kept"))
