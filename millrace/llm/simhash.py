"""SimHash near-dedup by tiled exact comparison.

1. A 64-bit fingerprint for each row (numpy bit counts over the XXH64 of its word shingles), staged.
2. Equal fingerprints are one class, aggregated map-side first; a group of copies of any size is one row from here on.
3. Classes are range-sorted by population count and cut into tiles. Two tiles are compared only if their population counts come
   within the radius, as two words that differ in r bits differ by at most r in population count; inside a pair of tiles the
   same bound cuts the range of each block. What is left is compared exactly, with exclusive-or and bit counts.
4. A pair of tiles gives a spanning forest of its links, at most one edge a fingerprint, so a large near-copy group gives no
   square of pairs and yet loses no connection. Components are then labelled by distributed star contraction.

Comparisons grow with the square of the number of distinct fingerprints, cut by the population bound; each costs about a
nanosecond. Neither fingerprints nor links reach the driver.

Words are runs without ASCII white space, after lower-casing A-Z. A text with fewer words than a shingle is one shingle; a text
without words has fingerprint zero and links like any other. A null id takes part but never names a component unless it is alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, forget, fresh, met, shuffle_partitions, stage
from .exact_dedup import normalised

#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Comparisons held at once.
CELLS = 1 << 20


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """text: lower-cased already."""
    words = text.split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return _majority(np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, tid) for each row; fp as a signed long, tid a hash of the text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in normalised(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], ["id", "fp", "tid"])
        forget()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), T.StructField("tid", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tid")).mapInArrow(run, schema)


def _settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Lowers labels along the edges (u, v) until both ends of each agree."""
    while True:
        lu, lv = label[u], label[v]
        odd = lu != lv
        if not odd.any():
            return
        u, v, low, high = u[odd], v[odd], np.minimum(lu, lv)[odd], np.maximum(lu, lv)[odd]
        np.minimum.at(label, high, low)  # the roots are hooked
        while True:  # and paths made short
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def tile_forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, fingerprint) that connect what links within radius between a and b (or in a, if b is a).

    a and b: unsigned, ordered by population count.
    """
    nodes = np.concatenate([a, b])
    label = np.arange(len(nodes))
    same = len(a) == len(b) and bool((a == b).all())
    if same:
        label[len(a) :] = np.arange(len(a))
    pa_, pb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    step = max(1, CELLS // max(1, len(b)))
    for i in range(0, len(a), step):
        rows = a[i : i + step]
        lo, hi = np.searchsorted(pb, pa_[i] - radius, "left"), np.searchsorted(pb, pa_[min(i + step, len(a)) - 1] + radius, "right")
        if lo >= hi:
            continue
        near = np.bitwise_count(rows[:, None] ^ b[None, lo:hi]) <= radius
        x, y = np.nonzero(near)
        if len(x):
            _settle(label, x + i, y + lo + len(a))
    own = np.arange(len(nodes))
    out = (label != own) & (nodes != nodes[label])
    if same:
        out[len(a) :] = False
    return nodes[out], nodes[label[out]]


def links(classes: DataFrame, radius: int = 4, tile: int | None = None) -> DataFrame:
    """(a, b): a forest over the distinct fingerprints fp of classes that connects all that link within radius."""
    spark = classes.sparkSession
    parts = shuffle_partitions(spark)
    size = tile or int(min(1 << 16, max(512, classes.count() // 64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64)

        def out(x: np.ndarray) -> pa.RecordBatch:
            p = np.bitwise_count(x)
            return pa.RecordBatch.from_arrays([pa.array([int(p[0])], pa.int32()), pa.array([int(p[-1])], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["lo", "hi", "fps"])

        for b in batches:
            held = np.concatenate([held, b.column(0).to_numpy().view(np.uint64)])
            while len(held) >= size:
                yield out(held[:size])
                held = held[size:]
        if len(held):
            yield out(held)

    ranged = classes.select("fp", F.bit_count("fp").alias("pc")).repartitionByRange(parts, "pc", "fp").sortWithinPartitions("pc", "fp")
    tiles = stage(ranged.select("fp").mapInArrow(cut, "lo int, hi int, fps binary").withColumn("tile", F.monotonically_increasing_id()), "simhash-tiles")
    ranges = tiles.select("tile", "lo", "hi")
    left = ranges.select(F.col("tile").alias("a"), F.explode(F.sequence("lo", "hi")).alias("pc"))
    right = ranges.select(F.col("tile").alias("b"), F.explode(F.sequence(F.col("lo") - radius, F.col("hi") + radius)).alias("pc"))
    pairs = left.join(right, "pc").where("a <= b").select("a", "b").union(right.join(left, "pc").where("b < a").select(F.col("b"), F.col("a"))).distinct()
    both = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                u, v = tile_forest(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return both.select("fa", "fb").repartition(4 * parts).mapInArrow(compare, "a long, b long")


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, seed: int, tile: int | None) -> DataFrame:
    """(fp, id, tid, root, component_id) for each row of docs; root tells components apart, as several may have the same smallest id."""
    rows = stage(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-rows")
    classes = stage(rows.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    roots = connected_components(links(classes, radius, tile))
    labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(labelled.join(least, "root").select("fp", "root", "component_id"), "simhash-named")
    return rows.join(named, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42, tile: int | None = None) -> DataFrame:
    """A row for each row of docs: <id_col>, fingerprint, component_id (the smallest id reachable)."""
    rows = labelled_rows(docs, id_col, text_col, shingle, radius, seed, tile)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row of docs for each component, all columns kept: that of the smallest id, and of several texts with that id the one of the smallest hash.

    Rows that repeat its id and text stay once. A row with a null id stays only where its whole component has no other id.
    """
    rows = stage(labelled_rows(docs, id_col, text_col, shingle, radius, seed, None).groupBy("root", "id", "tid", "component_id").agg(F.count("*").alias("n")), "simhash-texts")
    keeps = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("tid", "id")).alias("keep"))
    judged = stage(rows.join(keeps, "root").withColumn("kept", F.struct("tid", "id").eqNullSafe(F.col("keep"))), "simhash-judged")
    at, tid = fresh(docs, "id", "tid")
    own = {at: F.col(id_col), tid: F.xxhash64(text_col)}
    listed = lambda which: judged.where(which).select(F.col("id").alias(at), F.col("tid").alias(tid))
    out = met(docs, listed("not kept"), own, "left_anti")
    twice = listed("kept and n > 1")
    if twice.isEmpty():
        return out
    return met(out, twice, own, "left_anti").union(met(out, twice, own, "left_semi").dropDuplicates([id_col, text_col]))
