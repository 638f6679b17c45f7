"""Benchmark decontamination by a prefix-filtered set join.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Each item gives its windows (``window`` words; an
item of fewer words is one window) and each window its shingles of ``shingle`` words (fewer if the window is shorter).

1. One pass over the documents keeps, of each text, the maximal runs of positions whose shingles occur in the benchmark and that are
   long enough for a window (the length bound). Only these passages, and the word count of every row, are staged.
2. Shingles are ordered by rarity: how often they occur in the runs of all documents. As a window must be contained whole, its
   necessary prefix is one shingle, the rarest; only that one is joined.
3. A match at offset o of the window and place p of the run must satisfy 0 <= p - o and p - o + length <= the run's words (the positional
   bound); then all words are compared.
4. Covered words are the union of the hit intervals of a row.

The benchmark's shingles are sent to the workers in blocks of a fixed size; a larger benchmark takes more passes over the
documents, not more memory; there, a row's key is a 128-bit hash of its id and text. A null text has no words. An item with a null id can be hit but is not counted among items.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held, met, stage

#: Windows of a benchmark block: what is broadcast at once is under 100 bytes a window.
BLOCK_WINDOWS = 200_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def item_windows(benchmark: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(item, n, k, words): a row for each window; k: the words of its shingles, words: joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, sizes = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                w = words_of(t)
                n = min(window, len(w))
                for j in range(len(w) - n + 1 if n else 0):
                    at.append(i)
                    texts.append(b" ".join(w[j : j + n]).decode())
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(sizes, pa.int32()), pa.array([min(n, shingle) for n in sizes], pa.int32()), pa.array(texts, pa.string())], ["item", "n", "k", "words"])

    schema = T.StructType([T.StructField("item", benchmark.schema[id_col].dataType), T.StructField("n", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("words", T.StringType())])
    return benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _index(shingles: list[str]) -> tuple[dict[bytes, int], dict[int, np.ndarray]]:
    """Word numbers (from 1) and, by words of a shingle, the sorted codes of the shingles."""
    number: dict[bytes, int] = {}
    codes: dict[int, list[list[int]]] = {}
    for s in shingles:
        ids = [number.setdefault(w, len(number) + 1) for w in s.encode().split(b" ")]
        codes.setdefault(len(ids), []).append(ids)
    return number, {k: np.unique(_coded(np.array(v, np.uint64).T)) for k, v in codes.items()}


def _coded(columns: np.ndarray | list[np.ndarray]) -> np.ndarray:
    code = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        code = (code ^ c) * _MIX
        code ^= code >> np.uint64(29)
    return code


def runs_of(words: list[bytes], number: dict[bytes, int], codes: dict[int, np.ndarray], need: dict[int, int]) -> list[tuple[int, int, str]]:
    """(first word, k, words joined by a space) of the maximal runs; need: by k, the least shingles in a row."""
    ids = np.fromiter((number.get(w, 0) for w in words), np.uint64, len(words))
    found = []
    for k, wanted in codes.items():
        m = len(ids) - k + 1
        if m < need[k]:
            continue
        known = ids[:m] > 0
        for j in range(1, k):
            known &= ids[j : m + j] > 0
        at = np.flatnonzero(known)
        if not len(at):
            continue
        code = _coded([ids[at + j] for j in range(k)])
        at = at[wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code]
        if not len(at):
            continue
        cut = np.flatnonzero(np.diff(at) > 1)
        for lo, hi in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist(), strict=True):
            if hi - lo + 1 >= need[k]:
                found.append((lo, k, b" ".join(words[lo : hi + k]).decode()))
    return found


def _scan(texts: DataFrame, shingles: list[str], need: dict[int, int]) -> DataFrame:
    """(rid, id, n_words, runs) for each row of texts (id, text[, rid]); rid, if it isn't given, numbers the rows once they are staged."""
    sent, key = texts.sparkSession.sparkContext.broadcast(shingles), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, codes = held(key, lambda: _index(sent.value))
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("k", pa.int32()), ("words", pa.string())]))
        for b in batches:
            n, runs = [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                n.append(len(w))
                runs.append([{"pos": p, "k": k, "words": x} for p, k, x in runs_of(w, number, codes, need)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), *b.columns[2:]], ["id", "n_words", "runs", *["rid"] * (b.num_columns > 2)])

    place = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("words", T.StringType())]))
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", place), *(f for f in texts.schema if f.name == "rid")])
    out = texts.mapInArrow(run, schema)
    return out if "rid" in texts.columns else out.withColumn("rid", F.monotonically_increasing_id())


def _shingles(words: str, k: str) -> F.Column:
    """The shingles of a string of words, as an array."""
    return F.expr(f"transform(sequence(0, size(split({words}, ' ')) - {k}), i -> array_join(slice(split({words}, ' '), i + 1, {k}), ' '))")


def contained_windows(docs: DataFrame, windows: DataFrame, shingle: int, id_col: str, text_col: str, block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """All rows of docs (rid, id, n_words), and where windows occur: (rid, start, n, words).

    windows: staged, from item_windows().
    """
    texts = windows.select("words", "n", "k").distinct()
    blocks = max(1, -(-texts.count() // block_windows))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if blocks > 1:  # the same key in each pass; rows that share it are alike
        source = source.withColumn("rid", F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "id").alias("b")))
    rows, hits = None, None
    for i in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i) if blocks > 1 else texts
        need = {r["k"]: r["least"] for r in own.groupBy("k").agg(F.min(F.col("n") - F.col("k") + 1).alias("least")).collect()}
        parts = own.select("words", "n", F.posexplode(_shingles("words", "k")).alias("off", "shingle"))
        wanted = [r[0] for r in parts.select("shingle").distinct().collect()]  # bounded as the block is
        scanned = stage(_scan(source, wanted, need), "decontamination-runs")
        runs = scanned.select("rid", F.explode("runs").alias("r")).select("rid", "r.pos", "r.k", "r.words")
        places = runs.select("rid", "pos", F.split("words", " ").alias("run"), F.posexplode(_shingles("words", "k")).alias("at", "shingle"))
        rarity = places.groupBy("shingle").agg(F.count("*").alias("seen"))
        prefix = parts.join(rarity, "shingle").groupBy("words", "n").agg(F.min(F.struct("seen", "shingle", "off")).alias("p")).select("words", "n", "p.shingle", "p.off")
        found = places.join(F.broadcast(prefix), "shingle")  # a row for each window of the block at most
        found = found.where("at >= off and at - off + n <= size(run)").where("array_join(slice(run, at - off + 1, n), ' ') = words")
        more = found.select("rid", (F.col("pos") + F.col("at") - F.col("off")).alias("start"), "n", "words")
        hits = more if hits is None else hits.union(more)
        rows = rows or scanned.select("rid", "id", "n_words")
    return rows, hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row for each row of docs: <id_col>, n_words, n_hit, items (ids as sorted strings), contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    windows = stage(item_windows(benchmark, window, shingle, item_col, item_text_col), "decontamination-windows")
    rows, hits = contained_windows(docs, windows, shingle, id_col, text_col, block_windows)
    hits = stage(hits, "decontamination-hits")
    by_row = Window.partitionBy("rid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("rid", "start", "n").distinct().withColumn("seen", F.max(F.col("start") + F.col("n")).over(by_row))
    covered = spans.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce("seen", "start")))).cast("long").alias("n_hit"))
    items = hits.select("rid", "words").distinct().join(windows.select("words", F.col("item").cast("string").alias("item")).distinct(), "words")
    items = items.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(covered, "rid", "left").join(items, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The rows of docs that decontaminate() doesn't call contaminated, all columns kept. Rows that repeat an id go or stay together."""
    (bad,) = fresh(docs, "bad")
    gone = stage(decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **how).where("contaminated").select(F.col(id_col).alias(bad)).distinct(), "decontamination-bad")
    return met(docs, gone, {bad: F.col(id_col)}, "left_anti")
