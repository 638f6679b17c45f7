"""Exact dedup by an extendible-hash index on shared files.

1. Map tasks compare the bytes of the texts they hold in a dictionary of bounded size: equal ones become one entry with their number and
   their greatest id. Entries and light rows (id, number of the entry) are staged, in one pass over the input.
2. The directory is planned from counts of distinct 64-bit keys by their leading bits: it doubles, and a bucket splits on its next
   bit, as long as a bucket holds more than its capacity. Only counts reach the driver, at most ``2 ** bits`` for each bucket that
   is still overfull.
3. Each entry goes to the owner task of its bucket, which walks its range of keys in order, chains texts that share a key, compares their
   bytes and adds up the entries of equal ones: the owners alone decide what the groups are. Their entries are the index; it is
   written to the shared folder.
4. Each row takes its entry's group by the entry's number.

Texts are equal when their UTF-8 bytes are, after lower-casing A-Z only. A null text equals the empty one. Of equal texts the
row with the largest id stays (a null id is the smallest; of rows that repeat an id just one stays). A text that a third of
all rows hold is one entry for each time a map task empties its dictionary, so its owner reads few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, stage

#: Bytes of distinct texts that a map task holds before it hands them on.
HELD_BYTES = 32 << 20


def normalised(column: pa.Array) -> list[bytes]:
    return pc.ascii_lower(column.fill_null("")).cast(pa.binary()).to_pylist()


def xxh64(b: bytes) -> int:
    return xxhash.xxh64_intdigest(b)


def _signed(keys: list[int]) -> np.ndarray:
    return np.array(keys, dtype=np.uint64).view(np.int64)


def reduced(docs: DataFrame, id_col: str, text_col: str, key: Callable[[bytes], int] = xxh64) -> DataFrame:
    """Rows (text is null): id, rid, entry. Entries: the same for the row that stays, and h, n, text. Stage it before use, as rid and entry
    number the rows and entries of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held: dict[bytes, list] = {}  # text: entry, rows, (whether there is an id, id, rid)
        size = entries = rid = 0
        kind = pa.null()

        def out() -> pa.RecordBatch:
            found = held.values()
            keys = _signed([key(x) for x in held])
            return made([best[1] for _, _, best in found], [best[2] for _, _, best in found], [e for e, _, _ in found], keys, [n for _, n, _ in found], list(held))

        def made(ids: list | pa.Array, rids: list, own: list, keys: list | np.ndarray, n: list, texts: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            ids = ids if isinstance(ids, pa.Array) else pa.array(ids, kind)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip((rids, own, keys, n, texts), types, strict=True))], ["id", "rid", "entry", "h", "n", "text"])

        for b in batches:
            kind, own = b.column(0).type, []
            first = rid
            for i, x in zip(b.column(0).to_pylist(), normalised(b.column(1)), strict=True):
                best = (i is not None, i, base + rid)
                if (e := held.get(x)) is None:
                    e = held[x] = [base + entries, 0, best]
                    entries += 1
                    size += len(x) + 200
                elif best[0] and (not e[2][0] or best > e[2]):
                    e[2] = best
                e[1] += 1
                own.append(e[0])
                rid += 1
                if size > HELD_BYTES:
                    yield out()
                    held.clear()
                    size = 0
            none = [None] * b.num_rows
            yield made(b.column(0), list(range(base + first, base + rid)), own, none, none, none)
        if held:
            yield out()

    longs = [T.StructField(c, T.LongType()) for c in ("rid", "entry", "h", "n")]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *longs, T.StructField("text", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan_directory(keys: DataFrame, capacity: int, bits: int = 10, max_depth: int = 60) -> list[tuple[int, int]]:
    """Buckets as (prefix, depth), ordered by range of unsigned key; each has at most capacity distinct keys, or depth max_depth.

    keys: h, distinct. Each round counts the keys of the overfull buckets by their next bits, at most 2**bits rows a bucket.
    """
    done: list[tuple[int, int]] = []
    open_: list[tuple[int, int]] = [(0, 0)]
    while open_:
        depth = open_[0][1]
        wide = min(bits, max_depth - depth)
        rest = keys if depth == 0 else keys.where(F.shiftrightunsigned("h", 64 - depth).isin([p for p, _ in open_]))
        counts = {r["p"]: r["n"] for r in rest.groupBy(F.shiftrightunsigned("h", 64 - depth - wide).alias("p")).count().withColumnRenamed("count", "n").collect()}
        nxt: list[tuple[int, int]] = []

        def split(prefix: int, d: int, end: int, counts: dict = counts, nxt: list = nxt) -> int:
            """Doubles from depth d to end where a bucket is overfull."""
            lo, hi = prefix << (end - d), (prefix + 1) << (end - d)
            n = sum(counts.get(p, 0) for p in range(lo, hi))
            if n <= capacity or d == max_depth:
                done.append((prefix, d))
            elif d == end:
                nxt.append((prefix, d))
            else:
                split(prefix * 2, d + 1, end)
                split(prefix * 2 + 1, d + 1, end)
            return n

        for p, d in open_:
            split(p, d, d + wide)
        open_ = nxt
    return sorted(done, key=lambda b: b[0] << (64 - b[1]))


def build_index(staged: DataFrame, key: Callable[[bytes], int] = xxh64, capacity: int | None = None, with_text: bool = False) -> DataFrame:
    """The index: bucket, depth, h, chain (place among the texts of one key), sha, keep_id, keep_rid, group_size, entries[, text].

    staged: the result of reduced(), whose numbers of a text are its entries. The caller writes the index where it wants it kept.
    """
    parts = shuffle_partitions(staged.sparkSession)
    texts = staged.where("text is not null").select("h", "id", "rid", "entry", "n", "text")
    keys = texts.select("h").distinct()
    capacity = capacity or int(min(1 << 16, max(64, keys.count() // (8 * parts))))
    directory = plan_directory(keys, capacity)
    starts = np.array([p << (64 - d) if d else 0 for p, d in directory], dtype=np.uint64)
    depths = np.array([d for _, d in directory], dtype=np.int32)
    names = ["bucket", "depth", "h", "chain", "sha", "keep_id", "keep_rid", "group_size", "entries"] + ["text"] * with_text

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = np.searchsorted(starts, b.column(0).to_numpy().view(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), *b.columns], ["bucket", *b.schema.names])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come in order; chain: of each different text of the key at hand its rows, best row and entries."""
        last, chain, kind = None, {}, pa.null()

        def groups() -> list[tuple]:
            return [(last[0], int(depths[last[0]]), last[1], i, hashlib.sha256(x).hexdigest(), best[1], best[2], n, entries, *([x] if with_text else [])) for i, (x, (n, best, entries)) in enumerate(chain.items())]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), kind, pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * with_text
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in found], t) for i, t in enumerate(types)], names)

        for b in batches:
            found, kind = [], b.column(2).type
            for bucket, h, i, rid, entry, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (bucket, h) != last:
                    if last:
                        found += groups()
                    last, chain = (bucket, h), {}
                best = (i is not None, i, rid)
                group = chain.setdefault(x, [0, best, []])  # equal only if all bytes are
                group[0] += n
                if group[1][0] and best[0]:
                    group[1] = max(group[1], best)
                elif best[0]:
                    group[1] = best
                group[2].append(entry)
            yield batch(found)
        if last:
            yield batch(groups())

    id_type = staged.schema["id"].dataType.simpleString()
    owned = texts.mapInArrow(dealt, T.StructType([T.StructField("bucket", T.LongType()), *texts.schema])).repartition(parts, "bucket").sortWithinPartitions("bucket", "h")
    return owned.mapInArrow(own, f"bucket long, depth int, h long, chain int, sha string, keep_id {id_type}, keep_rid long, group_size long, entries array<long>" + ", text binary" * with_text)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[bytes], int] = xxh64, capacity: int | None = None) -> DataFrame:
    """A row for each row of docs: <id_col>, keep_id, group_size, kept, text_sha256."""
    staged = stage(reduced(docs, id_col, text_col, key), "exact-rows")
    index = stage(build_index(staged, key, capacity), "exact-index")
    groups = index.select(F.explode("entries").alias("entry"), "keep_id", "keep_rid", "group_size", "sha")
    both = staged.where("text is null").select("id", "rid", "entry").join(groups, "entry")
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))
