"""Suffix-array dedup: bytes under a repeated string of ``length`` bytes, by sampled prefix doubling.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id, judged on the input.

Ranks here are names: equal strings of a level share a name, made of the names of their halves (prefix doubling), and Spark groups and
sorts (name, document) pairs. Sorting every position at every level would shuffle some 24 bytes for each input byte and level, so
positions are sampled first, without losing any repeat:

1. In a task names double from 1 byte up to ``gram`` bytes. Of all grams in a window of ``length`` bytes the one of the least name (leftmost
   of equals) is its anchor; equal windows have equal anchors at equal places, and about one position in 14 is an anchor.
2. First sort, (name of the gram, document): anchors of names that only one document has are unique and leave. The names of the rest go
   back to their documents.
3. Second sort, (name, document) of the anchors left with the bytes around them: each window of ``length`` bytes around the anchor, the
   offsets past the gram, is named and reranked; a name's least document is found and the bytes are compared. A window is removed
   in all greater documents.
4. Removed windows go to their documents, which merge them.

Anchors travel as packed arrays, a row for each task, flush and bucket; what a task finds out for other buckets it gathers first. A flush
reduces what it holds of one name: of equal anchors with equal surroundings just the one of the least document goes on, the others are
removed at once. So a passage that a third of all documents share is one row a flush. Texts are shuffled twice, compressed. A null id
is the smallest; ids other than integers are replaced by their ranks. Rows that repeat an id are judged apart, and never remove each
other's bytes.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import numbered
from .common import shuffle_partitions, stage

#: Bytes of text that a task gathers before it hands on what it found.
FLUSH_BYTES = 16 << 20
#: Entries that a task gathers for other buckets.
BOX_ENTRIES = 2_000_000
#: Live anchors that a task gathers before it hands them on.
FLUSH_ROWS = 150_000
#: Bytes of text whose names are computed at once.
BLOCK_BYTES = 2 << 20
_NULL = -(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BYTE_NAMES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def names(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit name for the gram at each position; names of 2m bytes come from those of m bytes."""
    name, m = _BYTE_NAMES[data], 1
    while m < gram:
        step = min(m, gram - m)  # the last pair may overlap
        name = mixed(name[:-step] * _M1 + name[step:])
        m += step
    return name


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, name) in data; ends: for each byte, where its document ends."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    name = names(data, gram)
    value, place, m, w = name, np.arange(len(name)), 1, length - gram + 1
    while m < w:  # least of m grams, doubled
        step = min(m, w - m)
        right = value[step:] < value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        m += step
    at = np.flatnonzero(np.arange(n) + length <= ends[:n])
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    place = place[at]
    new = np.flatnonzero((np.diff(place) != 0) | (np.diff(at) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(at)]]) - 1
    return place[first], at[first], at[last], name[place[first]]


def _doc_blocks(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, document number, place of data in it, anchors ...) by blocks; long texts are cut with an overlap that loses no window."""
    held: list[bytes] = []
    which: list[int] = []
    froms: list[int] = []
    size = 0

    def out() -> tuple:
        lens = np.fromiter(map(len, held), np.int64, len(held))
        data = np.frombuffer(b"".join(held), np.uint8)
        stops = np.cumsum(lens)
        a, lo, hi, name = anchors(data, np.repeat(stops, lens), length, gram)
        k = np.searchsorted(stops, a, side="right")
        return data, np.array(which, np.int64)[k], np.array(froms, np.int64)[k] - (stops - lens)[k], np.stack([(stops - lens)[k], stops[k]]), np.stack([a, lo, hi]), name

    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), BLOCK_BYTES):
            held.append(t[s : s + BLOCK_BYTES + length - 1])
            which.append(i)
            froms.append(s)
            size += len(held[-1])
            if size >= BLOCK_BYTES:
                yield out()
                held, which, froms, size = [], [], [], 0
    if held:
        yield out()


def _keys(ids: list[int | None], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids as longs, and a name for each row by id and text."""
    doc = np.array([_NULL if i is None else i for i in ids], np.int64)
    return doc, mixed(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64) * _M1 ^ mixed(doc.view(np.uint64)))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays), 1)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for t in types:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def _planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, place by place: what compresses."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).reshape(-1)


def _numbers(planes: np.ndarray, kind: str) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(w, -1).T).reshape(-1).view(kind)


def _pack_near(d: np.ndarray, u: np.ndarray, pos: np.ndarray, j0: np.ndarray, j1: np.ndarray, text: np.ndarray) -> bytes:
    """Anchors by their bytes, with each row's document once."""
    order = np.argsort(np.ascontiguousarray(text[:, :8]).view(">u8")[:, 0], kind="stable") if text.shape[1] >= 8 else np.arange(len(d))
    rows, first, at = np.unique(u[order], return_index=True, return_inverse=True)
    return _pack(rows, d[order][first], _planes(at.astype(np.uint32)), _planes(pos[order]), j0[order], j1[order], text[order])


def _unpack_near(data: bytes, width: int) -> tuple[np.ndarray, ...]:
    rows, docs, at, pos, j0, j1, text = _unpack(data, "u8", "i8", "u1", "u1", "u1", "u1", "u1")
    at = _numbers(at, "u4")
    return docs[at], rows[at], _numbers(pos, "i8"), j0, j1, text.reshape(-1, width)


def _split(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket of the key, which entries go there."""
    if not len(key):
        return
    bucket = (key >> np.uint64(40)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    for b, lo, hi in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
        yield b, order[lo:hi]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts by flushes."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).fill_null("").cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t) + 64
            if size > FLUSH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.binary())], ["bucket", "kind", "data"])


ROWS = "bucket int, kind int, data binary"
KEYS, LIVE, TEXT, NEAR, SPANS = 1, 2, 3, 4, 5


class _Box:
    """Gathers arrays by the bucket they go to."""

    def __init__(self, kind: int) -> None:
        self.kind, self.size = kind, 0
        self.held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def add(self, bucket: int, *arrays: np.ndarray) -> None:
        self.held.setdefault(bucket, []).append(arrays)
        self.size += len(arrays[0])

    def rows(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """A row a bucket, if it holds at least so many entries."""
        if self.size >= least:
            yield _rows([(b, self.kind, _pack(*(np.concatenate(x) for x in zip(*got, strict=True)))) for b, got in self.held.items()])
            self.held.clear()
            self.size = 0


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()


def _free(df: DataFrame) -> None:
    """Shuffle files of finished steps go when the driver's garbage is collected, on both sides; their owners are let go in between."""
    for _ in range(2):
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(0.5)


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 24, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each row of docs: <id_col>, n_bytes, n_removed, n_spans, kept_sha256, spans (first byte, end)[, kept]."""
    if not 1 <= gram < length:
        raise ValueError("gram must be shorter than length")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = 4 * parts
    side = length - gram
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ranks = None
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        ranks = stage(numbered(source.select("id").where("id is not null").distinct(), ["id"], "rank"), "suffix-ids")
        source = source.join(ranks, "id", "left").select(F.col("rank").alias("id"), "text")
    source = source.select(F.col("id").cast("long"), "text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each flush: (name, row) of its anchors; what it knows to be shared goes as live keys at once."""
        for ids, texts in _texts(batches):
            _, uid = _keys(ids, texts)
            got = [(name, uid[which]) for _, which, _, _, _, name in _doc_blocks(texts, length, gram)]
            name, row = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.uint64),) * 2
            order = np.lexsort((row, name))
            name, row = name[order], row[order]
            keep = np.ones(len(name), bool)
            keep[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
            name, row = name[keep], row[keep]
            head = np.ones(len(name), bool)
            head[1:] = name[1:] != name[:-1]
            shared = ~head
            shared[:-1] |= ~head[1:]
            sent, live = np.flatnonzero(head), np.flatnonzero(shared)
            found = [(b, KEYS, _pack(np.diff(name[sent[at]], prepend=np.uint64(0)), row[sent[at]])) for b, at in _split(name[sent], buckets)]
            keys = mixed(name[live] ^ row[live] * _M1)
            found += [(b, LIVE, _pack(keys[at])) for b, at in _split(row[live], parts)]
            yield _rows(found)

    def alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names of a bucket that rows of two flushes or more have: live keys, by the row's bucket."""
        last, held, box = None, [], _Box(LIVE)

        def out() -> None:
            if not held:
                return
            name, row = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(name, kind="stable")
            name, row = name[order], row[order]
            same = name[1:] == name[:-1]
            shared = np.zeros(len(name), bool)
            shared[1:] |= same
            shared[:-1] |= same
            name, row = name[shared], row[shared]
            keys = mixed(name ^ row * _M1)
            for b, at in _split(row, parts):
                box.add(b, np.unique(keys[at]))

        for bucket, kind, data in _by_bucket(batches):
            if bucket != last:
                out()
                last = bucket
            if kind == LIVE:
                box.add(bucket, *_unpack(data, "u8"))
            else:
                steps, row = _unpack(data, "u8", "u8")
                held.append((np.cumsum(steps, dtype=np.uint64), row))
            yield from box.rows(BOX_ENTRIES)
        out()
        yield from box.rows()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            _, uid = _keys(ids, texts)
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            null = np.array([i is None for i in ids], bool)
            doc = np.array([0 if i is None else i for i in ids], np.int64)
            yield _rows([(b, TEXT, _pack(doc[at], null[at], lens[at], np.frombuffer(b"".join(texts[i] for i in at.tolist()), np.uint8))) for b, at in _split(uid, parts)])

    def opened(data: bytes) -> tuple[list[int | None], list[bytes]]:
        doc, null, lens, raw = _unpack(data, "i8", "?", "i8", "u1")
        raw, stops = raw.tobytes(), np.cumsum(lens).tolist()
        return [None if n else d for d, n in zip(doc.tolist(), null.tolist(), strict=True)], [raw[e - n : e] for e, n in zip(stops, lens.tolist(), strict=True)]

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Live anchors of the bucket's texts with the bytes around them, by name; the least document of equal ones, others removed."""
        last, held, keys = None, [], np.empty(0, np.uint64)
        got: list[tuple] = []
        width = length + side

        def out() -> pa.RecordBatch:
            name, d, u, pos, j0, j1, text = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            same = mixed(_row_names(np.concatenate([text, j0[:, None], j1[:, None]], 1)) ^ name)
            order = np.lexsort((d, same))
            name, d, u, pos, j0, j1, text, same = (x[order] for x in (name, d, u, pos, j0, j1, text, same))
            head = np.ones(len(name), bool)
            head[1:] = same[1:] != same[:-1]
            rep = np.flatnonzero(head)[np.cumsum(head) - 1]
            head |= (text != text[rep]).any(1) | (j0 != j0[rep]) | (j1 != j1[rep])  # names may collide, bytes don't
            least = ~head & (d == d[rep])  # the same document again: it must be judged like the first
            go = head | least
            gone = ~go
            found = [(b, NEAR, _pack_near(d[at], u[at], pos[at], j0[at], j1[at], text[at])) for b, at in ((b, np.flatnonzero(go)[at]) for b, at in _split(name[go], buckets))]
            span = (u[gone], pos[gone] - j1[gone], pos[gone] - j0[gone] + length)
            found += [(b, SPANS, _pack(*(x[at] for x in span))) for b, at in _split(span[0], parts)]
            return _rows(found)

        for bucket, kind, data in _by_bucket(batches):
            if bucket != last:
                last, held, keys = bucket, [], np.empty(0, np.uint64)
            if kind == LIVE:
                held.append(_unpack(data, "u8")[0])
                continue
            if held:
                keys, held = np.unique(np.concatenate(held)), []
            if not len(keys):
                continue
            ids, texts = opened(data)
            doc, uid = _keys(ids, texts)
            for raw, which, shift, _, (a, lo, hi), name in _doc_blocks(texts, length, gram):
                k = mixed(name ^ uid[which] * _M1)
                on = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k)
                if not len(on):
                    continue
                a, lo, hi, which, shift = a[on], lo[on], hi[on], which[on], shift[on]
                at = a[:, None] - side + np.arange(width)[None]
                inside = (at >= lo[:, None]) & (at < hi[:, None] + length)  # what its windows cover
                bytes_ = np.where(inside, raw[np.clip(at, 0, len(raw) - 1)], 0).astype(np.uint8)
                got.append((name[on], doc[which], uid[which], a + shift, (a - hi).astype(np.uint8), (a - lo).astype(np.uint8), bytes_))
            if sum(len(g[0]) for g in got) >= FLUSH_ROWS:
                yield out()
        if got:
            yield out()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows around the bucket's anchors that a smaller document has, as spans by row."""
        last, held, box = None, [], _Box(SPANS)

        def out() -> None:
            if not held:
                return
            name, d, u, pos, j0, j1, text = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(name, kind="stable")
            us, starts = [], []
            groups = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
            for lo in range(0, len(groups), 1 << 14):
                part = order[groups[lo] : groups[lo + (1 << 14)] if lo + (1 << 14) < len(groups) else len(order)]
                for j in range(side + 1):
                    own = part[(j0[part] <= j) & (j <= j1[part])]
                    if len(own) < 2:
                        continue
                    window = np.ascontiguousarray(text[own, side - j : side - j + length])
                    low = least_of(window, mixed(_row_names(window) ^ name[own]), d[own])
                    hit = own[low < d[own]]
                    us.append(u[hit])
                    starts.append(pos[hit] - j)
            if not us:
                return
            u, s = np.concatenate(us), np.concatenate(starts)
            order = np.lexsort((s, u))
            u, s = u[order], s[order]
            new = np.ones(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (s[1:] > s[:-1] + length)
            at = np.flatnonzero(new)
            stop = s[np.concatenate([at[1:], [len(s)]]) - 1] + length if len(s) else s
            for b, x in _split(u[at], parts):
                box.add(b, u[at][x], s[at][x], stop[x])

        for bucket, kind, data in _by_bucket(batches):
            if bucket != last:
                out()
                last = bucket
            if kind == SPANS:
                box.add(bucket, *_unpack(data, "u8", "i8", "i8"))
            else:
                near = _unpack_near(data, length + side)
                held.append((_row_names(near[-1][:, side : side + gram]), *near))
            yield from box.rows(BOX_ENTRIES)
        out()
        yield from box.rows()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 2 here: spans, which come before the texts."""
        last, held, by_row = None, [], (np.empty(0, np.uint64),) * 3
        kind_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for bucket, kind, data in _by_bucket(batches):
            if bucket != last:
                last, held, by_row = bucket, [], (np.empty(0, np.uint64),) * 3
            if kind == LIVE:
                held.append(_unpack(data, "u8", "i8", "i8"))
                continue
            if held:
                u, s, e = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((s, u))
                by_row, held = (u[order], s[order], e[order]), []
            ids, texts = opened(data)
            _, uid = _keys(ids, texts)
            lo, hi = np.searchsorted(by_row[0], uid, "left"), np.searchsorted(by_row[0], uid, "right")
            cols: list[list] = [[] for _ in range(7)]
            for i, t, x, y in zip(ids, texts, lo.tolist(), hi.tolist(), strict=True):
                spans: list[list[int]] = []
                for s, e in zip(by_row[1][x:y].tolist(), by_row[2][x:y].tolist(), strict=True):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                cuts = [0, *(v for sp in spans for v in sp), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                for c, v in zip(cols, (i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind_, pa.binary()][: 6 + with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 6 + with_text])

    live = stage(_dealt(source.mapInArrow(first, ROWS), parts).mapInArrow(alive, ROWS), "suffix-live")
    _free(live)
    texts = source.mapInArrow(packed, ROWS)
    near = _dealt(live.union(texts), parts).mapInArrow(around, ROWS)
    spans = stage(_dealt(near, parts).mapInArrow(judged, ROWS), "suffix-spans")
    _free(spans)
    both = spans.select("bucket", F.lit(LIVE).alias("kind"), "data").union(texts)
    out = _dealt(both, parts).mapInArrow(merged, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_text)
    if ranks is not None:
        own = ranks.withColumnRenamed("id", "own")
        return out.join(own, out["id"] == own["rank"], "left").select(F.col("own").alias(id_col), *out.columns[1:])
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def _row_names(rows: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of bytes."""
    n, w = rows.shape
    padded = np.zeros((n, -(-w // 8) * 8), np.uint8)
    padded[:, :w] = rows
    name = np.full(n, w, np.uint64)
    for lane in padded.view(np.uint64).T:
        name = mixed(name * _M1 ^ lane)
    return name


def least_of(windows: np.ndarray, name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window the least doc among equal windows; equal names are checked byte by byte."""
    order = np.lexsort((doc, name))
    sorted_ = name[order]
    head = np.ones(len(order), bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    rep = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    low = np.empty(len(doc), np.int64)
    low[order] = doc[rep]
    odd = np.empty(len(doc), bool)
    odd[order] = (windows[order] != windows[rep]).any(1)
    if odd.any():  # two strings of one name: their group by its bytes
        bad = np.isin(name, name[odd])
        best: dict[bytes, int] = {}
        at = np.flatnonzero(bad).tolist()
        for i in at:
            w = windows[i].tobytes()
            best[w] = min(best.get(w, int(doc[i])), int(doc[i]))
        for i in at:
            low[i] = best[windows[i].tobytes()]
    return low
