"""Token counts by byte-pair merging with a heap and a linked list.

A text's symbols are its characters. The adjacent pair of lowest rank is popped again and again and merged; the count is the number
of initial symbols less the merges, where a character that is no piece of the vocabulary counts as its UTF-8 bytes. No identifiers
are made. The vocabulary is read from a SentencePiece byte-pair model (identity normaliser, dummy prefix, byte fallback).

Merging is local: where no piece of the vocabulary holds two neighbouring characters, no merge crosses them. Texts are so cut at
spaces, and words at such neighbours, and each different word is merged once a worker (a cache of bounded size); this leaves
every count as it is.

A null text counts as empty: 0 bytes and 0 tokens. The special strings of the vocabulary are ordinary text.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a generation of a worker's cache.
HELD_WORDS = 400_000
SPACE = "▁"
#: Runs of spaces with the characters up to the next space.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

_loaded: dict[str, Counter] = {}


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """The fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(b):
        k = varint()
        if k & 7 == 0:
            yield k >> 3, varint()
        elif k & 7 == 2:
            n = varint()
            yield k >> 3, b[i : i + n]
            i += n
        else:
            n = 4 if k & 7 == 5 else 8
            yield k >> 3, struct.unpack("<f", b[i : i + 4])[0] if n == 4 else b[i : i + 8]
            i += n


def merge_ranks(path: str) -> dict[str, int]:
    """Piece -> rank, best score first; pieces of equal score share a rank. Ordinary pieces only (type 1)."""
    with open(path, "rb") as f:
        model = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 1]
    scores = {p[1].decode(): p.get(2, 0.0) for p in model if p.get(3, 1) == 1}
    place = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
    return {p: place[s] for p, s in scores.items()}


def merges(symbols: str, rank: dict[str, int]) -> list[str]:
    """What is left of symbols after all merges, lowest rank first and leftmost among equals."""
    n = len(symbols)
    part: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left, j = part[i], after[i]
        if left is None or j >= n or len(left) + len(part[j]) != size:
            continue  # one of the two has been merged since
        whole = left + part[j]
        part[i], part[j] = whole, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(both := whole + part[k])) is not None:
                heapq.heappush(heap, (r, i, len(both)))
        h = before[i]
        if h >= 0 and (r := rank.get(both := part[h] + whole)) is not None:
            heapq.heappush(heap, (r, h, len(both)))
    return [p for p in part if p is not None]


class Counter:
    """Counts tokens with one vocabulary; keeps the counts of words."""

    def __init__(self, path: str) -> None:
        self.rank = merge_ranks(path)
        self.neighbours = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError(f"{path}: pieces go on after a space, so texts can't be cut at spaces")
        self.held: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.lines = not any("\n" in p for p in self.rank)

    def keep(self, w: str, n: int) -> int:
        if len(w) <= 64:
            if len(self.held) >= HELD_WORDS:
                self.old, self.held = self.held, {}
            self.held[w] = n
        return n

    def segment(self, s: str) -> int:
        n = self.held.get(s) or self.old.get(s)
        if n is None:
            n = self.keep(s, sum(1 if p in self.rank else sum(len(c.encode()) for c in p) for p in (merges(s, self.rank) if len(s) > 1 else s)))
        return n

    def word(self, w: str) -> int:
        n = self.old.get(w)
        if n is None:
            near, n, at = self.neighbours, 0, 0
            for i in range(1, len(w)):
                if w[i - 1 : i + 1] not in near:
                    n += self.segment(w[at:i])
                    at = i
            if not at:
                return self.segment(w)
            n += self.segment(w[at:])
        return self.keep(w, n)

    def text(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        for line in (" " + text).split("\n") if self.lines else [" " + text]:
            if "  " in line or line[-1:] == " ":
                units = UNIT.findall(line.replace(" ", SPACE))
            else:
                first, *rest = line.split(" ")
                units = [SPACE + w for w in rest]
                if first:
                    units.append(first)
            get = self.held.get
            try:
                total += sum(map(get, units))
            except TypeError:  # a word is new
                for u in units:
                    n = self.held.get(u)
                    total += self.word(u) if n is None else n
            total += 1  # of the line feed, a byte
        return total - 1


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: <id_col>, n_bytes, n_tokens, over_limit. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).text
        for b in batches:
            texts = b.column(1).fill_null("")
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts.cast(pa.binary())).cast(pa.int64()), pa.array([count(x) for x in texts.to_pylist()], pa.int64())], ["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
