"""Best-fit packing planned over a histogram of lengths.

1. Map tasks tokenise the texts, cut what is longer than the limit and stage one light row a piece.
2. The histogram of lengths (at most ``limit`` rows) goes to the driver, which packs counts instead of documents: longest first,
   each length into the open sequences with the least room that still fits it. Sequences of equal room are one group, and a step
   fills a whole group or ends a length, so the plan's size depends on ``limit`` alone (each visit at least halves a group's room, so
   a group is visited at most log2(limit) times, and a length adds at most two groups): under 40 slots a length.
3. Pieces are ranked within their length and joined to the slot that holds their rank. A length with very many pieces is ranked in
   salted buckets whose sizes are summed, never in one task.

Of pieces of equal length, ranks go by salt, id and piece; any such order packs equally well. A null text is one piece with the end
token alone. The plan is broadcast: its size has the bound above.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, release, stage

#: Words in a generation of a worker's cache.
HELD_WORDS = 150_000
#: Bytes of text that are encoded at once, about.
FLUSH_BYTES = 2 << 20
#: Pieces of one length in a ranking bucket, about; the square root of their number if that is more.
BUCKET = 200
#: Words that are encoded as one text.
TOGETHER = 400
#: What stands for a pre-token in WordIds: letters, one digit, or other visible characters, after English clitics.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The marks that are cut off words; the first cores but for the empty one, so that 1 and 2 are their numbers.
MARKS = (",", ".")


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each start and size, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def check_tokenizer(j: dict) -> None:
    """Raises if a tokenizer file lets tokens reach over a space, a line feed or the end of a word before a comma or full stop."""
    normal, pre, model = j.get("normalizer") or {}, j.get("pre_tokenizer") or {}, j.get("model") or {}
    normal, pre = normal.get("normalizers", [normal]), pre.get("pretokenizers", [pre])
    kinds = [n.get("type") for n in normal]
    spaces = all(n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in normal if n.get("type") == "Replace")
    split = len(pre) == 2 and pre[0].get("type") == "Split" and pre[0].get("pattern") == {"Regex": PRE_TOKENS} and pre[0].get("invert") is True and pre[0].get("behavior") == "Removed"
    level = split and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    whole = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
    special = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) and not any(c.isspace() or c in ",." for c in t["content"]) for t in j.get("added_tokens", []))
    if not (set(kinds) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds and spaces and level and whole and special):
        raise ValueError("this tokenizer may join what is encoded apart here")


class WordIds:
    """The ids of words by one tokenizer, with two generations of cached words.

    Holds for tokenizers as check_tokenizer() lets pass: they lower-case, their pre-tokens, normal forms and special strings never
    cross a space or a line feed, they drop white space and mark the end of a pre-token in its last token. So a text's ids are those of its
    words, one after the other, and a word is encoded once for all its occurrences. A comma or full stop at a word's end is encoded apart if
    the normal form before it ends in a character that the tokenizer parts from it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parted: dict[str, bool] = {}
        self.more: list[np.ndarray] = []  # ids and bounds that learn() has still to add
        self.bounds: list[np.ndarray] = []
        self.old: tuple[dict[str, int], np.ndarray, np.ndarray] = ({}, np.empty(0, "<u4"), np.zeros(1, np.int64))
        self.held = self.old  # cores' numbers, their ids end to end, where each begins
        self.clear()

    def clear(self) -> None:
        """Starts a new generation; the marks are the first cores."""
        self.old, self.held = self.held, ({}, np.empty(0, "<u4"), np.zeros(1, np.int64))
        self.learn(["", *MARKS])

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts (no nulls) end to end, and where each text's ids end."""
        if len(self.held[0]) > HELD_WORDS:
            self.clear()
        kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        first, data = bounds[0], texts.buffers()[2]
        if data is None or bounds[-1] == first:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(data, np.uint8)[first : bounds[-1]]
        bounds = bounds - first
        cuts = np.concatenate([np.flatnonzero((raw == 32) | (raw == 10)) + 1, bounds])  # a word takes the space after it along
        cuts.sort(kind="stable")
        cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]
        words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        core, mark = self.parts(pc.ascii_rtrim(words.dictionary, " \n"))
        own = self.numbers(core.dictionary.to_pylist())[core.indices.to_numpy()]
        _, flat, at = self.held
        word = np.stack([own, mark], 1)[words.indices.to_numpy()]
        sizes = (at[word + 1] - at[word]).reshape(-1)
        ends = np.concatenate([[0], np.cumsum(sizes[::2] + sizes[1::2])])
        return ragged(flat, at[word].reshape(-1), sizes), ends[np.searchsorted(cuts, bounds[1:])]

    def parts(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Each word without the comma (1) or full stop (2) at its end that is encoded apart, and the number of that mark or 0."""
        ascii_ = pc.string_is_ascii(words)
        words = pc.if_else(ascii_, pc.ascii_lower(words), words)
        cut = pc.and_(ascii_, pc.match_substring_regex(words, "[a-z0-9][,.]$")).to_numpy(zero_copy_only=False).copy()
        other = pc.and_(pc.invert(ascii_), pc.match_substring_regex(words, "[,.]$")).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(other).tolist():
            cut[i] = self.splits(words[i].as_py()[:-1])
        mark = np.where(cut, np.where(pc.ends_with(words, ",").to_numpy(zero_copy_only=False), 1, 2), 0)
        return pc.if_else(pa.array(cut), pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode(), mark

    def numbers(self, cores: list[str]) -> np.ndarray:
        """The cores' numbers in the cache, which learns those it has not."""
        number = self.held[0]
        self.learn([c for c in cores if c not in number])
        return np.fromiter(map(number.__getitem__, cores), np.int64, len(cores))

    def splits(self, core: str) -> bool:
        """Whether a comma or full stop after core is a pre-token of its own."""
        last = self.tok.normalizer.normalize_str(core)[-1:]
        if last not in self.parted:
            self.parted[last] = bool(last) and not last.isspace() and all(len(self.tok.pre_tokenizer.pre_tokenize_str(last + c)) == 2 for c in ",.")
        return self.parted[last]

    def learn(self, cores: list[str]) -> None:
        """Adds cores that are not held yet."""
        before, flat, at = self.old
        known = [c for c in cores if c in before]
        if known:
            places = np.fromiter(map(before.__getitem__, known), np.int64, len(known))
            sizes = at[places + 1] - at[places]
            self.keep(known, ragged(flat, at[places], sizes), sizes)
            cores = [c for c in cores if c not in before]
        plain, odd, none = [], [], []
        for c in cores:
            (plain if c.isalpha() else odd if c else none).append(c)
        parts = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for part, e in zip(parts, self.tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self.keep(part, ids, np.diff(ends, prepend=0))
            else:
                odd += part  # a word of several pre-tokens
        ids = [e.ids for e in self.tok.encode_batch_fast(odd, add_special_tokens=False)]
        self.keep(none, np.empty(0, "<u4"), np.zeros(len(none), np.int64))
        self.keep(odd, np.array([x for y in ids for x in y], "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)))
        self.held = self.held[0], np.concatenate([self.held[1], *self.more]), np.concatenate([self.held[2], *self.bounds])
        self.more.clear()
        self.bounds.clear()

    def keep(self, cores: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        number = self.held[0]
        last = self.bounds[-1][-1] if self.bounds else self.held[2][-1]
        number.update(zip(cores, range(len(number), len(number) + len(cores)), strict=True))
        if cores:
            self.more.append(ids)
            self.bounds.append(last + np.cumsum(sizes))


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts, little-endian unsigned 32-bit, as the tokenizers library gives them without added special tokens, end to
    end, and where each text's ids end."""
    return held(f"word ids of {path}", lambda: WordIds(path)).encoded(texts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about FLUSH_BYTES of text (column 1), or of one longer text."""
    for b in batches:
        size = pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // FLUSH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc[, ids]): a row for each piece of at most limit tokens. The tokenizer's file is checked here, once."""
    check_tokenizer(json.loads(Path(tokenizer_path).read_text()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for b in _slices(batches):
            ids, ends = encoded(b.column(1).fill_null(""), tokenizer_path)
            raw, lo = memoryview(ids.tobytes()), 0
            rows: list[tuple] = []
            for i, hi in enumerate((ends * 4).tolist()):
                own = bytes(raw[lo:hi]) + end
                for j in range(0, max(1, len(own)), 4 * limit):
                    x = own[j : j + 4 * limit]
                    rows.append((i, j // (4 * limit), j // 4, len(x) // 4, zlib.crc32(x), x))
                lo = hi
            at, *rest = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=False))], ["id", "piece", "start", "length", "crc", "ids"][: 5 + with_ids])
        release()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "crc")), *[T.StructField("ids", T.BinaryType())] * with_ids])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, last rank, first sequence, pieces of this length a sequence, offset), best-fit, longest first.

    Ranks first..last go, so many at a time, to the sequences from first sequence on.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, sequences)
    rooms: list[int] = []  # heap of the rooms there are or were
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                heapq.heappush(rooms, room)
            open_.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank, aside = histogram[length], 0, []

        def fill(room: int, first: int, n: int) -> int:
            """Puts what is left into the n sequences from first; returns how many pieces it took."""
            each = room // length
            full = min(n, left // each)
            took = full * each
            if full:
                slots.append((length, rank, rank + took - 1, first, each, limit - room))
                add(room - each * length, first, full)
            some = left - took if full < n else 0  # fewer than each: into one more
            if some:
                slots.append((length, rank + took, rank + took + some - 1, first + full, some, limit - room))
                add(room - some * length, first + full, 1)
            add(room, first + full + bool(some), n - full - bool(some))
            return took + some

        while left and rooms:
            room = heapq.heappop(rooms)
            if not open_.get(room):
                open_.pop(room, None)
                continue
            if room < length:
                aside.append(room)
                continue
            first, n = open_[room].pop()
            if open_[room]:
                heapq.heappush(rooms, room)
            else:
                del open_[room]
            took = fill(room, first, n)
            left, rank = left - took, rank + took
        for room in aside:
            heapq.heappush(rooms, room)
        if left:
            n = -(-left // (limit // length))
            fill(limit, sequences, n)
            sequences += n
    return slots


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with rank, from 0 without gaps within key; buckets of a key are ranked apart and their sizes summed."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.greatest(F.lit(float(BUCKET)), F.sqrt("n")))).cast("long")
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    salted = rows.join(F.broadcast(sizes), key).withColumn("salt", F.pmod(F.xxhash64(*order), salts)).drop("n")
    counts = salted.groupBy(key, "salt").agg(F.count("*").alias("n"))
    before = counts.select(key, "salt", (F.sum("n").over(Window.partitionBy(key).orderBy("salt")) - F.col("n")).alias("before"))
    within = salted.withColumn("at", F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)))
    return within.join(before, [key, "salt"]).withColumn("rank", F.col("before") + F.col("at") - 1).drop("before", "at", "salt")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: <id_col>, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Pieces of one sequence lie end to end from offset 0. Without end_id a text without tokens is a piece of length 0, in no sequence.
    """
    spark = docs.sparkSession
    staged = stage(pieces(docs, tokenizer_path, limit, end_id, id_col, text_col, with_ids), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in staged.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, limit), "length long, lo long, hi long, first long, each long, base long")
    light = ranked(staged.drop("ids").where("length > 0"), "length", ["id", "piece"])
    placed = light.join(F.broadcast(slots), "length").where("rank between lo and hi")
    placed = placed.select("id", "piece", "start", "length", "crc", F.expr("first + (rank - lo) div each").alias("sequence_id"), F.expr("base + (rank - lo) % each * length").alias("offset"))
    empty = staged.where("length = 0").select("id", "piece", "start", "length", "crc", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    out = placed if end_id is not None else placed.unionByName(empty)
    out = out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
    if not with_ids:
        return out
    ids = staged.select(F.col("id").alias("__id"), F.col("piece").alias("__piece"), F.col("crc").alias("__crc"), "ids").dropDuplicates(["__id", "__piece", "__crc"])
    return out.join(ids, out[id_col].eqNullSafe(ids["__id"]) & (out["piece"] == ids["__piece"]) & (out["ids_crc32"] == ids["__crc"])).drop("__id", "__piece", "__crc")
