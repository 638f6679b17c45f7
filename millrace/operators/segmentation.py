"""Words of texts that are written without spaces: a dictionary, the lattice of its words in a text, and the likeliest path through it.

A run of letters of unspaced scripts is cut so that the sum of its words' log frequencies is greatest; a letter that begins no word stands alone and
counts as seen once, and of equal paths the one with the longer first word is taken. Other runs of letters and digits are words
as they are. The finer cut for searches gives, before each word, the shorter dictionary words of two and three letters inside it.

A batch's runs are cut together, the longest first: the lattice's edges are found by looking up the hashes of all stretches of one length among the
dictionary's words of that length, and the best paths are worked out for all runs of a block in step, from their ends. Dictionaries are passed in (at most MOST_WORDS words go to the
tasks), or learned from a corpus: letter groups that occur often, hold together and have free neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import scratch

#: Scripts that are written without spaces: Han, Kana, Thai, Lao, Myanmar, Khmer.
UNSPACED = "[㐀-䶿一-鿿豈-﫿\U00020000-\U000323af぀-ヿ฀-໿က-႟ក-៿]"
MOST_WORDS = 1_000_000
#: Of the hashes of letter groups.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that tell most places without a word, besides those that lead to a word.
FINER = 2
#: Letters of a batch whose words are held at once, about, and those that are cut at once, so that the caches hold their lattice.
PIECE = 1 << 19
BLOCK = 1 << 17


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Dictionary:
    """Words and how often they occur, by length, each length's words sorted by hash and found by its leading bits."""

    def __init__(self, words: Iterable[tuple[str, float]]) -> None:
        by: dict[int, dict[str, float]] = {}
        for word, n in words:
            if word:
                by.setdefault(len(word), {})[word] = max(float(n), 1.0)
        self.longest = max(by, default=1)
        self.total = np.log(max(1.0, sum(sum(x.values()) for x in by.values())))
        self.words: dict[int, np.ndarray] = {}  # letters by word
        self.keys: dict[int, np.ndarray] = {}  # their hashes, in order
        self.scores: dict[int, np.ndarray] = {}
        self.shift: dict[int, np.uint64] = {}  # leaves a hash's leading bits, one or two more than count the words
        self.first: dict[int, np.ndarray] = {}  # by leading bits: the first word that has them or more
        self.used: dict[int, np.ndarray] = {}  # by FINER bits more: whether a word has them
        for size, own in by.items():
            letters = _points("".join(own)).reshape(-1, size)
            keys = np.zeros(len(letters), np.uint64)
            for j in range(size):
                keys = (keys + letters[:, j].astype(np.uint64) + np.uint64(1)) * FACTOR
            order = np.argsort(keys, kind="stable")
            self.words[size], self.keys[size] = letters[order], keys[order]
            self.scores[size] = np.log(np.array(list(own.values())))[order] - self.total
            if (np.diff(self.keys[size]) == 0).any():
                raise ValueError(f"two words of {size} letters have the same hash")
            bits = len(keys).bit_length() + 1
            self.shift[size] = np.uint64(64 - bits)
            self.first[size] = np.searchsorted(self.keys[size] >> self.shift[size], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            self.used[size] = np.zeros(1 << (bits + FINER), bool)
            self.used[size][self.keys[size] >> (self.shift[size] - np.uint64(FINER))] = True

    def found(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: the places where a word begins, and its log share. points end with longest zeros."""
        n = len(points) - self.longest
        letters, rolled = points.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
        for size in range(1, self.longest + 1):
            rolled += letters[size - 1 : size - 1 + n]
            rolled *= FACTOR
            if size not in self.keys:
                continue
            keys, words, stretches = self.keys[size], self.words[size], np.lib.stride_tricks.sliding_window_view(points, size)
            lead = (rolled >> (self.shift[size] - np.uint64(FINER))).view(np.int64)
            place = np.flatnonzero(self.used[size][lead])
            own, lead = rolled[place], lead[place] >> FINER
            at, stop = self.first[size][lead], self.first[size][lead + 1]
            while len(place):
                hit = np.flatnonzero(keys[at] == own)
                where, which = place[hit], at[hit]
                same = (words[which] == stretches[where]).all(1)
                yield size, where[same], self.scores[size][which[same]]
                at = at + 1
                rest = np.flatnonzero(at < stop)
                place, own, at, stop = place[rest], own[rest], at[rest], stop[rest]

    def cut(self, runs: list[str], finer: bool = False) -> list[list[str]]:
        """The words of each run. Runs of about one length are cut together, so that few steps have few of them."""
        sizes = np.array([len(r) for r in runs], np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends, out, lo = np.cumsum(sizes[order]), [[] for _ in runs], 0
        while lo < len(runs):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
            some = order[lo:hi].tolist()
            for i, words in zip(some, self._cut([runs[i] for i in some], sizes[order[lo:hi]], finer), strict=True):
                out[i] = words
            lo = hi
        return out

    def _cut(self, runs: list[str], sizes: np.ndarray, finer: bool) -> list[list[str]]:
        """The words of runs, of which the longest is the first."""
        ends = np.cumsum(sizes)
        text = "".join(runs)
        n, longest = len(text), self.longest
        if not n:
            return [[] for _ in runs]
        # a row for each letter: first the last letters of all runs, then those before them, and so on
        left = np.repeat(ends, sizes) - np.arange(n)  # letters to the run's end
        counts = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")  # runs of so many letters
        starts = np.cumsum(counts) - counts
        row = starts[left - 1] + np.repeat(np.arange(len(runs)), sizes)
        edges = np.full((n, longest), -np.inf)  # by row: log shares of the words that begin there, the longest first
        edges[:, -1] = -self.total
        flat, cell = edges.reshape(-1), (row + 1) * longest
        known = np.zeros((n, longest) if finer else (0, 0), bool)
        for size, at, scores in self.found(np.concatenate([_points(text), np.zeros(longest, np.uint32)])):
            inside = np.flatnonzero(left[at] >= size)
            at = at[inside]
            flat[cell[at] - size] = scores[inside]
            if finer:
                known[at, size - 1] = True
        # best paths of each run from its last letters, the last few kept in columns that slide to the left; a run's end costs nothing
        best, base = np.zeros((int(counts[0]), 2 * longest + 1)), 0
        steps, firsts = np.empty(n, np.int64), np.arange(int(counts[0])) * longest
        for t, (lo, c) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True), 1):
            if t - base + longest == best.shape[1]:
                best[:c, :longest] = best[:c, -longest:]
                base = t
            at = t - base
            paths = edges[lo : lo + c]
            paths += best[:c, at : at + longest]
            np.round(paths, 9, out=paths)  # so that equal paths are equal
            most = paths.argmax(1)
            steps[lo : lo + c] = most
            best[:c, at + longest] = flat[firsts[:c] + (most + lo * longest)]
        step = (longest - steps)[row].tolist()
        out = []
        for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            words, at = [], lo
            while at < hi:
                size = step[at]
                if finer and size > 2:
                    words += [text[i : i + k] for k in (2, 3) if k < size and k <= longest for i in range(at, at + size - k + 1) if known[i, k - 1]]
                words.append(text[at : at + size])
                at += size
            out.append(words)
        return out


class Segmenter:
    """Cuts texts by a dictionary; unspaced: a character class of what is cut, other letters and digits being words as they stand."""

    def __init__(self, dictionary: Dictionary, unspaced: str = UNSPACED, finer: bool = False, min_chars: int = 1, stop: Iterable[str] = ()) -> None:
        self.dictionary, self.finer, self.min_chars, self.stop = dictionary, finer, min_chars, frozenset(stop)
        self.pattern = re.compile(rf"((?:{unspaced})+)|(?:(?!{unspaced})[^\W_])+")

    def words(self, texts: list[str | None]) -> list[list[str] | None]:
        """The words of each text, lower-cased; null of a null text."""
        out: list[list | None] = [None if t is None else [] for t in texts]
        runs: list[str] = []
        places: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            for (i, j), own in zip(places, self.dictionary.cut(runs, self.finer), strict=True):
                out[i][j] = own
            runs.clear()
            places.clear()

        for i, t in enumerate(texts):
            for m in self.pattern.finditer((t or "").lower()):
                if m[1]:
                    runs.append(m[1])
                    places.append((i, len(out[i])))
                    size += len(m[1])
                out[i].append([m[0]])
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        if self.min_chars <= 1 and not self.stop:
            return [None if x is None else list(chain.from_iterable(x)) for x in out]
        keep = lambda w: len(w) >= self.min_chars and w not in self.stop
        return [None if x is None else [w for part in x for w in part if keep(w)] for x in out]

    def tokenizer(self, spark) -> Callable[[Column | str], Column]:  # noqa: ANN001
        """A function from a text column to its words, as retrieval.lexical_index() takes it; the dictionary is sent out once."""
        if sum(len(x) for x in self.dictionary.words.values()) > MOST_WORDS:
            raise ValueError(f"a dictionary of over {MOST_WORDS} words")
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                for part in X.pieces(s, PIECE):
                    yield pd.Series(sent.value.words(part.tolist()), dtype=object)

        return lambda text: cut(F.col(text) if isinstance(text, str) else text)


def grouped_letters(texts: DataFrame, text_col: str, longest: int, unspaced: str = UNSPACED) -> DataFrame:
    """(word, size, n) of all groups of up to longest neighbouring letters, with how often each stands; counted in each task first."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(f"({unspaced}+)"), 1)).alias("run"))
    places = F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at")
    sizes = runs.select("run", places).select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))).alias("size"))
    return sizes.groupBy(F.substring("run", F.col("at"), F.col("size")).alias("word")).agg(F.first("size").alias("size"), F.count("*").alias("n"))


def learned_words(texts: DataFrame, text_col: str = "text", longest: int = 4, least: int = 5, cohesion: float = 3.0, freedom: float = 1.0, unspaced: str = UNSPACED) -> DataFrame:
    """(word, n) of a corpus: groups of up to longest letters that stand least times or more, whose parts meet cohesion (in natural logarithms)
    more often than by chance at every cut, and whose neighbours on either side have an entropy of freedom or more. Single letters all stay.

    An end of a run counts as a neighbour of its own each time. Joins are on the groups' own parts, so no key has more rows than there are
    different neighbours.
    """
    found, path = grouped_letters(texts, text_col, longest + 1, unspaced), scratch(texts.sparkSession, "letter-groups")
    found.write.parquet(path)
    groups = texts.sparkSession.read.schema(found.schema).parquet(path)
    total = groups.where("size = 1").agg(F.sum("n")).first()[0] or 1
    often = groups.where((F.col("size") <= longest) & (F.col("n") >= least))
    several = often.where("size > 1")
    cuts = several.select("word", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"), "size")
    parts = cuts.select("word", "n", F.substring("word", F.lit(1), F.col("cut")).alias("a"), F.substring("word", F.col("cut") + 1, F.col("size")).alias("b"))
    share = lambda name: groups.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    held = parts.join(share("a"), "a").join(share("b"), "b").groupBy("word", "n").agg(F.min(F.log(F.col("n")) + F.log(F.lit(float(total))) - F.log("n_a") - F.log("n_b")).alias("held"))
    good = held.where(F.col("held") >= cohesion)
    longer = groups.where("size > 2")

    def entropy(word: Column, name: str) -> DataFrame:
        """By word: the entropy of what stands next to it; occurrences at an end of a run are different neighbours."""
        sums = longer.groupBy(word.alias("word")).agg(F.sum(F.col("n") * F.log("n")).alias("inner"))
        return several.select("word", "n").join(sums, "word", "left").select("word", (F.log("n") - F.coalesce("inner", F.lit(0.0)) / F.col("n")).alias(name))

    before = entropy(F.expr("substring(word, 2, size - 1)"), "before")
    after = entropy(F.expr("substring(word, 1, size - 1)"), "after")
    free = good.join(before, "word").join(after, "word").where(F.least("before", "after") >= freedom)
    return free.select("word", "n").union(groups.where("size = 1").select("word", "n"))


def dictionary_of(words: DataFrame, longest: int = 16) -> Dictionary:
    """A dictionary of (word, n), of words of up to longest letters; the most frequent MOST_WORDS, if there are more, as no more go to the tasks."""
    own = words.where(F.length("word") <= longest).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(MOST_WORDS).toArrow()
    return Dictionary(zip(own["word"].to_pylist(), own["n"].to_pylist(), strict=True))


def segmented(df: DataFrame, text_col: str, segmenter: Segmenter, name: str = "words") -> DataFrame:
    """df with the words of text_col in column name."""
    return df.withColumn(name, segmenter.tokenizer(df.sparkSession)(text_col))
