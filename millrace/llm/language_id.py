"""Language identification of whole texts, and of the stretches of texts in several languages.

A word is a run of letters of one script. The word's script narrows the candidates: languages of whose learned letters at least a
thousandth are of it (all languages, where none has any). A word's score by a language is the sum of log ratios of its character n-grams of 1 to 5 letters, word ends included,
against the mean of the languages; n-grams are counted in hashed buckets over every learning row. Viterbi's algorithm then finds the labels
of a text's words whose scores are greatest together when each change of language costs a penalty; runs of equal labels are the spans.

Counts are added up in each task, then by bucket; the model that is sent out has at most MODEL_BYTES, whatever the input: with more
languages it has fewer buckets. A batch's words are labelled together: they are cut into about as many chunks as a chunk has words, which run
in step, once from every state and once, joined up, from the right one, so results are those of one pass over each text.

A text's language is the one with most letters (by name, if several have), its score the share of these letters times the probability
of the language over its own words. A null text, one without letters, and any text where nothing was learned, is ``und`` with score 0 and
no spans. A run of more than PIECE letters without white space counts as several words. Learning rows with null text or language are left out; an empty text teaches only how common its language is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .toxicity import slices

UNKNOWN = "und"
ORDERS = 5
BUCKETS = 1 << 16
MODEL_BYTES = 32 << 20
#: Languages that the learning rows may have.
MOST_LANGUAGES = 1000
#: Code points that are scored at once, about.
PIECE = 1 << 18
#: What forbids a language for a word; far more than any switching costs.
NEVER = np.float32(-1e4)

# Blocks of scripts, by first and last code point.
SCRIPTS = [
    ("Latin", [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Gurmukhi", [(0xA00, 0xA7F)]),
    ("Gujarati", [(0xA80, 0xAFF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Kannada", [(0xC80, 0xCFF)]),
    ("Malayalam", [(0xD00, 0xD7F)]),
    ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]),
    ("Myanmar", [(0x1000, 0x109F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("Ethiopic", [(0x1200, 0x139F)]),
    ("Khmer", [(0x1780, 0x17FF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
OTHER = len(SCRIPTS) + 1
MARK = 0x80


@cache
def script_table() -> np.ndarray:
    """By code point: the number of a letter's script from 1, plus MARK for combining marks; 0 for what is neither."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.fromiter((chr(c).isalpha() for c in range(len(table))), bool, len(table))
    table[letters] = OTHER
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for lo, hi in ranges:
            table[lo : hi + 1] = np.where(letters[lo : hi + 1], number, 0)
            for c in range(lo, hi + 1):
                if not letters[c] and unicodedata.category(chr(c))[0] == "M":
                    table[c] = number | MARK
    return table


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """A text's stretches of about size code points, cut at white space if there is some, with their places."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield at, text[at:end]
        at = end


class Words:
    """The words of a joined text: places, scripts, letters, and the buckets of their n-grams.

    buckets: for each order an array over all places and one before and after, those without an n-gram in bucket n_buckets.
    """

    def __init__(self, text: str, n_buckets: int) -> None:
        points = np.frombuffer(f" {text.replace('İ', 'i').lower()} ".encode("utf-32-le"), np.uint32)
        kind = script_table()[points]
        inside = kind != 0
        script = kind & (MARK - 1)
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (script[1:] != script[:-1])
        starts = np.flatnonzero(new)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:]
        ends = np.flatnonzero(last) + 1
        self.script = script[starts]
        letters = np.concatenate([[0], np.cumsum((kind != 0) & (kind < MARK))])
        self.letters = letters[ends] - letters[starts]
        self.starts, self.ends = starts - 1, ends - 1
        # A word's n-grams end at its letters and at the place after it, and reach back to the place before it at most.
        own = inside | np.concatenate([[False], inside[:-1]])
        place = np.arange(len(points))
        first = np.maximum.accumulate(np.where(new, place, 0))
        length = np.where(own, place - first + 2, 0)
        flat = np.where(inside, points, 32)
        rolled = np.zeros(len(points), np.uint32)
        shift = np.uint32(32 - (n_buckets.bit_length() - 1))
        self.buckets = []
        for order in range(1, ORDERS + 1):
            before = np.concatenate([np.zeros(1, np.uint32), rolled[:-1]])
            rolled = before * np.uint32(0x01000193) + (flat + np.uint32(1)) * np.uint32(0x9E3779B1)
            mixed = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            seen = (length >= order) & (inside if order == 1 else own)
            self.buckets.append(np.where(seen, (mixed >> shift).astype(np.int64), n_buckets))


class Model:
    """Languages by name, log ratios by bucket and language (a row of zeros at the end), candidates by script, and prior log shares."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray, shares: np.ndarray, least_share: float = 1e-3, pseudo: float = 1.0) -> None:
        """counts: by language and bucket; letters: by language and script; shares: how common languages are."""
        self.languages = languages
        total = np.maximum(1, counts.sum(1, keepdims=True))
        even = counts * (total.mean() / total) + pseudo
        ratio = np.log(even / even.mean(0)).T / ORDERS
        self.weights = np.vstack([ratio, np.zeros((1, len(languages)))]).astype(np.float32)
        used = letters > least_share * np.maximum(1, letters.sum(1, keepdims=True))
        self.allowed = np.where(used.any(0), used, True).T
        self.prior = np.log(shares / shares.sum()).astype(np.float32)

    @property
    def buckets(self) -> int:
        return len(self.weights) - 1

    def scored(self, words: Words) -> np.ndarray:
        """Scores by word and language."""
        if not len(words.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        by_place = self.weights[words.buckets[0]]
        for b in words.buckets[1:]:
            by_place += self.weights[b]
        # Where two words touch, what ends at the second's start is the second's.
        scores = np.add.reduceat(by_place, words.starts + 1, axis=0)
        return np.where(self.allowed[words.script], scores, NEVER)


def labelled(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi's labels of words, by scores of (word, label): a change of label costs penalty, but nothing where first says a text begins."""
    n, k = scores.shape
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    steps = int(np.ceil(np.sqrt(n)))
    chunks = -(-n // steps)
    s = np.zeros((chunks * steps, k), np.float32)
    s[:n] = scores
    cost = np.zeros(chunks * steps, np.float32)
    cost[:n] = np.where(first, 0, penalty)
    s, cost = s.reshape(chunks, steps, k), cost.reshape(chunks, steps)
    # Each chunk from every state it may be entered in.
    through = np.where(np.eye(k, dtype=bool), np.float32(0), np.float32(-1e9))[None].repeat(chunks, 0)
    for t in range(steps):
        through = s[:, t, None, :] + np.maximum(through, through.max(2, keepdims=True) - cost[:, t, None, None])
    entry = np.zeros((chunks, k), np.float32)
    for c in range(chunks - 1):
        after = (entry[c][:, None] + through[c]).max(0)
        entry[c + 1] = after - after.max()
    # Each chunk from what enters it, with where each state came from.
    came = np.empty((steps, chunks, k), np.int16)
    now, own = entry, np.arange(k, dtype=np.int16)
    for t in range(steps):
        best = now.argmax(1)
        most = now[np.arange(chunks), best][:, None] - cost[:, t, None]
        came[t] = np.where(now >= most, own, best[:, None])
        now = s[:, t] + np.maximum(now, most)
        now = now - now.max(1, keepdims=True)
    entered = np.arange(k, dtype=np.int64)[None].repeat(chunks, 0)
    for t in range(steps - 1, -1, -1):
        entered = np.take_along_axis(came[t], entered, 1).astype(np.int64)
    state = np.empty(chunks, np.int64)
    state[-1] = now[-1].argmax()
    for c in range(chunks - 1, 0, -1):
        state[c - 1] = entered[c, state[c]]
    out, rows = np.empty((chunks, steps), np.int64), np.arange(chunks)
    for t in range(steps - 1, -1, -1):
        out[:, t] = state
        state = came[t][rows, state].astype(np.int64)
    return out.reshape(-1)[:n]


def identified(texts: list[str | None], model: Model | None, penalty: float) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans of start, end and language in code points) of each text."""
    nothing = (UNKNOWN, 0.0, [])
    if model is None:
        return [nothing] * len(texts)
    found: list[list[np.ndarray]] = [[] for _ in range(5)]  # scores, text, start, end, letters

    def take(joined: list[str], docs: list[int], places: list[int]) -> None:
        w = Words(" ".join(joined), model.buckets)
        sizes = np.array([len(p) + 1 for p in joined])
        begins = np.cumsum(sizes) - sizes
        part = np.searchsorted(begins, w.starts, "right") - 1
        move = np.array(places)[part] - begins[part]
        for to, x in zip(found, (model.scored(w), np.array(docs)[part], w.starts + move, w.ends + move, w.letters), strict=True):
            to.append(x)

    joined, docs, places, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at, piece in pieces(text or ""):
            joined.append(piece)
            docs.append(i)
            places.append(at)
            size += len(piece)
            if size >= PIECE:
                take(joined, docs, places)
                joined, docs, places, size = [], [], [], 0
    if joined:
        take(joined, docs, places)
    if not found[0] or not sum(map(len, found[1])):
        return [nothing] * len(texts)
    scores, doc, start, end, letters = (np.concatenate(x) for x in found)
    k, n = len(model.languages), len(texts)
    first = np.diff(doc, prepend=-1) != 0
    label = labelled(scores + np.where(first[:, None], model.prior, np.float32(0)), first, penalty)
    share = np.bincount(doc * k + label, letters, n * k).reshape(n, k)
    best = share.argmax(1)
    total = share.sum(1)
    own = label == best[doc]
    sums = np.stack([np.bincount(doc[own], scores[own, j], n) for j in range(k)], 1) + model.prior
    sums = sums - sums.max(1, keepdims=True)
    sure = np.exp(sums[np.arange(n), best]) / np.exp(sums).sum(1)
    new = np.flatnonzero(first | (np.diff(label, prepend=-1) != 0))
    ends = end[np.append(new[1:], len(label)) - 1]
    spans: list[list[dict]] = [[] for _ in range(n)]
    for d, lo, hi, j in zip(doc[new].tolist(), start[new].tolist(), ends.tolist(), label[new].tolist(), strict=True):
        spans[d].append({"start": lo, "end": hi, "lang": model.languages[j]})
    return [(model.languages[b], float(r * s / t), x) if t else nothing for b, t, r, s, x in zip(best.tolist(), total.tolist(), share[np.arange(n), best].tolist(), sure.tolist(), spans, strict=True)]


def learned(rows: DataFrame, text_col: str, lang_col: str) -> Model | None:
    """A model of the rows' languages, counted over all rows; None without a language."""
    spark = rows.sparkSession
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    common = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(common) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not common:
        return None
    languages = sorted(common)
    fitting = max(1, MODEL_BYTES // (4 * len(languages)))
    buckets = min(BUCKETS, 1 << (fitting.bit_length() - 1))
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = buckets + 1 + OTHER + 1
        total: dict[int, np.ndarray] = {}
        for b in slices(batches, 0):
            by: dict[str, list[str]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).extend(p for _, p in pieces(text))
            for lang, parts in by.items():
                own = total.setdefault(number[lang], np.zeros(width, np.int64))
                lo = 0
                while lo < len(parts):
                    hi, size = lo, 0
                    while hi < len(parts) and size < PIECE:
                        size += len(parts[hi])
                        hi += 1
                    w = Words(" ".join(parts[lo:hi]), buckets)
                    for x in w.buckets:
                        own[: buckets + 1] += np.bincount(x, minlength=buckets + 1)
                    own[buckets + 1 :] += np.bincount(w.script, w.letters, OTHER + 1).astype(np.int64)
                    lo = hi
        for lang, own in total.items():
            own[buckets] = 0
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang), pa.int32()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most MODEL_BYTES / 4 rows and the scripts
    lang, bucket, n = (sums[c].to_numpy() for c in ("lang", "bucket", "n"))
    counts = np.zeros((len(languages), buckets + 1 + OTHER + 1))
    counts[lang, bucket] = n
    return Model(languages, counts[:, :buckets], counts[:, buckets + 1 :], np.array([common[x] for x in languages], float))


def identify(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 4.0) -> DataFrame:
    """A row for each row of docs: <id_col>, lang_pred, score, spans (start, end in code points, lang), learned from the rows of known alone.

    penalty: what a change of language within a text costs, in natural logarithms of likelihood.
    """
    model = learned(known, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = identified(b.column(1).to_pylist(), sent.value, penalty)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], kind)], [id_col, "lang_pred", "score", "spans"])

    span = T.StructType().add("start", "long").add("end", "long").add("lang", "string")
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType().add(id_col, docs.schema[id_col].dataType).add("lang_pred", "string").add("score", "double").add("spans", T.ArrayType(span)))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from; a null id may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
