"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

1. Examples: of each label at most ``max_examples`` rows (default 2,000), those of smallest id hash; the bound is a parameter and the
   only sample taken. Examples of one label and equal words are one example with a weight.
2. Terms: every word of every example; none is left out. Inverse document frequencies count every row of the corpus. A term's weight
   is also multiplied by its relevance frequency log2(2 + a / max(1, c)), of a examples with label 1 and c with label 0 that have
   it (the tf.rf weighting), to the power ``relevance``: what counts most in a cosine changes, not what is compared. 0: TF-IDF alone.
3. Index: examples in blocks of like ones; each term has a cell for each block it occurs in, with the cell's greatest weight and its
   postings. A query adds up cells to an upper bound for each block, evaluates the blocks of the highest bounds and then all others
   whose bound reaches its k-th neighbour: what it returns is exactly the k nearest.
4. Score: votes weighted by similarity over a prior, then a logistic curve fitted on leave-one-out scores of the examples, weighted
   to the labels' true shares. The neighbours are kept as evidence.

Words are runs of letters, digits, underscores and characters beyond ASCII, in lower case. Only text enters a score. Each row is
scored on its own, whole. A text without a word of the examples (null and empty ones too) has no neighbour and gets the prior's
score. Without examples of both labels every score is the share of positive labels (0.5 without any label). An id with both labels is
an example of each; a label that is given twice counts once, and each row of the corpus with a labelled id is an example.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh, held, met, stage
from .packing import ragged

#: Examples in a block of the index.
BLOCK = 64
#: Blocks that a query evaluates before it knows a bound for the rest.
FIRST_BLOCKS = 4
#: Lists of at least one example in so many are kept as rows of a matrix.
HEAVY = 30
#: Bytes of text whose terms are counted at once, about.
FLUSH_BYTES = 4 << 20
#: The same for what this module counts: words and places of a slice take some fifteen times its bytes in a worker.
SLICE_BYTES = 1 << 20
#: Postings that are added up at once, about.
CELLS = 1 << 19
#: Terms of which the counts travel in one row.
CHUNK = 1 << 14

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 95 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def held_out(id_column: F.Column) -> F.Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 3 == 1


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, of each word in the texts which of them it is, where each text's words end). The empty word stands for gaps."""
    low = pc.utf8_lower(texts.fill_null(""))
    kind = np.int64 if pa.types.is_large_string(low.type) else np.int32
    bounds = np.frombuffer(low.buffers()[1], kind)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    if not len(low) or bounds[-1] == bounds[0]:
        return pa.array([], pa.large_string()), np.empty(0, np.int64), np.zeros(len(low), np.int64)
    raw = _FOLD[np.frombuffer(low.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    cuts = np.concatenate([np.flatnonzero(raw == 32) + 1, bounds])
    cuts.sort(kind="stable")
    cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]
    found = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
    return pc.ascii_rtrim(found.dictionary, " "), found.indices.to_numpy(), np.searchsorted(cuts, bounds[1:])


def counted(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often) for the terms that occur, ordered by text and term."""
    unique, which, ends = words(texts)
    number = pc.index_in(unique, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = number[which] if len(which) else which
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    known = term >= 0
    key, times = np.unique(text[known] * max(1, len(terms)) + term[known], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), times


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of about most bytes of text (FLUSH_BYTES by default), or of one longer text."""
    for b in batches:
        size = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        group = np.cumsum(size) // (most or FLUSH_BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def document_frequencies(docs: DataFrame, terms: pa.Array, text_col: str) -> tuple[int, np.ndarray]:
    """The number of rows, and how many have each of the terms: counts are added up in each task and then by chunks of terms."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(sent.value) + 1, np.int64), 0
        for b in slices(batches, 0, SLICE_BYTES):
            _, term, _ = counted(b.column(0), sent.value)
            total += np.bincount(term, minlength=len(total))
            rows += b.num_rows
        total[-1] = rows
        if rows:
            at = range(0, len(total), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i in at], pa.int32()), pa.array([total[i : i + CHUNK].tobytes() for i in at], pa.binary())], ["chunk", "counts"])
        forget()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(x, np.int64)
                total[i] = total[i] + own if i in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    parts = docs.select(text_col).mapInArrow(count, schema).repartition(1 + len(terms) // CHUNK, "chunk").mapInArrow(add, schema).collect()  # 8 bytes a term
    total = np.zeros(len(terms) + 1, np.int64)
    for r in parts:
        own = np.frombuffer(r["counts"], np.int64)
        total[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(own)] = own
    return int(total[-1]), total[:-1]


def weighed(text: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The weight of each term in its text; a text's weights are of length 1 together."""
    w = (1.0 + np.log(times)) * weight[term]
    norm = np.sqrt(np.bincount(text, w * w, n))
    return w / np.where(norm > 0, norm, 1.0)[text]


class BlockMaxIndex:
    """Cells of a term and a block, each with its greatest weight and its postings, from (example, term, weight) of size examples.

    The postings of terms that more than one example in HEAVY has are rows of a matrix: such a list has a posting in every block and
    nearly nothing to skip, so a block's bound is its greatest sum over them plus the bounds of its other cells.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, n_terms: int, block: int = BLOCK) -> None:
        self.size, self.blocks, self.block = size, -(-size // block), block
        heavy = np.flatnonzero(np.bincount(term, minlength=n_terms) * HEAVY > size)
        self.heavy = np.full(n_terms, -1, np.int32)
        self.heavy[heavy] = np.arange(len(heavy))
        row = self.heavy[term]
        self.rows = np.zeros((len(heavy), size))
        self.rows[row[row >= 0], example[row >= 0]] = weight[row >= 0]
        self.starts = np.arange(0, size, block)
        example, term, weight = example[row < 0], term[row < 0], weight[row < 0]
        order = np.lexsort((example, term))
        example, term, self.weight = example[order], term[order], weight[order]
        self.example = example.astype(np.int32)
        key = term * max(1, self.blocks) + example // block
        first = np.flatnonzero(np.diff(key, prepend=-1) != 0)
        self.at = np.append(first, len(key)).astype(np.int32)  # where a cell's postings begin
        self.cell_block = (key[first] % max(1, self.blocks)).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.cells = np.searchsorted(key[first] // max(1, self.blocks), np.arange(n_terms + 1)).astype(np.int32)  # where a term's cells begin
        self.postings = np.bincount(term, minlength=n_terms).astype(np.int32)

    def nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of n texts, from (text, term, weight) ordered by text: the numbers and cosines of the k nearest examples of
        positive cosine, nearest first; ties (to 12 places) go to the smaller number."""
        bounds = np.searchsorted(text, np.arange(n + 1))
        work = np.concatenate([[0], np.cumsum(np.bincount(text, self.postings[term], n) + 2 * self.size)])
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(work, work[lo] + CELLS)) - 1)
            own = slice(bounds[lo], bounds[hi])
            yield from self._some(text[own] - lo, term[own], weight[own], hi - lo, k)
            lo = hi

    def _some(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        row = self.heavy[term]
        own = np.zeros((n, len(self.rows)))
        own[text[row >= 0], row[row >= 0]] = weight[row >= 0]
        scores = own @ self.rows
        text, term, weight = text[row < 0], term[row < 0], weight[row < 0]
        many = self.cells[term + 1] - self.cells[term]
        cell = ragged(np.arange(len(self.top)), self.cells[term], many)
        text, weight = np.repeat(text, many), np.repeat(weight, many)
        bound = np.maximum.reduceat(scores, self.starts, axis=1)
        bound = bound + np.bincount(text * self.blocks + self.cell_block[cell], weight * self.top[cell], n * self.blocks).reshape(n, self.blocks)
        first = min(self.blocks, max(FIRST_BLOCKS, -(-2 * k // self.block)))
        chosen = np.zeros(bound.shape, bool)
        np.put_along_axis(chosen, np.argpartition(-bound, first - 1, 1)[:, :first], True, 1)
        scores = scores + self._scores(text, weight, cell, chosen, n)
        if first < self.blocks:
            least = np.partition(scores, self.size - k, 1)[:, self.size - k] if k <= self.size else np.zeros(n)
            rest = ~chosen & (bound >= least[:, None] - 1e-9)
            scores = scores + self._scores(text, weight, cell, rest, n)
        take = min(k, self.size)
        some = np.argpartition(-scores, take - 1, 1)[:, :take] if take < self.size else np.broadcast_to(np.arange(self.size), scores.shape)
        least = np.round(np.take_along_axis(scores, some, 1).min(1), 12)
        for i in range(n):
            found = np.flatnonzero((scores[i] > 0) & (np.round(scores[i], 12) >= least[i]))
            order = np.lexsort((found, -np.round(scores[i][found], 12)))[:k]
            yield found[order], scores[i][found[order]]

    def _scores(self, text: np.ndarray, weight: np.ndarray, cell: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
        """What the cells of the chosen blocks add to the cosines."""
        use = blocks[text, self.cell_block[cell]]
        text, weight, cell = text[use], weight[use], cell[use]
        many = self.at[cell + 1] - self.at[cell]
        post = ragged(np.arange(len(self.weight)), self.at[cell], many)
        return np.bincount(np.repeat(text * self.size, many) + self.example[post], np.repeat(weight, many) * self.weight[post], n * self.size).reshape(n, self.size)


def vote(sims: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float, strength: float = 0.5) -> float:
    w = sims**2 * weights
    return float((w @ labels + strength * prior) / (w.sum() + strength)) if len(sims) else prior


def logistic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept over log odds of votes, by Newton's method on smoothed targets with a small ridge."""
    x = log_odds(votes)
    pos, neg = weights[labels == 1].sum(), weights[labels == 0].sum()
    y = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.zeros(2)
    features = np.stack([x, np.ones_like(x)], 1)
    ridge = np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ a, -30, 30)))
        grad = features.T @ (weights * (p - y)) + ridge @ (a - [1.0, 0.0])
        step = np.linalg.solve((features * (weights * p * (1 - p))[:, None]).T @ features + ridge, grad)
        a -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a[0]), 1e-3), float(a[1])


def log_odds(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def like_order(text: np.ndarray, term: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Examples so that those of one label and of like common words come together, which makes the blocks' bounds tight."""
    n = len(label)
    common = np.argsort(-np.bincount(term), kind="stable")[:256] if len(term) else term
    own = np.isin(term, common)
    order = np.lexsort((term[own], -weight[own], text[own]))
    text, term = text[own][order], term[own][order]
    best = np.full(n, -1)
    first = np.flatnonzero(np.diff(text, prepend=-1) != 0)
    best[text[first]] = term[first]
    return np.lexsort((np.arange(n), best, label))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = 2000, k: int = 15, threshold: float = 0.7, relevance: float = 2.0) -> DataFrame:
    """A row for each row of docs: <id_col>, score, predicted, evidence (example id, label, similarity; nearest first).

    labels may only hold rows one may learn from; null labels are left out.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = share.get(1, 0) / sum(share.values()) if share else 0.5
    picked = None
    for y in (0, 1):
        own = known.where(F.col("label") == y).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_examples)
        picked = own if picked is None else picked.union(own)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE_BYTES):
            unique, which, ends = words(b.column(1))
            own, lo = [], 0
            for hi in ends.tolist():
                at, times = np.unique(which[lo:hi], return_counts=True)
                found: dict[str, int] = {}
                for w, n in zip(unique.take(pa.array(at)).to_pylist(), times.tolist(), strict=True):
                    if w:
                        found[w] = found.get(w, 0) + n
                own.append(found)
                lo = hi
            yield pa.RecordBatch.from_arrays([pc.cast(b.column(0), pa.string()), b.column(2), pa.array([list(x) for x in own], pa.list_(pa.string())), pa.array([list(x.values()) for x in own], pa.list_(pa.int32()))], ["id", "label", "words", "times"])

    sample = texts.join(F.broadcast(picked), "id").select(F.col("id").cast("string").alias("id"), "text", "label")  # 2 * max_examples ids at most
    found = sample.mapInArrow(listed, "id string, label int, words array<string>, times array<int>").toArrow().combine_chunks().sort_by([("label", "ascending"), ("id", "ascending")])
    label = found["label"].to_numpy().astype(np.float64)
    taken = {y: int((label == y).sum()) for y in (0, 1)}
    many = pc.list_value_length(found["words"]).to_numpy()
    without = {y: float(((label == y) & (many == 0)).sum() * share.get(y, 0) / max(1, taken[y])) for y in (0, 1)}  # examples without a word
    coded = pc.list_flatten(found["words"]).combine_chunks().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary)
    terms = coded.dictionary.take(by_name).cast(pa.large_string())
    term = np.argsort(by_name.to_numpy())[coded.indices.to_numpy()].astype(np.int64) if len(coded) else np.empty(0, np.int64)
    text, times = np.repeat(np.arange(len(many)), many), pc.list_flatten(found["times"]).to_numpy().astype(np.int64)
    order = np.lexsort((term, text))
    text, term, times = text[order], term[order], times[order]
    ends = np.cumsum(many)
    alike: dict[bytes, list[int]] = {}
    for i, (lo, hi) in enumerate(zip((ends - many).tolist(), ends.tolist(), strict=True)):
        if hi > lo:
            alike.setdefault(hashlib.sha256(bytes([int(label[i])]) + term[lo:hi].tobytes() + times[lo:hi].tobytes()).digest(), []).append(i)
    first = np.array([x[0] for x in alike.values()], np.int64)
    each = {y: share.get(y, 0) / max(1, taken[y]) for y in (0, 1)}  # labels that an example stands for
    curve, blank, model = (1.0, 0.0), prior, None
    if taken[0] and taken[1] and len(first) > 1:
        place = np.full(len(many), -1)
        place[first] = np.arange(len(first))
        use = place[text] >= 0
        text, term, times = place[text[use]], term[use], times[use]
        ids, ys, sizes = found["id"].take(pa.array(first)).to_pylist(), label[first], np.array([len(x) for x in alike.values()], np.float64)
        n_docs, df = document_frequencies(texts, terms, "text")
        weight = np.log((1 + n_docs) / (1 + df)) + 1
        a, c = np.bincount(term, ys[text] * sizes[text]), np.bincount(term, (1 - ys[text]) * sizes[text])
        weight = weight * np.log2(2 + a / np.maximum(1, c)) ** relevance
        w = weighed(text, term, times, weight, len(ids))
        order = like_order(text, term, w, ys)
        place = np.argsort(order)
        text = place[text]
        by = np.lexsort((term, text))
        text, term, w = text[by], term[by], w[by]
        ids, ys, sizes = [ids[i] for i in order], ys[order], sizes[order]
        votes = sizes * np.where(ys == 1, each[1], each[0])
        model = (terms, weight, text.astype(np.int32), term.astype(np.int32), w, ids, ys, votes)
    del found, coded, by_name, text, term, times, order  # the driver keeps no more than the model
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def made() -> BlockMaxIndex:
        _, weight, text, term, w, ids, _, _ = sent.value
        return BlockMaxIndex(text, term.astype(np.int64), w, len(ids), len(weight))

    def index() -> BlockMaxIndex:
        return held(key, made)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vote on each example by the others."""
        _, _, text, term, w, ids, ys, votes = sent.value
        sizes = votes / np.where(ys == 1, each[1], each[0])
        for b in batches:
            number, found = b.column(0).to_numpy(), []
            lo, hi = np.searchsorted(text, [number[0], number[-1] + 1])
            own = text[lo:hi].astype(np.int64) - number[0], term[lo:hi].astype(np.int64), w[lo:hi]
            for e, (near, s) in zip(number.tolist(), index().nearest(*own, b.num_rows, k + 1), strict=True):
                rest = np.where(near == e, (sizes[near] - 1) / sizes[near], 1.0)
                at = rest > 1e-9
                found.append(vote(s[at][:k], ys[near][at][:k], (votes[near] * rest)[at][:k], prior))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["id", "vote"])
        forget()

    if model:
        loo = spark.range(0, len(ids), 1, max(1, len(ids) // 200)).mapInArrow(left_out, "id long, vote double").orderBy("id").toArrow()["vote"].to_numpy()  # 8 bytes an example
        curve = logistic(np.array([*loo, prior, prior]), np.array([*ys, 0, 1]), np.array([*votes, without[0], without[1]]))
        blank = 1 / (1 + math.exp(-(curve[0] * float(log_odds(prior)) + curve[1])))
    slope, start = curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("similarity", pa.float64())]))
        if model_ := sent.value:
            terms, weight, _, _, _, ids, ys, votes = model_
        for b in slices(batches, most=SLICE_BYTES):
            scores, proof = [blank] * b.num_rows, [[]] * b.num_rows
            if model_:
                own = counted(b.column(1), terms)
                for i, (near, s) in enumerate(index().nearest(*own[:2], weighed(*own, weight, b.num_rows), b.num_rows, k)):
                    if len(near):
                        odds = float(log_odds(vote(s, ys[near], votes[near], prior)))
                        scores[i] = 1 / (1 + math.exp(-(slope * odds + start)))
                        proof[i] = [{"id": ids[e], "label": int(ys[e]), "similarity": x} for e, x in zip(near.tolist(), np.round(s, 6).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(proof, kind)], ["id", "score", "evidence"])
        forget()

    near = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("evidence", near)])
    out = texts.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The rows of docs that toxicity_scores() doesn't predict as 1, all columns kept. Rows that repeat an id go if one of them is toxic."""
    (bad,) = fresh(docs, "bad")
    gone = stage(toxicity_scores(docs, labels, id_col, text_col, **how).where("predicted = 1").select(F.col(id_col).alias(bad)).distinct(), "toxicity-bad")
    return met(docs, gone, {bad: F.col(id_col)}, "left_anti")
