"""Many queries against a table whose rows stay where they are: blocks of queries go to the tasks, which keep k rows a query.

A block of queries is sent as matrix or postings of bounded size; a task scores its rows in Arrow batches and hands on at most k rows a
query. No row of the corpus is shuffled, and a word that every text and every query has costs additions, not a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..session import scratch

#: Entries of query vectors (a word or a dimension each) that are sent at once.
BLOCK_ENTRIES = 1_000_000
#: Queries that are sent at once.
BLOCK_QUERIES = 2000
#: Scores held at once.
CELLS = 1 << 19
#: Words of texts (or numbers of vectors) that are scored at once, and products with the queries' weights; a longer text is taken alone.
WORDS, PRODUCTS = 1 << 18, 1 << 20
#: Candidates that a task holds before it drops those beyond the k best of their query.
HELD = 1 << 18

#: From a batch of rows to its scores, rows by queries, and which of them count (None: all).
Score = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]]


class Best:
    """The k best rows of each of n queries; ties, at 9 places, go to the smaller id."""

    def __init__(self, n: int, k: int, ascending: bool) -> None:
        self.k, self.sign = k, -1.0 if ascending else 1.0
        self.least = np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, scores: np.ndarray, there: np.ndarray | None, ids: pa.Array) -> None:
        scores = np.round(scores * self.sign, 9)
        good = scores >= self.least
        if there is not None:
            good &= there
        row, query = np.nonzero(good)
        self.held.append((query, scores[row, query], ids.take(pa.array(row))))
        self.size += len(row)
        if self.size > HELD:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        query, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        ids = pa.chunked_array([h[2] for h in self.held]).combine_chunks()
        order = pc.sort_indices(pa.table({"q": query, "s": -score, "id": ids}), sort_keys=[("q", "ascending"), ("s", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        self.least[query[place == self.k - 1]] = score[order[place == self.k - 1]]
        kept = order[place < self.k]
        self.held = [(query[place < self.k], score[kept], ids.take(pa.array(kept)))]
        self.size = len(kept)
        return self.held[0]


def slices(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """b in parts of at most most rows and, by its second column of lists (or of codes, whose items are bytes), WORDS items, whatever the batch's own size."""
    sizes = pc.list_value_length if pa.types.is_nested(b.column(1).type) else pc.binary_length
    ends = np.cumsum(sizes(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right"))
        end = max(at + 1, min(end, at + most))
        yield b.slice(at, end - at)
        at = end


def best_rows(rows: DataFrame, query_ids: pa.Array, k: int, make: Callable[[], Score], ascending: bool = False) -> DataFrame:
    """(query_id, unique_id, score): of each task at most k rows a query. rows: unique_id first; make, called in the task, gives a
    function from a batch of rows to its scores and which of them count."""
    n = len(query_ids)
    step = max(1, CELLS // max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, best, kind = make(), Best(n, k, ascending), None
        for b in batches:
            kind = b.column(0).type
            for part in slices(b, step):
                best.add(*score(part), part.column(0))
        if best.held:
            query, scores, ids = best.reduce()
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)), ids.cast(kind), pa.array(scores * best.sign)], ["query_id", "unique_id", "score"])

    query_type = T.StructField("query_id", from_arrow_type(query_ids.type))
    return rows.mapInArrow(run, T.StructType([query_type, rows.schema["unique_id"], T.StructField("score", T.DoubleType())]))


def blocks(queries: DataFrame, entries: int, ids: DataFrame | None = None) -> list[DataFrame]:
    """queries (query_id, ...) in blocks of bounded size, by hash of the id. entries: what all of them hold together; ids: rows with the
    same ids that are cheaper to count."""
    n = max(1, -(-entries // BLOCK_ENTRIES), -(-(ids or queries).select("query_id").distinct().count() // BLOCK_QUERIES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def by_block(queries: DataFrame, entries: int, run: Callable[[DataFrame], DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """run(block) of every block of queries, see blocks(). With several, each is run and staged before the next is made, so that the driver and the
    tasks hold one block at a time."""
    own = blocks(queries, entries, ids)
    if len(own) == 1:
        return run(own[0])
    path, schema = scratch(queries.sparkSession, "blocks"), None
    for i, block in enumerate(own):
        found = run(block)
        schema = found.schema
        found.write.parquet(f"{path}/block={i}")
    return queries.sparkSession.read.schema(schema).parquet(*[f"{path}/block={i}" for i in range(len(own))])


def word_counts(words: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, how often) of the terms in lists of words, ordered by row and term, and the lists' lengths."""
    lengths = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    term = pc.index_in(words.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    known = term >= 0
    key, times = np.unique(row[known] * max(1, len(terms)) + term[known], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), times, lengths


class Postings:
    """Query weights by term."""

    def __init__(self, table: pa.Table) -> None:
        """table: query_id, term, weight"""
        self.query_ids = pc.unique(table["query_id"])
        self.query_ids = self.query_ids.combine_chunks() if isinstance(self.query_ids, pa.ChunkedArray) else self.query_ids
        self.terms = pc.unique(table["term"])
        query = pc.index_in(table["query_id"], value_set=self.query_ids).to_numpy().astype(np.int64)
        term = pc.index_in(table["term"], value_set=self.terms).to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order], table["weight"].to_numpy().astype(np.float64)[order]
        self.at = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def scores(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of n rows, from (row, term, weight), with every query, and which of them have a term in common."""
        from_, many = self.at[term], self.at[term + 1] - self.at[term]
        first = np.searchsorted(row, np.arange(n + 1))  # rows ascend
        done = np.concatenate([[0], np.cumsum(many)])[first]  # products before each row
        scores, there = np.zeros((n, len(self.query_ids))), np.zeros((n, len(self.query_ids)), bool)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PRODUCTS, "right")) - 1)
            own = slice(first[lo], first[hi])
            ends = np.cumsum(many[own])
            post = np.repeat(from_[own] - ends + many[own], many[own]) + np.arange(ends[-1] if len(ends) else 0)
            cell = np.repeat(row[own] - lo, many[own]) * len(self.query_ids) + self.query[post]
            scores[lo:hi] = np.bincount(cell, np.repeat(weight[own], many[own]) * self.weight[post], (hi - lo) * len(self.query_ids)).reshape(hi - lo, -1)
            there[lo:hi].reshape(-1)[cell] = True
            lo = hi
        return scores, there


def whole(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there, without nulls in it."""
    return vectors.where(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull()))


def matrix(vectors: pa.Array, dims: int | None = None) -> np.ndarray:
    """Vectors without nulls as rows; all must have dims, or as many dimensions as the first."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    dims = dims if dims is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths != dims).any():
        raise ValueError(f"vectors of {sorted({*lengths.tolist(), dims})} dimensions")
    return np.asarray(vectors.flatten()).astype(np.float64).reshape(len(vectors), dims)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, unique_id, score) of vectors (unique_id, embedding) for queries (query_id, embedding), k a task; by inner product (ip)
    or squared distance (l2). Null vectors, and those with nulls in them, neither ask nor are found; vectors of another length are an error."""
    queries = whole(queries.select("query_id", "embedding"))
    vectors = whole(vectors.select("unique_id", "embedding"))
    first = queries.select(F.size("embedding")).first()

    def block(own: DataFrame) -> DataFrame:
        asked = own.toArrow()
        wanted = matrix(asked["embedding"].combine_chunks(), first[0] if first else 0)

        def make() -> Score:
            def score(b: pa.RecordBatch) -> tuple[np.ndarray, None]:
                if not len(wanted):
                    return np.zeros((b.num_rows, 0)), None
                x = matrix(b.column(1), wanted.shape[1])
                inner = x @ wanted.T
                if metric == "ip":
                    return inner, None
                return np.maximum((x * x).sum(1)[:, None] + (wanted * wanted).sum(1)[None] - 2 * inner, 0.0), None

            return score

        return best_rows(vectors, asked["query_id"].combine_chunks(), k, make, metric == "l2")

    return by_block(queries, (first[0] if first else 0) * queries.count(), block)
