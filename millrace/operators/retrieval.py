"""Index tables and batch retrieval: BM25, TF-IDF, dense, sparse and hybrid.

Every search takes many queries at once and returns RANKED rows (query_id, unique_id, score, rank). Scores are rounded to 9 places before
ranking and ties go to the smaller id, so ranks are the same on any partitioning. Texts and vectors are scored where they stand
(scoring.py): the queries' weights go to the tasks in blocks, and of each task k rows a query go on. Sparse vectors that are given as
rows are joined with the queries' terms, which the term filter and the k rows a task (WindowGroupLimit) keep small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import scratch
from . import scoring

#: Terms of the corpus whose document frequencies are sent to all tasks, those of greatest frequency.
FREQUENT_TERMS = 500_000


def top_k(scored: DataFrame, k: int, ascending: bool = False, tie: str = "unique_id") -> DataFrame:
    score = F.round("score", 9)
    order = Window.partitionBy("query_id").orderBy(score.asc() if ascending else score.desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_counts(df: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, term, tf)"""
    return df.select(F.col(id_col), F.explode(words).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def counted_rows(docs: DataFrame, dims: int | None = None) -> DataFrame:
    """(unique_id, doc_len, terms, times): the words of docs (unique_id, words), counted in their own row, so that no word is shuffled; null words are
    no terms, but count in doc_len. dims: only so many terms a row, the most frequent ones, of equal counts those that sort first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in scoring.slices(b, b.num_rows):
                words = part.column(1)
                lengths = pc.list_value_length(words)
                n = lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = words.flatten().dictionary_encode()
                term = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, size, known = np.repeat(np.arange(len(n)), n), max(1, len(coded.dictionary)), term >= 0
                key, times = np.unique(row[known] * size + term[known], return_counts=True)
                row, term = key // size, key % size
                if dims is not None:
                    by_name = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())
                    order = np.lexsort((by_name[term], -times, row))
                    row, term, times = row[order], term[order], times[order]
                    use = np.arange(len(row)) - np.searchsorted(row, row, side="left") < dims
                    row, term, times = row[use], term[use], times[use]
                at = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(term)))
                yield pa.RecordBatch.from_arrays([part.column(0), lengths, terms, pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], ["unique_id", "doc_len", "terms", "times"])

    kinds = T._parse_datatype_string("doc_len int, terms array<string>, times array<long>").fields
    return docs.select("unique_id", "words").mapInArrow(run, T.StructType([docs.schema["unique_id"], *kinds]))


@dataclass
class LexicalIndex:
    """docs: (unique_id, words), a row a document. Frequencies are combined map-side, in one pass with the totals, and staged."""

    docs: DataFrame
    _rows: DataFrame | None = None
    _counted: DataFrame | None = None
    _totals: Row | None = None

    def rows(self) -> DataFrame:
        """counted_rows() of docs, worked out once for the index and staged; what is asked for later comes from them."""
        if self._rows is None:
            own = counted_rows(self.docs)
            path = scratch(self.docs.sparkSession, "counted")
            own.write.parquet(path)
            self._rows = self.docs.sparkSession.read.schema(own.schema).parquet(path)
        return self._rows

    def counted(self) -> DataFrame:
        """(term, df, texts, len): a row a term, and one without a term for all documents: how many, how many with words, and their words together."""
        if self._counted is None:
            words, size = (F.array_distinct(F.coalesce("words", F.array().cast("array<string>"))), F.size("words")) if self._rows is None else (F.col("terms"), F.col("doc_len"))
            every = F.concat(words, F.array(F.lit(None).cast("string")))
            rows = (self.docs if self._rows is None else self._rows).select(F.explode(every).alias("term"), size.cast("long").alias("len"))
            whole = F.col("term").isNull()
            own = rows.groupBy("term").agg(F.count("*").alias("df"), F.count(F.when(whole, F.col("len"))).alias("texts"), F.sum(F.when(whole, F.col("len"))).alias("len"))
            path = scratch(self.docs.sparkSession, "terms")
            own.write.parquet(path)
            self._counted = self.docs.sparkSession.read.schema(own.schema).parquet(path)
        return self._counted

    def totals(self) -> Row:
        """n_docs and avg_len, counted once for the index."""
        if self._totals is None:
            found = self.counted().where("term IS NULL").first()
            self._totals = Row(n_docs=found["df"] if found else 0, avg_len=found["len"] / found["texts"] if found and found["texts"] else None)
        return self._totals

    def lengths(self) -> DataFrame:
        return self.rows().select("unique_id", "doc_len")

    def frequencies(self) -> DataFrame:
        """(term, df)"""
        return self.counted().where("term IS NOT NULL").select("term", "df")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(unique_id, doc_len, term, tf), of the given terms only if there are any."""
        own = self.rows().select("unique_id", "doc_len", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("unique_id", "doc_len", F.col("t.terms").alias("term"), F.col("t.times").alias("tf"))
        return own if terms is None else own.join(terms.select("term").distinct(), "term", "left_semi").select(own.columns)


def lexical_index(docs: DataFrame, id_col: str = "unique_id", text_col: str = "page_content", tokenizer=X.tokens) -> LexicalIndex:
    return LexicalIndex(docs.select(F.col(id_col).alias("unique_id"), tokenizer(text_col).alias("words")))


def bm25_idf(index: LexicalIndex, epsilon: float = 0.25) -> DataFrame:
    """(term, idf): negative values become epsilon times the mean over all terms."""
    n_docs = index.totals()["n_docs"]
    raw = index.frequencies().select("term", (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))  # one row, of the frequencies counted once
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def _best_texts(docs: DataFrame, weights: DataFrame, asked: DataFrame, k: int, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """RANKED rows of docs (unique_id, words, ...) by inner product with weights (query_id, term, weight), which has a row for some of
    asked (query_id, term). weigh: from (row, times, lengths
    of the rows, batch) to the weight of each term in its row."""
    weights = weights.select("query_id", "term", F.col("weight").cast("double").alias("weight"))

    def block(own: DataFrame) -> DataFrame:
        postings = scoring.Postings(own.toArrow())

        def make() -> scoring.Score:
            def score(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
                row, term, times, lengths = scoring.word_counts(b.column(1), postings.terms)
                return postings.scores(row, term, weigh(row, times, lengths, b), b.num_rows)

            return score

        return scoring.best_rows(docs, postings.query_ids, k, make)

    return top_k(scoring.by_block(weights, asked.count(), block, asked), k)


def bm25(index: LexicalIndex, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """queries: (query_id, words); words that repeat count as often. Documents without a common term have no row."""
    asked = term_counts(queries, "query_id", F.col("words"))
    weights = asked.join(bm25_idf(index), "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    mean = float(index.totals()["avg_len"] or 1.0)

    def weigh(row: np.ndarray, times: np.ndarray, lengths: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        return times * (k1 + 1) / (times + k1 * (1 - b + b * lengths[row] / mean))

    return _best_texts(index.docs.select("unique_id", "words"), weights, asked, k, weigh)


def tfidf(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """Cosine of smooth TF-IDF vectors; documents without a common term have no row.

    A document's norm is added up in its own row from the frequencies of FREQUENT_TERMS terms; the postings of rarer terms, if there are
    any, are shuffled by term and their share of the norm is joined to the document.
    """
    docs, n_docs = index.docs.select("unique_id", "words"), index.totals()["n_docs"]
    all_terms = index.frequencies().withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)
    frequent = all_terms.orderBy(F.desc("df"), "term").limit(FREQUENT_TERMS).select("term", "idf").toArrow()
    terms, idf = frequent["term"].combine_chunks(), frequent["idf"].to_numpy()
    sent = index.docs.sparkSession.sparkContext.broadcast((terms, idf))
    rare = None
    if len(terms) == FREQUENT_TERMS:
        few = all_terms.where(F.col("df") <= all_terms.orderBy(F.desc("df"), "term").limit(FREQUENT_TERMS).agg(F.min("df")).first()[0])
        known = index.docs.sparkSession.createDataFrame(frequent.select(["term"]))
        few = few.join(known, "term", "left_anti")
        squares = rare_counts(docs, sent).join(few, "term").groupBy("unique_id").agg(F.sum((F.col("tf") * F.col("idf")) ** 2).alias("rare"))
        rare = docs.join(squares, "unique_id", "left").select("unique_id", "words", F.coalesce("rare", F.lit(0.0)).alias("rare"))
    # every term's frequency is known already unless there are more than that
    terms_idf = all_terms.select("term", "idf") if rare is not None else index.docs.sparkSession.createDataFrame(frequent)
    asked = term_counts(queries, "query_id", F.col("words"))
    weights = tfidf_weights(asked, terms_idf, "query_id").join(terms_idf, "term").select("query_id", "term", (F.col("weight") * F.col("idf")).alias("weight"))

    def weigh(row: np.ndarray, times: np.ndarray, _: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        own_terms, own_idf = sent.value
        at, term, n, _ = scoring.word_counts(b.column(1), own_terms)
        norm = np.bincount(at, (n * own_idf[term]) ** 2, b.num_rows) + (b.column(2).to_numpy() if b.num_columns > 2 else 0.0)
        return times / np.sqrt(np.where(norm > 0, norm, 1.0))[row]

    return _best_texts(docs if rare is None else rare, weights, asked, k, weigh)


def rare_counts(docs: DataFrame, frequent: Broadcast) -> DataFrame:
    """(unique_id, term, tf) of the terms of docs (unique_id, words) that are not in frequent (a broadcast pair, terms first): counted in each
    row, so that no posting of a frequent term is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in scoring.slices(b, b.num_rows):
                words = pc.unique(part.column(1).flatten()).drop_null()
                rare = words.filter(pc.invert(pc.is_in(words, value_set=frequent.value[0])))
                row, term, times, _ = scoring.word_counts(part.column(1), rare)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), rare.take(pa.array(term)), pa.array(times, pa.int64())], ["unique_id", "term", "tf"])

    schema = T.StructType([docs.schema["unique_id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return docs.select("unique_id", "words").mapInArrow(run, schema)


def tfidf_weights(counts: DataFrame, idf: DataFrame, id_col: str) -> DataFrame:
    """(id, term, weight) of length 1 an id."""
    w = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    return w.select(id_col, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))).alias("weight"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column | str) -> Column:
    norms = F.array_repeat(F.sqrt(dot(v, v)), F.size(v))  # worked out once a vector; inside the function it would be once an element
    return F.zip_with(v, norms, lambda x, n: F.when(n > 0, x / n).otherwise(x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """vectors: (unique_id, embedding), queries: (query_id, embedding); metric ip (greater is better) or l2 (squared, less is better).

    Exact, by matrix products of the corpus's batches with blocks of queries.
    """
    return top_k(scoring.nearest_vectors(vectors, queries, k, metric), k, ascending=metric == "l2")


def sparse_vectors(df: DataFrame, id_col: str, words: Column, dims: int = 200) -> DataFrame:
    """(id, term, weight): log1p of counts, the dims greatest an id; a stand-in for a learned sparse encoder."""
    w = term_counts(df, id_col, words).select(id_col, "term", F.log1p("tf").alias("weight")).where("weight > 0")
    order = Window.partitionBy(id_col).orderBy(F.desc("weight"), "term")
    return w.withColumn("place", F.row_number().over(order)).where(F.col("place") <= dims).drop("place")


def sparse_rows(docs: DataFrame, dims: int = 200) -> DataFrame:
    """sparse_vectors() of docs (unique_id, words), a row a text: (unique_id, terms, weights). What is in a text is decided in its own row."""
    return counted_rows(docs, dims).select("unique_id", "terms", F.transform("times", F.log1p).alias("weights"))


def sparse(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Inner product over (unique_id, term, weight) and (query_id, term, weight)."""
    asked = queries.select("query_id", "term", F.col("weight").alias("q_weight"))
    return top_k(vectors.join(asked, "term").groupBy("query_id", "unique_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score")), k)


def sparse_texts(docs: DataFrame, queries: DataFrame, k: int, dims: int = 200) -> DataFrame:
    """sparse() of sparse_vectors(): docs (unique_id, words) and queries (query_id, words). A text's dims are chosen in its own row."""
    weights = sparse_vectors(queries, "query_id", F.col("words"), dims)

    def block(own: DataFrame) -> DataFrame:
        postings = scoring.Postings(own.toArrow())

        def make() -> scoring.Score:
            def score(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
                every = pc.unique(b.column(1).flatten())
                every = every.take(pc.sort_indices(every))  # so that equal weights go by term
                row, term, times, _ = scoring.word_counts(b.column(1), every)
                order = np.lexsort((term, -times, row))
                row, term, times = row[order], term[order], times[order]
                place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
                number = pc.index_in(every, value_set=postings.terms).fill_null(-1).to_numpy(zero_copy_only=False)[term]
                use = (place < dims) & (number >= 0)
                return postings.scores(row[use], number[use].astype(np.int64), np.log1p(times[use]), b.num_rows)

            return score

        return scoring.best_rows(docs.select("unique_id", "words"), postings.query_ids, k, make)

    return top_k(scoring.by_block(weights, weights.count(), block), k)


def normed(score: Column, how: str) -> Column:
    if how == "arctan":
        return F.atan(score) * 2 / F.lit(3.141592653589793)
    if how == "none":
        return score
    raise ValueError(f"unknown normalisation {how}")


def weighted_hybrid(parts: list[tuple[DataFrame, float]], k: int, norm: str = "arctan") -> DataFrame:
    """RANKED lists by weighted, normalised score; an id that one list lacks gets nothing from it."""
    rows = None
    for df, weight in parts:
        own = df.select("query_id", "unique_id", (F.lit(weight) * normed(F.col("score"), norm)).alias("part"))
        rows = own if rows is None else rows.unionByName(own)
    return top_k(rows.groupBy("query_id", "unique_id").agg(F.sum("part").alias("score")), k)
