"""A lexical index on disk that is searched: postings bucketed by term, in blocks with maxima, and bounds that let searches skip blocks.

Documents are dealt to shards by hash and numbered within their shard by id. A shard's numbers fall into ranges of RANGE documents; a row of the
postings table is what one term has in one range: the numbers, values (counts or weights) and lengths of its documents, with the greatest
value and the least length. As the ranges of all terms are the same, the greatest score that a range can give to a query is a sum over the
query's terms.

The table is partitioned by a hash of the term and sorted by term within its files, so a search reads the buckets and, by the
files' statistics, the pages of the terms it asks for. What it reads is brought together by shard, a bounded group. There a query's ranges are
scored by falling bound until the next bound is below the k-th score; every SEED_SHARDS-th shard is searched first, and what it gives is a
floor for all others. Bounds are never below the scores, so results are those of a full search.

More documents are appended as new shards; nothing that is there is written again but the one row of totals. A document that is appended twice is
in the index twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, scratch
from . import scoring
from .retrieval import counted_rows, term_counts, top_k

SHARD_DOCS = 8192
RANGE = 128
#: Postings in a bucket, about.
BUCKET_POSTINGS = 4_000_000
MOST_BUCKETS = 1024
#: One shard in so many is searched first.
SEED_SHARDS = 64
#: Terms that go into the scan's filter; with more they are joined.
FILTER_TERMS = 10_000


TABLES = {
    "postings": "term string, shard int, range int, max_value double, min_len int, places array<int>, values array<double>, lengths array<int>, bucket int",
    "terms": "term string, df long, bucket int",
    "documents": "shard int, place int, unique_id {id_type}, doc_len int",
}
TOTALS = "n_docs long, n_terms long, total_len long, mean_idf double, buckets int, shards int, id_type string"


@dataclass(frozen=True)
class Bm25:
    """values are counts of a term in a document"""

    k1: float = 1.5
    b: float = 0.75

    def impact(self, value: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
        """Rises with value and falls with length, so that it bounds a range at its greatest value and least length."""
        return value * (self.k1 + 1) / (value + self.k1 * (1 - self.b + self.b * length / mean))

    def weights(self, asked: DataFrame, store: Store) -> DataFrame:
        t = store.totals
        raw = F.log(t["n_docs"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, 0.25 * t["mean_idf"]).otherwise(raw)
        return asked.join(store.frequencies(asked.select("term")), "term").select("query_id", "term", (F.col("value") * idf).alias("weight"))


@dataclass(frozen=True)
class InnerProduct:
    """values are weights of sparse vectors; those of queries count as they are"""

    def impact(self, value: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
        return value

    def weights(self, asked: DataFrame, store: Store) -> DataFrame:
        return asked.select("query_id", "term", F.col("value").alias("weight"))


@dataclass
class Store:
    """A saved index: its folder and its totals (see TOTALS)."""

    spark: SparkSession
    path: str
    totals: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name].format(**self.totals)).parquet(f"{self.path}/{name}")

    def bucket(self) -> Column:
        return F.pmod(F.hash("term"), F.lit(self.totals["buckets"]))

    def of_terms(self, name: str, terms: DataFrame) -> DataFrame:
        """The rows of a table that are of the given terms: by a filter that prunes the scan, or by a join that prunes it when it runs."""
        own = terms.select("term").distinct()
        few = [r["term"] for r in own.limit(FILTER_TERMS + 1).collect()]
        if len(few) <= FILTER_TERMS:
            named = own.sparkSession.createDataFrame([(t,) for t in few], "term string").select(self.bucket().alias("b")).distinct().collect() if few else []
            return self.table(name).where(F.col("bucket").isin([r["b"] for r in named]) & F.col("term").isin(few))
        return self.table(name).join(own.withColumn("bucket", self.bucket()), ["bucket", "term"], "left_semi")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df)"""
        return self.of_terms("terms", terms).groupBy("term").agg(F.sum("df").alias("df"))


def opened(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, spark.read.parquet(f"{path}/totals").first().asDict())


def _ranges(docs: DataFrame, shards: int, base: int) -> DataFrame:
    """The lists of docs (unique_id, terms, values, doc_len), a row a term and range; and for each range a row without a term, which has the ids and
    lengths of its documents. Documents are shuffled once, by shard: what follows groups within it.
    """
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64(F.col("unique_id").cast("string")), F.lit(shards)).cast("int") + base)
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("unique_id")) - 1)
    placed = placed.withColumn("range", F.floor(F.col("place") / RANGE).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        """table: the documents of a range, RANGE at most"""
        table = table.sort_by("place")
        place, length, ids = (table[c].combine_chunks() for c in ("place", "doc_len", "unique_id"))
        sizes = pc.list_value_length(table["terms"]).to_numpy().astype(np.int64)
        coded = pc.list_flatten(table["terms"]).combine_chunks().dictionary_encode()
        term, value = coded.indices.to_numpy(), pc.list_flatten(table["values"]).to_numpy()
        order = np.argsort(term, kind="stable")
        document, value = np.repeat(np.arange(len(sizes)), sizes)[order], value[order]
        first = np.searchsorted(term[order], np.arange(len(coded.dictionary)))
        ends = np.concatenate([first, [len(term), len(term)]])  # the last list is empty but for documents
        places, lengths = place.to_numpy()[document], length.to_numpy()[document]
        at = np.append(ends[:-1], len(term) + len(sizes))
        listed = lambda offsets, flat, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
        n = len(first)
        best = (np.maximum.reduceat(value, first), np.minimum.reduceat(lengths, first)) if n else (np.empty(0), np.empty(0, np.int32))
        one = lambda name: pa.repeat(table[name][0], n + 1)
        columns = {
            "term": pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]),
            "shard": one("shard"),
            "range": one("range"),
            "max_value": pa.array(np.append(best[0], 0.0), pa.float64()),
            "min_len": pa.array(np.append(best[1], 0), pa.int32()),
            "places": listed(at, np.concatenate([places, place.to_numpy()]), pa.int32()),
            "values": listed(ends, value, pa.float64()),
            "lengths": listed(at, np.concatenate([lengths, length.to_numpy()]), pa.int32()),
            "ids": pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n + 1), len(sizes)), pa.int32()), ids),
        }
        return pa.table(columns)

    id_type = docs.schema["unique_id"].dataType.simpleString()
    schema = TABLES["postings"].removesuffix(", bucket int") + f", ids array<{id_type}>"
    return placed.groupBy("shard", "range").applyInArrow(run, schema)


def _staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _written(store: Store, docs: DataFrame, base: int) -> Store:
    """Adds the shards of docs (unique_id, terms, values, doc_len) from number base on, then the new totals. Docs are worked out once and staged, and so
    are their lists, as ranges of terms are sampled before they are written."""
    spark, path = store.spark, store.path
    own, docs_path = _staged(docs.withColumn("n_terms", F.size("terms")), "lexical-docs")
    counts = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("len"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("postings")).first()
    shards = max(1, -(-counts["n"] // SHARD_DOCS))
    buckets = store.totals.get("buckets") or max(1, min(MOST_BUCKETS, -(-counts["postings"] // BUCKET_POSTINGS)))
    store.totals |= {"buckets": buckets, "shards": base + shards, "n_docs": store.totals.get("n_docs", 0) + counts["n"], "total_len": store.totals.get("total_len", 0) + counts["len"], "id_type": docs.schema["unique_id"].dataType.simpleString()}
    ranges, ranges_path = _staged(_ranges(own.drop("n_terms"), shards, base), "lexical-ranges")
    postings = ranges.where("term IS NOT NULL").drop("ids").withColumn("bucket", store.bucket())
    ranged = postings.repartitionByRange("bucket", "term", "shard").sortWithinPartitions("bucket", "term", "shard", "range")
    ranged.write.mode("append").partitionBy("bucket").option("parquet.block.size", 8 << 20).option("parquet.page.size", 64 << 10).parquet(f"{path}/postings")
    documents = ranges.where("term IS NULL").select("shard", F.explode(F.arrays_zip("places", "ids", "lengths")).alias("d"))
    documents.select("shard", F.col("d.places").alias("place"), F.col("d.ids").alias("unique_id"), F.col("d.lengths").alias("doc_len")).write.mode("append").parquet(f"{path}/documents")
    discard(spark, docs_path)
    discard(spark, ranges_path)
    new = store.table("postings").where(F.col("shard") >= base).groupBy("bucket", "term").agg(F.sum(F.size("places")).alias("df"))
    new.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{path}/terms")
    n = store.totals["n_docs"]
    terms = store.table("terms").groupBy("term").agg(F.sum("df").alias("df"))
    whole = terms.agg(F.count("*").alias("n"), F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean")).first()
    store.totals |= {"n_terms": whole["n"], "mean_idf": float(whole["mean"] or 0.0)}
    row = [tuple(store.totals[c.split()[0]] for c in TOTALS.split(", "))]
    spark.createDataFrame(row, TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return store


def _texts(docs: DataFrame) -> DataFrame:
    counted = counted_rows(docs.select("unique_id", F.coalesce("words", F.array().cast("array<string>")).alias("words")))
    return counted.select("unique_id", "terms", F.col("times").cast("array<double>").alias("values"), "doc_len")


def _vectors(rows: DataFrame) -> DataFrame:
    own = rows.where("term IS NOT NULL AND weight IS NOT NULL").groupBy("unique_id").agg(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("value"))).alias("t"))
    return own.select("unique_id", F.col("t.term").alias("terms"), F.col("t.value").alias("values"), F.size("t").alias("doc_len"))


def build_texts(docs: DataFrame, path: str) -> Store:
    """A new index at path, over docs (unique_id, words); ids are never null. A null list of words is an empty one."""
    return _written(Store(docs.sparkSession, path), _texts(docs), 0)


def build_vectors(rows: DataFrame, path: str) -> Store:
    """A new index over sparse vectors (unique_id, term, weight), a term once a vector."""
    return _written(Store(rows.sparkSession, path), _vectors(rows), 0)


def build_vector_rows(vectors: DataFrame, path: str) -> Store:
    """build_vectors() of vectors that come in a row each, (unique_id, terms, weights), without nulls in them: nothing is shuffled to make them."""
    own = vectors.select("unique_id", "terms", F.col("weights").cast("array<double>").alias("values"), F.size("terms").alias("doc_len"))
    return _written(Store(vectors.sparkSession, path), own, 0)


def append_texts(store: Store, docs: DataFrame) -> Store:
    return _written(store, _texts(docs), store.totals["shards"])


def append_vectors(store: Store, rows: DataFrame) -> Store:
    return _written(store, _vectors(rows), store.totals["shards"])


class ShardSearch:
    """Scores the ranges of one shard for a block of queries, best bounds first."""

    def __init__(self, postings: scoring.Postings, floors: np.ndarray, k: int, scorer: Bm25 | InnerProduct, mean: float) -> None:
        self.postings, self.floors, self.k, self.scorer, self.mean = postings, floors, k, scorer, mean
        order = np.argsort(postings.query, kind="stable")
        self.term = np.repeat(np.arange(len(postings.at) - 1), np.diff(postings.at))[order]
        self.weight = postings.weight[order]
        self.at = np.searchsorted(postings.query[order], np.arange(len(postings.query_ids) + 1))

    def found(self, table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
        """(query, places, scores, ranges there, ranges scored) of each query that has a term in the shard's rows."""
        one = lambda name: table[name].combine_chunks() if table.num_rows else table[name]
        flat = lambda name: np.asarray(one(name).flatten())
        term = np.asarray(pc.index_in(one("term"), value_set=self.postings.terms).fill_null(-1)).astype(np.int64)
        ranges = np.asarray(one("range")).astype(np.int64)
        sizes = np.asarray(pc.list_value_length(one("places"))).astype(np.int64)
        ends = np.cumsum(sizes)
        places, values, lengths = flat("places").astype(np.int64), flat("values"), flat("lengths").astype(np.float64)
        bound = self.scorer.impact(np.asarray(one("max_value")), np.asarray(one("min_len")).astype(np.float64), self.mean)
        order = np.argsort(term, kind="stable")
        first = np.searchsorted(term[order], np.arange(len(self.postings.terms) + 1))
        n_ranges = int(ranges.max()) + 1
        for q in range(len(self.postings.query_ids)):
            own = slice(self.at[q], self.at[q + 1])
            terms, weights = self.term[own], self.weight[own]
            many = first[terms + 1] - first[terms]
            if not many.sum():
                continue
            rows = order[_ragged(first[terms], many)]
            weight = np.repeat(weights, many)
            top = np.bincount(ranges[rows], np.maximum(weight, 0) * bound[rows], n_ranges)
            there = np.unique(ranges[rows])
            there = there[np.argsort(-top[there], kind="stable")]
            by = np.argsort(ranges[rows], kind="stable")
            start = np.searchsorted(ranges[rows][by], np.arange(n_ranges + 1))
            floor, done, step = self.floors[q], 0, 1
            best_place, best_score = np.empty(0, np.int64), np.empty(0)
            while done < len(there) and top[there[done]] >= floor - 1e-9:
                now = there[done : done + step]
                now = now[top[now] >= floor - 1e-9]
                pick = by[_ragged(start[now], start[now + 1] - start[now])]
                at = _ragged(ends[rows[pick]] - sizes[rows[pick]], sizes[rows[pick]])
                part = np.repeat(weight[pick], sizes[rows[pick]]) * self.scorer.impact(values[at], lengths[at], self.mean)
                place, which = np.unique(places[at], return_inverse=True)
                best_place = np.concatenate([best_place, place])
                best_score = np.concatenate([best_score, np.round(np.bincount(which, part), 9)])
                kept = np.lexsort((best_place, -best_score))[: self.k]
                best_place, best_score = best_place[kept], best_score[kept]
                if len(kept) == self.k:
                    floor = max(floor, best_score[-1])
                done, step = done + len(now), step * 2
            yield q, best_place, best_score, len(there), done


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each start and size, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _scored(store: Store, rows: DataFrame, asked: pa.Table, floors: np.ndarray, k: int, scorer: Bm25 | InnerProduct, query_type: T.DataType) -> DataFrame:
    """(query_id, shard, place, score, ranges, scored), k a shard and query; rows: the postings to search."""
    mean = (store.totals["total_len"] / store.totals["n_docs"] if store.totals["n_docs"] else 0) or 1.0
    sent = store.spark.sparkContext.broadcast((asked, floors))
    ids = scoring.Postings(asked).query_ids

    def run(table: pa.Table) -> pa.Table:
        asked, floors = sent.value
        search = ShardSearch(scoring.Postings(asked), floors, k, scorer, mean)
        parts = list(search.found(table))
        n = [len(p[1]) for p in parts]
        query = np.repeat([p[0] for p in parts], n).astype(np.int64)
        put = lambda i, kind: np.concatenate([np.empty(0, kind), *(p[i] for p in parts)]).astype(kind)
        counts = [np.repeat([p[i] for p in parts], n).astype(np.int64) for i in (3, 4)]
        shard = np.full(len(query), table["shard"][0].as_py(), np.int32)
        return pa.table([ids.take(pa.array(query)), pa.array(shard), pa.array(put(1, np.int32)), pa.array(put(2, np.float64)), *map(pa.array, counts)], names=["query_id", "shard", "place", "score", "ranges", "scored"])

    schema = T.StructType([T.StructField("query_id", query_type), *T._parse_datatype_string("shard int, place int, score double, ranges long, scored long").fields])
    return rows.groupBy("shard").applyInArrow(run, schema)


def searched(store: Store, queries: DataFrame, k: int, scorer: Bm25 | InnerProduct | None = None) -> DataFrame:
    """search() with the shard, and how many of the shard's ranges have a term of the query and how many were scored."""
    scorer = scorer or Bm25()
    if isinstance(scorer, Bm25):
        asked = term_counts(queries, "query_id", F.col("words")).select("query_id", "term", F.col("tf").cast("double").alias("value"))
    else:
        asked = queries.select("query_id", "term", F.col("weight").cast("double").alias("value"))
    weights = scorer.weights(asked.where("term IS NOT NULL"), store).select("query_id", "term", F.col("weight").cast("double").alias("weight"))

    def block(own: DataFrame) -> DataFrame:
        asked = own.toArrow()
        rows = store.of_terms("postings", own)
        ids = scoring.Postings(asked).query_ids
        floors = np.full(len(ids), -np.inf)
        if store.totals["shards"] > SEED_SHARDS:
            first = _scored(store, rows.where(F.col("shard") % SEED_SHARDS == 0), asked, floors, k, scorer, own.schema["query_id"].dataType)
            kth = top_k(first.withColumnRenamed("place", "unique_id"), k).where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query
            floors[np.asarray(pc.index_in(kth["query_id"].combine_chunks(), value_set=ids))] = np.asarray(kth["score"])
        return _scored(store, rows, asked, floors, k, scorer, own.schema["query_id"].dataType)

    hits = scoring.by_block(weights, asked.count(), block, asked)
    best = hits.join(store.table("documents").select("shard", "place", "unique_id"), ["shard", "place"])
    return top_k(best, k).select("query_id", "unique_id", "score", "rank", "shard", "ranges", "scored")


def search(store: Store, queries: DataFrame, k: int, scorer: Bm25 | InnerProduct | None = None) -> DataFrame:
    """RANKED rows (query_id, unique_id, score, rank) of a saved index, as bm25() or sparse() of the same corpus give them.

    queries: (query_id, words), or (query_id, term, weight) for InnerProduct.
    """
    return searched(store, queries, k, scorer).select("query_id", "unique_id", "score", "rank")


def skips(store: Store, queries: DataFrame, k: int, scorer: Bm25 | InnerProduct | None = None) -> DataFrame:
    """(query_id, ranges, scored): of the shards that gave one of the k best, how many ranges have a term of the query, and how many were scored."""
    by_shard = searched(store, queries, k, scorer).groupBy("query_id", "shard").agg(F.first("ranges").alias("ranges"), F.first("scored").alias("scored"))
    return by_shard.groupBy("query_id").agg(F.sum("ranges").alias("ranges"), F.sum("scored").alias("scored"))
