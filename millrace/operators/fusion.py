"""What follows retrieval: parents, fusion, reranking, context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, which should be unique within the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def ranks_without_gaps(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*(order or ["rank"]))))


def to_parents(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Children by their parent, others as they are; rows whose parent or id docs lacks go. Each id stays once, at its best rank.

    docs: (unique_id, parent_id). Two joins for all hits of all queries.
    """
    own = ranked.join(docs.select("unique_id", "parent_id"), "unique_id")
    target = own.withColumn("target", F.coalesce("parent_id", "unique_id")).drop("unique_id", "parent_id")
    known = target.join(docs.select(F.col("unique_id").alias("target")).distinct(), "target", "left_semi").withColumnRenamed("target", "unique_id")
    return ranks_without_gaps(first_seen(known, ["query_id", "unique_id"], ["rank"]))


def wrrf(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of RANKED lists; ties keep the order of first sight (list, then rank)."""
    rows = None
    for i, (df, weight) in enumerate(lists):
        own = df.select("query_id", "unique_id", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("at")).alias("seen"))
        rows = own if rows is None else rows.unionByName(own)
    fused = rows.groupBy("query_id", "unique_id").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def merge_docs(first: DataFrame, second: DataFrame, docs: DataFrame, use_wrrf: bool = True, weight: float = 0.7) -> DataFrame:
    """Two RANKED lists as parents, fused or put one after the other without repeats."""
    a, b = to_parents(first, docs), to_parents(second, docs)
    if use_wrrf:
        return wrrf([(a, weight), (b, weight)])
    rows = a.select("query_id", "unique_id", F.lit(0).alias("list"), "rank").unionByName(b.select("query_id", "unique_id", F.lit(1).alias("list"), "rank"))
    return ranks_without_gaps(first_seen(rows, ["query_id", "unique_id"], ["list", "rank"]), ["list", "rank"])


def rerank(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best by score; equals keep their order (column rank)."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "input_rank")
    return candidates.withColumn("input_rank", F.col("rank")).withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_overlap(query_words: Column | str, doc_words: Column | str) -> Column:
    """Share of the query's distinct words that the document has: the reranker without a model."""
    q = F.array_distinct(query_words)
    return F.size(F.array_intersect(q, doc_words)) / F.greatest(F.size(q), F.lit(1))


def contexts(ranked: DataFrame, texts: DataFrame, style: str = "【{}】", most: int | None = None) -> DataFrame:
    """(query_id, context): the numbered texts of each query in rank order. texts: (unique_id, page_content)."""
    own = ranked.join(texts.select("unique_id", "page_content"), "unique_id")
    lists = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_content"))).alias("docs"))  # k a query
    context = X.numbered_context(F.col("docs.page_content"), style)
    return lists.select("query_id", (X.truncated(context, most) if most else context).alias("context"))


def cited_sources(responses: DataFrame, ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, answer, cite_pages, related_images): numbers in the response by rank to documents; out of range ones go.

    responses: (query_id, response); docs: (unique_id, page, images_info). Refusals cite nothing.
    """
    cites = responses.select("query_id", F.explode(X.cite_numbers("response")).alias("rank"))
    hits = cites.join(ranked.select("query_id", "rank", "unique_id"), ["query_id", "rank"]).join(docs.select("unique_id", "page", "images_info"), "unique_id")
    titled = F.filter("images_info", lambda i: F.coalesce(i["title"], F.lit("")) != "")
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", titled.alias("images")))), lambda x: x["images"])).alias("images"))
    answer = X.without_cites("response")
    out = responses.join(found, "query_id", "left")
    none = X.is_refusal(answer)
    pages, images = docs.schema["page"].dataType.simpleString(), docs.schema["images_info"].dataType.simpleString()
    return out.select("query_id", answer.alias("answer"), F.when(none | F.col("pages").isNull(), F.array().cast(f"array<{pages}>")).otherwise(F.col("pages")).alias("cite_pages"), F.when(none | F.col("images").isNull(), F.array().cast(images)).otherwise(F.col("images")).alias("related_images"))


def retry_candidates(answers: DataFrame, ranked: DataFrame, top: int = 3) -> DataFrame:
    """The top documents of queries that were refused although they had more than top."""
    many = ranked.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > top)
    refused = answers.where(F.trim("answer").isin("无答案", "无", "")).select("query_id").join(many, "query_id", "left_semi")
    return ranked.where(F.col("rank") <= top).join(refused, "query_id", "left_semi")


def looked_up(rows: DataFrame, docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns of the document of their key; those of an unknown key are null. A key that docs repeats counts once."""
    own = docs.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
    return rows.join(own, key, "left")


def with_next(rows: DataFrame, group: list[str], order: str, column: str) -> DataFrame:
    """rows with the column of the row after, by order in the group, as next; null in the last."""
    return rows.withColumn("next", F.lead(column).over(Window.partitionBy(*group).orderBy(order)))
