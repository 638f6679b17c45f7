"""Retrieval queries over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fusion, retrieval
from ..session import spread
from .catalogue import register

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_WORDS = f"""
d AS (SELECT doc_id, {_TOKENS} AS words FROM documents),
q AS (SELECT item_id, {_TOKENS} AS words FROM benchmark),
tok AS (SELECT doc_id, unnest(words) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, len(words) AS doc_len FROM d),
stats AS (SELECT count(*) AS n_docs, avg(len(words)) AS avg_len FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qtf AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(words) AS term FROM q) GROUP BY ALL)"""
_BM25 = f"""{_WORDS},
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
bs AS (SELECT item_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))) AS score
  FROM qtf JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (doc_id), stats GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs) WHERE rank <= 15)"""
_SPARSE = """
sw AS (SELECT * FROM (SELECT doc_id, term, ln(1 + tf) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY ln(1 + tf) DESC, term) AS p FROM tf) WHERE p <= 200),
qw AS (SELECT * FROM (SELECT item_id, term, ln(1 + times) AS q_weight, row_number() OVER (PARTITION BY item_id ORDER BY ln(1 + times) DESC, term) AS p FROM qtf) WHERE p <= 200),
ss AS (SELECT item_id, doc_id, sum(weight * q_weight) AS score FROM sw JOIN qw USING (term) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ss) WHERE rank <= 15)"""
_FUSED = """
parts AS (SELECT item_id, doc_id, 0.7 / (60 + rank) AS part, 0 * 1000000 + rank AS seen FROM bm25 UNION ALL SELECT item_id, doc_id, 0.7 / (60 + rank), 1000000 + rank FROM sparse),
fs AS (SELECT item_id, doc_id, sum(part) AS score, min(seen) AS seen FROM parts GROUP BY ALL),
fused AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, seen) AS rank FROM fs)"""
_OUT = "item_id AS query_id, doc_id AS unique_id, round(score, 6) AS score, rank"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("unique_id"), F.col("text").alias("page_content"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """(unique_id, words) of documents, on all cores."""
    return spread(documents(spark, sf), "unique_id").select("unique_id", X.tokens("page_content").alias("words"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def words(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", X.tokens("query").alias("words"))


def shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "unique_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(retrieval.LexicalIndex(corpus(spark, sf)), words(spark, sf), 15)


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.sparse_texts(corpus(spark, sf), words(spark, sf), 15)


def fused(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.wrrf([(bm25(spark, sf), 0.7), (sparse(spark, sf), 0.7)])


register("r3_bm25_topk", lambda s, d: shown(bm25(s, d)), f"WITH {_BM25} SELECT {_OUT} FROM bm25")
register(
    "r4_tfidf_topk",
    lambda s, d: shown(retrieval.tfidf(retrieval.LexicalIndex(corpus(s, d)), words(s, d), 15)),
    f"""WITH {_WORDS},
idf AS (SELECT term, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM df, stats),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), nd AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
v AS (SELECT item_id, term, times * idf AS w FROM qtf JOIN idf USING (term)), nq AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM v GROUP BY 1),
s AS (SELECT item_id, doc_id, sum((w.w / nd.n) * (v.w / nq.n)) AS score FROM w JOIN nd USING (doc_id) JOIN v USING (term) JOIN nq USING (item_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT {_OUT} FROM k WHERE rank <= 15""",
)
register("r9_sparse_ip_topk", lambda s, d: shown(sparse(s, d)), f"WITH {_WORDS}, {_SPARSE} SELECT {_OUT} FROM sparse")
register("r12_wrrf_fusion", lambda s, d: shown(fused(s, d)), f"WITH {_BM25}, {_SPARSE}, {_FUSED} SELECT {_OUT} FROM fused")
register(
    "r10_hybrid_weighted",
    lambda s, d: shown(retrieval.weighted_hybrid([(bm25(s, d), 1.0), (sparse(s, d), 1.0)], 10)),
    f"""WITH {_BM25}, {_SPARSE},
p AS (SELECT item_id, doc_id, atan(score) * 2 / pi() AS part FROM bm25 UNION ALL SELECT item_id, doc_id, atan(score) * 2 / pi() FROM sparse),
s AS (SELECT item_id, doc_id, sum(part) AS score FROM p GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT {_OUT} FROM k WHERE rank <= 10""",
)


#: The queries of the searches by vector: a set that grows with the table.
EVERY_50TH = "vec_id % 50 = 0"


def _vectors(spark: SparkSession, sf: str, asked: str = EVERY_50TH) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("unique_id"), "embedding", "label"), e.where(asked).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("q_label"))


def _dense(metric: str, k: int, asked: str = EVERY_50TH):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v, q = _vectors(spark, sf, asked)
        return shown(retrieval.dense(v.select("unique_id", "embedding"), q, k, metric))

    return run


def _dense_sql(score: str, direction: str, k: int) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS item_id, e.vec_id AS doc_id, {score} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) {direction}, doc_id) AS rank FROM s) SELECT {_OUT} FROM k WHERE rank <= {k}"""


_IP = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::double * z[2]::double))"
_L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) ** 2))"
register("r7_dense_ip_topk", _dense("ip", 10), _dense_sql(_IP, "DESC", 10))
register("r8_dense_l2_topk", _dense("l2", 10), _dense_sql(_L2, "ASC", 10))


def label_knn(spark: SparkSession, sf: str, asked: str = EVERY_50TH) -> DataFrame:
    """How often the nearest other vectors share the label, by label and over all."""
    v, q = _vectors(spark, sf, asked)
    hits = retrieval.dense(v.select("unique_id", "embedding"), q, 6).where("query_id <> unique_id")
    both = hits.join(v.select("unique_id", "label"), "unique_id").join(q.select("query_id", "q_label"), "query_id")
    from ..operators.metrics import accuracy

    return accuracy(both, "q_label", F.col("label") == F.col("q_label")).select("category", "n", F.round("accuracy", 6).alias("accuracy"))


register(
    "a10_accuracy_rollup",
    label_knn,
    f"""WITH s AS (SELECT q.vec_id AS qi, e.vec_id AS di, q.label AS ql, e.label AS dl, {_IP} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY round(score, 9) DESC, di) AS rank FROM s),
h AS (SELECT * FROM k WHERE rank <= 6 AND qi <> di)
SELECT CASE WHEN grouping(ql) = 1 THEN 'Average' ELSE ql::varchar END AS category, count(*) AS n, round(avg((ql = dl)::int), 6) AS accuracy FROM h GROUP BY ROLLUP (ql)""",
)


def _with_parents(spark: SparkSession, sf: str) -> DataFrame:
    """documents as children (odd ids) of the even id before them; id 1's parent is missing."""
    docs = documents(spark, sf).select("unique_id")
    parent = F.when(F.col("unique_id") == 1, F.lit(-1)).when(F.col("unique_id") % 2 == 1, F.col("unique_id") - 1)
    return docs.withColumn("parent_id", parent.cast("long"))


_PARENTS = """
par AS (SELECT doc_id, CASE WHEN doc_id = 1 THEN -1 WHEN doc_id % 2 = 1 THEN doc_id - 1 END AS parent_id FROM documents),
{n}t AS (SELECT item_id, coalesce(parent_id, doc_id) AS doc_id, rank FROM {src} JOIN par USING (doc_id)),
{n}f AS (SELECT item_id, doc_id, min(rank) AS r FROM {n}t WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY ALL),
{n} AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY r) AS rank FROM {n}f)"""
_BOTH_PARENTS = _PARENTS.format(n="pa", src="bm25") + "," + _PARENTS.format(n="pb", src="sparse").replace("\npar AS (SELECT doc_id, CASE WHEN doc_id = 1 THEN -1 WHEN doc_id % 2 = 1 THEN doc_id - 1 END AS parent_id FROM documents),", "")
_MERGED = """
mp AS (SELECT item_id, doc_id, 0.7 / (60 + rank) AS part, rank AS seen FROM pa UNION ALL SELECT item_id, doc_id, 0.7 / (60 + rank), 1000000 + rank FROM pb),
ms AS (SELECT item_id, doc_id, sum(part) AS score, min(seen) AS seen FROM mp GROUP BY ALL),
merged AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, seen) AS rank FROM ms)"""


def merged(spark: SparkSession, sf: str, use_wrrf: bool = True) -> DataFrame:
    return fusion.merge_docs(bm25(spark, sf), sparse(spark, sf), _with_parents(spark, sf), use_wrrf)


def j1(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.to_parents(bm25(spark, sf), _with_parents(spark, sf)).select("query_id", "unique_id", F.col("rank").cast("long").alias("rank"))


register("j1_child_parent_lookup", j1, f"WITH {_BM25}, {_PARENTS.format(n='pa', src='bm25')} SELECT item_id AS query_id, doc_id AS unique_id, rank FROM pa")
register("r13_merge_parents", lambda s, d: shown(merged(s, d)), f"WITH {_BM25}, {_SPARSE}, {_BOTH_PARENTS}, {_MERGED} SELECT {_OUT} FROM merged")
register(
    "r13_merge_concat",
    lambda s, d: merged(s, d, False).select("query_id", "unique_id", F.col("rank").cast("long").alias("rank")),
    f"""WITH {_BM25}, {_SPARSE}, {_BOTH_PARENTS},
u AS (SELECT item_id, doc_id, rank AS seen FROM pa UNION ALL SELECT item_id, doc_id, 1000000 + rank FROM pb), f AS (SELECT item_id, doc_id, min(seen) AS seen FROM u GROUP BY ALL)
SELECT item_id AS query_id, doc_id AS unique_id, row_number() OVER (PARTITION BY item_id ORDER BY seen) AS rank FROM f""",
)


def reranked(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Texts are scored where they are joined; ids and scores alone are ranked."""
    both = fused(spark, sf).join(spread(documents(spark, sf), "unique_id"), "unique_id").join(questions(spark, sf).select("query_id", X.tokens("query").alias("asked")), "query_id")
    scored = both.select("query_id", "unique_id", "rank", fusion.lexical_overlap("asked", X.tokens("page_content")).alias("overlap"))
    return fusion.rerank(scored, F.col("overlap"), k).drop("overlap")


_RERANK = """
ro AS (SELECT f.item_id, f.doc_id, f.rank AS input_rank, len(list_intersect(list_distinct(q.words), d.words))::double / greatest(len(list_distinct(q.words)), 1) AS score
  FROM fused f JOIN q USING (item_id) JOIN d USING (doc_id)),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, input_rank) AS rank FROM ro) WHERE rank <= 5)"""
_CHAIN = f"WITH {_BM25}, {_SPARSE}, {_FUSED}, {_RERANK}"
register("tk2_lexical_rerank", lambda s, d: shown(reranked(s, d)), f"{_CHAIN} SELECT {_OUT} FROM rr")
register(
    "p12_context_string",
    lambda s, d: fusion.contexts(reranked(s, d).select("query_id", "unique_id", "rank"), documents(s, d)),
    f"{_CHAIN} SELECT item_id AS query_id, string_agg('【' || rank || '】' || text, chr(10) ORDER BY rank) AS context FROM rr JOIN documents USING (doc_id) GROUP BY 1",
)
register(
    "p13_truncated_context",
    lambda s, d: fusion.contexts(reranked(s, d).select("query_id", "unique_id", "rank"), documents(s, d), "{}.", 4096),
    f"{_CHAIN} SELECT item_id AS query_id, substr(string_agg(rank || '.' || text, chr(10) ORDER BY rank), 1, 4096) AS context FROM rr JOIN documents USING (doc_id) GROUP BY 1",
)
register(
    "a20_term_statistics",
    lambda s, d: retrieval.lexical_index(documents(s, d)).frequencies(),
    f"WITH {_WORDS} SELECT term, df FROM df",
)
register(
    "j2_hit_document",
    lambda s, d: fusion.looked_up(reranked(s, d).select("query_id", F.col("rank").cast("long").alias("rank"), "unique_id"), s.read.parquet(f"{d}/documents.parquet").withColumnRenamed("doc_id", "unique_id"), "unique_id", ["lang", "source"]),
    f"{_CHAIN} SELECT item_id AS query_id, rank, doc_id AS unique_id, lang, source FROM rr JOIN documents USING (doc_id)",
)
register(
    "tk3_retry_top3",
    lambda s, d: fusion.retry_candidates(questions(s, d).select("query_id", F.when(F.col("query_id") % 3 == 0, F.lit("无答案")).otherwise(F.lit("x")).alias("answer")), fused(s, d)).select("query_id", "unique_id", F.col("rank").cast("long").alias("rank")),
    f"WITH {_BM25}, {_SPARSE}, {_FUSED} SELECT item_id AS query_id, doc_id AS unique_id, rank FROM fused WHERE rank <= 3 AND item_id % 3 = 0 AND item_id IN (SELECT item_id FROM fused GROUP BY 1 HAVING count(*) > 3)",
)


def cited(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and images that made-up responses cite among each query's reranked documents."""
    response = F.concat(F.lit("答【1, 3】又【"), (F.col("query_id") % 7).cast("string"), F.lit("】{x}"))
    responses = questions(spark, sf).select("query_id", F.when(F.col("query_id") % 5 == 0, "无答案【1】").otherwise(response).alias("response"))
    image = F.struct((F.col("unique_id") % 50).cast("int").alias("page"), F.lit("p").alias("image_path"), F.when(F.col("unique_id") % 2 == 0, F.concat(F.lit("t"), F.col("unique_id").cast("string"))).otherwise("").alias("title"))
    docs = documents(spark, sf).select("unique_id", (F.col("unique_id") % 50).cast("int").alias("page"), F.array(image).alias("images_info"))
    out = fusion.cited_sources(responses, reranked(spark, sf).select("query_id", "rank", "unique_id"), docs)
    return out.select("query_id", "answer", F.array_join(F.col("cite_pages").cast("array<string>"), ",").alias("pages"), F.array_join(F.transform("related_images", lambda i: i["title"]), ",").alias("images"))


register(
    "x3_cite_pages",
    cited,
    f"""{_CHAIN},
resp AS (SELECT item_id, item_id % 5 = 0 AS refused, CASE WHEN item_id % 5 = 0 THEN '无答案' ELSE '答又x' END AS answer, unnest(list_distinct(CASE WHEN item_id % 5 = 0 THEN [1] ELSE [1, 3, item_id % 7] END)) AS rank FROM benchmark),
hit AS (SELECT item_id, rank, doc_id, doc_id % 50 AS page FROM resp JOIN rr USING (item_id, rank) WHERE NOT refused),
agg AS (SELECT item_id, string_agg(DISTINCT page::varchar, ',' ORDER BY page::varchar) AS p0, list_aggregate(list_transform(list_sort(list_distinct(list(page))), lambda x: x::varchar), 'string_agg', ',') AS pages, string_agg('t' || doc_id, ',' ORDER BY rank) FILTER (doc_id % 2 = 0) AS images FROM hit GROUP BY 1)
SELECT item_id AS query_id, answer, coalesce(pages, '') AS pages, coalesce(images, '') AS images FROM (SELECT DISTINCT item_id, answer FROM resp) LEFT JOIN agg USING (item_id)""",
)
