"""Queries over texts, lines, pages and question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, fusion, metrics, qa, sampling
from ..sources import readers
from .catalogue import register


def table(name: str):
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


docs, talk, labels = table("documents"), table("conversations"), table("labels")

_QA = """qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, question, answer): user turns with the assistant's next turn, by an equi-join."""
    t = talk(spark, sf)
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Questions with planted faults, so that each rule is met: the turn number picks one.
_FAULTS = ["", "1. ", "导航去", "播放", "？a？", "x歌手", "车门", "第3页"]
_VARIED_SQL = f"""varied AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '短' ELSE f || question || CASE WHEN f = 'x歌手' THEN '歌手' ELSE '' END END AS question,
  CASE WHEN conv_id % 13 = 0 THEN '无答案' WHEN conv_id % 17 = 0 THEN '见图' || answer WHEN conv_id % 19 = 0 THEN '第12页' || answer WHEN conv_id % 23 = 0 THEN '还可以' WHEN conv_id % 29 = 0 THEN '可以吧好' ELSE answer END AS answer
  FROM (SELECT *, {_list(_FAULTS)}[(conv_id % 8)::int + 1] AS f FROM qa))"""


def varied(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    f = F.element_at(F.array(*[F.lit(x) for x in _FAULTS]), (c % 8 + 1).cast("int"))
    a = F.col("answer")
    question = F.when(c % 11 == 0, "短").otherwise(F.concat(f, F.col("question"), F.when(f == "x歌手", "歌手").otherwise("")))
    answer = F.when(c % 13 == 0, "无答案").when(c % 17 == 0, F.concat(F.lit("见图"), a)).when(c % 19 == 0, F.concat(F.lit("第12页"), a)).when(c % 23 == 0, "还可以").when(c % 29 == 0, "可以吧好").otherwise(a)
    return pairs(spark, sf).select("conv_id", "turn", question.alias("question"), answer.alias("answer"))


_OFF = _list(qa.OFF_TOPIC)
_REASON = f"""CASE WHEN q = '' OR a = '' THEN '问题或答案为空' WHEN length(q) < 5 THEN '问题过短(' || length(q) || '字)' WHEN a = '无答案' THEN NULL
  WHEN length(a) < 4 THEN '答案过短(' || length(a) || '字)' WHEN len(list_filter({_OFF}, lambda w: contains(q, w))) > 0 THEN '问题含无关关键词：' || list_filter({_OFF}, lambda w: contains(q, w))[1]
  WHEN regexp_matches(a, '{qa.PAGE_REFERENCE}') THEN '答案含页码引用' WHEN regexp_matches(a, '{qa.IMAGE_REFERENCE}') THEN '答案含图片引用' WHEN regexp_matches(q, '{qa.TWO_QUESTIONS}') THEN '问题含多个问号(可能是拼接问题)'
  WHEN regexp_matches(a, '{qa.UNFINISHED}') THEN '答案不完整(口语化短句)' WHEN regexp_matches(q, '{qa.ENTERTAINMENT}') THEN '问题属娱乐类' END"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FILTERED = f"""{_QA}, {_VARIED_SQL},
cleaned AS (SELECT conv_id, turn, trim(regexp_replace(question, '^\\s*\\d+\\s*[.．。、]\\s*', '')) AS question, answer FROM varied),
filtered AS (SELECT conv_id, turn, question, answer, {_REASON} AS reject_reason FROM (SELECT *, {_STRIP.format('question')} AS q, {_STRIP.format('answer')} AS a FROM cleaned))"""

register("p6_qa_filter", lambda s, d: qa.filter_pairs(varied(s, d)), f"WITH {_FILTERED} SELECT * FROM filtered")
register("p5_qa_quality_reasons", lambda s, d: qa.filter_pairs(varied(s, d)).where("reject_reason is not null").select("conv_id", "turn", "reject_reason"), f"WITH {_FILTERED} SELECT conv_id, turn, reject_reason FROM filtered WHERE reject_reason IS NOT NULL")
register("a2_reason_histogram", lambda s, d: qa.reason_histogram(qa.filter_pairs(varied(s, d))), f"WITH {_FILTERED} SELECT reject_reason, count(*) AS n, round(count(*) * 100.0::double / (SELECT count(*) FROM filtered), 1) AS percent FROM filtered WHERE reject_reason IS NOT NULL GROUP BY 1")
_LOW = " ".join(f"WHEN regexp_matches(q, '{p}') THEN '匹配模式: {p}'" for p in qa.LOW_QUALITY)
_CHECKED = f"""{_QA}, {_VARIED_SQL}, checked AS (SELECT conv_id, turn, CASE WHEN q = '' THEN '空问题' WHEN length(q) < 3 THEN '问题过短' WHEN length(q) > 500 THEN '问题过长' {_LOW} END AS question_problem,
  CASE WHEN answer = '无答案' THEN NULL WHEN a = '' THEN '空答案' WHEN regexp_matches(a, '{"|".join(qa.INVALID_ANSWERS)}') THEN '无效答案类型' END AS answer_problem
  FROM (SELECT *, {_STRIP.format('question')} AS q, {_STRIP.format('answer')} AS a FROM varied))"""
register("p7_training_check", lambda s, d: varied(s, d).select("conv_id", "turn", qa.question_problem().alias("question_problem"), qa.answer_problem().alias("answer_problem")), f"WITH {_CHECKED} SELECT * FROM checked")
register("p8_good_training_pairs", lambda s, d: qa.good_training_pairs(varied(s, d)).select("conv_id", "turn"), f"WITH {_CHECKED} SELECT conv_id, turn FROM checked WHERE question_problem IS NULL")
register(
    "a3_training_report",
    lambda s, d: qa.training_report(varied(s, d)),
    f"WITH {_CHECKED} SELECT count(*) AS total, count(question_problem) AS low_quality, count(answer_problem) AS invalid_answers, round(count(question_problem) * 100.0::double / count(*), 2) AS low_percent, round(count(answer_problem) * 100.0::double / count(*), 2) AS invalid_percent FROM checked",
)
register(
    "p4_negative_valid",
    lambda s, d: varied(s, d).where(qa.valid_negative()).select("conv_id", "turn"),
    f"WITH {_QA}, {_VARIED_SQL} SELECT conv_id, turn FROM (SELECT *, {_STRIP.format('question')} AS q FROM varied) WHERE length(q) BETWEEN 5 AND 80 AND len(list_filter({_list(qa.DOMAIN_WORDS)}, lambda w: contains(q, w))) = 0",
)
register("p9_unanswerable", lambda s, d: varied(s, d).where(qa.answerable()).agg(F.count("*").alias("n")), f"WITH {_QA}, {_VARIED_SQL} SELECT count(*) AS n FROM varied WHERE {_STRIP.format('question')} <> '' AND {_STRIP.format('answer')} <> '' AND NOT contains(answer, '无法准确') AND NOT contains(answer, '未提及')")
register(
    "p10_judge_eligibility",
    lambda s, d: varied(s, d).where(qa.judgeable("question", "answer", F.regexp_replace("question", "^短$", "无"))).select("conv_id", "turn"),
    f"WITH {_QA}, {_VARIED_SQL} SELECT conv_id, turn FROM varied WHERE {_STRIP.format('question')} <> '' AND {_STRIP.format('answer')} NOT IN ('无答案', '没有答案', '无', '-', '') AND {_STRIP.format(chr(39).join(['regexp_replace(question, ', '^短$', ', ', '无', ')']))} NOT IN ('无答案', '没有答案', '无', '-', '')",
)


def negative_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = varied(spark, sf).select("question", (F.col("conv_id") * 100 + F.col("turn")).alias("pos"))
    return qa.negatives(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"))


register(
    "q3_negative_set",
    negative_rows,
    f"""WITH {_QA}, {_VARIED_SQL}, n AS (SELECT DISTINCT {_STRIP.format('question')} AS question FROM varied)
SELECT md5(question) AS unique_id, question, '无答案' AS answer FROM n WHERE length(question) BETWEEN 5 AND 80 AND len(list_filter({_list(qa.DOMAIN_WORDS)}, lambda w: contains(question, w))) = 0""",
)


# paraphrases and keywords are derived from the pairs themselves
def paraphrased(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    raw = p.select(X.content_id("question").alias("unique_id"), F.to_json(F.array(F.struct("question", "answer"))).alias("raw_resp")).distinct()
    variants = p.where("conv_id % 3 = 0").select("question", X.trimmed_lines(F.concat(F.col("question"), F.lit("\n\n 改写 \n"), F.col("question"), F.lit("?"))).alias("variants")).dropDuplicates(["question"])
    return qa.with_paraphrases(qa.explode_pairs(raw), variants).select("unique_id", "question", "answer")


register(
    "q2_paraphrase_explode",
    paraphrased,
    rf"""WITH {_QA}, p AS (SELECT DISTINCT question, answer, max(conv_id % 3 = 0) OVER (PARTITION BY question) AS v FROM qa),
r AS (SELECT {_STRIP.format('question')} AS q, {_STRIP.format('answer')} AS answer, question AS raw, v FROM p),
k AS (SELECT * FROM r WHERE q <> '' AND answer <> '' AND NOT contains(answer, '无法准确') AND NOT contains(answer, '未提及')),
e AS (SELECT q AS question, answer FROM k UNION ALL SELECT unnest(list_filter(list_transform(string_split(raw || chr(10) || chr(10) || ' 改写 ' || chr(10) || raw || '?', chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')), answer FROM k WHERE v AND q = raw)
SELECT md5(question) AS unique_id, question, answer FROM e""",
)


def _word(column: str, n: int) -> F.Column:
    return F.coalesce(F.get(F.split(column, " "), n), F.lit(""))


def keyworded(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    raw = p.where("conv_id % 2 = 0").select("answer", F.when(F.col("conv_id") % 10 == 0, "无").otherwise(F.concat(_word("answer", 0), F.lit(", SU7,无,zzz,"), _word("answer", 2))).alias("raw_resp")).groupBy("answer").agg(F.min("raw_resp").alias("raw_resp"))
    return qa.attach_keywords(p, raw)


_KEYWORDS = f"""{_QA}, kr AS (SELECT answer, min(CASE WHEN conv_id % 10 = 0 THEN '无' ELSE coalesce(string_split(answer, ' ')[1], '') || ', SU7,无,zzz,' || coalesce(string_split(answer, ' ')[3], '') END) AS raw FROM qa WHERE conv_id % 2 = 0 GROUP BY 1),
kw AS (SELECT answer, CASE WHEN trim(raw) = '无' THEN [] ELSE list_filter(list_transform(string_split(trim(raw), ','), lambda k: trim(k)), lambda k: k <> '' AND contains(answer, k) AND k NOT IN ('无', 'SU7', '')) END AS ks FROM kr),
kq AS (SELECT qa.*, coalesce(ks, []) AS ks FROM qa LEFT JOIN kw USING (answer))"""
register("j4_keyword_attach", lambda s, d: keyworded(s, d).select("conv_id", "turn", F.array_join("keywords", "|").alias("keywords")), f"WITH {_KEYWORDS} SELECT conv_id, turn, array_to_string(ks, '|') AS keywords FROM kq")
register("a19_keyword_coverage", lambda s, d: keyworded(s, d).agg(F.count_if(F.size("keywords") > 0).alias("covered"), F.count("*").alias("n")), f"WITH {_KEYWORDS} SELECT count(*) FILTER (len(ks) > 0) AS covered, count(*) AS n FROM kq")


def scored_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Gold answers against made-up predictions: whole, single words, refused; word overlap stands in for similarity."""
    p = keyworded(spark, sf)
    gold = F.when(F.col("conv_id") % 13 == 0, "无答案").when(F.col("conv_id") % 5 == 0, _word("answer", 0)).when(F.col("conv_id") % 7 == 0, F.concat_ws(" ", _word("answer", 1), _word("answer", 2), _word("answer", 3))).otherwise(F.col("answer"))
    pred = F.when(F.col("conv_id") % 26 == 0, "无答案").when(F.col("conv_id") % 3 == 0, F.col("answer")).when(F.col("conv_id") % 3 == 1, _word("answer", 2)).otherwise(F.col("question"))
    own = p.select("conv_id", "turn", gold.alias("gold"), pred.alias("pred"), "keywords")
    sim = fusion.lexical_overlap(X.tokens("gold"), X.tokens("pred")) * 0.8
    return own.select("conv_id", "turn", F.round(metrics.answer_score(F.col("gold"), F.col("pred"), sim, F.col("keywords")), 6).alias("score"))


_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_CH = "list_distinct(list_filter(string_split({}, ''), lambda c: c <> '' AND c <> ' '))"
_HIT = "len(list_filter(" + _CH.format("k") + ", lambda c: contains({t}, c)))::double / greatest(len(" + _CH.format("k") + "), 1)"
_FUZZY = "(contains({t}, k) OR (len(" + _CH.format("k") + ") > 0 AND " + _HIT + " >= 0.6))"
_SCORES = f"""{_KEYWORDS},
g AS (SELECT conv_id, turn, ks, CASE WHEN conv_id % 13 = 0 THEN '无答案' WHEN conv_id % 5 = 0 THEN coalesce(string_split(answer, ' ')[1], '') WHEN conv_id % 7 = 0 THEN coalesce(string_split(answer, ' ')[2], '') || ' ' || coalesce(string_split(answer, ' ')[3], '') || ' ' || coalesce(string_split(answer, ' ')[4], '') ELSE answer END AS gold,
  CASE WHEN conv_id % 26 = 0 THEN '无答案' WHEN conv_id % 3 = 0 THEN answer WHEN conv_id % 3 = 1 THEN coalesce(string_split(answer, ' ')[3], '') ELSE question END AS pred FROM kq),
v AS (SELECT *, 0.8 * len(list_intersect(list_distinct({_TOK.format('gold')}), {_TOK.format('pred')}))::double / greatest(len(list_distinct({_TOK.format('gold')})), 1) AS sem, list_filter(ks, lambda k: {_FUZZY.format(t='gold')}) AS valid FROM g),
h AS (SELECT *, len(list_filter(valid, lambda k: {_FUZZY.format(t='pred')}))::double / greatest(len(valid), 1) AS rate FROM v),
b AS (SELECT *, CASE WHEN len(valid) > 0 THEN greatest(sem, 0.3 * CASE WHEN rate > 0.3 THEN 1.0 ELSE rate END + 0.7 * sem) ELSE sem END AS base,
  CASE WHEN length(gold) <= 20 AND contains(pred, trim(gold)) THEN 0.9 WHEN length(trim(pred)) BETWEEN 4 AND 30 AND contains(gold, trim(pred)) THEN 0.9
    WHEN length(gold) <= 50 AND len(list_intersect({_CH.format('gold')}, {_CH.format('pred')}))::double / greatest(len({_CH.format('gold')}), 1) > 0.6 THEN 0.8 ELSE 0.0 END AS floor FROM h),
scored AS (SELECT conv_id, turn, round(CASE WHEN gold = '无答案' THEN CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END ELSE greatest(base, floor) END::double, 6) AS score FROM b)"""
register("e1_answer_score", scored_answers, f"WITH {_SCORES} SELECT * FROM scored")
register("a8_mean_score", lambda s, d: scored_answers(s, d).agg(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n")), f"WITH {_SCORES} SELECT round(avg(score), 6) AS mean, count(*) AS n FROM scored")

# lines and chunks
_LINES = """ln AS (SELECT doc_id, i - 1 AS pos, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


register(
    "w7_short_chunk_merge",
    lambda s, d: chunking.merged_short_rows(lines(s, d), "doc_id", "pos", "line", 50),
    f"""WITH {_LINES}, m AS (SELECT *, sum(CASE WHEN length(line) >= 50 OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_no FROM ln)
SELECT doc_id, chunk_no, string_agg(line, '' ORDER BY pos) AS chunk FROM m GROUP BY ALL""",
)
register(
    "a6_chunk_quality",
    lambda s, d: metrics.chunk_quality(lines(s, d), ["doc_id"], "pos", "line").select("doc_id", "chunk_count", *[F.round(c, 6).alias(c) for c in ("avg_chunk_length", "length_std", "avg_context_similarity", "quality_score")]),
    f"""WITH {_LINES}, h AS (SELECT *, length(line) AS l, list_distinct(list_filter(string_split(substr(line, 1, 200), ''), lambda c: c <> '')) AS a FROM ln),
n AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM h),
s AS (SELECT doc_id, count(*) AS chunk_count, avg(l) AS m, stddev_pop(l) AS sd, coalesce(avg(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) END), 0) AS sim FROM n GROUP BY 1)
SELECT doc_id, chunk_count, round(m, 6) AS avg_chunk_length, round(sd, 6) AS length_std, round(sim, 6) AS avg_context_similarity, round(
  0.5 * CASE WHEN m BETWEEN 150 AND 1200 THEN 1.0 WHEN m < 150 THEN m / 150 ELSE greatest(0.0, 1 - (m - 1200) / 1200) END + 0.35 * (1 - least(sd / greatest(m, 1), 0.8)) + 0.03 * sim + 0.12 * greatest(0.0, 1 - abs(chunk_count - 1000) / 1000), 6) AS quality_score FROM s""",
)
_TITLE = metrics.TITLES.replace("'", "''")
_LIST = metrics.LIST_ITEMS.replace("'", "''")
_QUALITY_SQL = rf"""pt AS (SELECT doc_id, text AS raw, regexp_replace(text, '[ ]+', ' ', 'g') AS p FROM documents),
tq AS (SELECT doc_id, least(length({_STRIP.format('p')})::double / greatest(length({_STRIP.format('raw')}), 1), 1.0) AS keep, 1 - len(list_filter(string_split(p, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> ''))::double / len(string_split(p, chr(10))) AS blank,
  CASE WHEN len(regexp_extract_all(raw, '{_TITLE}')) = 0 THEN 1.0 ELSE len(regexp_extract_all(p, '{_TITLE}'))::double / len(regexp_extract_all(raw, '{_TITLE}')) END AS titles,
  CASE WHEN len(regexp_extract_all(raw, '{_LIST}')) = 0 THEN 1.0 ELSE len(regexp_extract_all(p, '{_LIST}'))::double / len(regexp_extract_all(raw, '{_LIST}')) END AS lists,
  len(regexp_extract_all(p, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFD}}]'))::double / greatest(length(p), 1) AS odd FROM pt)"""


def quality(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select("doc_id", F.col("text").alias("raw_text"), F.regexp_replace("text", "[ ]+", " ").alias("parsed_text"))
    names = ("text_retention_rate", "blank_line_ratio", "title_retention", "list_retention", "abnormal_char_rate", "overall_score")
    return metrics.text_quality(own).select("doc_id", *[F.round(n, 6).alias(n) for n in names])


register("a4_text_quality", quality, f"WITH {_QUALITY_SQL} SELECT doc_id, round(keep, 6) AS text_retention_rate, round(blank, 6) AS blank_line_ratio, round(titles, 6) AS title_retention, round(lists, 6) AS list_retention, round(odd, 6) AS abnormal_char_rate, round(0.55 * keep + 0.10 * (1 - blank) + 0.10 * titles + 0.10 * lists + 0.15 * (1 - odd), 6) AS overall_score FROM tq")
register("a5_abnormal_chars", lambda s, d: docs(s, d).select("doc_id", metrics.abnormal_chars(F.translate("text", "%", "�")).cast("long").alias("n")), r"SELECT doc_id, len(regexp_extract_all(translate(text, '%', chr(65533)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]')) AS n FROM documents")
register("a7_parse_accuracy", lambda s, d: quality(s, d).agg(F.round(F.avg(metrics.parse_accuracy(F.col("overall_score"), F.col("text_retention_rate"))), 5).alias("accuracy")), f"WITH {_QUALITY_SQL} SELECT round(avg(0.85 * round(0.55 * keep + 0.10 * (1 - blank) + 0.10 * titles + 0.10 * lists + 0.15 * (1 - odd), 6) + 0.15 * round(keep, 6)), 5) AS accuracy FROM tq")
register(
    "x10_heading_split",
    lambda s, d: docs(s, d).where("text like '%###%'").select("doc_id", F.posexplode(X.heading_sections("text")).alias("pos", "section")),
    """WITH s AS (SELECT doc_id, string_split(text, '###') AS p FROM documents WHERE text LIKE '%###%'),
l AS (SELECT doc_id, list_concat(CASE WHEN trim(p[1]) <> '' THEN [p[1]] ELSE [] END, list_transform(p[2:], lambda x: '###' || x)) AS parts FROM s)
SELECT doc_id, unnest(range(0, len(parts))) AS pos, unnest(parts) AS section FROM l""",
)
register(
    "c2_section_chunks",
    lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.coalesce(chunking.section_chunks(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))), F.array(F.lit("*clustered*")))).alias("pos", "chunk")),
    """WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS x FROM documents), s AS (SELECT doc_id, x, string_split(x, '###') AS p, string_split(x, chr(10) || chr(10)) AS g FROM t),
l AS (SELECT doc_id, x, g, list_concat(CASE WHEN trim(p[1]) <> '' THEN [p[1]] ELSE [] END, list_transform(p[2:], lambda y: '###' || y)) AS h FROM s),
c AS (SELECT doc_id, CASE WHEN length(x) <= 256 THEN [x] WHEN len(h) > 1 THEN h WHEN len(g) <= 10 THEN g ELSE ['*clustered*'] END AS c FROM l) SELECT doc_id, unnest(range(0, len(c))) AS pos, unnest(c) AS chunk FROM c""",
)
register("c4_chunk_fallback", lambda s, d: docs(s, d).select("doc_id", F.size(F.coalesce(F.when(F.col("doc_id") % 3 == 0, X.trimmed_lines("text")), F.array("text"))).cast("long").alias("n")), rf"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')) ELSE 1 END AS n FROM documents")


def paged(spark: SparkSession, sf: str) -> DataFrame:
    own = docs(spark, sf).select(F.col("source"), F.col("doc_id").cast("int").alias("page"), X.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("chunks"), F.array().cast("array<struct<page:int,image_path:string,title:string>>").alias("images_info"))
    return chunking.parents_of(own)


def family(spark: SparkSession, sf: str) -> DataFrame:
    """Parents by paragraph and children by sentence-free halves, without Python: children are lines of 120 characters."""
    parents = paged(spark, sf)
    width = 120
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("page_content") - 1) / width).cast("int")), lambda i: F.substring("page_content", i * width + 1, F.lit(width)))
    kids = parents.withColumn("part", F.explode(parts)).where("part <> page_content")
    return kids.select(X.content_id("part").alias("unique_id"), F.col("unique_id").alias("parent_id"), "page").union(parents.select("unique_id", F.lit(None).cast("string"), "page"))


register(
    "c6_parent_child",
    family,
    """WITH p AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS c FROM documents), q AS (SELECT * FROM p WHERE trim(c) <> ''),
k AS (SELECT page, c, unnest(list_transform(range(0, ((length(c) - 1) // 120) + 1), lambda i: substr(c, i * 120 + 1, 120))) AS part FROM q)
SELECT md5(part) AS unique_id, md5(c) AS parent_id, page FROM k WHERE part <> c UNION ALL SELECT md5(c), NULL, page FROM q""",
)
register("q6_row_conservation", lambda s, d: family(s, d).agg(F.count_if(F.col("parent_id").isNull()).alias("parents"), F.count("parent_id").alias("children")), """WITH p AS (SELECT unnest(string_split(text, chr(10))) AS c FROM documents), q AS (SELECT * FROM p WHERE trim(c) <> '')
SELECT count(*) AS parents, sum(CASE WHEN length(c) > 120 THEN (length(c) - 1) // 120 + 1 ELSE 0 END)::bigint AS children FROM q""")
register("p2_page_filter", lambda s, d: readers.page_documents(docs(s, d).withColumn("i", F.col("doc_id").cast("int")), "text", "source", 2, 278, "i").select("unique_id", "page", "source"), "SELECT md5(text) AS unique_id, doc_id + 1 AS page, source FROM documents WHERE doc_id BETWEEN 2 AND 278 AND trim(text) <> ''")
register("p1_doc_md5_dedup", lambda s, d: docs(s, d).groupBy(X.content_id("text").alias("unique_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "SELECT md5(text) AS unique_id, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
register("k1_last_wins_upsert", lambda s, d: sampling.last_wins(docs(s, d).select(X.content_id("text").alias("unique_id"), "doc_id", "source"), "unique_id", "doc_id"), "SELECT md5(text) AS unique_id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1")
register("w2_first_seen_distinct", lambda s, d: fusion.first_seen(docs(s, d).select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"]), "SELECT min(doc_id) AS doc_id, lang, source FROM documents GROUP BY lang, source")
register("p3_minimum_chunk", lambda s, d: qa.unprocessed(docs(s, d).select("doc_id", "text"), labels(s, d), "doc_id", "text", 1000).select("doc_id"), "SELECT doc_id FROM documents WHERE length(replace(text, chr(10), '')) >= 1000 AND doc_id NOT IN (SELECT doc_id FROM labels)")
register("j6_resume_antijoin", lambda s, d: qa.unprocessed(docs(s, d).select("doc_id", "lang"), labels(s, d), "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
register("j7_clean_join", lambda s, d: docs(s, d).select("doc_id", F.trim("text").alias("clean")).dropDuplicates(["doc_id"]).join(labels(s, d).dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "quality", "toxic", F.length("clean").cast("long").alias("n")), "SELECT d.doc_id, quality, toxic, length(trim(text)) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
register("j12_stopword_filter", lambda s, d: docs(s, d).select("doc_id", F.size(X.without(X.tokens("text"), ["the", "and", "of", "de", "le", "la"])).cast("long").alias("n")), rf"SELECT doc_id, len(list_filter({_TOK.format('text')}, lambda w: w NOT IN ('the', 'and', 'of', 'de', 'le', 'la'))) AS n FROM documents")
register("x9_sentence_split", lambda s, d: docs(s, d).select("doc_id", F.size(X.sentences(F.replace(F.col("text"), F.lit(". "), F.lit("。")))).cast("long").alias("n")), rf"SELECT doc_id, len(list_filter(list_transform(string_split(replace(replace(replace(text, '. ', '。'), '。', '。' || chr(1)), chr(10), chr(1)), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')) AS n FROM documents")
register("x12_line_split", lambda s, d: docs(s, d).select("doc_id", F.size(X.trimmed_lines("text")).cast("long").alias("n")), rf"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')) AS n FROM documents")
register("x6_abbreviations", lambda s, d: docs(s, d).select("doc_id", X.expand_abbreviations("text", [("The", "DIE"), ("DIE", "DER")]).alias("text")), r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^A-Za-z])The($|[^A-Za-z])', '\1DIE\2', 'g'), '(^|[^A-Za-z])The($|[^A-Za-z])', '\1DIE\2', 'g'), '(^|[^A-Za-z])DIE($|[^A-Za-z])', '\1DER\2', 'g'), '(^|[^A-Za-z])DIE($|[^A-Za-z])', '\1DER\2', 'g') AS text FROM documents")
_CITED = "'a' || doc_id || '【' || (doc_id % 7) || ', 3】b【{x}，' || (doc_id % 11) || '】c【】'"
register("x1_cite_extract", lambda s, d: docs(s, d).select("doc_id", F.explode(X.cite_numbers(F.expr(_CITED))).alias("cite")), f"WITH r AS (SELECT doc_id, {_CITED} AS t FROM documents), m AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(t, '[【](.*?)[】]', 1), lambda x: replace(regexp_replace(x, '[{{}} 【】]', '', 'g'), ',', '，'))) AS x FROM r), n AS (SELECT doc_id, unnest(string_split(x, '，')) AS n FROM m) SELECT DISTINCT doc_id, n::int AS cite FROM n WHERE regexp_matches(n, '^[0-9]+$')")
register("x2_cite_strip", lambda s, d: docs(s, d).select("doc_id", X.without_cites(F.expr(_CITED)).alias("answer")), f"SELECT doc_id, regexp_replace(regexp_replace({_CITED}, '[【](.*?)[】]', '', 'g'), '[{{}}【】]', '', 'g') AS answer FROM documents")
register("x4_format_answer", lambda s, d: docs(s, d).select("doc_id", X.cited_answer(F.expr("if(doc_id % 3 = 0, 'x', 'y【' || (doc_id % 9) || ',2】')")).alias("answer")), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '无答案' ELSE 'y【' || array_to_string(list_sort(list_distinct([(doc_id % 9)::int, 2])), ',') || '】' END AS answer FROM documents")
register("x5_number_prefix", lambda s, d: docs(s, d).select("doc_id", X.without_number_prefix(F.expr("doc_id || '. ' || text")).alias("q")), r"SELECT doc_id, trim(regexp_replace(doc_id || '. ' || text, '^\s*\d+\s*[.．。、]\s*', '')) AS q FROM documents")
register("x13_keyword_list", lambda s, d: docs(s, d).select("doc_id", F.array_join(X.keyword_list(F.expr("if(doc_id % 4 = 0, '无', 'the, zzz ,SU7,' || element_at(split(text || ' ', ' '), 2))"), "text"), "|").alias("k")), "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(list_filter(list_transform(string_split(trim('the, zzz ,SU7,' || string_split(text || ' ', ' ')[2]), ','), lambda k: trim(k)), lambda k: k <> '' AND contains(text, k) AND k NOT IN ('无', 'SU7', '')), '|') END AS k FROM documents")
register("u5_character_sets", lambda s, d: docs(s, d).select("doc_id", F.size(F.array_intersect(X.characters("text"), X.characters("source"))).cast("long").alias("both"), F.size(F.array_union(X.characters("text"), X.characters("source"))).cast("long").alias("either")), f"SELECT doc_id, len(list_intersect({_CH.format('text')}, {_CH.format('source')})) AS both, len(list_distinct(list_concat({_CH.format('text')}, {_CH.format('source')}))) AS either FROM documents")
register("x7_fuzzy_match", lambda s, d: docs(s, d).select("doc_id", X.fuzzy_match(F.concat(F.element_at(F.split(F.concat("text", F.lit(" ")), " "), 2), F.lit("QZJ")), F.col("text")).alias("hit")), f"WITH t AS (SELECT doc_id, text, string_split(text || ' ', ' ')[2] || 'QZJ' AS k FROM documents) SELECT doc_id, {_FUZZY.format(t='text')} AS hit FROM t")
