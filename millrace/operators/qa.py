"""Question-answer corpora: explosion, quality rules, negatives, splits, keywords, training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .fusion import first_seen

# A question with one of these is off topic.
OFF_TOPIC = [
    "诗", "诗歌", "古诗", "唐诗", "宋词", "诗经", "背一首",
    "还珠格格", "电视剧", "电影", "明星", "演员", "小品", "相声",
    "美剧", "神雕侠侣", "快乐大本营",
    "放歌", "听歌", "播放", "放一首", "听他的", "听她的", "成名曲",
    "主题曲", "片头曲", "专辑",
    "导航去", "怎么走", "导航过去",
    "天气", "股票", "游戏", "汇率", "限行",
    "谢娜", "汪峰", "周杰伦", "王菲", "郭德纲", "郭麒麟", "肖战", "王一博",
    "张韶涵", "范玮琪", "费玉清", "昆凌", "何炅", "尚雯婕", "小虎队",
    "长城", "西湖", "故宫", "峨眉山", "三星堆", "外滩",
    "花语", "市花", "幸运色",
]

# A question with one of these can be answered, so it is no negative sample.
DOMAIN_WORDS = [
    "车门", "车窗", "车灯", "车锁", "天窗", "后视镜", "雨刷", "雨刮",
    "刹车", "油门", "方向盘", "安全带", "后备箱", "轮胎", "胎压",
    "大灯", "远光灯", "近光灯", "雾灯", "转向灯", "尾灯", "氛围灯",
    "仪表盘", "挡位",
    "行车记录仪", "辅助驾驶", "自动驾驶", "巡航",
    "倒车影像", "电子眼", "车机", "中控", "车载", "鹰眼",
    "充电桩", "动力电池",
    "座椅", "空调",
    "保养", "年检",
]

# Patterns of the answer and question rules, and their reasons.
PAGE_REFERENCE = r"第\d+页|页码\s*\d+|参见第|请参阅"
IMAGE_REFERENCE = r"图\s*\d+|如图所示|见图"
TWO_QUESTIONS = r"[？?].*[？?]"
UNFINISHED = r"^(还可以|没有[，,]|不行[，,]|也可以)[^。，；]{0,10}$"
ENTERTAINMENT = r"(歌曲$|歌手$|专辑$|相声$|小品$|京剧$)"

# Questions of low quality, in the order they are tried.
LOW_QUALITY = [
    r"^\s*(哦|啊|嗯|呢|吧|吗|哈|嗨|嘿|喂|好|行|可以)\s*$",
    r"^\s*$",
    r"^\s*[你我他她它]的\s*$",
    r"^\s*(给我|我要|请给|想让)\s*$",
    r"^\s*(看|听|读|唱|背)\s*$",
    r"(诗|诗歌|背诗|古诗|唐诗|宋词)",
    r"(还珠格格|电视剧|电影|明星|演员)",
    r"(诗经|论语|历史|文学|小说)",
    r"(门|路口|左转|右转|导航|怎么走)",
    r"(放歌|听歌|音乐|唱歌|播放)",
    r"(女儿|儿子|妈妈|爸爸|家庭|家人)",
    r"(天气|新闻|时间|日期)",
    r"(股票|基金|财经|价格)",
    r"(游戏|软件|手机|电脑)",
]
INVALID_ANSWERS = [r"^无答案\s*$", r"^不知道\s*$", r"^不清楚\s*$", r"^无法回答\s*$"]
UNANSWERABLE = ["无法准确", "未提及"]


def _trim(c: Column | str) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def reject_reason(question: Column | str = "question", answer: Column | str = "answer") -> Column:
    """The first rule that a pair breaks, or null. An answer that says there is none is fine once the question is long enough."""
    q, a = F.coalesce(_trim(question), F.lit("")), F.coalesce(_trim(answer), F.lit(""))
    word = F.try_element_at(F.filter(F.array(*[F.lit(w) for w in OFF_TOPIC]), lambda w: q.contains(w)), F.lit(1))
    return (
        F.when((q == "") | (a == ""), "问题或答案为空")
        .when(F.length(q) < 5, F.concat(F.lit("问题过短("), F.length(q).cast("string"), F.lit("字)")))
        .when(a == X.NO_ANSWER, F.lit(None).cast("string"))
        .when(F.length(a) < 4, F.concat(F.lit("答案过短("), F.length(a).cast("string"), F.lit("字)")))
        .when(X.has_any(q, OFF_TOPIC), F.concat(F.lit("问题含无关关键词："), word))
        .when(a.rlike(PAGE_REFERENCE), "答案含页码引用")
        .when(a.rlike(IMAGE_REFERENCE), "答案含图片引用")
        .when(q.rlike(TWO_QUESTIONS), "问题含多个问号(可能是拼接问题)")
        .when(a.rlike(UNFINISHED), "答案不完整(口语化短句)")
        .when(q.rlike(ENTERTAINMENT), "问题属娱乐类")
    )


def filter_pairs(pairs: DataFrame, abbreviations: Sequence[tuple[str, str]] = (), remove_no_answer: bool = False) -> DataFrame:
    """pairs (question, answer, ...) cleaned and expanded, with reject_reason (null: passed). One projection, no shuffle."""
    q = X.expand_abbreviations(X.without_number_prefix("question"), abbreviations)
    a = F.when((F.col("answer") != X.NO_ANSWER) & (F.col("answer") != ""), X.expand_abbreviations("answer", abbreviations)).otherwise(F.col("answer"))
    out = pairs.withColumns({"question": q, "answer": a})
    reason = reject_reason()
    if remove_no_answer:
        reason = F.coalesce(reason, F.when(F.col("answer") == X.NO_ANSWER, "测试集不含负样本"))
    return out.withColumn("reject_reason", reason)


def reason_histogram(filtered: DataFrame) -> DataFrame:
    """(reject_reason, n, share in percent), most common first."""
    total = filtered.agg(F.count("*").alias("total"))
    counts = filtered.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("reject_reason", "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("percent")).orderBy(F.desc("n"), "reject_reason")


def question_problem(question: Column | str = "question") -> Column:
    """What is wrong with a training question, or null."""
    q = F.coalesce(_trim(question), F.lit(""))
    c = F.when(q == "", "空问题").when(F.length(q) < 3, "问题过短").when(F.length(q) > 500, "问题过长")
    for p in LOW_QUALITY:
        c = c.when(q.rlike(p), f"匹配模式: {p}")
    return c


def answer_problem(answer: Column | str = "answer") -> Column:
    """What is wrong with a training answer, or null; one that says there is no answer is not looked at."""
    raw = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    a = _trim(raw)
    bad = a.rlike("|".join(INVALID_ANSWERS))
    return F.when(raw == X.NO_ANSWER, F.lit(None).cast("string")).when(a == "", "空答案").when(bad, "无效答案类型")


def training_report(pairs: DataFrame) -> DataFrame:
    """One row: total, low_quality, invalid_answers and their shares in percent."""
    low, bad = F.count_if(question_problem().isNotNull()), F.count_if(answer_problem().isNotNull())
    total = F.count("*")
    return pairs.agg(total.alias("total"), low.alias("low_quality"), bad.alias("invalid_answers"), F.round(low / total * 100, 2).alias("low_percent"), F.round(bad / total * 100, 2).alias("invalid_percent"))


def good_training_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(question_problem().isNull())


def valid_negative(question: Column | str = "question") -> Column:
    q = _trim(question)
    return F.length(q).between(5, 80) & ~X.has_any(q, DOMAIN_WORDS)


def answerable(question: Column | str = "question", answer: Column | str = "answer") -> Column:
    q, a = _trim(question), _trim(answer)
    return (q != "") & (a != "") & ~X.has_any(a, UNANSWERABLE)


def judgeable(question: Column | str, response: Column | str, reference: Column | str) -> Column:
    """Rows that a judge may score: nothing empty, and neither side a refusal."""
    refusals = ("无答案", "没有答案", "无", "-", "")
    q, r, t = _trim(question), _trim(response), _trim(reference)
    return (q != "") & (r != "") & (t != "") & ~r.isin(*refusals) & ~t.isin(*refusals)


def model_pairs(raw: DataFrame) -> DataFrame:
    """raw (unique_id, raw_resp: JSON list of question and answer) to (unique_id, question, answer), each pair as it stands; broken JSON is dropped."""
    rows = F.from_json("raw_resp", "array<struct<question:string,answer:string>>")
    return raw.select("unique_id", F.explode(rows).alias("qa")).select("unique_id", "qa.question", "qa.answer")


def explode_pairs(raw: DataFrame) -> DataFrame:
    """The pairs of raw, trimmed, that have a question and an answer to it."""
    return model_pairs(raw).select("unique_id", _trim("question").alias("question"), _trim("answer").alias("answer")).where(answerable())


def with_paraphrases(pairs: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """Each pair with its question and every paraphrase of it. paraphrases: (question, variants)."""
    own = paraphrases.select(F.col("question").alias("__q"), "variants")
    both = pairs.join(own, F.col("question") == F.col("__q"), "left").drop("__q")
    asked = F.concat(F.array("question"), F.coalesce("variants", F.array().cast("array<string>")))
    return both.withColumn("question", F.explode(asked)).drop("variants").withColumn("unique_id", X.content_id("question"))


def negatives(*lists: DataFrame) -> DataFrame:
    """Questions without an answer, from lists (question, pos): first sight kept, rules applied."""
    rows = None
    for i, df in enumerate(lists):
        own = df.select(_trim("question").alias("question"), F.struct(F.lit(i).alias("l"), F.col("pos").alias("p")).alias("seen")).where("question <> ''")
        rows = own if rows is None else rows.union(own)
    kept = first_seen(rows, ["question"], ["seen"]).where(valid_negative())
    return kept.select(X.content_id("question").alias("unique_id"), "question", F.lit(X.NO_ANSWER).alias("answer"))


def attach_keywords(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """pairs with keywords of their answer. raw: (answer, raw_resp), one row an answer; without one, or an answer, none."""
    words = raw.select(F.col("answer").alias("__a"), X.keyword_list("raw_resp", "answer").alias("keywords"))
    both = pairs.join(words, F.col("answer") == F.col("__a"), "left").drop("__a")
    none = F.array().cast("array<string>")
    return both.withColumn("keywords", F.when((F.col("answer") == "") | (F.col("answer") == X.NO_ANSWER), none).otherwise(F.coalesce("keywords", none)))


def unprocessed(todo: DataFrame, done: DataFrame, key: str = "unique_id", text: str | None = None, least_chars: int = 100) -> DataFrame:
    """Rows of todo that done lacks; with text, only those with so many characters besides line feeds."""
    rest = todo.join(done.select(key).distinct(), key, "left_anti")
    return rest.where(F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) >= least_chars) if text else rest


def sft_items(records: DataFrame, prompt: str, most: int = 4096) -> DataFrame:
    """records (query, context, response, merged_docs) to (query, context, instruction, input, output). prompt has {query} and {context}."""
    context = X.truncated(X.numbered_context("context", "{}."), most)
    query = _trim("query")
    filled = X.filled(prompt.replace("{query}", "{{query}}").replace("{context}", "{{context}}"), query=query, context=context)
    return records.select(query.alias("query"), context.alias("context"), filled.alias("instruction"), F.lit("").alias("input"), X.cited_answer("response").alias("output"))


def negative_docs(merged: Column | str, context: Column | str) -> Column:
    """merged less context; repeats and order stay."""
    return F.filter(merged, lambda x: ~F.array_contains(context, x))


def drawn(items: Column, *key: Column | str) -> Column:
    """One item, chosen by a hash of the key; null if there is none."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("bigint")
    return F.when(F.size(items) > 0, F.try_element_at(items, (F.pmod(h, F.greatest(F.size(items), F.lit(1))) + 1).cast("int")))


def rerank_triples(records: DataFrame, seed: str = "42") -> DataFrame:
    """(query, content, label): 2 the first context, 1 one of the last two, 0 one that is not context; a refusal gives 0 only."""
    cited = X.cited_answer("response") != X.NO_ANSWER
    query = _trim("query")
    last = F.slice("context", F.greatest(F.size("context") - 1, F.lit(1)), 2)
    wrong = drawn(negative_docs("merged_docs", "context"), query, F.lit(seed))
    any_ = drawn(F.col("merged_docs"), query, F.lit(seed))
    row = lambda c, y: F.struct(c.alias("content"), F.lit(y).alias("label"))
    rows = F.when(cited, F.array(row(F.try_element_at("context", F.lit(1)), 2), row(drawn(last, query, F.lit(seed)), 1), row(wrong, 0))).otherwise(F.array(row(any_, 0)))
    return records.select(query.alias("query"), F.explode(rows).alias("r")).select("query", "r.content", "r.label").where("content <> '' and query <> ''")
