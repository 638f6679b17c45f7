from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.tools import DIALECTS, function_text
from millrace.operators import qa


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_citations(spark):
    assert one(spark, X.cite_numbers(F.lit("答【1, 2】和【3】【²】"))) == [1, 2, 3]
    assert one(spark, X.without_cites(F.lit("答【1, 2】和【3】{x}"))) == "答和x"
    assert one(spark, X.cited_answer(F.lit("答【2,1】"))) == "答【1,2】"
    assert one(spark, X.cited_answer(F.lit("答"))) == "无答案"
    assert one(spark, X.cite_numbers(F.lit(""))) == []


def test_heading_sections(spark):
    assert one(spark, X.heading_sections(F.lit("x###a###b"))) == ["x", "###a", "###b"]
    assert one(spark, X.heading_sections(F.lit("###a"))) == ["###a"]
    assert one(spark, X.heading_sections(F.lit("plain"))) == ["plain"]


def test_sentences_and_lines(spark):
    assert one(spark, X.sentences(F.lit("一。二\n三\t四"))) == ["一。", "二", "三", "四"]
    assert one(spark, X.trimmed_lines(F.lit(" a \n\n b"))) == ["a", "b"]


def test_abbreviations_cascade_and_touch(spark):
    assert one(spark, X.expand_abbreviations(F.lit("ABS和XABS, ABS"), [("ABS", "制动$1")])) == "制动$1和XABS, 制动$1"


def test_bigrams_and_fuzzy(spark):
    assert one(spark, X.cjk_bigrams(F.lit("车门a窗"))) == ["车门", "窗"]
    assert one(spark, X.fuzzy_match(F.lit("abcde"), F.lit("xx abc")))
    assert not one(spark, X.fuzzy_match(F.lit("abcde"), F.lit("ab")))
    assert not one(spark, X.fuzzy_match(F.lit("  "), F.lit("ab")))


def test_numbered_context(spark):
    assert one(spark, X.numbered_context(F.array(F.lit("a"), F.lit("b")))) == "【1】a\n【2】b"
    assert one(spark, X.filled("{{a}}-{{b}}-{{a}}", a=F.lit("{{b}}"), b=F.lit("y"))) == "{{b}}-y-{{b}}"


def test_reject_reasons(spark):
    rows = [("", "x", "问题或答案为空"), ("abc", "xxxx", "问题过短(3字)"), ("怎么打开车窗", "无答案", None), ("怎么打开车窗", "好", "答案过短(1字)"), ("天气怎么样呢", "xxxxx", "问题含无关关键词：天气"), ("怎么打开车窗", "见第3页的说明", "答案含页码引用"), ("怎么打开车窗", "如图所示的按钮", "答案含图片引用"), ("开车窗？关车窗？", "按下按钮即可", "问题含多个问号(可能是拼接问题)"), ("怎么打开车窗", "还可以吧好", "答案不完整(口语化短句)")]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(rows)], "i int, question string, answer string")
    got = {r["i"]: r["r"] for r in df.select("i", qa.reject_reason().alias("r")).collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(rows)}
    assert df.where("i < 0").select(qa.reject_reason()).count() == 0


def test_filter_pairs_cleans_first(spark):
    df = spark.createDataFrame([("1. 怎么打开ABS", "用ABS开关"), (None, None)], "question string, answer string")
    a, b = qa.filter_pairs(df, [("ABS", "制动")]).collect()
    assert (a["question"], a["answer"], a["reject_reason"]) == ("怎么打开制动", "用制动开关", None)
    assert b["reject_reason"] == "问题或答案为空"


def test_tool_dialects_round_trip():
    calls = [("f", '{"a": 1}'), ("g", "{}")]
    for name, d in DIALECTS.items():
        own = calls[:1] if name == "glm4" else calls
        assert d.extract(d.call(own)) == own, name
        assert d.extract("plain words") is None
    assert function_text('<think>x</think>\n{"name": "f", "arguments": {}}', "qwen") == '<think>x</think>\n<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call>'
