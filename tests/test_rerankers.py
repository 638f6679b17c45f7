"""Prompts and scores of rerankers, with a letter a token."""

import math

import pytest

from millrace.operators import rerankers
from millrace.operators.rerankers import STYLES, PromptReranker, shortened

letters = lambda text: [ord(c) for c in text]
read = lambda ids: "".join(map(chr, ids))


def plain_shortened(a, b, most):
    a, b = list(a), list(b)
    while len(a) + len(b) > most and (a or b):
        (a if len(a) > len(b) else b).pop()
    return a, b


def test_shortened():
    for a in range(0, 9):
        for b in range(0, 9):
            for most in range(0, 12):
                assert shortened(list(range(a)), list(range(b)), most) == plain_shortened(range(a), range(b), most), (a, b, most)


def test_prompts():
    made = lambda name, most: read(STYLES[name].joined(letters, "Q?", "long text", most))
    assert made("pair", 100) == "Q?long text" and made("pair", 6) == "Q?long"
    whole = made("instruct", 9999)
    assert whole.startswith("<|im_start|>system\nJudge") and whole.endswith("<think>\n\n</think>\n\n") and f"<Instruct>: {rerankers.TASK}\n<Query>: Q?\n<Document>: long text<|im_end|>" in whole
    assert len(made("instruct", len(whole) - 3)) == len(whole) - 3 and "<Document>: long t<|im_end|>" in made("instruct", len(whole) - 3)
    chat = made("instruct_chat", 9999)
    assert "<Query>: Q?\n\n<Document>: long text<|im_end|>" in chat and len(made("instruct_chat", 10)) == 10 + len(rerankers._CLOSE)
    passage = made("passage", 100)
    assert passage.startswith("A: Q?\nB: long text\nGiven a query A") and made("passage", 12).startswith("A: Q?\nB: lon\nGiven")
    assert rerankers.passage_style(7).joined(letters, "q", "t", 50)[0] == 7


def test_scores():
    style = STYLES["instruct"]
    assert style.score(1.0, 1.0) == 0.5 and style.score(2.0, None) == pytest.approx(1 / (1 + math.exp(-12))) and style.score(None, None) == 0.5
    assert style.score(-5000.0, 5000.0) == pytest.approx(0) and STYLES["passage"].score(3.5, None) == 3.5


def test_batches_of_like_length_and_ranking(spark):
    seen = []

    def logits(inputs):
        seen.append([len(x) for x in inputs])
        return [(float(sum(x) % 1000), None) for x in inputs]

    own = PromptReranker(STYLES["pair"], letters, logits, most=50, batch_ids=60)
    texts = ["x" * n for n in (5, 49, 7, 60, 6, 0, 48)]
    assert own.scores(["q"] * 7, texts) == [float((ord("q") + ord("x") * min(len(t), 49)) % 1000) for t in texts]
    assert all(len(b) * max(b) <= 60 or len(b) == 1 for b in seen) and sum(map(len, seen)) == 7
    rows = [(1, i, i, "q", t) for i, t in enumerate(texts)] + [(2, 9, 1, None, None), (2, 10, 2, "a", "b")]
    df = spark.createDataFrame(rows, "query_id long, unique_id long, rank int, query string, page_content string").repartition(3)
    whole = PromptReranker(STYLES["pair"], letters, lambda xs: [(float(len(x)), None) for x in xs], most=50)
    got = sorted((r["query_id"], r["rank"], r["unique_id"]) for r in whole.rank(df, 3).collect())
    assert got == [(1, 1, 1), (1, 2, 3), (1, 3, 6), (2, 1, 10), (2, 2, 9)]
