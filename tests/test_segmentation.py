"""Cuts against all paths through small lattices, and learned dictionaries against plain counts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval, segmentation
from millrace.operators.segmentation import Dictionary, Segmenter

WORDS = [("发动", 30), ("发动机", 80), ("动机", 20), ("机油", 60), ("油", 40), ("更换", 50), ("换", 10), ("发", 5), ("一", 9), ("机", 8)]


def plain(words, run, finer=False):
    """The likeliest path letter by letter, from the end."""
    freq, total = dict(words), math.log(sum(n for _, n in words))
    best = {len(run): (0.0, 0)}
    for i in range(len(run) - 1, -1, -1):
        ways = [((math.log(freq.get(run[i : i + k], 1)) - total) + best[i + k][0], k) for k in range(1, len(run) - i + 1) if k == 1 or run[i : i + k] in freq]
        best[i] = max((round(s, 9), k) for s, k in ways)
    out, i = [], 0
    while i < len(run):
        k = best[i][1]
        if finer and k > 2:
            out += [run[j : j + m] for m in (2, 3) if m < k for j in range(i, i + k - m + 1) if run[j : j + m] in freq]
        out.append(run[i : i + k])
        i += k
    return out


@pytest.mark.parametrize("finer", [False, True])
def test_cuts_against_plain_code(finer):
    rng = random.Random(5)
    for _ in range(40):
        letters = "一丁七万丈𠀀あ"
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): rng.choice([1, 2, 5, 40, 700]) for _ in range(rng.randint(1, 25))}
        runs = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 18))) for _ in range(30)]
        assert Dictionary(words.items()).cut(runs, finer) == [plain(list(words.items()), r, finer) for r in runs]
    assert Dictionary([]).cut(["一二", "三"]) == [["一", "二"], ["三"]] and Dictionary(WORDS).cut([]) == []


@pytest.mark.parametrize("finer", [False, True])
def test_cuts_in_blocks(monkeypatch, finer):
    """Runs of all lengths, empty ones and words longer than most runs, however many letters a block has."""
    rng = random.Random(8)
    letters = "一丁七万丈𠀀"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))): rng.choice([1, 3, 50]) for _ in range(200)}
    runs = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 9, 70]))) for _ in range(60)]
    want = [plain(list(words.items()), r, finer) for r in runs]
    for block in (1, 20, 1 << 17):
        monkeypatch.setattr(segmentation, "BLOCK", block)
        assert Dictionary(words.items()).cut(runs, finer) == want


def test_a_place_is_not_compared_with_all_words():
    """Looking words up takes about as long in a dictionary of 200,000 as in one of 2,000."""
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(200_000)})
    few, all_ = Dictionary((w, 1) for w in words[:2000]), Dictionary((w, 1) for w in words)
    assert max(d.first[8].size / d.keys[8].size for d in (few, all_)) <= 5
    assert max(int(np.diff(d.first[8]).max()) for d in (few, all_)) <= 12
    points = np.concatenate([segmentation._points("".join(words[:50])), np.zeros(8, np.uint32)])
    for d in (few, all_):
        found = {int(i) for _, at, _ in d.found(points) for i in at}
        assert set(range(0, 400, 8)) <= found and all("".join(words[:50])[i : i + 8] in set(words) for i in found)


def test_texts_of_several_kinds(spark, monkeypatch):
    s = Segmenter(Dictionary(WORDS))
    texts = ["发动机油更换 every 5000KM，发动机。", None, "", "...", "No Han", "更换ABC机油"]
    want = [["发动机", "油", "更换", "every", "5000km", "发动机"], None, [], [], ["no", "han"], ["更换", "abc", "机油"]]
    assert s.words(texts) == want
    monkeypatch.setattr(segmentation, "PIECE", 3)
    assert s.words(texts) == want
    assert Segmenter(Dictionary(WORDS), finer=True).words(["发动机"]) == [["发动", "动机", "发动机"]]
    assert Segmenter(Dictionary(WORDS), min_chars=2, stop=["更换"]).words(["更换机油油"]) == [["机油"]]
    df = segmentation.segmented(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2), "text", s)
    assert [r["words"] for r in df.orderBy("i").collect()] == want


def test_bm25_of_cut_texts(spark):
    """Words that single letters or pairs would mix up."""
    docs = spark.createDataFrame([(1, "发动机油更换"), (2, "机油"), (3, "动机不明"), (4, None)], "unique_id long, page_content string")
    tokenizer = Segmenter(Dictionary(WORDS)).tokenizer(spark)
    index = retrieval.lexical_index(docs, tokenizer=tokenizer)
    asked = spark.createDataFrame([(1, "动机"), (2, "发动机"), (3, "机油")], "query_id long, query string").select("query_id", tokenizer("query").alias("words"))
    got = {(r["query_id"], r["unique_id"]) for r in retrieval.bm25(index, asked, 5).collect()}
    assert got == {(1, 3), (2, 1), (3, 2)}


def test_learned_words(spark):
    rng = random.Random(1)
    words, fillers = ["天地", "玄黄宇", "宙洪荒日"], "甲乙丙丁戊己庚辛壬癸子丑寅卯"
    runs = ["".join(rng.choice([*words, *fillers]) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(r + "。" + r[:3],) for r in runs] + [(None,), ("plain words",)], "text string").repartition(3)
    got = {r["word"]: r["n"] for r in segmentation.learned_words(df, cohesion=2.0, freedom=1.5).collect()}
    assert {w for w in got if len(w) > 1} == set(words)
    whole = [x for r in runs for x in (r, r[:3])]
    assert all(got[w] == sum(x[i : i + len(w)] == w for x in whole for i in range(len(x))) for w in got)
    cut = Segmenter(segmentation.dictionary_of(segmentation.learned_words(df, cohesion=2.0, freedom=1.5)))
    assert cut.words(["甲玄黄宇天地乙宙洪荒日"]) == [["甲", "玄黄宇", "天地", "乙", "宙洪荒日"]]


def test_too_many_words(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        Segmenter(Dictionary(WORDS)).tokenizer(spark)
    rows = spark.createDataFrame([(w, n) for w, n in WORDS], "word string, n int")
    assert sum(len(x) for x in segmentation.dictionary_of(rows.select("word", F.col("n").cast("long").alias("n"))).words.values()) == 3
