"""Encoders and splitters whose results no SQL expresses, against plain code on whole tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions.templates import get_template
from millrace.operators import chunking, encode

SF = "/root/testdata/sf0.001"
MESSAGES = "array<struct<role:string,content:string>>"


def dealt(m, n, room):
    """What of a source of m and a target of n ids stays in room: the shorter is spared."""
    most = room if 2 * n < room else room - m if 2 * m < room else int(room * (n / (m + n)))
    b = min(most, n)
    return min(max(room - b, 0), m), b


@pytest.fixture(scope="module")
def rows():
    said = lambda role, i, n: (role, " ".join(f"{role}{i}_{k}" for k in range(n)))
    out = []
    for i in range(12):
        prompt = [said("user", i, 1 + i), said("assistant", i, 2), said("user", i, 12 - i)] if i % 2 else [said("user", i, 2 * i)]
        answers = [said("assistant", i, 1 + i), said("assistant", i + 100, 9)]
        if i % 3 == 0:
            answers[i % 2] = ("assistant", "")
        out.append((i, prompt, answers, "be brief" if i % 4 == 0 else "", ""))
    return out


@pytest.fixture(scope="module")
def aligned(spark, rows):
    return spark.createDataFrame(rows, f"id int, _prompt {MESSAGES}, _response {MESSAGES}, _system string, _tools string")


def texts(spark, aligned, response):
    """(id, rendered texts) of the prompt with an answer."""
    t = get_template("qwen")
    return {r["id"]: list(r["t"]) for r in aligned.select("id", t.render(F.concat("_prompt", response), "_system", "_tools").alias("t")).collect()}


def ids(parts):
    return [i for p in parts for i in encode.hashed_ids(p)]


@pytest.mark.parametrize("cutoff", [10, 24, 500])
def test_pairwise(spark, aligned, rows, cutoff):
    first, second = (texts(spark, aligned, F.slice("_response", k, 1)) for k in (1, 2))
    got = {r["id"]: r for r in encode.encode_pairwise(aligned, get_template("qwen"), settings=encode.Settings(cutoff=cutoff)).collect()}
    assert got
    for i, r in got.items():
        source, c, j = ids(first[i][:-1]), ids(first[i][-1:]), ids(second[i][-1:])
        a, b = dealt(len(source), max(len(c), len(j)), cutoff)
        assert (r["chosen_input_ids"], r["rejected_input_ids"]) == (source[:a] + c[:b], source[:a] + j[:b])
        assert (r["chosen_labels"], r["rejected_labels"]) == ([-100] * a + c[:b], [-100] * a + j[:b])
        assert r["chosen_attention_mask"] == [1] * len(r["chosen_input_ids"])


@pytest.mark.parametrize("cutoff", [10, 500])
def test_prompts_and_feedback(spark, aligned, rows, cutoff):
    first = texts(spark, aligned, F.slice("_response", 1, 1))
    for r in encode.encode_prompts(aligned, get_template("qwen"), settings=encode.Settings(cutoff=cutoff)).collect():
        source, answer = ids(first[r["id"]][:-1]), ids(first[r["id"]][-1:])
        a, b = dealt(len(source), len(answer), cutoff)
        assert (r["input_ids"], r["labels"]) == (source[:a], answer[:b])
    wanted = F.when(F.element_at("_response", 1)["content"] != "", F.slice("_response", 1, 1)).otherwise(F.slice("_response", 2, 1))
    mine = texts(spark, aligned, wanted)
    got = {r["id"]: r for r in encode.encode_feedback(aligned, "id", get_template("qwen"), settings=encode.Settings(cutoff=cutoff), batch=5).collect()}
    for i, r in got.items():
        before = i - 1 if i % 5 else min(i + 4, len(rows) - 1)  # circular in a batch of five
        source, answer, other = ids(mine[i][:-1]), ids(mine[i][-1:]), ids(mine[before][-1:])
        for name, own in (("", answer), ("kl_", other)):
            a, b = dealt(len(source), len(own), cutoff)
            assert r[f"{name}input_ids"] == source[:a] + own[:b] and r[f"{name}labels"] == [-100] * a + own[:b]
        assert r["kto_tags"] == (rows[i][2][0][1] != "")


def test_packing_loses_nothing(spark):
    """The registered packs hold the ids of all rows that fit, each once."""
    got = entry.queries()["g2_greedy_pack"](spark, SF).collect()
    assert {r["n"] for r in got} == {513}
    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.size(F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")).alias("n"))
    assert sum(r["segments"] for r in got) == words.where("n between 1 and 512").count()


def test_children_cover_their_parents(spark):
    rows = [(f"p{i}", "\n\n".join("\n".join(f"line {i} {k} " + "x" * (7 * k % 90) for k in range(i % 9)) for _ in range(1 + i % 4)), "s", i, 0) for i in range(40)] + [("long", "y" * 900, "s", 99, 0), ("empty", "", "s", 98, 0)]
    df = spark.createDataFrame(rows, "unique_id string, page_content string, source string, page int, ordinal long").withColumn("images_info", F.array().cast("array<struct<page:int,image_path:string,title:string>>"))
    out = chunking.children(df, 256, 50).collect()
    parents = {r["unique_id"]: r["page_content"] for r in out if r["parent_id"] is None}
    assert len(parents) == len(rows)
    for key, text in parents.items():
        own = [r["page_content"] for r in out if r["parent_id"] == key]
        assert all(p in text and (len(p) <= 256 or "\n" not in p) for p in own)
        if own:
            assert {x.strip() for x in text.split("\n") if x.strip()} <= {x.strip() for p in own for x in p.split("\n")}


def test_clusters_hold_every_paragraph_once(spark):
    rows = [(i, "\n\n".join(f"paragraph {i} {k} " + "word " * (k % 5 * 20) for k in range(n))) for i, n in enumerate((1, 5, 11, 23, 40))]
    out = chunking.semantic_chunks(spark.createDataFrame(rows, "id int, page_content string"), group_size=4).collect()
    letters = lambda s: Counter(s.split())
    for r in out:
        assert letters(" ".join(r["chunks"])) == letters(rows[r["id"]][1])
