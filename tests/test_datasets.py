import itertools

import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions.templates import get_template, reasoning_messages, register_template
from millrace.operators import align, encode, fusion, sampling
from millrace.operators.chunking import average_linkage, merge_short, split_recursively
from millrace.operators.metrics import bleu4, rouge_l, rouge_n
from millrace.sources import readers


@pytest.mark.parametrize(("args", "want"), [((3000, 2000, 1000), (600, 400)), ((2000, 3000, 1000), (400, 600)), ((1000, 100, 1000), (900, 100)), ((100, 1000, 1000), (100, 900)), ((100, 500, 1000), (100, 500)), ((500, 100, 1000), (500, 100)), ((10, 10, 1000), (10, 10))])
def test_inferred_lengths(spark, args, want):
    row = spark.range(1).select(*N.inferred_lengths(*map(F.lit, args))).first()
    assert tuple(row) == want


def test_resized_without_area(spark):
    """A picture without area has no size within the bounds, and doesn't end the job; a very narrow one is longer than an int holds."""
    rows = [(0, 7), (7, 0), (0, 0), (None, 7), (4, 4), (3072, 768), (1, 10**16)]
    df = spark.createDataFrame(rows, "w long, h long")
    got = [tuple(r) for r in df.select(*N.resized(F.col("w"), F.col("h"), 768 * 768, 32 * 32)).collect()]
    assert got == [(None, None)] * 3 + [(None, 7), (32, 32), (1536, 384), (0, 76800000000)]


def test_alpaca_golden(spark):
    df = spark.createDataFrame([("Solve the math problem.", "3 + 4", "The answer is 7.")], "instruction string, input string, output string")
    r = align.align(df, align.Columns()).first()
    assert [tuple(m) for m in r["_prompt"]] == [("user", "Solve the math problem.\n3 + 4")]
    assert [tuple(m) for m in r["_response"]] == [("assistant", "The answer is 7.")]
    assert (r["_system"], r["_tools"], r["_images"]) == ("", "", None)


def test_alpaca_empty_parts(spark):
    """An empty instruction or input is left out, unless it is kept as a line."""
    df = spark.createDataFrame([("", "b"), ("a", ""), ("a", None), (None, None)], "instruction string, input string")
    asked = lambda c: [r["_prompt"][0]["content"] for r in align.align(df, c).collect()]
    assert asked(align.Columns()) == ["b", "a", "a", ""]
    assert asked(align.Columns(keep_empty=True)) == ["\nb", "a\n", None, None]


def turns(spark, *messages):
    return spark.createDataFrame([(list(messages),)], "conversations array<struct<from:string,value:string>>")


def test_sharegpt_golden(spark):
    df = turns(spark, ("system", "You are a helpful assistant."), ("human", "q"), ("gpt", "a"))
    r = align.align(df, align.Columns(formatting="sharegpt")).first()
    assert [tuple(m) for m in r["_prompt"]] == [("user", "q")] and [tuple(m) for m in r["_response"]] == [("assistant", "a")]
    assert r["_system"] == "You are a helpful assistant."


@pytest.mark.parametrize("messages", [[("gpt", "a"), ("human", "q")], [("human", "q")], [("human", "q"), ("who", "a")]])
def test_sharegpt_broken(spark, messages):
    r = align.align(turns(spark, *messages), align.Columns(formatting="sharegpt")).first()
    assert r["_prompt"] == [] and r["_response"] == []


def test_duplicate_registrations():
    with pytest.raises(ValueError):
        register_template(get_template("chatml"))
    with pytest.raises(ValueError):
        align.register_converter("alpaca", align.align_alpaca)
    with pytest.raises(ValueError):
        align.check_stage("sft", True)


def test_packs():
    assert list(encode.packs([8, 3, 7, 2, 6], 10)) == [[8, 2], [7, 3], [6]]
    assert list(encode.packs([5] * 5 + [1], 10)) == [[5, 5], [5, 5], [5, 1]] and list(encode.packs([0], 3)) == []
    with pytest.raises(ValueError):
        list(encode.packs([4], 3))


def test_packs_hold_what_they_should():
    import random

    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        own = list(encode.packs(lengths, 30))
        assert sorted(n for p in own for n in p) == sorted(lengths) and all(sum(p) <= 30 for p in own)
        for k, p in enumerate(own):  # no later length would have fitted in its place or in the room left
            later = [n for q in own[k + 1 :] for n in q]
            assert all(n > 30 - sum(p) for n in later)


def test_pack_supervised(spark):
    rows = [(i, list(range(n)), list(range(n))) for i, n in enumerate((8, 3, 7, 2, 6, 11))]
    df = spark.createDataFrame(rows, "id int, input_ids array<int>, labels array<int>")
    got = encode.pack_supervised(df, "id", encode.Settings(cutoff=10, neat_packing=True)).collect()
    assert len(got) == 3 and all(len(r[c]) == 11 for r in got for c in ("input_ids", "attention_mask", "position_ids", "labels"))
    assert sorted(max(r["attention_mask"]) for r in got) == [1, 2, 2]


def supervised(spark, pairs, **how):
    df = spark.createDataFrame([(pairs,)], "pairs array<struct<s:array<int>,t:array<int>>>")
    return tuple(df.select(*encode.supervised_turns(F.col("pairs"), encode.Settings(**how))).first())


def test_mask_history_learns_the_last_turn_only(spark):
    pairs = [([1, 2], [3]), ([4], [5, 6])]
    assert supervised(spark, pairs, mask_history=True) == ([1, 2, 3, 4, 5, 6], [-100] * 4 + [5, 6])
    ids, labels = supervised(spark, pairs, train_on_prompt=True)
    assert ids == labels
    ids, labels = supervised(spark, pairs, cutoff=4)
    assert len(ids) == len(labels) <= 4
    assert supervised(spark, pairs, efficient_eos=True, eos_id=9) == ([1, 2, 3, 4, 5, 6, 9], [9, -100, 3, 9, 5, 6, 9])
    assert supervised(spark, [([], []), ([1], [2])]) == ([1, 2], [-100, 2]) and supervised(spark, []) == ([], [])


def test_supervised_turns_share_the_cutoff(spark):
    """Against the rule, turn by turn: what is left of the cutoff is dealt between a source and its target, the shorter spared."""
    import random

    rng = random.Random(8)

    def dealt(m, n, room):
        most = room if 2 * n < room else room - m if 2 * m < room else int(room * (n / (m + n)))
        b = min(most, n)
        return min(max(room - b, 0), m), b

    rows = [[([rng.randint(0, 99)] * rng.randint(0, 9), [rng.randint(0, 99)] * rng.randint(1, 9)) for _ in range(rng.randint(0, 5))] for _ in range(60)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "id int, pairs array<struct<s:array<int>,t:array<int>>>")
    for how in ({"cutoff": 12}, {"cutoff": 12, "mask_history": True}, {"cutoff": 20, "mask_history": True}):
        got = {r[0]: (r[1], r[2]) for r in df.select("id", *encode.supervised_turns(F.col("pairs"), encode.Settings(**how))).collect()}
        for i, pairs in enumerate(rows):
            left, parts = how["cutoff"], []
            for k, (s, t) in enumerate(pairs[::-1] if "mask_history" in how else pairs):
                a, b = dealt(len(s), len(t), left) if left > 0 else (0, 0)
                left -= a + b
                parts.append((s[:a] + t[:b], [-100] * a + ([-100] * b if k and "mask_history" in how else t[:b])))
            parts = parts[::-1] if "mask_history" in how else parts
            assert got[i] == ([x for p, _ in parts for x in p], [x for _, p in parts for x in p])


def test_block_pack_against_plain_cutting(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 3, 40, 500]))]) for i in range(57)]
    got = {(r["batch"], r["block_no"]): r["input_ids"] for r in encode.block_pack(spark.createDataFrame(rows, "id int, ids array<int>"), "id", "ids", 16, 10).collect()}
    want = {}
    for b in range(6):
        whole = [x for _, v in rows[10 * b : 10 * b + 10] for x in v]
        want |= {(b, k): whole[16 * k : 16 * k + 16] for k in range(len(whole) // 16)}
    assert got == want


def test_collate(spark):
    df = spark.createDataFrame([(0, [1] * 6, [1] * 6, [1] * 6), (0, [2] * 2, [1] * 2, [2] * 2)], "b int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    for r in encode.collate(df, "b").collect():
        assert len(r["input_ids"]) == len(r["attention_mask"]) == len(r["labels"]) == 8
        n = sum(r["attention_mask"])
        assert r["labels"][n:] == [-100] * (8 - n) and r["input_ids"][n:] == [0] * (8 - n)


def test_block_causal_mask():
    m = encode.block_causal_mask([1, 1, 2, 2, 2, 0])
    assert m[1] == [1, 1, 0, 0, 0, 0] and m[4] == [0, 0, 1, 1, 1, 0] and m[5] == [0] * 6


def test_encoders_keep_shapes(spark):
    msgs = "array<struct<role:string,content:string>>"
    rows = [(i, [("user", f"q{i} x")], [("assistant", f"a{i}"), ("assistant", "")] if i % 2 else [("assistant", ""), ("assistant", f"b{i} c")], "", "") for i in range(5)]
    df = spark.createDataFrame(rows, f"id int, _prompt {msgs}, _response {msgs}, _system string, _tools string")
    t = get_template("qwen")
    for r in encode.encode_pairwise(df, t).collect():
        assert len(r["chosen_input_ids"]) == len(r["chosen_labels"]) == len(r["chosen_attention_mask"])
    got = {r["id"]: r for r in encode.encode_feedback(df, "id", t).collect()}
    assert [got[i]["kto_tags"] for i in range(5)] == [False, True, False, True, False]
    assert all(len(r["kl_input_ids"]) == len(r["kl_labels"]) for r in got.values())
    assert encode.encode_supervised(df, t).count() == 0
    assert encode.encode_prompts(df, t).count() == 5


def test_reasoning(spark):
    df = spark.createDataFrame([([("user", "q"), ("assistant", "<think>x</think>\n\na"), ("user", "r"), ("assistant", "b")],)], "m array<struct<role:string,content:string>>")
    out = df.select(reasoning_messages("m").alias("m")).first()["m"]
    assert [m["content"] for m in out] == ["q", "a", "r", "<think>\n\n</think>\n\nb"]


def test_splitting_and_clusters():
    text = "\n\n".join("w" * n for n in (10, 40, 5, 5, 5, 30))
    parts = split_recursively(text, 20, 6)
    assert "".join(parts).count("w") >= 95 and all(len(p) <= 20 or "\n" not in p for p in parts)
    assert merge_short(["a" * 60, "b" * 10, "c" * 20, "d" * 70]) == ["a" * 60 + "b" * 10 + "c" * 20, "d" * 70]
    import numpy as np

    assert average_linkage(np.array([[1, 0], [1, 0.1], [0, 1]]), 2) == [0, 0, 1]


def test_overlap_metrics():
    a = "the cat sat".split()
    assert rouge_n(a, a, 1) == rouge_l(a, a) == 1.0 and rouge_n(a, ["dog"], 1) == 0
    assert abs(bleu4(list("abcdef"), list("abcdef")) - 1) < 1e-12 and bleu4([], list("a")) == 0


def test_wrrf_and_ties(spark):
    ranked = lambda ids: spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(ids)], "query_id int, unique_id string, rank int")
    order = lambda df: [r["unique_id"] for r in df.orderBy("rank").collect()]
    assert order(fusion.wrrf([(ranked(["a", "b"]), 0.7), (ranked(["b", "c"]), 0.7)])) == ["b", "a", "c"]
    assert order(fusion.wrrf([(ranked(["b"]), 1.0), (ranked(["a"]), 1.0)])) == ["b", "a"]
    docs = spark.createDataFrame([("p", None), ("c", "p"), ("o", "gone")], "unique_id string, parent_id string")
    assert order(fusion.to_parents(ranked(["c", "p", "o"]), docs)) == ["p"]


def test_splits_are_disjoint_and_samples_exact(spark):
    df = spark.range(200)
    both = sampling.train_validation(df, 0.25, "id")
    a, b = ({r[0] for r in both[k].collect()} for k in ("train", "validation"))
    assert not a & b and len(a | b) == 200 and 25 < len(b) < 75
    assert sampling.sampled(df, 450, "id").count() == 450
    assert sampling.train_validation(df, 7, "id")["validation"].count() == 7


def test_registry_and_files(spark, tmp_path):
    reg = {"a": {"file_name": "a.json", "columns": {"prompt": "q"}}, "b": {"hf_hub_url": "x", "formatting": "sharegpt", "tags": {"role_tag": "r"}}, "c": {}}
    a, b = readers.resolve(reg, ["a", "b"])
    assert (a.load_from, a.columns.prompt) == ("file", "q") and (b.load_from, b.columns.role_tag) == ("hf_hub", "r")
    for bad in (["c"], ["zzz"]):
        with pytest.raises(ValueError):
            readers.resolve(reg, bad)
    (tmp_path / "a.jsonl").write_text('{"q": "x"}\nbroken\n{"q": "y"}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "q string").where("q is not null").count() == 2
    (tmp_path / "w.txt").write_text(" one \n\ntwo\n")
    assert [r[0] for r in readers.text_lines(spark, str(tmp_path / "w.txt")).collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        readers.read_files(spark, ["a.csv", "b.json"])
    (tmp_path / "abbr.csv").write_text("﻿ABS,制动,anti\nEPS,转向,x\nbad\n")
    assert readers.abbreviations(spark, str(tmp_path / "abbr.csv")) == [("ABS", "制动"), ("EPS", "转向")]


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert sorted(r["a"] for r in readers.read_files(spark, str(tmp_path / "t.arrow")).collect()) == [1, 2, 3]


def test_dialogue_scripts(spark):
    row = spark.range(1).select(readers.peeled_dialogue(F.lit("Human: a Assistant: b Human: c")).alias("d"), readers.alternating_dialogue(F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("e")).first()
    assert [tuple(t) for t in row["d"]] == [("human", "a"), ("gpt", "b")]
    assert [tuple(t) for t in row["e"]] == [("human", "x"), ("gpt", "y")]
    h, q, c, r = spark.range(1).select(*readers.preference_dialogue(F.lit("\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: d"), F.lit("\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: e"))).first()
    assert (h, q, c, r) == ([["a", "b"]], "c", "d", "e")


def test_round_robin_of_unequal_parts(spark):
    parts = [spark.createDataFrame([(f"{k}{i}", i) for i in range(n)], "v string, i int") for k, n in (("a", 3), ("b", 5))]
    got = [r["v"] for r in sampling.round_robin(parts, ["i"], "all_exhausted").orderBy("mix_pos").collect()]
    assert got == list(itertools.chain(*zip("a0 a1 a2 a0 a1".split(), "b0 b1 b2 b3 b4".split(), strict=True)))
    assert sampling.round_robin(parts, ["i"]).count() == 6
