import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import packing, token_counts
from millrace.llm.queries import tokenizer_path

LETTERS = " ▁\n\t abcTHE'sD.,é́中文🙂<s></s><|endoftext|>\x00ñ  　 123"


def texts(n=600):
    rng = random.Random(1)
    own = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*own, "", " ", "  ", "\n", "a" * 3000, "the" * 500, "the cat, sat. " * 3000, "<|endoftext|> a", "İi", "Word, word. WORD"]


def test_counts_equal_the_library(docs_of):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "x"), (9999, None)]
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs_of(rows), path).collect()}
    assert got == {(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows}


def test_merging_order():
    rank = {"ab": 0, "bc": 1, "abc": 2, "cd": 3}
    assert token_counts.merges("abcd", rank) == ["abc", "d"] and token_counts.merges("aab", rank) == ["a", "ab"]
    assert token_counts.merges("x", rank) == ["x"]


def ids_of(own, path):
    ids, ends = packing.encoded(pa.array(own, pa.string()), path)
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip([0, *(ends * 4).tolist()], (ends * 4).tolist(), strict=False)]


def of_library(own, path):
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch_fast(own, add_special_tokens=False)]


def test_ids_equal_the_library(monkeypatch):
    path, own = tokenizer_path("word_bpe_49k.json"), texts()
    want = of_library(own, path)
    assert ids_of(own, path) == want and ids_of(own, path) == want
    monkeypatch.setattr(packing, "HELD_WORDS", 20)  # words go to the older generation and come back
    assert [x for i in range(0, len(own), 40) for x in ids_of(own[i : i + 40], path)] == want
    assert ids_of([], path) == [] and ids_of(["", ""], path) == [b"", b""]
    part = pa.array(["not this", *own, "nor this"], pa.large_string()).slice(1, len(own))
    raw, ends = packing.encoded(part, path)
    assert raw.tobytes() == b"".join(want) and (ends * 4).tolist() == np.cumsum([len(x) for x in want]).tolist()


def test_ids_of_every_character_before_a_mark():
    path = tokenizer_path("word_bpe_49k.json")
    alike = lambda c: 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0x20000  # noqa: E731 - of ideographs and Hangul every 64th
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co") and not (alike(c) and c % 64)]
    own = [f"{c}, {c}. a{c}, {c}b. {c}\n,{c}" for c in every]
    got, want = ids_of(own, path), of_library(own, path)
    assert got == want, [x for x, a, b in zip(own, got, want, strict=True) if a != b][:5]


@pytest.mark.parametrize("change", [lambda j: j["normalizer"]["normalizers"].append({"type": "NFKC"}), lambda j: j["normalizer"]["normalizers"].pop(), lambda j: j["pre_tokenizer"]["pretokenizers"][0].update(invert=False), lambda j: j["model"].update(end_of_word_suffix=None), lambda j: j["added_tokens"].append({"content": "a b"})])
def test_unfit_tokenizers_are_refused(change):
    import json
    from pathlib import Path

    j = json.loads(Path(tokenizer_path("word_bpe_49k.json")).read_text())
    packing.check_tokenizer(j)
    change(j)
    with pytest.raises(ValueError, match="tokenizer"):
        packing.check_tokenizer(j)


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    rng = random.Random(seed)
    limit = rng.choice([10, 50, 4096])
    histogram = {rng.randint(1, limit): rng.randint(1, 500) for _ in range(rng.randint(1, min(limit, 50)))}
    placed, counts = {}, {}
    for length, lo, hi, first, each, base in packing.plan(histogram, limit):
        for r in range(lo, hi + 1):
            placed.setdefault(first + (r - lo) // each, []).append((base + (r - lo) % each * length, length))
            counts[length] = counts.get(length, 0) + 1
    assert counts == histogram
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    # no two sequences of the plan could be one, but for the last few
    room = sorted(sum(n for _, n in own) for own in placed.values())
    assert len(room) < 2 or room[0] + room[1] > limit


def test_packing_round_trip(docs_of):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(texts(80))] + [(None, "x"), (9998, None), (5, "again"), (5, "again")]
    got = packing.best_fit_packing(docs_of(rows), path, with_ids=True).collect()
    ids = {}
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 4 * 4096
        ids.setdefault(r["doc_id"], []).append((r["piece"], r["start"], bytes(r["ids"])))
    end = np.array([1], "<u4").tobytes()
    for i, t in rows:
        if i != 5:
            own = sorted(ids[i])
            assert b"".join(x for _, _, x in own) == ids_of([t or ""], path)[0] + end
            assert [s for _, s, _ in own] == [4096 * k for k in range(len(own))]
    sequences = {}
    for r in packing.best_fit_packing(docs_of(rows), path).collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
    total = sum(n for own in sequences.values() for _, n in own)
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.best_fit_packing(docs_of([]), path).count() == 0


def test_ranks_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    df = spark.createDataFrame([(5, i, 0) for i in range(100)] + [(6, 1, 0)], "length long, id long, piece int")
    got = [r["rank"] for r in packing.ranked(df, "length", ["id", "piece"]).where("length = 5").collect()]
    assert sorted(got) == list(range(100))
