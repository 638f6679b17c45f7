import hashlib
import random

import numpy as np
import pytest

from millrace.llm import suffix_dedup as S


def brute(rows, length=50):
    least, out = {}, []
    for i, t in rows:
        b, d = (t or "").encode(), S._NULL if i is None else i
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, d), d)
    for i, t in rows:
        b, d = (t or "").encode(), S._NULL if i is None else i
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < d:
                m[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((i, len(b), sum(m), sum(m[k] and (k == 0 or not m[k - 1]) for k in range(len(m))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(1)
    piece = lambda letters, lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    passages = [piece("ab é", 30, 120) for _ in range(8)]
    own = [(i, "".join(rng.choice(passages) if rng.random() < 0.5 else piece("abcdefé ", 1, 60) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    return own + [(None, passages[0] * 2), (5, passages[1] * 3), (5, passages[1] * 3), (200, None), (201, ""), (202, "a" * 500), (203, "a" * 49), (204, "a" * 50), (205, "x" + "a" * 300)]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(docs_of, seed):
    data = rows() if seed == 0 else [(i, f"{'common passage of words that repeats ' * 3}{i}") for i in range(40)]
    got = S.repeated_spans(docs_of(data), with_text=True).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute(data)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_cut_texts_lose_no_window(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 97)
    texts = [bytes(np.random.default_rng(i).integers(97, 100, 700, dtype=np.uint8)) for i in range(3)] + [b"", b"x" * 49, b"y" * 50]
    windows = set()
    for _, which, shift, _, (_, lo, hi), _ in S._doc_blocks(texts, 50, 24):
        for w, s, a, b in zip(which, shift, lo, hi, strict=True):
            windows |= {(int(w), int(p + s)) for p in range(a, b + 1)}
    assert windows == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)}


def test_equal_names_are_told_apart_by_bytes():
    windows = np.array([[1, 2], [1, 2], [3, 4], [3, 4]], np.uint8)
    assert S.least_of(windows, np.zeros(4, np.uint64), np.array([5, 2, 7, 9])).tolist() == [2, 2, 7, 7]


def test_empty(docs_of):
    assert S.repeated_spans(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        S.repeated_spans(docs_of([]), length=20, gram=20)


@pytest.mark.parametrize("entries", [S.BOX_ENTRIES, 1])
def test_string_ids_and_full_boxes(spark, monkeypatch, entries):
    monkeypatch.setattr(S, "BOX_ENTRIES", entries)
    data = rows()
    named = [(None if i is None else f"id{i:05}", t) for i, t in data]
    got = S.repeated_spans(spark.createDataFrame(named, "doc_id string, text string").repartition(3)).collect()
    want = sorted(((None if r[0] is None else f"id{r[0]:05}", *r[1:]) for r in brute(data)), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == want
