import hashlib
import random
import re

import pytest

from millrace.llm import fill_in_middle as fim

TEXTS = ["", None, "a", "ab", "é", "ab cd", "x" * 9000, "a b " * 5000, "日本 text\n\nzwei 😀 three" * 300, "<P>", "a<S>b", "m <M>", "<<P", "a<", "<S", ">M>", "<P" * 3000, "\n" * 5000, "aé" * 3000, "x" * 5000 + " " + "y" * 5000]


def plain(key, text):
    """The transformation over a list of units."""
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, n)))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_lists_of_units(docs_of):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(8 * len(TEXTS))] + [(None, "one two"), (7, "twice"), (7, "twice")]
    got = fim.restored(fim.fill_in_middle(docs_of(rows))).collect()
    key = lambda r: (str(r[0]), str(r[-1]), str(r[-2]))
    want = sorted(((i, *plain(i, t or ""), t or "") for i, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_without_rows(docs_of):
    got = fim.restored(fim.fill_in_middle(docs_of([])))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"] and got.count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_ropes(size):
    """Small leaves: ranks, places and searches over leaves."""
    rng = random.Random(size)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "<", "P", ">", "é", "😀", "\n"]) for _ in range(rng.randint(0, 30)))
        r = fim.rope(text, size)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert (r.units, r.chars, fim.text_of(r)) == (len(units), len(text), text)
        at = rng.randint(0, len(units))
        low, high = fim.split(r, at)
        assert (fim.text_of(low), fim.text_of(high), low.units, high.units) == ("".join(units[:at]), "".join(units[at:]), at, len(units) - at)
        low, high = fim.split(high, rng.randint(0, high.units))
        assert fim.text_of(fim.join(low, high)) == "".join(units[at:])
        for what, start in (("<P>", 0), ("<P>", rng.randint(0, 30)), ("é", 0), (">", 3)):
            assert fim.find(r, what, start) == text.find(what, start)


def test_other_sentinels_and_rates(docs_of):
    forms = fim.Forms("<pre>", "<suf>", "<mid>", rate=100, spm=50, salt="s")
    rows = [(i, f"<P> text {i} <M>" + "<pre" * (i % 3)) for i in range(60)]
    made = fim.fill_in_middle(docs_of(rows), forms=forms)
    got = fim.restored(made.withColumnRenamed("form", "kind").selectExpr("*", "1 AS restored"), form_col="kind", forms=forms).collect()
    assert {r["doc_id"]: r["restored"] for r in got} == dict(rows) and {r["kind"] for r in got} == {"psm", "spm"}
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs_of(rows), forms=fim.Forms("<a>", "<a>", "<b>"))
