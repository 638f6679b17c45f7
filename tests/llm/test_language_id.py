import math
import os
import re
import zlib

import numpy as np
import pytest

from millrace.llm import language_id as L
from millrace.llm import queries

SF = "/root/testdata/sf0.01"
EN = "the house and the garden were there with this water while they thought that weather"
DE = "das haus und der garten sind nicht weit von der schule und ich möchte heute schwimmen"
RU = "это дом и сад где мы жили когда то давно и все было хорошо"
UK = "це дім і сад де ми жили колись давно і все було її їжак"


def plain_labels(scores, first, penalty):
    """Viterbi word by word."""
    out, text = [], []

    def close():
        if not text:
            return
        best, back = scores[text[0]].astype(float), []
        for t in text[1:]:
            change = best.max() - penalty
            back.append([j if best[j] >= change else int(best.argmax()) for j in range(scores.shape[1])])
            best = scores[t] + np.maximum(best, change)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(b[path[-1]])
        out.extend(reversed(path))

    for t in range(len(scores)):
        if first[t]:
            close()
            text = []
        text.append(t)
    close()
    return out


@pytest.mark.parametrize(("n", "k", "penalty"), [(1, 3, 2), (2, 2, 1), (50, 4, 3), (333, 3, 0.5), (400, 5, 6), (97, 1, 2)])
def test_labels_against_one_pass(n, k, penalty):
    rng = np.random.default_rng(n)
    scores = rng.integers(-9, 9, (n, k)).astype(np.float32) + rng.random((n, k)).astype(np.float32)
    first = rng.random(n) < 0.1
    first[0] = True
    assert L.labelled(scores, first, penalty).tolist() == plain_labels(scores, first, penalty)


def test_ngrams_against_strings():
    text = "Über die  Brücke, naïve-été x 日本語テスト мир42mir İz"
    w, low = L.Words(text, 1 << 12), text.replace("İ", "i").lower()
    spans = [(m.start(), m.end()) for m in re.finditer(r"[a-zà-ÿ]+|[а-я]+|[日本語]+|[テスト]+", low)]
    assert list(zip(w.starts.tolist(), w.ends.tolist(), strict=True)) == spans
    assert w.letters.tolist() == [b - a for a, b in spans]
    by_gram, by_bucket = {}, {}
    for a, b in spans:
        padded = " " + low[a:b] + " "
        for order in range(1, L.ORDERS + 1):
            for end in range(order, len(padded) + 1):
                gram = padded[end - order : end]
                place = a + end - 1
                if place == a or place > b and (order == 1 or b in [x for x, _ in spans]):
                    continue  # a space alone, or a word that touches the next one
                bucket = int(w.buckets[order - 1][place])
                assert bucket < 1 << 12 and by_gram.setdefault((order, gram), bucket) == bucket
                by_bucket.setdefault(bucket, set()).add(gram)
    assert sum(len(x) > 1 for x in by_bucket.values()) < 10  # chance collisions


def trained(spark, extra=()):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru"), (UK, "uk"), ("", "en"), (None, "de"), ("nothing", None), *extra])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_mixed_texts(spark):
    model = L.learned(trained(spark), "text", "lang")
    assert model.languages == ["de", "en", "ru", "uk"]
    mixed = f"{EN}. {DE}! {RU}"
    (lang, score, spans), none, digits, latin_ru, odd = L.identified([mixed, None, "12 345 ...", f"{RU} the", "ελληνικά"], model, 4.0)
    assert lang == "de" and 0 < score < 1
    assert [x["lang"] for x in spans] == ["en", "de", "ru"] and [mixed[x["start"] : x["end"]] for x in spans] == [EN, DE, RU]
    assert none == digits == ("und", 0.0, [])
    assert latin_ru[0] == "ru" and odd[0] in model.languages and len(odd[2]) == 1
    many = [mixed, EN, DE, UK, "", None, RU] * 5
    assert L.identified(many, model, 4.0)[:7] == [L.identified([t], model, 4.0)[0] for t in many[:7]]


def test_scripts_narrow_candidates(spark):
    """A Cyrillic word is never of a language without Cyrillic letters."""
    model = L.learned(trained(spark), "text", "lang")
    w = L.Words("дом house", model.buckets)
    ok = model.scored(w) > L.NEVER
    assert ok.tolist() == [[False, False, True, True], [True, True, False, False]]


def test_pieces_do_not_matter(spark, monkeypatch):
    model = L.learned(trained(spark), "text", "lang")
    text = f"{EN} {DE} {RU} {EN}\n" * 40
    whole = L.identified([text, EN], model, 4.0)
    monkeypatch.setattr(L, "PIECE", 300)
    assert "".join(p for _, p in L.pieces(text, 300)) == text
    assert L.identified([text, EN], model, 4.0) == whole
    again = L.learned(trained(spark, [(text, "en")]), "text", "lang")
    monkeypatch.undo()
    assert np.array_equal(again.weights, L.learned(trained(spark, [(text, "en")]), "text", "lang").weights)


def test_odd_rows(spark, docs_of):
    rows = [(1, EN), (2, None), (None, DE), (4, ""), (4, "..."), (4, EN), (4, EN)]
    got = L.identify(docs_of(rows), trained(spark)).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == sorted([("1", "en"), ("2", "und"), ("None", "de"), ("4", "und"), ("4", "und"), ("4", "en"), ("4", "en")])
    assert all(0 <= r["score"] <= 1 for r in got)
    blank = L.identify(docs_of(rows), trained(spark).limit(0)).collect()
    assert len(blank) == 7 and {(r["lang_pred"], r["score"]) for r in blank} == {("und", 0.0)}
    empty = L.identify(docs_of([]), trained(spark))
    assert empty.columns == ["doc_id", "lang_pred", "score", "spans"] and empty.count() == 0


def test_weights_against_counts(spark):
    """The model's ratios from counts of strings, where buckets are many enough to have one n-gram each."""
    model = L.learned(trained(spark), "text", "lang")
    w = L.Words("the", model.buckets)
    counts = {}
    for lang, text in (("en", EN), ("de", DE), ("ru", RU), ("uk", UK)):
        grams = [(n, f" {x} "[i : i + n]) for x in re.findall(r"\w+", text) for n in range(1, 6) for i in range(len(x) + 3 - n) if not (n == 1 and f" {x} "[i] == " ")]
        counts[lang] = {g: grams.count(g) for g in set(grams)}
    total = {x: sum(c.values()) for x, c in counts.items()}
    even = [counts[x].get((5, " the "), 0) * np.mean(list(total.values())) / total[x] + 1 for x in model.languages]
    want = [math.log(e / np.mean(even)) / L.ORDERS for e in even]
    assert model.weights[w.buckets[4][4]].tolist() == pytest.approx(want, abs=1e-5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op11_language_id(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.98 * len(held)
