import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from millrace.llm import common, html_extract, quality, toxicity


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body>{body}</body></html>"


def lines(html):
    """(text, whether inside an article) of what the structure leaves."""
    return [(t, at == html_extract.INSIDE) for t, at in html_extract.blocks(html) if at != html_extract.OUT]


def text(body):
    found = html_extract.blocks(page(body))
    inside = [t for t, at in found if at == html_extract.INSIDE]
    return "\n\n".join(inside) if inside else html_extract.main_text(found)


@pytest.mark.parametrize(("body", "want"), [
    ("<nav><ul><li>Menu</ul></nav><article><h1>A &amp; B</h1><p>x\n  <b>y</b><br>z<p>next</article><footer>f</footer>", "A & B\n\nx y z\n\nnext"),
    ("<div class='ad'>Buy</div><main><p>One</p><aside>side</aside><div id=comments><p>first!</p></div><form>f</form><p>Two</main>", "One\n\nTwo"),
    ("<div class=cookie-notice>We use <article><p>kept</p></article>", "kept"),
    ("<p>no article</p><div role='navigation'>nav</div><p hidden>h</p><p>end", "no article\n\nend"),
    ("<article><header><p>by me</p></header><p>&lt;b&gt; &#233;&nbsp;&eacute;</p><!-- <p>c</p> --></article>", "by me\n\n<b> é é"),
    ("<header>Site</header><article><p title='a > b'>q</p><pre>a\n b</pre></article", "q\n\na b"),
    ("", ""),
])
def test_structure(body, want):
    assert text(body) == want


def test_null_and_broken():
    assert html_extract.blocks(None) == [] and lines("<") == [("<", False)]
    assert lines("a < b <p>c") == [("a < b", False), ("c", False)]


def test_common_lines_is_a_longest_common_subsequence():
    for seed in range(200):
        rng = random.Random(seed)
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 10))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html_extract.common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_differencing_does_not_depend_on_ranges(spark, parts):
    rows = [(i, f"http://h.example/{'a' if i < 20 else 'b'}/{i}?q={i}", f"<div>Site</div><div>Menu {'a' if i < 20 else 'b'}</div><p>page {i}</p><p>more {i}</p><div>foot</div>") for i in range(40)]
    rows += [(60 + i, f"http://mix.example/{i}", f"<div>Head</div><{'article' if i % 2 else 'p'}>text {i}</{'article' if i % 2 else 'p'}>") for i in range(6)]
    rows += [(90, "http://alone.example/x", "<div>only</div>"), (91, None, None), (92, "http://[bad", ""), (93, "http://two.example/a", "<p>same</p>"), (94, "http://two.example/b", "<p>same</p>"), (5, "http://h.example/a/5?q=5", "<p>repeat id</p>")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(4)
        got = [tuple(r) for r in html_extract.extract_main_text(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows) and all(n == len(t) for *_, t, n in got)
    by = {(i, u): t for i, u, t, _ in got}
    assert by[(3, rows[3][1])] == "page 3\n\nmore 3" and by[(30, rows[30][1])] == "page 30\n\nmore 30"
    assert all(by[(60 + i, f"http://mix.example/{i}")] == f"text {i}" for i in range(6))
    assert by[(90, "http://alone.example/x")] == "only" and by[(91, None)] == "" and by[(93, "http://two.example/a")] == "same"


@pytest.mark.parametrize("parts", ["1", "5"])
def test_lines_outside_articles_are_differenced(spark, parts):
    card = "<article><p>{0}</p></article>"
    body = lambda i, tail="": f"<div>Site</div>{card.format(f'card {i}')}<div><p>main {i}</p><p>more {i}</p></div><div>foot</div>{tail}"
    rows = [(i, f"http://h.example/a/{i}", body(i)) for i in range(10, 30)]
    rows += [(40 + k, f"http://copy.example/{k}", body(0)) for k in range(2)] + [(42, "http://copy.example/2", body(2))]
    rows += [(50 + k, f"http://plain.example/{k}", f"<div>Site</div>{card.format(k)}") for k in range(3)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
        got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows) and all(got[i] == f"card {i}\n\nmain {i}\n\nmore {i}" for i in range(10, 30))
    assert got[41] == "card 0\n\nmain 0\n\nmore 0"  # its nearest page is a copy, so the other one decides
    assert [got[50 + k] for k in range(3)] == ["0", "1", "2"]


@pytest.mark.parametrize(("body", "want"), [
    ("<article><p>story</p></article><article class='comment-body even'><p>nice</p></article>", [("story", True)]),
    ("<article class='post has-sidebar'><p>story</p></article><div id=comments><article><p>nice</p></article></div>", [("story", True)]),
    ("<div><p>the main text</p></div><section class=comments><article><p>nice</p></article></section>", [("the main text", False)]),
    ("<form><div>go</div><article><p>a page in one form</p></article></form><p>x</p>", [("a page in one form", True), ("x", False)]),
    ("<article class=promo><p>all there is</p></article>", [("all there is", True)]),
])
def test_left_out_articles(body, want):
    assert lines(page(body)) == want


@pytest.mark.parametrize(("body", "want"), [
    ("<article><div class='article-header'><h1>Title</h1></div><p>Body</p></article>", [("Title", True), ("Body", True)]),
    ("<article><div class='related-work'>A</div><div class='important-note widget-free'>B</div><p>C</p></article>", [("A", True), ("B", True), ("C", True)]),
    ("<h1>Title</h1><p>Lead</p><article><p>x</p></article>", [("Title", False), ("Lead", False), ("x", True)]),
    ("<div id=comments><article class=comment><p>c</p></article></div><aside><article><p>y</p></article></aside><article><p>x</p></article>", [("x", True)]),
    ("<article><p>x</p><div class='share-buttons'>Share</div><section class='comment-list'>c</section><div class=notice>n</div></article>", [("x", True)]),
    ("<div class='content-header'><h1>Title</h1></div><div class='site-header'>Site</div><div class='post-comments'>c</div>", [("Title", False)]),
])
def test_names_are_a_prior(body, want):
    assert lines(page(body)) == want


def test_differencing_against_plain_pairing(spark):
    """A few hundred pages of three hosts, one of which has most, paired plainly."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        host = rng.choice(["big", "big", "big", "b", "c"])
        path = "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 3))) + f"/{i}"
        parts = [f"<div>menu {host} {rng.randint(0, 2)}</div>", f"<nav>nav {rng.randint(0, 1)}</nav>", f"<div>text {i if rng.random() < 0.8 else 7}</div>"]
        parts += [f"<article><p>story {i}</p></article>"] * (rng.random() < 0.5) + [f"<div>foot {host}</div>"] * (rng.random() < 0.7)
        rows.append((i, f"http://{host}.example/{path}", "".join(parts)))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    every = sorted((*html_extract.url_key(u), i, html_extract.blocks(h)) for i, u, h in rows)
    cut = 0
    for k, (host, path, i, found) in enumerate(every):
        near = [every[j] for j in (k - 1, k + 1) if 0 <= j < len(every) and every[j][0] == host]
        near.sort(key=lambda x: -html_extract.shared_segments(path, x[1]))
        outside = [(t, at) for t, at in found if at != 1]
        gone = []
        for other in near:
            shared = html_extract.common_lines([t for t, _ in outside], [t for t, at in other[3] if at != 1])
            story, its = [t for t, at in found if at == 1], [t for t, at in other[3] if at == 1]
            if any(at == 0 and n not in shared for n, (_, at) in enumerate(outside)) or story and story != its:
                gone = [n for n in shared if outside[n][1] == 0]
                break
        cut += bool(gone)
        assert got[i] == html_extract.main_text(found, gone), i
    assert cut > 100


def test_no_pages(spark):
    got = html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 0


def labelled(n=200, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    docs, toxic = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 60))]
        bad = i % 5 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["zzidiot", "zzmoron", "zztrash"]))
        docs.append((i, " ".join(words)))
        toxic.append((i, int(bad)))
    return docs, toxic


def test_toxicity_held_out(spark, docs_of):
    docs, marks = labelled()
    extra = [(None, "zzidiot zzmoron zztrash"), (900, None), (901, ""), (902, "ab " * 30000), (3, "zzidiot zzmoron zztrash")]
    labels = spark.createDataFrame([(i, y, "x") for i, y in marks] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    learn = labels.where(~toxicity.held_out(labels["doc_id"]))
    got = toxicity.toxicity_scores(docs_of(docs + extra), learn).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    first = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    right = [first[i]["predicted"] == y for i, y in marks if i != 3]
    assert np.mean(right) > 0.97
    assert first[None]["predicted"] == 1 and first[900]["predicted"] == first[901]["predicted"] == first[902]["predicted"] == 0
    assert first[900]["score"] == first[901]["score"] and len(first[0]["evidence"]) > 0
    kept = toxicity.drop_toxic(docs_of(docs + [(None, "zzidiot zzmoron zztrash")]), learn)
    assert kept.columns == docs_of([]).columns and all((r["doc_id"] or 0) % 5 for r in kept.collect() if r["doc_id"] not in (0, None))


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0)]])
def test_toxicity_without_both_labels(spark, docs_of, marks):
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs_of([(1, "a b"), (2, None)]), labels).collect()
    assert {r["score"] for r in got} == {0.5 if not marks else float(marks[0][1])}
    assert toxicity.toxicity_scores(docs_of([]), labels).count() == 0


@pytest.mark.parametrize(("first", "cells"), [(1, 1 << 21), (3, 500)])
def test_block_max_search_is_exact(monkeypatch, first, cells):
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", first)
    monkeypatch.setattr(toxicity, "CELLS", cells)
    rng = np.random.default_rng(0)
    whole = np.zeros((300, 40))
    for e in range(300):
        i = rng.choice(40, rng.integers(0, 8), replace=False)
        whole[e, i] = rng.random(len(i))
    whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-300)
    whole[250:] = whole[:50]  # ties
    text, term = np.nonzero(whole)
    index = toxicity.BlockMaxIndex(text, term, whole[text, term], 300, 40, block=16)
    own = text < 80
    for k in (1, 9, 40, 300, 400):
        found = list(index.nearest(text[own], term[own], whole[text, term][own], 80, k))
        assert len(found) == 80
        for e, (n, s) in enumerate(found):
            all_ = whole @ whole[e]
            order = np.lexsort((np.arange(300), -np.round(all_, 12)))[:k]
            order = order[all_[order] > 0]
            assert n.tolist() == order.tolist() and np.allclose(s, all_[order])


def test_evidence_is_the_nearest_by_whole_vocabulary(spark, docs_of):
    """Against cosines over all words of the examples, computed plainly."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "x_1", "中文"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) + rng.choice(["", ".", "!", "\nW1 w2"])) for i in range(120)]
    marks = [(i, int(i % 4 == 0)) for i in range(0, 120, 2)] + [(4, 0), (2, 0)]  # 4 has both labels, 2 one twice
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    counts = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in docs}
    examples = sorted({(i, y) for i, y in marks if counts[i]})
    terms = sorted({w for i, _ in examples for w in counts[i]})
    for relevance in (2.0, 1.0, 0.0):
        got = {r["doc_id"]: r["evidence"] for r in toxicity.toxicity_scores(docs_of(docs), labels, k=5, relevance=relevance).collect()}

        def weight(w):
            idf = math.log((1 + len(docs)) / (1 + sum(w in c for c in counts.values()))) + 1
            a, c = (sum(w in counts[i] for i, y in examples if y == z) for z in (1, 0))
            return idf * math.log2(2 + a / max(1, c)) ** relevance

        weights = {w: weight(w) for w in terms}
        vector = lambda i: np.array([(1 + math.log(counts[i][w])) * weights[w] if counts[i][w] else 0.0 for w in terms])  # noqa: E731, B023
        unit = lambda v: v / (np.linalg.norm(v) or 1)
        alike = {(y, tuple(sorted(counts[i].items()))): i for i, y in examples}  # equal ones of a label are one
        whole = np.array([unit(vector(i)) for i in alike.values()])
        for i, _ in docs:
            best = np.sort(whole @ unit(vector(i)))[::-1][:5]
            assert np.allclose([e["similarity"] for e in got[i]], best[best > 0], atol=2e-6), i


def test_quality_keeps_target_like_texts(spark, docs_of):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(40))
    junk = lambda: " ".join(rng.choice(["!!", "###", "XX", "alpha!!"]) for _ in range(40))
    docs = [(i, junk() if i % 4 == 0 else good()) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200, 3)] + [(None, 1)], "doc_id long, quality int")
    rows = docs + [(None, "alpha"), (900, None), (901, ""), (5, docs[5][1]), (902, "alpha " * 20000)]
    got = quality.resample(docs_of(rows), labels, keep=0.75).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert sum(i in kept for i, _ in docs if i % 4) >= 145 and sum(i in kept for i, _ in docs if i % 4 == 0) <= 3
    assert quality.resample(docs_of([]), labels).count() == 0
    assert {r["log_weight"] for r in quality.importance_weights(docs_of(rows), labels.where("quality = 5")).collect()} == {0.0}


def test_top_k(spark):
    df = spark.createDataFrame([(i if i else None, float(v)) for i, v in enumerate([3, -1, 3, 0.5, -7.25, 3, 0, 1e5])], "id long, s double")
    for k in range(10):
        got = sorted(df.where(quality.top_k(df, "s", "id", k)).collect(), key=str)
        rows = sorted(df.collect(), key=lambda r: (-r["s"], r["id"] is not None, r["id"] or 0))[:k]
        assert got == sorted(rows, key=str), k


def test_sums_of_any_size_and_string_ids(spark):
    df = spark.createDataFrame([(f"id{i}", float(v)) for i, v in enumerate([3e9, -1e12, 2, 2, 7e11, 2, 0.25])] + [(None, 2.0)], "id string, s double")
    sizes = [df.where(quality.top_k(df, "s", "id", k)).count() for k in range(9)]
    assert sizes == list(range(9))
    assert {r["s"] for r in df.where(quality.top_k(df, "s", "id", 2)).collect()} == {7e11, 3e9}


@pytest.mark.parametrize("span", [100, None])
def test_whole_resampling_against_plain_code(spark, docs_of, span):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma!", "x", "y-z", "É"]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(None, "alpha"), (200, None), (7, rng.choice(["a", "b"]))]
    marks = [(i, int(i % 3 == 0)) for i in range(0, 80, 2)]
    buckets = 64
    own = {n: quality.ngram_buckets(t, buckets) for n, (_, t) in enumerate(rows)}
    good = {i for i, y in marks if y}
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for n, (i, _) in enumerate(rows):
        np.add.at(raw, own[n], 1)
        if i in good:
            np.add.at(target, own[n], 1)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    weight = [0.0 if not len(x) else float(ratio[x].sum() if span is None else ratio[x].mean() * span) for x in own.values()]
    noise = [-math.log(-math.log((xxhash.xxh64_intdigest(f"{i}\0{t or ''}", 0) + 0.5) / 2**64)) for i, t in rows]
    sums = [w + g for w, g in zip(weight, noise, strict=True)]
    k = round(0.6 * len(rows))
    edge = sorted(sums, reverse=True)[k - 1]
    got = quality.resample(docs_of(rows), spark.createDataFrame(marks, "doc_id long, quality int"), keep=0.6, buckets=buckets, span=span).collect()
    key = lambda r: (str(r[0]), round(r[1], 6), round(r[2], 6), r[3])
    assert sorted(map(key, got)) == sorted(key((i, w, s, s >= edge)) for (i, _), w, s in zip(rows, weight, sums, strict=True))


def test_what_a_worker_holds(monkeypatch):
    """What making an index takes is given back before it is asked; its places are numbers of 4 bytes; texts are counted a megabyte at a time."""
    done = []
    monkeypatch.setattr(common, "release", lambda: done.append("released"))
    monkeypatch.setattr(common, "_held", {})
    assert common.held("index", lambda: done.append("made") or 7) == 7
    assert done == ["released", "made", "released"]
    index = toxicity.BlockMaxIndex(np.arange(90), np.arange(90) % 7, np.ones(90), 90, 7, block=16)
    assert {x.dtype.itemsize for x in (index.example, index.at, index.cell_block, index.cells, index.postings, index.heavy)} == {4}
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["word " * 2000] * 400)], ["id", "text"])
    parts = list(toxicity.slices(iter([batch]), most=toxicity.SLICE_BYTES))
    assert sum(p.num_rows for p in parts) == 400 and max(p.num_rows for p in parts) * 10_000 <= 1.1 * 2**20
