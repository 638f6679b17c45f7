import os
import random

import pytest

import corpus_pipeline
from millrace.llm import common, queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    first = docs = common.load(spark, SF, "documents")
    sizes = [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(function(spark, docs, SF), name)
        assert docs.columns == first.columns and docs.dtypes == first.dtypes
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0.7 * sizes[0] < sizes[-1] < sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, last.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, whole.select("doc_id", "piece", "length").collect()))
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}


def test_all_operators_are_registered():
    assert {int(n.removeprefix("op").split("_")[0]) for n in queries.queries()} == set(range(1, 14))
    assert len(queries.queries()) == 13


ITEM = "the quick brown fox jumps over the lazy dog and runs far away into the deep woods"
CLASHES = ["bad", "gone", "id", "tid", "cut", "rid", "words", "n_lines", "__gone", "__id", "__bad", "__tid", "TID"]


@pytest.fixture
def sf_dir(spark, tmp_path):
    labels = [(i, 0, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None), (None, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def plain_docs():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, ("zzfoul zzvile " * 3 if i % 4 == 0 else "") + "\n".join(text(rng.randint(6, 12)) for _ in range(3))) for i in range(60)]
    rows += [(100 + i, rows[1][1]) for i in range(5)] + [(110, rows[2][1].upper()), (111, rows[5][1] + " w1"), (120, f"{text(8)}\n{rows[6][1]}")]
    return rows + [(130, ITEM), (131, f"{text(100)} {ITEM} {text(300)}"), (140, None), (141, ""), (142, "\n\n"), (None, None), (None, text(9)), (150, "long words " * 20_000), (7, rows[7][1]), (7, "another text of id seven that stands alone")]


def documents_of(spark, rows):
    """documents with columns whose names the operators might use."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES if c.lower() != "tid" or c == "tid")
    names = [c for c in CLASHES if c.lower() != "tid" or c == "tid"]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


def test_stages_on_odd_rows(spark, sf_dir):
    """Null ids and texts, empty and long texts, repeats and clashing names, each stage against plain code on what the one before kept."""
    from .test_decontamination_and_lines import brute, line_brute

    docs = documents_of(spark, plain_docs())
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    kept = common.stage(stages["toxicity"](spark, docs, sf_dir), "t")
    assert kept.dtypes == docs.dtypes
    gone = {i for i, t in plain_docs() if i is not None and i < 60 and i % 4 == 0}
    assert not gone & {i for i, _ in rows(kept)} and len(rows(kept)) >= len(plain_docs()) - len(gone) - 1

    lined = common.stage(stages["line_dedup"](spark, kept, sf_dir), "l")
    assert lined.dtypes == docs.dtypes
    assert rows(lined) == sorted(((i, t) for i, t, _, _ in line_brute(rows(kept))), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect() if r["text"] is not None)

    single = common.stage(stages["simhash"](spark, lined, sf_dir), "s")
    assert single.dtypes == docs.dtypes
    prints = [(i, t, simhash.fingerprint((t or "").encode().lower())) for i, t in rows(lined)]
    label = list(range(len(prints)))
    for _ in prints:
        label = [min(label[j] for j, (_, _, g) in enumerate(prints) if (f ^ g).bit_count() <= 4) for _, _, f in prints]
    groups = {}
    for (i, t, _), c in zip(prints, label, strict=True):
        groups.setdefault(c, []).append((i, t))
    least = {c: min((i for i, _ in own if i is not None), default=None) for c, own in groups.items()}
    got = rows(single)
    assert len(got) == len(groups) and sorted((i for i, _ in got), key=str) == sorted(least.values(), key=str)
    assert all(any(x in own for own in groups.values()) for x in got)

    clean = common.stage(stages["decontamination"](spark, single, sf_dir), "d")
    assert clean.dtypes == docs.dtypes
    bad = [r[0] for r in brute([(n, t) for n, (_, t) in enumerate(got)], [(1, ITEM), (2, "short item"), (3, None), (None, "x y")]) if r[-1]]
    assert rows(clean) == sorted((x for n, x in enumerate(got) if n not in bad), key=str)

    packed = stages["packing"](spark, clean, sf_dir).collect()
    assert sorted({r["doc_id"] for r in packed}, key=str) == sorted({i for i, _ in rows(clean)}, key=str)
    assert all(r["length"] <= 4096 for r in packed)


def test_stages_of_empty_tables(spark, sf_dir):
    docs = documents_of(spark, [])
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf_dir)
        assert out.count() == 0, name
        if name != "packing":
            assert out.dtypes == docs.dtypes, name


def test_lists_in_blocks_and_shuffled(spark, sf_dir, monkeypatch):
    """Drop lists sent whole, in blocks and joined by shuffling drop the same rows."""
    docs = documents_of(spark, plain_docs())
    stages = [f for n, f in corpus_pipeline.STAGES if n in ("toxicity", "simhash", "decontamination")]
    whole = [sorted(map(str, f(spark, docs, sf_dir).select("doc_id", "text").collect())) for f in stages]
    for rows, blocks in ((3, 100), (1, 1)):
        monkeypatch.setattr(common, "BLOCK_ROWS", rows)
        monkeypatch.setattr(common, "MOST_BLOCKS", blocks)
        assert whole == [sorted(map(str, f(spark, docs, sf_dir).select("doc_id", "text").collect())) for f in stages]
