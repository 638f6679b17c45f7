import random
import re

import pytest

from millrace.llm import common, decontamination, line_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                if x := wins.get(tuple(w[j : j + n])):
                    found |= x
                    hit[j : j + n] = [1] * n
        out.append((i, len(w), sum(hit), sorted(str(x) for x in found if x is not None), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontamination.BLOCK_WINDOWS, 9])
def test_against_brute_force(spark, docs_of, block):
    rng = random.Random(5)
    vocabulary = [f"{c}{n}" for c in "abcdé" for n in range(4)] + ["Ünï", "x-y"]
    passage = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, passage(n)) for i, n in enumerate((1, 2, 3, 4, 5, 8, 13, 14, 20, 40))] + [(77, None), (78, ""), (79, "!!"), (None, passage(15)), (80, "a0 a0 a0 a0 a0 a0")]
    docs = []
    for i in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.4 else passage(rng.randint(1, 30)) for _ in range(rng.randint(0, 5))]
        docs.append((i, rng.choice([". ", "\n", " "]).join(parts).upper() if rng.random() < 0.5 else " ".join(parts)))
    docs += [(None, items[9][1]), (500, None), (501, ""), (502, "z9 " * 3000 + items[8][1]), (3, items[7][1]), (3, items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs_of(docs), bench, block_windows=block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontamination.decontaminate(docs_of([(1, "a b")]), none).collect()] == [(1, 2, 0, [], False)]
    assert decontamination.decontaminate(docs_of([]), none).count() == 0


def test_contaminated_go(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of([(1, item), (2, "clean text"), (3, item + " filler" * 2000), (None, None)])
    out = decontamination.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted((r["doc_id"] for r in out.collect()), key=str) == [2, 3, None]


def line_brute(rows, least=5):
    lines = []
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            lines.append(((-1 if i is None else i, k), x.lower().split()))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    gone = {p for p, w in lines if w and any(q < p and (v == w or min(len(w), len(v)) >= least and near(w, v)) for q, v in lines)}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for k, x in enumerate(parts) if (-1 if i is None else i, k) not in gone]
        out.append((i, "\n".join(kept) if len(kept) < len(parts) else t, len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_at_once", [common.BLOCK_ROWS, 5, 1])
def test_lines_against_brute_force(docs_of, monkeypatch, rows_at_once):
    """Lists sent whole, in blocks, and shuffled."""
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", rows_at_once)
    monkeypatch.setattr(common, "BLOCK_ROWS", rows_at_once)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 9))] for _ in range(12)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at, kind = rng.randrange(len(w)), rng.random()
                if kind < 0.4:
                    w[at] = rng.choice(vocabulary)
                elif kind < 0.7:
                    del w[at]
                else:
                    w.insert(at, rng.choice(vocabulary))
            own.append((" " if rng.random() < 0.5 else "  ").join(w).title() if rng.random() < 0.3 else " ".join(w))
        rows.append((i, "\n".join(own)))
    rows += [(None, "w1 w2 w3 w4 w5 w6"), (100, "w1 w2 w3 w4 w5"), (101, None), (102, ""), (103, "\n\n"), (104, "long " * 5000), (105, "long " * 5001)]
    got = line_dedup.dedup_lines(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=str) == line_brute(rows)


def test_lines_edge_cases(docs_of):
    docs = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e x\nshort")])
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(1, "a b c d e f"), (1, "a b c d e f"), (2, "short")]  # repeated rows are alike
    out = line_dedup.dedup_lines(docs_of([]))
    assert out.count() == 0 and set(docs.columns) < set(out.columns)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, min_words=1)


def test_short_and_spaceless_lines(spark, docs_of):
    import corpus_pipeline

    rows = [(1, "Les.\n\na b c d e f"), (2, "les.\n\n这是一个没有空格的段落\na b c d e x"), (3, "这是一个没有空格的段落\nles\n  LES. \nand b"), (None, "and  b")]
    docs = docs_of(rows)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs.withColumn("n_chars", docs["doc_id"]), "").collect()}
    assert got == {1: "Les.\n\na b c d e f", 2: "\n这是一个没有空格的段落", 3: "les", None: "and  b"}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 2, 3: 3, None: 0}
