import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, i int, s string, __part int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levelled(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        at = i - i % fanout
        run = level[at : at + fanout]
        out.append((run[: i - at], run[i - at + 1 :]))
        i //= fanout
    return out


def brute(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof_sha256) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, digest(*r[:5]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levelled([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order}
    top = levelled([trees[g][-1][0] for g in order], fanout)
    out = []
    for n, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof = siblings(trees[g], i, fanout) + siblings(top, n, fanout)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h("".join("".join(b + a) for b, a in proof))))
    return sorted(out, key=str)


def made(n, sources, seed=1):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "a", "é\nü", "two\n\nlines", "日本"])
    rows = [(rng.choice([None, *range(n)]) if i % 9 == 0 else i, rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 3]), text(), "x", i, "y", 0) for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("n", "sources", "fanout"), [(70, [None, "", "b", "a", "é", "z"], 3), (40, ["hot"] * 9 + list("abcdefghijklm"), 3), (1, ["a"], 3), (2, [None], 3), (30, ["a"], 2), (45, ["a", "b"], 5)])
def test_against_plain_trees(spark, n, sources, fanout):
    rows = made(n, sources)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], fanout=fanout)
    got = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")), manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, fanout)
    assert all(r[5] == r["root"] for r in got)


def test_other_columns_come_through(spark):
    leaves = spark.createDataFrame([(i, "s", h(str(i)), f"r{i}", i) for i in range(7)], "at long, g string, h string, root string, proof int")
    got = manifest.proofs(leaves, "g", ["at"], "h")
    assert got.columns == ["at", "g", "h", "root", "proof", "subroot", "root_", "proof_"]
    rows = got.orderBy("at").collect()
    assert [(r["at"], r["h"], r["root"], r["proof"]) for r in rows] == [(i, h(str(i)), f"r{i}", i) for i in range(7)]
    assert {r["root_"] for r in rows} == {levelled([h(str(i)) for i in range(7)], 3)[-1][0]}


def test_without_rows(spark):
    got = manifest.manifest(spark.createDataFrame([], SCHEMA), ["doc_id", "text"])
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof"] and got.count() == 0


def test_tampered_rows_are_found(spark, tmp_path):
    """The query: line feeds taken out of every other row."""
    import zlib

    rows = made(60, ["a", "b", None])
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_manifest(spark, str(tmp_path)).collect()
    changed = {digest(*r[:5]) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")}
    assert len(got) == len(rows) and changed
    assert {r["leaf"] for r in got if not r["verified"]} == changed
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
