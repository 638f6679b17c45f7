import hashlib

import numpy as np
import pytest

from millrace.llm import common, exact_dedup, simhash

ROWS = [(1, "Same Text"), (2, "same text"), (3, "other"), (None, "OTHER"), (4, None), (5, ""), (6, "É x"), (7, "é x"), (7, "é x"), (8, "same text"), (9, "w " * 20000)]


def brute(rows):
    low = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    key = lambda i: (i is not None, i or 0)
    return sorted(((i, max(groups[low(t)], key=key), len(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("key", [exact_dedup.xxh64, len, lambda b: 0])
def test_exact(docs_of, key):
    got = exact_dedup.exact_dedup(docs_of(ROWS), key=key, capacity=2).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(ROWS)
    assert sum(r["kept"] for r in got) == len({(t or "").encode().lower() for _, t in ROWS})


def test_exact_empty(docs_of):
    got = exact_dedup.exact_dedup(docs_of([]))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and got.count() == 0


def test_index_buckets(spark, docs_of):
    """Buckets hold at most their capacity, cover all keys and keep texts apart that share a key."""
    docs = docs_of([(i, f"text {i}") for i in range(300)])
    rows = common.stage(exact_dedup.reduced(docs, "doc_id", "text"), "t")
    index = exact_dedup.build_index(rows, capacity=20, with_text=True).collect()
    assert len(index) == 300 and {bytes(r["text"]).decode() for r in index} == {f"text {i}" for i in range(300)}
    sizes = {}
    for r in index:
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
    assert max(sizes.values()) <= 20
    same = exact_dedup.build_index(common.stage(exact_dedup.reduced(docs, "doc_id", "text", len), "t"), key=len, capacity=20).collect()
    assert max(r["chain"] for r in same) > 0 and len(same) == 300


@pytest.mark.parametrize("held", [exact_dedup.HELD_BYTES, 1])
def test_exact_of_string_ids_and_full_dictionaries(spark, monkeypatch, held):
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", held)
    rows = [("a", "x"), ("b", "X"), ("é", "x"), (None, "x"), ("c", "y"), (None, "z"), (None, "Z")] * 3
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string").repartition(2)).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {("a", "é", 12), ("b", "é", 12), ("é", "é", 12), (None, "é", 12), ("c", "c", 3), (None, None, 6)}
    assert len(got) == 21 and sum(r["kept"] for r in got) == 3


def test_simhash_against_all_pairs(docs_of):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [words[j] for j in rng.integers(0, 60, 80)]
        rows.append((3 * i, " ".join(base)))
        base[int(rng.integers(0, 80))] = "changed"
        rows += [(3 * i + 1, " ".join(base)), (3 * i + 2, " ".join(base).upper())]
    rows += [(None, "null id"), (500, None), (501, " \t\n"), (502, "one"), (503, "ONE"), (504, "a b c"), (504, "a b c"), (505, "q " * 30000)]
    got = sorted(simhash.simhash_components(docs_of(rows), tile=16).collect(), key=str)
    fps = [simhash.fingerprint((t or "").encode().lower()) for _, t in rows]
    assert sorted((r["doc_id"], r["fingerprint"]) for r in got if r["doc_id"] is not None) == sorted((i, f"{f:016x}") for (i, _), f in zip(rows, fps, strict=True) if i is not None)
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 4
    label = np.arange(len(rows))
    while True:
        new = np.array([label[m].min() for m in near])
        if (new == label).all():
            break
        label = new
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, least.get(c)) for (i, _), c in zip(rows, label, strict=True)), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == want


def test_simhash_fingerprint_by_definition():
    import xxhash

    words = b"a b c d e f g".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(4)]
    assert simhash.fingerprint(b" a b  c d\te f g ") == sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > 4)
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(b"x y") == xxhash.xxh64_intdigest(b"x y", 42)


def test_forest_of_a_dense_group():
    a = np.sort(np.arange(64, dtype=np.uint64))
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    u, v = simhash.tile_forest(a, a, 1)
    assert len(u) == 63  # a hypercube hangs together


def test_near_duplicates_drop(docs_of):
    docs = docs_of([(1, "a b c d e"), (2, "A b c d e"), (3, "something else here now"), (None, "null id text")])
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 3, None]
    assert simhash.simhash_components(docs_of([])).count() == 0


def test_near_duplicates_of_repeated_rows(docs_of):
    far = "words of another kind that share nothing with it"
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "A b c d e"), (2, "a b c d E")]  # one component
    rows += [(0, far), (1, far), (1, "one more text of its own"), (None, "null id text"), (None, "null id text")]
    docs = docs_of(rows)
    out = simhash.drop_near_duplicates(docs)
    got = sorted(((r["doc_id"], r["text"].lower()) for r in out.collect()), key=str)
    assert out.columns == docs.columns and got == [(0, far), (1, "a b c d e"), (1, "one more text of its own"), (None, "null id text")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(100, 50 + i) for i in range(40)] + [(7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(21, 41)} == {21} and got[100] == got[89] == 50
