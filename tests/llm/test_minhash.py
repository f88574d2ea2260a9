import random

import numpy as np
import pytest

from wayquad.llm import minhash

SCHEMA = "doc_id long, text string, cls string"


def brute(rows, n, num, den):
    sets = {}
    for doc_id, text in rows:
        w = [x for x in (text or "").encode().lower().split()]
        m = min(n, len(w))
        sets[doc_id] = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1, groups=12, copies=9, large=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = []

    def add(words):
        rows.append((len(rows) * 3 + 1, " ".join(words)))

    def edited(words, edits):
        out = list(words)
        for _ in range(edits):
            out[rng.randrange(len(out))] = rng.choice(vocabulary) + "x"
        return out

    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 20, 80, 200]))]
        if g % 2:
            base += common.split()
        for _ in range(copies):
            add(edited(base, rng.choice([0, 0, 1, 2, 5])))
    base = [rng.choice(vocabulary) for _ in range(110)]
    for _ in range(large):  # similarities around the threshold
        add(edited(base, rng.choice([1, 2, 3, 4, 6])))
    for _ in range(60):
        add([rng.choice(vocabulary) for _ in range(60)] + common.split())
    rows += [(100_001, None), (100_002, ""), (100_003, " \t\n"), (100_004, "One two"), (100_005, "one  TWO"), (100_006, "É a b"), (100_007, "é a b")]
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, monkeypatch, n, num):
    rows = corpus()
    monkeypatch.setattr(minhash, "BLOCK", 32)
    monkeypatch.setattr(minhash, "EDGES", 50)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, n, num, 100).collect()}
    want = brute(rows, n, num, 100)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "k"), (2, "a b c d e f", "k"), (None, "a b c d e f", None), (5, "A B C D E F", "k")], SCHEMA)
    got = sorted(((r["doc_id"] or -1), r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(docs, 3, 85, 100).collect())
    assert got == [(-1, -1, True), (2, 2, True), (2, 2, True), (5, 2, False)]
    kept = minhash.keep_one(docs, 3, 85, 100)
    assert kept.columns == ["doc_id", "text", "cls"]
    # One of the repeated rows stays, and the row without an id.
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []
    assert minhash.keep_one(docs.limit(0)).collect() == []


def test_texts_that_share_an_id_are_judged_row_by_row(spark):
    a, b = "one two three four five six", "alpha beta gamma delta epsilon zeta"
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, None, "u"), (3, "", "v"), (4, b, "w")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(r["cls"] for r in minhash.keep_one(docs).collect()) == ["u", "v", "x", "z"]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (3, 3, True), (4, 2, False)]
    # Two rows of one id and no other: nothing is lost.
    assert minhash.keep_one(spark.createDataFrame([(2, a, ""), (2, b, "")], SCHEMA)).count() == 2


def test_ids_that_are_texts(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five SIX"), ("c", "else")], "doc_id string, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True)}
    assert {r["doc_id"] for r in minhash.keep_one(docs).collect()} == {"a", "c"}


def test_large_weakly_tied_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(7)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for g in range(40):  # small clusters that all share one passage, more than half of their text
        own = [f"g{g}w{k}" for k in range(30)]
        for _ in range(4):
            words = own + common
            words[rng.randrange(len(words))] = f"e{rng.random()}"
            rows.append((len(rows) + 1, " ".join(words)))
    base = [f"b{k}" for k in range(120)]
    for k in range(60):  # a chain: each is like the next, the ends are not alike
        rows.append((1000 + k, " ".join(base[k:] + [f"n{j}" for j in range(k)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 3, 85, 100).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_union_sketches_against_sets():
    rng = np.random.default_rng(5)
    k = 8
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 20)).astype(np.uint64)) for _ in range(2))
        fill = lambda s: np.append(s[:k], np.full(k - len(s[:k]), minhash.NONE)).astype(np.uint64)[None]
        size, both = minhash.union_sketches(fill(a), fill(b), k)
        union = sorted({*a.tolist(), *b.tolist()})[:k]
        assert size[0] == len(union)
        assert both[0] == len(set(union) & set(a.tolist()) & set(b.tolist()))


def test_query(spark, tmp_path):
    rows = corpus(groups=4, copies=4, large=20)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = minhash.op3(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute(rows, 3, 85, 100)


def test_long_text(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, long, ""), (2, long + " end", ""), (3, "other text of few words", "")], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (59_996, 1), 2: (59_997, 1), 3: (1, 3)}


def test_components_of_a_path(spark, monkeypatch):
    monkeypatch.setattr(minhash, "EDGES", 7)
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {r["v"]: r["root"] for r in minhash.components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_need_never_exceeds_what_small_sets_share():
    for size in range(1, 65):
        assert 1 <= minhash.needed(size, 64, 0.85) <= max(1, -(-85 * size // 100))
