import random

from wayquad.llm import decontaminate

DOCS = "doc_id long, text string, n_words string"


def brute(docs, items, window):
    pats = []
    for name, text in items:
        w = decontaminate.words(text or "")
        for s in range(max(1, len(w) - window + 1)):
            if w[s : s + window]:
                pats.append((name, w[s : s + window]))
    out = {}
    for key, text in docs:
        w = decontaminate.words(text or "")
        hit, names = set(), set()
        for name, p in pats:
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    hit |= set(range(s, s + len(p)))
                    names.add(name)
        out[key] = (len(w), len(hit), sorted(names))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = ["a", "B", "c1", "é", "dd", "Ee", "ß"]
    items = [(str(k), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 9])))) for k in range(12)]
    items += [("none", None), ("blank", " ,. "), ("", "zz yy"), ("7", items[7][1])]
    docs = [(k, ", ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 30])))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "zz! YY zz yy"), (103, "x " * 30_000 + "zz yy")]
    return docs, items


def test_against_brute_force_in_one_and_many_blocks(spark, monkeypatch):
    docs, items = cases()
    want = brute(docs, items, 4)
    d = spark.createDataFrame([(*r, "clash") for r in docs], DOCS).repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    for block, piece in ((100_000, 5_000), (10, 5_000), (12, 3)):
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
        got = {r["doc_id"]: r["found"] for r in decontaminate.find(d, b, window=4, block_words=block).collect()}
        assert {k: (f["n_words"], f["n_hit"], f["items"]) for k, f in got.items()} == want


def test_spans_lie_in_the_original_text(spark):
    text = "Über: AB, cd! — Ab CD x"
    d = spark.createDataFrame([(1, text, "")], DOCS)
    b = spark.createDataFrame([("q", "ab cd")], "item_id string, text string")
    found = decontaminate.find(d, b).first()["found"]
    assert [text[s["start"] : s["end"]] for s in found["spans"]] == ["AB, cd", "Ab CD"]


def test_clean_keeps_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "ab cd", "k"), (2, "other", "k"), (2, "other", "k"), (None, None, None)], DOCS)
    b = spark.createDataFrame([(None, "ab cd")], "item_id long, text string")
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 2]
    assert decontaminate.clean(d, b.limit(0)).count() == 4
    assert decontaminate.find(d.limit(0), b).collect() == []


def test_query(spark, tmp_path):
    docs, items = cases()
    docs += [(200, " ".join(f"w{k}" for k in range(30))), (201, " ".join(f"w{k}" for k in range(9)))]
    items += [("q", " ".join(f"W{k}," for k in range(5, 18)))]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, items, 10)
    out = decontaminate.op5(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for r in out.collect():
        n, hit, names = want[r["doc_id"]]
        assert tuple(r)[1:] == (n, hit, len(names), decontaminate.sha256_of(names), hit > 0)
