"""The pipeline against a version without Spark, and the set of queries."""

import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from wayquad.llm import bpe, decontaminate, quality, queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed=9):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["an", "ti", "or", "el", "mu", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    items = [(k, " ".join(rng.choice(plain) for _ in range(14))) for k in range(4)]
    docs, labels = [], []
    for k in range(420):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 90))]
        if k % 9 == 1 and docs:
            words = docs[rng.randrange(len(docs))][1].split(" ")
            if k % 2:
                words = [*words, "tail"]
        good, toxic = k % 5 != 0, k % 7 == 0
        if toxic:
            words = [w if rng.random() > 0.15 else rng.choice(["grobnak", "vilk", "grobnaken"]) for w in words]
        if not good:
            words = [w + "$$$" for w in words]
        if k % 31 == 3:
            words += items[k % 4][1].split()[:11]
        docs.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, int(good), int(toxic)))
    docs += [(9000, None), (9001, ""), (9002, "few words")]
    return docs, labels, items


def toxic_scores(docs, found, totals):
    """Scores of the two models, built here from the texts: halves by digest, calibration on the other half."""
    label = {}
    for _, y, t in found:
        label[t] = max(y, label.get(t, 0))
    half = {t: int(hashlib.md5(t.encode()).hexdigest()[-1], 16) % 2 for t in label}
    known = sorted(label)
    keys, n = toxicity.counted([toxicity.normal(t) for t in known], np.array([2 * half[t] + label[t] for t in known]), 4)
    runs = toxicity.shared_runs([toxicity.normal(t) for _, t in docs if t])
    judges = [toxicity.Comparer(toxicity.KneserNey(keys, n[:, 2 - 2 * h : 4 - 2 * h], runs)) for h in (0, 1)]
    x = np.array([judges[half[t]].figures([toxicity.normal(t)])[0] for _, _, t in found])
    y = np.array([r[1] for r in found])
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    weights = toxicity.logistic(x[order], y[order], toxicity.RIDGE)
    model = toxicity.Model(totals[1] / totals.sum(), toxicity.KneserNey(keys, n[:, :2] + n[:, 2:], runs), weights)
    return model.scores([t or "" for _, t in docs])


def without_spark(docs, labels, items):
    def rows(place, modulus, held):
        """Labelled documents that are still there, with their labels, and how many have each label."""
        text = dict(docs)
        found = sorted((k, label[place], text[k]) for k, *label in labels if text.get(k) is not None and zlib.crc32(str(k).encode()) % modulus != held)
        return found, np.array([sum(r[1] == 0 for r in found), sum(r[1] == 1 for r in found)])

    found, totals = rows(0, 5, 0)
    scores = quality.Model([quality.sparse(quality.terms(r[2])) for r in found], np.array([r[1] for r in found]), totals).scores([t or "" for _, t in docs])
    docs = [d for d, s in zip(docs, scores, strict=True) if s >= 0.3]
    docs = [d for d, s in zip(docs, toxic_scores(docs, *rows(1, 4, 2)), strict=True) if s < 0.3]
    sets = {}
    for k, t in docs:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    ids, root = sorted(sets), {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    docs = [(k, t) for k, t in docs if find(k) == k]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [decontaminate.words(t)] for i in range(max(1, len(w) - 9))}
    clean = []
    for k, t in docs:
        w = decontaminate.words(t or "")
        if not any(tuple(w[i : i + 10]) in windows for i in range(len(w))):
            clean.append((k, t))
    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    return {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in clean}, dict(clean)


def test_pipeline_against_a_version_without_spark(spark, tmp_path):
    docs, labels, items = corpus()
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(k, t, "en", None, None) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stage = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [stage.count()]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, stage, folder)
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / f"s{k}"))
        stage = spark.read.parquet(str(tmp_path / f"s{k}"))
        counts.append(stage.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] == counts[5]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    ids, text = without_spark(docs, labels, items)
    assert {k: r["ids"] for k, r in got.items()} == ids
    for k, r in got.items():
        assert r["n_tokens"] == len(ids[k])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[k])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text[k] or "").encode()).hexdigest()


def test_stages_keep_clashing_columns(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["_score", "_found", "body", "root", "digest", "cls", "kept"]
    own = spark.createDataFrame([(k, t, *names) for k, t in docs[:60]], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for _, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, own, str(tmp_path))
        assert out.columns == own.columns
        assert all(list(r[2:]) == names for r in out.collect())
        assert f(spark, own.limit(0), str(tmp_path)).collect() == []
    assert corpus_pipeline.STAGES[4][1](spark, own, str(tmp_path)).count() == 60


def test_no_row_is_lost_with_repeated_ids(spark, tmp_path):
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)).collect()) == [(1, a), (2, b)]


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "bpe"]
