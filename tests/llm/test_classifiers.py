import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayquad.llm import quality, toxicity
from wayquad.llm.labelled import sample, usable

DOCS = "doc_id long, text string, score string"


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["an", "ti", "or", "el", "mu", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rude = ["grobnak" + e for e in ("", "a", "il", "ost", "en", "ur")] + ["vilk"]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 90))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.75
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(rude)
        if not good:
            words = [w + rng.choice(["!!", "$$$", "###"]) for w in words] if k % 2 else [w for w in words[:12] for _ in range(9)]
        docs.append((k, " ".join(words).capitalize() + ".", "x"))
        if k % 3 < 2:
            labels.append((k, int(good), int(toxic)))
    docs += [(5000, None, None), (5001, "", ""), (5002, " \n", ""), (None, "one two", ""), (5003, "word " * 40_000, ""), (0, docs[0][1], "x")]
    truth = {k: (g, t) for k, g, t in labels}
    labels += [(None, 1, 0), (7000, None, None), (7001, 1, 1)]
    return docs, labels, truth


@pytest.mark.parametrize(("module", "place", "modulus", "held"), [(quality, 0, 5, 0), (toxicity, 1, 4, 2)])
def test_held_out_rows(spark, module, place, modulus, held):
    docs, labels, truth = corpus()
    d = spark.createDataFrame(docs, DOCS).repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = module.score(d, module.fit(d, lab), into="_s").collect()
    assert len(rows) == len(docs)
    assert all(0 <= r["_s"] <= 1 for r in rows)
    test = [(truth[r["doc_id"]][place], int(r["_s"] >= 0.3)) for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % modulus == held]
    assert len(test) > 80
    assert sum(a == b for a, b in test) / len(test) > 0.95
    # The score of a text does not depend on the partitions, nor on the rows beside it.
    again = {r["doc_id"]: r["_s"] for r in module.score(d.repartition(2), module.fit(d.repartition(2), lab), into="_s").collect()}
    assert all(abs(again[r["doc_id"]] - r["_s"]) < 1e-9 for r in rows)


def test_queries_of_the_classifiers(spark, tmp_path):
    docs, labels, truth = corpus()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query, modulus, held in ((toxicity.op6, 4, 2), (quality.op9, 5, 0)):
        out = query(spark, str(tmp_path))
        assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
        rows = out.collect()
        assert sorted(r["doc_id"] or -1 for r in rows) == sorted(d[0] or -1 for d in docs)
        for r in rows:
            assert r["predicted"] == (r["score"] >= 0.3)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_rows(spark, module):
    d = spark.createDataFrame([(1, "a b", ""), (2, None, "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["_s"] for r in module.score(d, module.fit(d, none), into="_s").collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(k, 1, 1) for k in range(9)], "doc_id long, quality int, toxic int")
    assert {r["_s"] for r in module.score(d, module.fit(d, one), into="_s").collect()} == {1.0}
    assert module.score(d.limit(0), module.fit(d, one), into="_s").collect() == []


class Plain:
    """Interpolated Kneser-Ney with dictionaries and strings of bytes, straight from its definition."""

    def __init__(self, own, everywhere):
        order, shared = toxicity.ORDER, toxicity.SHARED
        grams = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
        self.n = []
        for c in (0, 1):
            top = Counter(g for t in own[c] for g in set(grams(t, order)))
            counts = {order: top}
            for length in range(order - 1, shared, -1):
                counts[length] = Counter(g[1:] for g in counts[length + 1])
            seen = {length: {g for t in everywhere for g in grams(t, length)} for length in (shared + 1,)}
            for length in range(shared, 0, -1):
                seen[length] = {g[1:] for g in seen[length + 1]}
                counts[length] = Counter(g[1:] for g in seen[length + 1])
            self.n.append(counts)
        self.after = [{length: defaultdict(list) for length in counts} for counts in self.n]
        for c, counts in enumerate(self.n):
            for length, own_counts in counts.items():
                for g, n in own_counts.items():
                    self.after[c][length][g[:-1]].append(n)

    def p(self, c, run):
        out = 1 / 256
        for length in range(1, len(run) + 1):
            g = run[len(run) - length :]
            follow = self.after[c][length].get(g[:-1])
            if follow:
                total, d = sum(follow), toxicity.DISCOUNT
                out = max(self.n[c][length].get(g, 0) - d, 0) / total + d * len(follow) / total * out
        return out

    def mean(self, text):
        runs = [text[i : i + toxicity.ORDER] for i in range(len(text) - toxicity.ORDER + 1)]
        return sum(math.log(self.p(1, r)) - math.log(self.p(0, r)) for r in runs) / len(runs)


def test_kneser_ney_against_its_definition(spark):
    docs, labels, _ = corpus(300)
    docs = [(k, t, s) for k, t, s in docs if k is not None]
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    y = {k: t for k, _, t in labels if k is not None and t is not None and zlib.crc32(str(k).encode()) % 4 != 2}
    own = [{toxicity.normal(t) for k, t, _ in docs if t and y.get(k) == c} for c in (0, 1)]
    plain = Plain(own, {toxicity.normal(t) for _, t, _ in docs if t})
    bodies = [toxicity.normal(t) for _, t, _ in docs[:40] if t] + [toxicity.normal("grobnakost qqq zzzz"), toxicity.normal("é 漢字 A!B")]
    got = toxicity.Comparer(model.models).figures(bodies)
    assert np.allclose(got[:, 0], [plain.mean(b) for b in bodies], atol=1e-12)
    assert np.allclose(np.expm1(got[:, 1]), [len(b) - toxicity.ORDER + 1 for b in bodies])
    # Over all next bytes an interpolated model has probability 1 if it knows the context.
    for c in (0, 1):
        assert abs(sum(plain.p(c, b" ant" + bytes([b])) for b in range(256)) - 1) < 0.05


def test_pieces_of_long_texts_hold_all_runs(monkeypatch):
    bodies = [toxicity.normal(t) for t in ("ab cde " * 50, "", "x", "long " * 300)]
    whole = toxicity.counted(bodies, np.array([0, 0, 1, 1]), 2)
    runs = toxicity.shared_runs(bodies)
    totals = [sum(len(key) for _, _, key in toxicity.pieces(bodies, toxicity.ORDER))]
    monkeypatch.setattr(toxicity, "PIECE", 64)
    cut = toxicity.counted(bodies, np.array([0, 0, 1, 1]), 2)
    totals.append(sum(len(key) for _, _, key in toxicity.pieces(bodies, toxicity.ORDER)))
    assert np.array_equal(whole[0], cut[0])
    assert np.array_equal(whole[1] > 0, cut[1] > 0)
    assert np.array_equal(runs, toxicity.shared_runs(bodies))
    assert totals[0] == totals[1] == sum(max(0, len(b) - toxicity.ORDER + 1) for b in bodies)


def test_toxic_words_outside_the_calibration_sample_count(spark):
    docs, _, truth = corpus()
    # A word of one toxic text that the bounded sample leaves out must be known to the models.
    rare = [(9000, "xyqqzwv " * 3 + "an ti or", "x")] + [(9100 + k, f"or ti an el mu{k}", "x") for k in range(40)]
    marks = [(9000, 1, 1)] + [(9100 + k, 1, 0) for k in range(40)]
    d = spark.createDataFrame(docs[:900] + rare, DOCS).repartition(4)
    lab = spark.createDataFrame([(k, 1, t) for k, (_, t) in truth.items()] + marks, "doc_id long, quality int, toxic int")
    assert zlib.crc32(b"9000") % 4 != 2
    figures = toxicity.Comparer(toxicity.fit(d, lab, per_class=(30, 30)).models).figures([toxicity.normal("xyqqzwv"), toxicity.normal("an ti")])
    assert figures[0, 0] > 0.5 > figures[1, 0]


def test_votes_against_a_plain_version(spark):
    docs, labels, _ = corpus(500)
    docs = [(k, t, s) for k, t, s in docs if k is not None][:-1]
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    model = quality.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    y = {k: q for k, q, _ in labels if k is not None and q is not None and zlib.crc32(str(k).encode()) % 5 != 0}
    known = sorted((k, t) for k, t, _ in docs if k in y and t is not None)
    assert model.y.astype(int).tolist() == [y[k] for k, _ in known]

    def vector(text):
        z = quality.rates(quality.terms(text)) @ model.base
        return z / max(np.linalg.norm(z), 1e-9)

    vectors = [vector(t) for _, t in known]
    for _, text, _ in docs[:60]:
        sims = [round(float(vector(text) @ v), 9) for v in vectors]
        best = sorted(range(len(sims)), key=lambda k: (-sims[k], k))[: quality.NEIGHBOURS]
        weight = [max(sims[k], 0) ** quality.POWER * model.stands[k] for k in best]
        want = sum(w * y[known[k][0]] for w, k in zip(weight, best, strict=True)) / sum(weight)
        assert abs(model.scores([text])[0] - want) < 1e-6


def test_terms_count_words_and_repeats():
    counts = quality.terms("One one two one two one")
    assert counts[quality.RUNS : quality.RUNS + quality.WORDS].sum() == 6
    # like the word before; words, pairs and triples seen before
    assert counts[-4:].tolist() == [1, 4, 2, 1]
    assert counts[: quality.RUNS].sum() == len("One one two one two one") - 2
    assert not quality.terms("").any()


def test_labels_without_documents_take_no_place_in_the_sample(spark):
    d = spark.createDataFrame([(k, f"text {k}" if k % 3 else None, "") for k in range(60)], DOCS)
    lab = spark.createDataFrame([(k, k % 2, 0) for k in range(600)] + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    found, totals = usable(d, lab, "quality", F.lit(True))
    assert totals.tolist() == [19, 21]
    assert sorted(r["y"] for r in sample(found, totals, (10, 10)).collect()) == [0] * 10 + [1] * 10
