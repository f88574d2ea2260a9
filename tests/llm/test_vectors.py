import numpy as np

from wayquad.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, extra string"


def brute(rows, queries, k):
    v = {i: np.array(e, np.float64) for i, e in rows}
    ids = sorted(v)
    m = np.array([v[i] for i in ids])
    out = {}
    for q in queries:
        s = m @ v[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(ids[j], s[j]) for j in order]
    return out


def test_recall_ranks_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]
    rows = [(i, x[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], SCHEMA).repartition(6)
    got: dict = {}
    for r in vectors.search(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows, range(0, 3000, 20), 20)
    assert set(got) == set(want)
    hits = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        listed = [ranks[k] for k in range(1, 21)]
        assert q not in [i for i, _ in listed]
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0]))
        true = dict(want[q])
        hits += sum(i in true for i, _ in listed)
        for i, s in listed:
            assert abs(s - x[i].astype(np.float64) @ x[q].astype(np.float64)) < 1e-12
    assert hits / (20 * len(want)) >= 0.9
    # A query in the hot group finds the smallest ids of its copies.
    assert [i for i, _ in (got[200][k] for k in range(1, 21))] == list(range(100, 120))


def test_odd_vectors_and_few_rows(spark):
    rows = [
        (0, [1.0, 0.0], "a"),
        (1, [0.5, 0.5], "a"),
        (2, None, "a"),
        (3, [0.0, 0.0], "a"),
        (4, [float("nan"), 1.0], "a"),
        (5, [None, 1.0], "a"),
        (6, [float("inf"), 1.0], "a"),
        (None, [1.0, 1.0], "a"),
        (20, [2.0, 0.0], None),
        (40, None, None),
        (7, [1.0, 2.0, 3.0], ""),
    ]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.search(empty, lambda i: i % 20 == 0).collect() == []


def test_vectors_of_unequal_norms_and_the_reach(spark):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((2500, 12)) * rng.lognormal(0, 0.7, (2500, 1))).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame([(i, e, "") for i, e in rows], SCHEMA).repartition(3)
    want = brute(rows, range(0, 2500, 20), 20)
    hits = 0
    for r in vectors.search(df, lambda i: i % 20 == 0).collect():
        hits += r["vec_id"] in dict(want[r["query_id"]])
    assert hits / (20 * len(want)) >= 0.9


def test_calibration_and_truth_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8))
    tree = vectors.Tree(x, 40)
    leaf = tree.assign(x)
    df = spark.createDataFrame([(i, x[i].tolist(), [i], int(leaf[i])) for i in range(900)], "point long, v array<double>, ids array<long>, leaf long").repartition(5)
    probes = list(range(0, 900, 30))
    got = vectors.truth(df, x[probes], probes, 10)
    want = [[int(leaf[j]) for j in np.lexsort((np.arange(900), -(x @ x[p]))) if j != p][:10] for p in probes]
    assert got == want
    visits, reach = vectors.calibrate(tree, x[probes], want, 0.9)
    found = sum(w in set(list(tree.visit(x[p], reach))[:visits]) for p, ws in zip(probes, want, strict=True) for w in ws)
    assert found >= 0.9 * 10 * len(probes)
    # Every leaf comes once, and reaches bound the distances of the vectors that the tree has seen.
    assert sorted(tree.visit(x[0], 0.5)) == list(range(tree.n_leaves))


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(60)]
    spark.createDataFrame([(i, e, "") for i, e in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vectors.op10(spark, str(tmp_path))
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert out.groupBy("query_id").count().collect() and {r["count"] for r in out.groupBy("query_id").count().collect()} == {20}
