"""Known answers and invariants of the trajectory engine."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wayquad.functions import codes, signature
from wayquad.functions.geometry import Grid, box, contains, contains_point, intersects
from wayquad.operators import augment, cost, index, order, partition, report, search, similarity
from wayquad.sources import trajectories as src

SQUARE = Grid(0, 0, 100, 100, levels=3, alpha=2, beta=2)


def rows_of(spark, *trajectories):
    return spark.createDataFrame([(tid, [(float(x), float(y)) for x, y in pts]) for tid, pts in trajectories], "tid long, points array<struct<x:double,y:double>>")


def walks(n, seed=5, extent=100.0):
    rng = random.Random(seed)
    out = []
    for tid in range(n):
        x, y, step = rng.uniform(0, extent), rng.uniform(0, extent), rng.choice([0.5, 3, 12])
        pts = []
        for _ in range(rng.randint(2, 8)):
            pts.append((x, y))
            x, y = min(extent, max(0, x + rng.uniform(-step, step))), min(extent, max(0, y + rng.uniform(-step, step)))
        out.append((tid, pts))
    return out


def test_codes_known_and_back(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 1), (1, 1, 0, 21846), (2, 2, 0, 21846 + 1 + 5461), (2, 1, 0, 5463)], "level int, ix long, iy long, want long")
    got = cells.withColumn("code", codes.encode(8)).collect()
    assert all(r["code"] == r["want"] for r in got if r["want"] != 21846 + 1 + 5461)
    every = index.all_cells(spark, Grid(levels=5)).withColumn("again", codes.encode(5))
    assert every.where("again <> quad_code").count() == 0
    assert every.count() == codes.subtree_size(0, 5)
    bad = spark.createDataFrame([(999_999_999,), (-1,)], "quad_code long").select(codes.decode(8).alias("c"))
    assert [r["c"] for r in bad.collect()] == [None, None]


def test_box_predicates(spark):
    def verdict(f, a, b):
        lit = lambda v: tuple(F.lit(float(x)) for x in v)
        return spark.range(1).select(f(lit(a), lit(b)).alias("v")).first()["v"]

    assert not verdict(intersects, (0, 0, 1, 1), (1, 0, 2, 1))
    assert verdict(intersects, (0, 0, 1, 1), (0.9, 0.9, 2, 2))
    assert verdict(contains, (0, 0, 1, 1), (0, 0, 1 + 1e-11, 1))
    assert not verdict(contains, (0, 0, 1, 1), (0, 0, 1.1, 1))
    assert spark.range(1).select(contains_point(tuple(F.lit(float(v)) for v in (0, 0, 1, 1)), F.lit(1.0), F.lit(0.0)).alias("v")).first()["v"]
    with pytest.raises(ValueError, match="2 at least"):
        Grid(alpha=1)


def test_assignment_and_prune_to_root(spark):
    got = index.assign(rows_of(spark, (999, [(10, 10), (12, 12)]), (1, [(100, 100), (100, 100)]), (2, [(-1, 5), (3, 5)]), (3, [(75, 75), (76, 99)])), SQUARE)
    by = {r["tid"]: (r["level"], r["ix"], r["iy"]) for r in got.collect()}
    assert by[999] == (3, 0, 0)
    assert by[1] == (3, 7, 7)
    assert by[2] == (None, None, None)
    pruned = index.prune(got, SQUARE, 100)
    assert {(r["tid"], r["level"], r["quad_code"]) for r in pruned.collect()} == {(999, 0, 0), (1, 0, 0), (3, 0, 0)}
    assert all(r["n"] == 0 for r in index.check_prune(got, pruned, 100).collect())


def test_every_box_lies_in_its_element_and_pruning_keeps_that(spark):
    own = index.assign(rows_of(spark, *walks(300)), SQUARE)
    for least in (0, 2, 9):
        moved = index.prune(own, SQUARE, least)
        ee = index.cell_box(SQUARE, F.col("level"), F.col("ix"), F.col("iy"), 2, 2)
        assert moved.where(~contains(ee, box())).count() == 0
        assert moved.count() == 300


@pytest.mark.parametrize("least", [0, 4])
def test_candidates_against_a_walk(spark, least):
    """No trajectory with a point in the box is missed, and candidates equal a breadth-first walk over the tree."""
    grid = Grid(0, 0, 100, 100, levels=4, alpha=3, beta=3)
    data = walks(200, seed=8)
    own = index.signed(index.prune(index.assign(rows_of(spark, *data), grid), grid, least), grid).cache()
    cells = index.active_cells(own, grid).cache()
    rng = random.Random(2)
    boxes = [(k, x, y, x + rng.choice([1, 9, 60]), y + rng.choice([1, 9, 60])) for k in range(12) for x, y in [(rng.uniform(0, 90), rng.uniform(0, 90))]]
    boxes.append((99, -1.0, -1.0, 400.0, 400.0))
    queries = spark.createDataFrame(boxes, "query_id int, min_x double, min_y double, max_x double, max_y double")
    got = {(r["query_id"], r["tid"]) for r in search.candidates(queries, own, cells, grid).collect()}
    held = {}
    for r in own.collect():
        held.setdefault((r["level"], r["ix"], r["iy"]), []).append((r["tid"], r["sig"]))
    want = set()
    for qid, x0, y0, x1, y1 in boxes:
        todo = [(0, 0, 0)]
        while todo:
            lv, ix, iy = todo.pop()
            w = 100 * 0.5**lv
            ex0, ey0, ex1, ey1 = ix * w, iy * w, ix * w + 3 * w, iy * w + 3 * w
            children = [(lv + 1, 2 * ix + a, 2 * iy + b) for a in (0, 1) for b in (0, 1)] if lv < 4 else []
            if x1 < ex0 + 1e-10 or x0 > ex1 - 1e-10 or y1 < ey0 + 1e-10 or y0 > ey1 - 1e-10:
                continue
            inside = ex0 >= x0 - 1e-10 and ey0 >= y0 - 1e-10 and ex1 <= x1 + 1e-10 and ey1 <= y1 + 1e-10
            g = (ex1 - ex0) / (3 + 1e-12)
            bits = 0
            for i in range(max(0, math.floor((x0 - ex0 + 1e-12) / g)), min(2, math.floor((x1 - ex0 - 1e-12) / g)) + 1):
                for j in range(max(0, math.floor((y0 - ey0 + 1e-12) / g)), min(2, math.floor((y1 - ey0 - 1e-12) / g)) + 1):
                    bits |= 1 << (i * 3 + j)
            want |= {(qid, tid) for tid, sig in held.get((lv, ix, iy), []) if inside or sig & bits}
            todo += children
    assert got == want
    sure = {(qid, tid) for qid, x0, y0, x1, y1 in boxes for tid, pts in data for x, y in pts if x0 <= x <= x1 and y0 <= y <= y1}
    assert sure <= got
    exact = {(r["query_id"], r["tid"]) for r in search.exact_segments(queries, rows_of(spark, *data)).collect()}
    assert sure <= exact


def test_signature_of_points_and_boxes(spark):
    t = rows_of(spark, (1, [(0.5, 0.5), (0.9, 0.9)]), (2, [(2.5, 2.5), (2.9, 2.9)]), (3, []))
    row = t.select("tid", signature.of_points("points", ("0D", "0D", "4D", "4D"), 2, 2).alias("s")).collect()
    assert {r["tid"]: r["s"] for r in row} == {1: 1, 2: 8, 3: 0}
    wide = t.where("tid = 2").select(signature.of_points("points", ("0D", "0D", "3D", "3D"), 8, 8).alias("s")).first()["s"]
    assert wide & (1 << 64) - 1 == (1 << (6 * 8 + 6)) | (1 << (7 * 8 + 7))
    q = spark.range(1).select(signature.of_box(tuple(map(F.lit, (0.0, 0.0, 1.0, 4.0))), tuple(map(F.lit, (0.0, 0.0, 4.0, 4.0))), 2, 2).alias("s")).first()["s"]
    assert q == 0b11


def test_partition_score_and_choice(spark):
    grid = Grid(0, 0, 2, 2, levels=0, alpha=2, beta=2)
    own = index.assign(rows_of(spark, (1, [(0.5, 0.5), (0.9, 0.9)]), (2, [(2.5, 2.5), (2.9, 2.9)])), Grid(0, 0, 4, 4, levels=0, alpha=2, beta=2))
    own = own.withColumns({"level": F.lit(0), "ix": F.lit(0).cast("long"), "iy": F.lit(0).cast("long"), "quad_code": F.lit(0).cast("long")})
    r = partition.scores(own, grid, [(2, 2)]).first()
    assert (r["occupancy"], r["discrimination"], r["score"]) == (0.5, 0.5, 0.5)
    table = spark.createDataFrame([(7, 3, 3, 0.5), (7, 3, 4, 0.54), (7, 4, 3, 0.6), (7, 4, 4, 0.61), (8, 3, 3, 0.5), (8, 4, 3, 0.5)], "quad_code long, alpha int, beta int, score double")
    assert {r["quad_code"]: (r["alpha"], r["beta"]) for r in partition.choose(table).collect()} == {7: (4, 3), 8: (3, 3)}


def test_interval_merge_and_cost(spark):
    rng = random.Random(4)
    raw = [(q, a, a + rng.randint(0, 6)) for q in range(20) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 9)))]
    df = spark.createDataFrame(raw, "query_id int, lo long, hi long")
    got = {}
    for r in cost.merge_intervals(df).collect():
        got.setdefault(r["query_id"], []).append((r["lo"], r["hi"]))
    queries = spark.createDataFrame([(q,) for q in range(21)], "query_id int")
    costs = {r["query_id"]: r["cost"] for r in cost.query_cost(queries, cost.merge_intervals(df)).collect()}
    for q in range(21):
        merged = []
        for _, lo, hi in sorted(x for x in raw if x[0] == q and x[2] > x[1]):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        assert sorted(got.get(q, [])) == [tuple(m) for m in merged]
        gaps = [b[0] - a[1] for a, b in zip(merged, merged[1:], strict=False)]
        h = -sum(g / sum(gaps) * math.log(g / sum(gaps)) for g in gaps) / math.log(len(gaps)) if len(gaps) > 1 else 0
        assert costs[q] == pytest.approx(len(merged) + h, abs=2e-6)
    assert cost.hgs_score(2.0, 1.0) == pytest.approx(0.5)
    assert cost.mean_score(1.0, 3.0) == 2.0


def test_order_file_round_trip_and_greedy(spark, tmp_path):
    grid = Grid(0, 0, 100, 100, levels=4, alpha=2, beta=2)
    own = index.signed(index.prune(index.assign(rows_of(spark, *walks(150)), grid), grid, 3), grid)
    cells = index.active_cells(own, grid)
    ordered = index.z_order(cells)
    path = str(tmp_path / "order.json")
    order.write_order(order.entries(ordered, grid), path, grid)
    assert json.loads((tmp_path / "order.json").read_text())["metadata"]["quadtree_max_level"] == 4
    back = {(r["quad_code"], r["ord"], r["level"], r["ix"], r["iy"]) for r in order.read_order(spark, path).collect()}
    assert back == {(r["quad_code"], r["ord"], r["level"], r["ix"], r["iy"]) for r in ordered.collect()}
    sims = {(r["code_a"], r["code_b"]): r["sim"] for r in similarity.jaccard(own, cells, grid).collect()}
    listed = [r.asDict() for r in cells.collect()]
    walk = order.greedy_order(listed, sims, grid)
    assert walk[0] == 0
    assert sorted(walk) == sorted(c["quad_code"] for c in listed)
    assert all(0 < s <= 1 for s in sims.values())


def test_order_file_with_coverage(spark, tmp_path):
    grid = Grid(0, 0, 100, 100, levels=4, alpha=2, beta=2)
    own = index.signed(index.prune(index.assign(rows_of(spark, *walks(150)), grid), grid, 3), grid)
    cells = index.active_cells(own, grid)
    ordered = index.z_order(cells)
    q = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 10.0, 5.0, 70.0, 60.0), (3, -9.0, -9.0, 300.0, 300.0), (4, 200.0, 200.0, 300.0, 300.0)], "query_id int, min_x double, min_y double, max_x double, max_y double")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "lo", "hi").collect()))
    wanted = rows(search.order_intervals(q, own, cells, ordered, grid))
    for source, covered in (("pruned_default_xz_order", True), ("learned", False)):
        path = str(tmp_path / f"{source}.json")
        order.write_order(order.entries(ordered, grid), path, grid, source, {"min_trajs": 3})
        meta = order.read_metadata(spark, path)
        assert (meta["order_source"], order.covers(meta)) == (source, covered)
        data = json.loads(Path(path).read_text())
        assert data["metadata"]["min_trajs"] == 3
        assert all(("effective_subtree_orders" in e["coverage"]) != covered for e in data["ordering"])
        assert rows(search.coverage_intervals(q, own, cells, order.read_order(spark, path), grid)) == wanted
    # An order with a gap in a subtree is not marked as contiguous, whatever its name.
    swapped = order.entries(ordered, grid).withColumn("ord", F.when(F.col("ord") < 1, F.lit(10_000)).otherwise(F.col("ord")))
    order.write_order(swapped, str(tmp_path / "s.json"), grid, "xz")
    assert not order.covers(order.read_metadata(spark, str(tmp_path / "s.json")))


def test_order_file_odd_entries(spark, tmp_path):
    path = tmp_path / "odd.json"
    ordering = [{"quad_code": [1, 2], "order": 5}, {"quad_code": 3, "order": 1, "coverage": {"effective_subtree_count": 4}}, {"order": 2}, {"quad_code": 4}, {"quad_code": "x", "order": 3}, {"quad_code": 99, "order": 4}, {"quad_code": 3, "order": 0}]
    path.write_text(json.dumps({"ordering": ordering, "metadata": {"quadtree_max_level": 1}}))
    got = {(r["quad_code"], r["ord"], r["level"], r["effective_subtree_count"]) for r in order.read_order(spark, str(path)).collect()}
    assert got == {(1, 5, 1, None), (2, 5, 1, None), (3, 0, 1, None)}
    assert not order.covers(order.read_metadata(spark, str(path)))
    for text in ('{"ordering": []}', '{"metadata": {"quadtree_max_level": 1}}', '{"ordering": [], "metadata": {}}'):
        path.write_text(text)
        with pytest.raises(ValueError, match="order file"):
            order.read_order(spark, str(path))
    with pytest.raises(ValueError, match="not an order file"):
        order.read_order(spark, str(tmp_path / "odd.csv"))


def test_adapted_grids_lose_nothing(spark):
    grid = Grid(0, 0, 100, 100, levels=4, alpha=2, beta=2)
    own = index.signed(index.prune(index.assign(rows_of(spark, *walks(150)), grid), grid, 3), grid)
    cells = index.active_cells(own, grid)
    chosen = own.select("quad_code").distinct().select("quad_code", (F.col("quad_code") % 7 + 2).cast("int").alias("alpha"), F.when(F.col("quad_code") % 2 == 0, 8).otherwise(3).alias("beta"))
    fine, sized = partition.adapted(own, cells, chosen, grid)
    assert fine.count() == own.count()
    assert fine.where("sig = 0").count() == 0
    q = spark.createDataFrame([(i, x, y, x + w, y + w) for i, (x, y, w) in enumerate([(0.0, 0.0, 9.0), (30.0, 40.0, 5.0), (50.0, 50.0, 50.0), (-5.0, 20.0, 60.0), (97.0, 97.0, 1.0)])], "query_id int, min_x double, min_y double, max_x double, max_y double")
    pairs = lambda df: set(map(tuple, df.select("query_id", "tid").collect()))
    found = pairs(search.candidates(q, fine, sized, grid))
    points = own.select("tid", F.explode("points").alias("p")).select("tid", "p.x", "p.y")
    assert pairs(search.exact_points(q, points, grid)) <= found
    counts = partition.shrunk(sized, Grid(0, 0, 100, 100, levels=4, alpha=4, beta=4)).first()
    listed = [(r["alpha"], r["beta"]) for r in sized.collect()]
    assert tuple(counts) == (sum(a < 4 for a, _ in listed), sum(b < 4 for _, b in listed), sum(a < 4 and b < 4 for a, b in listed))


def test_augmentation(spark):
    t = rows_of(spark, (1, [(0, 0), (3, 6)]), (2, [(1, 1), (2, 2), (5, 1)]))
    pts = {r["tid"]: [(p["x"], p["y"]) for p in r["p"]] for r in t.select("tid", augment.interpolate("points", 3).alias("p")).collect()}
    assert pts[1] == [(0, 0), (1, 2), (2, 4), (3, 6)]
    assert len(pts[2]) == 7
    turned = t.where("tid = 1").select(augment.rotate("points", F.lit(180.0)).alias("p")).first()["p"]
    assert [(round(p["x"], 9), round(p["y"], 9)) for p in turned] == [(3, 6), (0, 0)]
    sized = {r["tid"]: len(r["p"]) for r in t.select("tid", augment.scale("points", F.lit(1.0)).alias("p")).collect()}
    assert sized == {1: 6, 2: 9}
    many = rows_of(spark, *walks(200))
    made = augment.augment(many, 0.5)
    again = augment.augment(many.repartition(3), 0.5)
    assert made.exceptAll(again).count() == 0
    assert 250 < made.count() < 350
    assert augment.augment(many, 3.0).count() == 800
    assert augment.augment(many, 3.0).select("tid").distinct().count() == 800
    walked = augment.synthetic(spark, 50, (0.0, 0.0, 10.0, 5.0))
    assert walked.where("size(points) < 10 OR size(points) > 49 OR exists(points, p -> p.x < 0 OR p.x > 10 OR p.y < 0 OR p.y > 5)").count() == 0


def test_text_formats_and_files(spark, tmp_path):
    t = rows_of(spark, *walks(20))
    want = {(r["tid"], tuple((p["x"], p["y"]) for p in r["points"])) for r in t.collect()}
    for kind, suffix in (("txt", "csv"), ("geojson", "json"), ("wkt", "wkt")):
        path = str(tmp_path / f"t.{suffix}")
        src.to_lines(t, kind).write.text(path)
        assert {(r["tid"], tuple((p["x"], p["y"]) for p in r["points"])) for r in src.read_lines(spark, path).collect()} == want
    lines = spark.createDataFrame([("1|a|b|1,2;x,4",), ("2|a|b|1,2",), ("3|a|b|1,2;3,4;",), ("",)], "value string")
    assert [r["tid"] for r in src.parse_txt(lines).collect()] == [3]
    raw = spark.createDataFrame([("8275-8275_1-MULTIPOINT Z((116.1 39.9 7), (bad 3 1), (116.2 39.8 8))",)], "value string")
    assert [len(r["points"]) for r in src.parse_raw(raw).collect()] == [2]
    with pytest.raises(ValueError, match="unknown format"):
        src.to_lines(t, "shape")
    named = t.withColumns({"oid": F.concat(F.lit("car"), "tid"), "seg": F.lit("7")})
    for kind in ("txt", "geojson", "wkt"):
        path = str(tmp_path / f"named.{kind}")
        src.to_lines(named, kind).write.text(path)
        assert {(r["tid"], r["oid"], r["seg"]) for r in src.read_lines(spark, path).collect()} == {(k, f"car{k}", "7") for k in range(20)}
    src.to_lines(t, "raw").write.text(str(tmp_path / "parts"))
    assert src.read_lines(spark, str(tmp_path / "parts/part-*")).count() == 20
    with pytest.warns(UserWarning, match="unknown suffix"):
        assert src.format_of("x.dat") == "txt"
    with open(tmp_path / "few.txt", "w") as file:
        file.write("bad\n" + "".join(f"{k}|a|0|1,2;3,{k}\n#\n" for k in range(50)))
    assert [r["tid"] for r in src.read_first(spark, str(tmp_path / "few.txt"), 3).collect()] == [0, 1, 2]
    assert src.read_or_make(spark, None, 5, (0.0, 0.0, 1.0, 1.0)).count() == 5
    heads = spark.createDataFrame([("12-12_3-MULTIPOINT Z((1 2 3))",), ("x",)], "value string").select(src.identifier().alias("i")).collect()
    assert [tuple(r["i"]) for r in heads] == [("12", 3), ("unknown", 0)]


def test_reports(spark):
    t = rows_of(spark, *walks(60))
    points = t.select("tid", F.posexplode("points").alias("seq", "p")).select("tid", "seq", "p.x", "p.y")
    scaled = report.normalise(points)
    low = scaled.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert [round(v, 9) for v in low] == [0, 1, 0, 1]
    bins = {r["bin"]: r["n"] for r in report.length_bins(t).collect()}
    assert bins == {0: 60}
    assert sum(r["n"] for r in report.level_histogram(index.assign(t, SQUARE)).collect()) == 60


def test_stream_equals_batch(spark, tmp_path):
    from wayquad.streaming.ingest import assign_stream, start

    t = rows_of(spark, *walks(40))
    t.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    start(stream, SQUARE, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("tid", "quad_code", "sig").exceptAll(assign_stream(t, SQUARE).select("tid", "quad_code", "sig")).count() == 0
    assert got.count() == 40


def test_learning_helpers():
    from wayquad.operators import learn

    assert learn.checkpoints(8, 4, 2) == [1, 2, 5, 8]
    assert learn.returns([1, 2], [0.5, 0.25], [False, True]) == pytest.approx([2.893375, 2.0])
    assert learn.weight(0.2, 1, 10) == pytest.approx(0.2)
    assert learn.weight(0.2, 11, 10) == pytest.approx(1.0)
    assert learn.action_limit(0, 2, 1, 1, 5) is None
    assert [learn.action_limit(4, 2, 0.5, e, 4) for e in (0, 2, 4, 9)] == [8, 5, 2, 2]
    stop = learn.EarlyStop(patience=2, min_delta=0.1, max_negative=3)
    assert [stop.update(s) for s in (1.0, 1.05, 2.0, 2.0, 2.05)] == [False, False, False, False, True]


def test_store_and_prefix_rewards(spark, tmp_path):
    from wayquad.operators import learn
    from wayquad.sources import store

    grid = Grid(0, 0, 100, 100, levels=4, alpha=2, beta=2)
    own = index.signed(index.prune(index.assign(rows_of(spark, *walks(120)), grid), grid, 3), grid)
    store.save_index(own, str(tmp_path / "i"), 3)
    back = store.load_index(spark, str(tmp_path / "i"))
    assert back.select("tid", "quad_code", "sig").exceptAll(own.select("tid", "quad_code", "sig")).count() == 0
    assert store.lookup(back, [3, 999]).count() == 1
    assert store.scan(back, 0, 10**9).count() == 120
    cells = index.active_cells(back, grid).cache()
    sims = similarity.jaccard(back, cells, grid)
    store.save_similarity(sims, str(tmp_path / "s"))
    assert store.load_similarity(spark, str(tmp_path / "s"), cells).count() == sims.count()
    assert store.load_similarity(spark, str(tmp_path / "s"), cells.limit(1)) is None
    queries = spark.createDataFrame([(1, 10.0, 10.0, 40.0, 60.0), (2, 0.0, 0.0, 5.0, 90.0)], "query_id int, min_x double, min_y double, max_x double, max_y double")
    z = index.z_order(cells).select("quad_code", "ord")
    flipped = z.select("quad_code", (F.lit(cells.count()) - 1 - F.col("ord")).alias("ord"))
    same = learn.prefix_reward(queries, back, cells, z, 0, flipped, grid).first()
    assert same["length"] == 0
    assert math.isfinite(same["reward"])


def test_command_line(spark, tmp_path):
    from wayquad.__main__ import main

    src.to_lines(rows_of(spark, *walks(60)), "wkt").write.text(str(tmp_path / "in.wkt"))
    common = ["--box", "0", "0", "100", "100", "--levels", "4"]
    main(["clean", str(tmp_path / "in.wkt"), str(tmp_path / "clean.csv"), "--least", "3", *common], spark)
    kept = src.read_lines(spark, str(tmp_path / "clean.csv"))
    assert 0 < kept.count() < 60
    main(["export-order", str(tmp_path / "clean.csv"), str(tmp_path / "o.json"), "--adaptive", *common], spark)
    assert len(json.loads((tmp_path / "o.json").read_text())["ordering"]) > 1
    main(["queries", str(tmp_path / "clean.csv"), str(tmp_path / "q"), "--count", "20", *common], spark)
    assert spark.read.json(str(tmp_path / "q")).count() == 60
    main(["report", str(tmp_path / "clean.csv"), str(tmp_path / "r"), *common], spark)
    assert spark.read.json(str(tmp_path / "r")).first()["trajectories"] == kept.count()
