"""All queries of the trajectory engine.  Their SQL for DuckDB is in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayquad.functions import codes, signature
from wayquad.functions.geometry import Grid, box, cell_box, contains, intersects
from wayquad.operators import augment, cost, features, index, learn, order, partition, report, search, similarity
from wayquad.plans.oracle import ORACLE_SQL
from wayquad.session import pin, shared_dir
from wayquad.sources import store
from wayquad.sources import trajectories as src

GRID = Grid()
LEAST = 4
ROOT = (0.0, 0.0, 720.0, 600.0)
TOWN = (115.0, 39.0, 118.0, 41.5)
#: A batch of boxes: tiny, medium, large, thin in x, thin in y, whole root, outside, touching edge, corner, off centre.
BOXES = (
    (1, 10.0, 10.0, 12.0, 14.0),
    (2, 100.0, 50.0, 220.0, 160.0),
    (3, 40.0, 0.0, 600.0, 400.0),
    (4, 300.0, 0.0, 301.5, 600.0),
    (5, 0.0, 30.0, 720.0, 33.0),
    (6, 0.0, 0.0, 720.0, 600.0),
    (7, 800.0, 700.0, 900.0, 800.0),
    (8, 720.0, 0.0, 760.0, 600.0),
    (9, 0.0, 0.0, 90.0, 75.0),
    (10, 333.3, 11.1, 444.4, 99.9),
)


def boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "query_id int, min_x double, min_y double, max_x double, max_y double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_points(spark, sf_dir)


def assigned(spark: SparkSession, sf_dir: str, grid: Grid = GRID) -> DataFrame:
    return index.assign(src.trajectories(spark, sf_dir), grid)


def pruned(spark: SparkSession, sf_dir: str, grid: Grid = GRID, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Trajectories with their cells and signatures after pruning, and the active cells.

    The index is stored in the shared folder, sorted by code, at the first use by an application and read from there.
    """
    key = (spark.sparkContext.applicationId, sf_dir, grid, least)
    if key not in _stored:
        path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        store.save_index(index.signed(index.prune(assigned(spark, sf_dir, grid), grid, least), grid), f"{path}/trajectories")
        index.active_cells(store.load_index(spark, f"{path}/trajectories"), grid).write.parquet(f"{path}/cells")
        _stored[key] = path
    return store.load_index(spark, f"{_stored[key]}/trajectories"), spark.read.parquet(f"{_stored[key]}/cells")


_stored: dict[tuple, str] = {}


def sixes(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def exploded(df: DataFrame, digits: int = 6) -> DataFrame:
    """(tid, seq, x, y) of ``points``, rounded."""
    return df.select("tid", F.posexplode("points").alias("seq", "p")).select("tid", "seq", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y"))


def traj_mbr(spark, d):
    return index.mbr(src.trajectories(spark, d)).select("tid", F.size("points").alias("n_points"), "min_x", "min_y", "max_x", "max_y")


def traj_level_cell(spark, d):
    return assigned(spark, d).select("tid", "level", "ix", "iy", "quad_code")


def quad_code_roundtrip(spark, d):
    cells = index.all_cells(spark, replace(GRID, levels=6))
    back = cells.withColumn("again", codes.encode(6))
    lo, hi = codes.leaf_range(6, F.col("quad_code"), F.col("level"))
    return back.select("quad_code", "level", "ix", "iy", "again", lo.cast("long").alias("leaf_lo"), hi.cast("long").alias("leaf_hi"))


def ee_bbox(spark, d):
    cells = index.occupied(assigned(spark, d))
    sides = cell_box(GRID, F.col("level"), F.col("ix"), F.col("iy"), GRID.alpha, GRID.beta)
    return cells.select("level", "ix", "iy", *(F.round(s, 9).alias(n) for s, n in zip(sides, ("min_x", "min_y", "max_x", "max_y"), strict=True)))


def traj_signature(spark, d):
    return index.signed(assigned(spark, d), GRID).select("tid", "sig")


def query_signature(spark, d):
    cells = index.occupied(assigned(spark, d))
    ee = cells.withColumns(dict(zip(("ee_min_x", "ee_min_y", "ee_max_x", "ee_max_y"), cell_box(GRID, F.col("level"), F.col("ix"), F.col("iy"), GRID.alpha, GRID.beta), strict=True)))
    met = ee.join(F.broadcast(boxes(spark)), intersects(box(), box("ee_")))
    return met.select("query_id", "level", "ix", "iy", signature.of_box(box(), box("ee_"), GRID.alpha, GRID.beta).alias("qsig"), contains(box(), box("ee_")).alias("contained"))


def range_candidates_noprune(spark, d):
    own = pin(index.signed(assigned(spark, d), GRID).where("quad_code IS NOT NULL"))
    return search.candidates(boxes(spark), own, index.active_cells(own, GRID), GRID)


def range_candidates_pruned(spark, d):
    own, cells = pruned(spark, d)
    return search.candidates(boxes(spark), own, cells, GRID)


def range_exact_points(spark, d):
    return search.exact_points(boxes(spark), exploded(src.trajectories(spark, d), 15))


def range_exact_segments(spark, d):
    return search.exact_segments(boxes(spark), src.trajectories(spark, d))


def quadcode_intervals(spark, d):
    own, cells = pruned(spark, d)
    return search.code_intervals(boxes(spark), own, cells, GRID)


def quadorder_intervals(spark, d):
    own, cells = pruned(spark, d)
    return search.order_intervals(boxes(spark), own, cells, index.z_order(cells), GRID)


def interval_merge(spark, d):
    own = assigned(spark, d).where("quad_code IS NOT NULL")
    size = codes.subtree_size_of(F.col("level"), GRID.levels)
    raw = own.select((F.col("tid") % 50).cast("int").alias("query_id"), F.col("quad_code").alias("lo"), (F.col("quad_code") + F.least(size, F.lit(40))).alias("hi"))
    return cost.merge_intervals(raw)


def query_cost(spark, d):
    return cost.query_cost(boxes(spark), quadcode_intervals(spark, d))


def compare_orders(spark, d):
    own, cells = pruned(spark, d)
    q = boxes(spark)
    planned = search.plan(q, cells, GRID)
    by_code = cost.query_cost(q, search.code_intervals(q, own, cells, GRID, planned))
    by_order = cost.query_cost(q, search.order_intervals(q, own, cells, index.z_order(cells), GRID, planned))
    return cost.compare(by_code, by_order, search.candidates(q, own, cells, GRID, planned))


def prune_cells(spark, d):
    own = index.prune(assigned(spark, d), GRID, LEAST)
    return own.groupBy("quad_code", "level", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def prune_report(spark, d):
    before = assigned(spark, d)
    return report.prune_report(before, index.prune(before, GRID, LEAST))


def prune_check(spark, d):
    before = assigned(spark, d)
    return index.check_prune(before, index.prune(before, GRID, LEAST), LEAST)


def tree_stats(spark, d):
    return index.tree_stats(pruned(spark, d)[1], GRID)


def z_order(spark, d):
    return index.z_order(pruned(spark, d)[1]).select("quad_code", "ord")


def subtree_orders(spark, d):
    found = order.subtree_orders(index.z_order(pruned(spark, d)[1]), GRID)
    return found.withColumn("effective_subtree_orders", F.array_join(F.col("effective_subtree_orders").cast("array<string>"), ","))


def xz_coverage(spark, d):
    rows = order.entries(index.z_order(pruned(spark, d)[1]), GRID)
    return sixes(rows.select("quad_code", "ord", "level", "alpha", "beta", "xmin", "ymin", "effective_subtree_count", (F.col("ord") + F.col("effective_subtree_count") + 1).alias("scan_end")), "xmin", "ymin", digits=9)


def _options(spark, d) -> DataFrame:
    own, _ = pruned(spark, d)
    return partition.scores(own, GRID, partition.options(GRID), sample=1 << 30)


def partition_score(spark, d):
    return _options(spark, d)


def partition_choice(spark, d):
    return partition.choose(_options(spark, d))


def partition_choice_sampled(spark, d):
    own, _ = pruned(spark, d)
    return partition.choose(partition.scores(own, GRID, partition.options(GRID)))


def range_candidates_adaptive(spark, d):
    own, cells = partition.adapted(*pruned(spark, d), partition_choice(spark, d), GRID)
    return search.candidates(boxes(spark), own, cells, GRID)


def traj_signature_adaptive(spark, d):
    return partition.adapted(*pruned(spark, d), partition_choice(spark, d), GRID)[0].select("tid", "quad_code", "sig")


def xz_intervals(spark, d):
    """Ranges of the Z order with coverage, but for every seventh cell, whose count is missing."""
    own, cells = pruned(spark, d)
    listed = order.subtree_orders(index.z_order(cells), GRID).withColumn("effective_subtree_count", F.when(F.col("ord") % 7 != 0, F.col("effective_subtree_count")))
    return search.coverage_intervals(boxes(spark), own, cells, listed, GRID)


def order_merge(spark, d):
    own, cells = pruned(spark, d)
    rows = order.entries(index.z_order(cells), GRID, partition.choose(_options(spark, d)))
    return rows.select("quad_code", "ord", "alpha", "beta")


def order_metadata(spark, d):
    own, cells = pruned(spark, d)
    return order.metadata(cells, own, partition.choose(_options(spark, d)), GRID, LEAST)


def complete_order(spark, d):
    cells = index.z_order(pruned(spark, d)[1])
    prefix = cells.where("n % 5 = 0").select("quad_code", (-F.col("ord")).alias("ord"))
    return order.complete_order(prefix, cells.select("quad_code", "ord"))


def cell_jaccard(spark, d):
    return similarity.jaccard(*pruned(spark, d), GRID)


def similarity_stats(spark, d):
    own, cells = pruned(spark, d)
    return similarity.stats(similarity.jaccard(own, cells, GRID), cells)


def signature_jaccard(spark, d):
    return similarity.signature_jaccard(pruned(spark, d)[0])


def topk_similar(spark, d):
    return similarity.top_similar(cell_jaccard(spark, d), 5)


def eight_neighbours(spark, d):
    return index.neighbours(pruned(spark, d)[1])


def traj_statistics(spark, d):
    return sixes(features.trajectory_statistics(*pruned(spark, d), GRID), "density_x", "density_y")


def static_features(spark, d):
    own, cells = pruned(spark, d)
    return features.static_features(features.trajectory_statistics(own, cells, GRID), cells, GRID)


def greedy_order(spark, d):
    own, cells = pruned(spark, d)
    sims = {(r["code_a"], r["code_b"]): r["sim"] for r in similarity.jaccard(own, cells, GRID).collect()}
    walk = order.greedy_order([r.asDict() for r in cells.collect()], sims, GRID)
    return spark.createDataFrame([(c, k) for k, c in enumerate(walk)], "quad_code long, ord long")


def level_histogram(spark, d):
    return report.level_histogram(assigned(spark, d))


def level_summary(spark, d):
    return report.level_summary(assigned(spark, d))


def cell_load_buckets(spark, d):
    return report.load_buckets(index.occupied(assigned(spark, d)))


def fill_rate_cdf(spark, d):
    return report.fill_rate(assigned(spark, d))


def dataset_report(spark, d):
    own = src.trajectories(spark, d)
    return report.dataset_report(index.mbr(own), exploded(own, 15))


def length_bins(spark, d):
    return report.length_bins(src.from_points(src.event_points(spark, d, 37)))


def path_length(spark, d):
    return report.path_length(points(spark, d))


def sampling_intervals(spark, d):
    return report.intervals(src.event_points(spark, d, 1000), 72_000)


def moving_average(spark, d):
    return report.moving_average(src.event_points(spark, d, 1000))


def point_centre(spark, d):
    return report.centre(points(spark, d), (720.0, 600.0))


def hotspot_grid(spark, d):
    return report.hotspots(points(spark, d), ROOT)


def normalize_traj(spark, d):
    return sixes(report.normalise(points(spark, d)), "x", "y", digits=9)


def global_bounds(spark, d):
    return report.bounds(points(spark, d), (5.0, 5.0, 700.0, 300.0))


def clean_filter(spark, d):
    return report.clean(src.trajectories(spark, d), (0.0, 1.0, 718.0, 250.0), 3)


def _round_trip(kind: str, parse: Callable[[DataFrame], DataFrame]):
    def run(spark, d):
        lines = src.to_lines(src.trajectories(spark, d), kind)
        broken = spark.createDataFrame([("",), ("#|x",), ("1|a|b|1,2;z,3",), ("x,y",), ("[1,",), ('{"type": 3}',), ("1-2_3-MULTIPOINT Z((1 2 3))",)], "value string")
        return exploded(parse(lines.union(broken)))

    return run


def parse_raw(spark, d):
    found = src.parse_raw(src.to_lines(src.trajectories(spark, d), "raw"))
    return found.select("tid", "oid", F.size("points").alias("n_points"), F.round(F.col("points")[0]["x"], 6).alias("x0"), F.round(F.col("points")[0]["y"], 6).alias("y0"))


def parse_taxi(spark, d):
    own = src.trajectories(spark, d)
    quoted = F.when(F.col("tid") % 2 == 0, F.concat(F.lit('"'), F.col("tid").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("t"), F.col("tid").cast("string")))
    body = F.array_join(F.transform("points", lambda p: F.concat(F.lit('["2024-01-01 00:00:00",'), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))), ",")
    found = src.parse_taxi(own.select(F.concat(F.lit("["), quoted, F.lit(",["), body, F.lit("]]")).alias("value")))
    return found.select("oid", F.size("points").alias("n_points"), F.round(F.col("points")[0]["x"], 6).alias("x0"))


#: Texts of times, as data sets have them.
TIMES = (
    "2024-01-02 03:04:05", "2024-01-02 03:04:05.123", "2024/01/02 03:04:05", "02/01/2024 03:04:05", "03:04:05", "20240102030405", "0", "", "soon", "1704164645", "1704164645.5", "999999999",
    "12345678901", "2024-13-02 03:04:05", "2024-1-2 3:4:5", "31/12/1999 23:59:59", None,
)


def parse_time(spark, d):
    rows = spark.createDataFrame(list(enumerate(TIMES)), "id long, text string")
    return rows.select("id", F.coalesce(F.unix_millis(src.parse_time(F.col("text"))), F.lit(-1)).cast("long").alias("millis"))


def read_part_files(spark, d):
    folder = f"{shared_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    src.to_lines(src.trajectories(spark, d), "raw").write.text(folder)
    found = src.read_lines(spark, f"{folder}/part-*")
    return found.select("tid", "oid", F.size("points").alias("n_points"), F.round(F.col("points")[0]["x"], 6).alias("x0"), F.round(F.col("points")[0]["y"], 6).alias("y0"))


def action_limit(spark, d):
    return spark.createDataFrame([(e, learn.action_limit(10, 2.0, 0.5, e, 7)) for e in range(12)], "episode long, cells long")


def nearest_active(spark, d):
    every = index.occupied(assigned(spark, d)).withColumn("quad_code", codes.encode(GRID.levels))
    return index.nearest_active(every, pruned(spark, d)[1])


def unique_active(spark, d):
    cells = pruned(spark, d)[1]
    z = index.z_order(cells)
    twice = z.select("quad_code", (-F.col("ord")).alias("pos")).union(z.select("quad_code", F.col("ord") - 50)).union(spark.range(1).selectExpr("-5L", "-9999L"))
    return index.unique_active(twice, cells)


def reassigned(spark, d):
    own = assigned(spark, d)
    return index.reassigned(own.union(own.where("tid % 7 = 0")).union(own.where("tid % 5 = 0").withColumn("ix", F.col("ix") + 1)))


def scan_queries(spark, d):
    own = index.mbr(src.trajectories(spark, d)).select(*(F.floor(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")), (F.col("tid") % 100).alias("query_id"))
    lines = own.groupBy("query_id").agg(F.array_join(F.collect_list(F.concat_ws(", ", "min_x", "min_y", "max_x", "max_y")), ";").alias("value"))
    broken = spark.createDataFrame([("1, 2; a, b, c, d;",)], "value string")
    return src.scan_queries(lines.select("value").union(broken)).agg(F.count(F.lit(1)).alias("n"), F.sum("min_x").alias("min_x"), F.sum("max_y").alias("max_y"))


def format_wkt(spark, d):
    own = src.trajectories(spark, d).select("tid", F.transform("points", lambda p: F.struct(F.floor(p["x"]).alias("x"), F.floor(p["y"]).alias("y"))).alias("points"))
    return src.to_lines(own, "wkt")


def parse_queries(spark, d):
    own = index.mbr(src.trajectories(spark, d)).select(F.concat_ws(", ", *(F.floor(c).cast("string") for c in ("min_x", "min_y", "max_x", "max_y"))).alias("query"), (F.col("tid") % 5 * 500).alias("range_meters"))
    broken = spark.createDataFrame([("1, 2", 100), ("a, b, c, d", 100), ("", 1)], "query string, range_meters long")
    return src.parse_queries(own.union(broken)).groupBy("range_meters").agg(F.count(F.lit(1)).alias("n"), F.sum("min_x").alias("min_x"), F.sum("max_y").alias("max_y"))


def interpolate(spark, d):
    return exploded(src.trajectories(spark, d).withColumn("points", augment.interpolate("points", 3)))


def rotate(spark, d):
    return exploded(src.trajectories(spark, d).withColumn("points", augment.rotate("points", F.lit(17.0))))


def scale(spark, d):
    return exploded(src.trajectories(spark, d).withColumn("points", augment.scale("points", F.lit(0.9))))


def mix(spark, d):
    own = src.trajectories(spark, d)
    other = own.select((F.col("tid") - 1).alias("tid"), F.col("points").alias("other"))
    return exploded(own.join(other, "tid").withColumn("points", augment.mix("points", "other", 0.1)))


def meters_to_degrees(spark, d):
    lat = F.col("value") % 60
    lon_deg, lat_deg = augment.meters_to_degrees(F.lit(500.0), lat)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(lon_deg, 12).alias("lon_deg"), F.round(lat_deg, 12).alias("lat_deg"))


def augment_set(spark, d):
    made = augment.augment(src.trajectories(spark, d), 1.5)
    return made.select("tid", "oid", F.size("points").alias("n_points"))


def synthetic_walks(spark, d):
    return exploded(augment.synthetic(spark, 500, ROOT))


def gen_queries(spark, d):
    return augment.generate_queries(points(spark, d), ROOT, 100, (5.0, 10.0, 20.0))


def gen_queries_skewed(spark, d):
    own = points(spark, d)
    return augment.generate_queries(own, ROOT, 100, (5.0, 10.0, 20.0), report.hotspots(own, ROOT))


def gen_queries_meters(spark, d):
    """Points as degrees around a town, ranges in metres."""
    return augment.generate_queries(report.normalise(points(spark, d), TOWN), TOWN, 100, (100.0, 500.0, 2500.0), metres=True)


def gen_queries_gaussian(spark, d):
    return augment.generate_gaussian_queries(spark, (116.4, 0.3, 39.9, 0.2), TOWN, 200, (100.0, 500.0, 2500.0))


def split_queries(spark, d):
    items = spark.range(500).withColumnRenamed("id", "query_id")
    return augment.split_sets(items, "query_id", 0.7, 0.15)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        traj_mbr, traj_level_cell, quad_code_roundtrip, ee_bbox, traj_signature, query_signature, range_candidates_noprune, range_candidates_pruned, range_exact_points,
        range_exact_segments, quadcode_intervals, quadorder_intervals, interval_merge, query_cost, compare_orders, prune_cells, prune_report, prune_check, tree_stats, z_order,
        subtree_orders, xz_coverage, partition_score, partition_choice, partition_choice_sampled, order_merge, order_metadata, complete_order, cell_jaccard, similarity_stats,
        signature_jaccard, topk_similar, eight_neighbours, traj_statistics, static_features, greedy_order, level_histogram, level_summary, cell_load_buckets, fill_rate_cdf,
        dataset_report, length_bins, path_length, sampling_intervals, moving_average, point_centre, hotspot_grid, normalize_traj, global_bounds, clean_filter, parse_raw, parse_taxi,
        parse_time, format_wkt, parse_queries, interpolate, rotate, scale, mix, meters_to_degrees, augment_set, synthetic_walks, gen_queries, gen_queries_skewed, gen_queries_meters, gen_queries_gaussian, split_queries,
        range_candidates_adaptive, traj_signature_adaptive, xz_intervals, read_part_files, action_limit, nearest_active, unique_active, reassigned, scan_queries,
    )
}
QUERIES |= {"parse_txt": _round_trip("txt", src.parse_txt), "parse_geojson": _round_trip("geojson", src.parse_geojson), "parse_wkt": _round_trip("wkt", src.parse_wkt)}

__all__ = ["ORACLE_SQL", "QUERIES"]
