"""Reports about data sets and about the distribution of trajectories over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lower bounds of the bins of trajectory lengths, and upper bounds of those of cell loads (fixed values).
LENGTH_BINS = (0, 10, 20, 50, 100, 200, 500)
LOAD_BINS = ((1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"))


def bounds(points: DataFrame, drift: tuple[float, float, float, float]) -> DataFrame:
    """The box of all points inside the ``drift`` box; that box itself if there are none."""
    inside = points.where(F.col("x").between(drift[0], drift[2]) & F.col("y").between(drift[1], drift[3]))
    return inside.agg(*(F.coalesce(f(c), F.lit(float(d))).alias(n) for f, c, n, d in ((F.min, "x", "min_x", drift[0]), (F.min, "y", "min_y", drift[1]), (F.max, "x", "max_x", drift[2]), (F.max, "y", "max_y", drift[3]))))


def clean(trajectories: DataFrame, box: tuple[float, float, float, float], least: int, strict: bool = False) -> DataFrame:
    """(tid, verdict): outside, short, flat or valid; a trajectory with one point outside the box is outside."""
    p = lambda c: F.transform("points", lambda q: q[c])
    outside = F.exists("points", lambda q: (q["x"] < box[0]) | (q["x"] > box[2]) | (q["y"] < box[1]) | (q["y"] > box[3]))
    short = F.size("points") <= least if strict else F.size("points") < least
    flat = (F.array_max(p("x")) <= F.array_min(p("x"))) | (F.array_max(p("y")) <= F.array_min(p("y")))
    return trajectories.select("tid", F.when(outside, "outside").when(short, "short").when(flat, "flat").otherwise("valid").alias("verdict"))


def normalise(points: DataFrame, target: tuple[float, float, float, float] = (0, 0, 1, 1)) -> DataFrame:
    """Scale all points from their common box to ``target``; an axis without extent keeps its unit."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def scaled(v: str, low: str, high: str, a: float, z: float) -> Column:
        extent = F.when(F.col(high) - F.col(low) == 0, 1.0).otherwise(F.col(high) - F.col(low))
        return a + (F.col(v) - F.col(low)) / extent * (z - a)

    # One row of bounds.
    joined = points.join(F.broadcast(b), F.lit(True))
    return joined.select("tid", "seq", scaled("x", "x0", "x1", target[0], target[2]).alias("x"), scaled("y", "y0", "y1", target[1], target[3]).alias("y"))


def level_histogram(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("quad_code").alias("cells"))


def level_summary(assigned: DataFrame) -> DataFrame:
    lv = assigned.where("level IS NOT NULL")
    return lv.agg(F.min("level").alias("lowest"), F.max("level").alias("highest"), F.round(F.avg("level"), 6).alias("mean"), F.median("level").alias("median"), F.round(F.stddev_pop("level"), 6).alias("std"))


def load_buckets(cells: DataFrame) -> DataFrame:
    """(bucket, cells, trajectories) by the number of trajectories of a cell."""
    bucket = F.lit("100+")
    for top, name in reversed(LOAD_BINS):
        bucket = F.when(F.col("n") <= top, name).otherwise(bucket)
    return cells.where("n > 0").withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").cast("long").alias("trajectories"))


def fill_rate(assigned: DataFrame) -> DataFrame:
    """(level, n, fill_pct, cdf): cells in use of a level's 4^level, and the share of trajectories up to it."""
    h = level_histogram(assigned.where("level IS NOT NULL"))
    upto, everything = Window.orderBy("level"), Window.partitionBy()
    return h.select("level", "n", F.round(F.col("cells") / F.pow(F.lit(4.0), "level") * 100, 8).alias("fill_pct"), F.round(F.sum("n").over(upto) / F.sum("n").over(everything), 9).alias("cdf"))


def prune_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(level, cells_before, trajectories_before, cells_after, trajectories_after)."""
    b = level_histogram(before.where("level IS NOT NULL")).select("level", F.col("cells").alias("cells_before"), F.col("n").alias("trajectories_before"))
    a = level_histogram(after).select("level", F.col("cells").alias("cells_after"), F.col("n").alias("trajectories_after"))
    zero = F.lit(0).cast("long")
    return b.join(a, "level", "full").select("level", *(F.coalesce(c, zero).alias(c) for c in ("cells_before", "trajectories_before", "cells_after", "trajectories_after")))


def steps(points: DataFrame) -> DataFrame:
    """(tid, seq, dt, length): hours and distance to the next point of a trajectory."""
    order = Window.partitionBy("tid").orderBy("seq")
    nx, ny = F.lead("x").over(order), F.lead("y").over(order)
    return points.select("tid", "seq", (nx - F.col("x")).alias("dt"), F.sqrt((nx - F.col("x")) ** 2 + (ny - F.col("y")) ** 2).alias("length")).where("dt IS NOT NULL")


def path_length(points: DataFrame) -> DataFrame:
    return steps(points).groupBy("tid").agg(F.round(F.sum("length"), 6).alias("length"))


def intervals(points: DataFrame, longest_s: int = 3600) -> DataFrame:
    """One row about the seconds between points that are more than 0 and less than ``longest_s``."""
    s = steps(points).select((F.col("dt") * 3600).alias("s")).where(f"s > 0 AND s < {longest_s}")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 4).alias("mean_s"), F.round(F.median("s"), 4).alias("median_s"))


def length_bins(trajectories: DataFrame) -> DataFrame:
    """(bin, n): trajectories by their number of points; a bin is named by its lower bound."""
    low = F.lit(LENGTH_BINS[0])
    for b in LENGTH_BINS[1:]:
        low = F.when(F.size("points") >= b, b).otherwise(low)
    return trajectories.groupBy(low.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dataset_report(boxed: DataFrame, points: DataFrame) -> DataFrame:
    """One row: trajectories, points, mean and median box area, common box, mean and median length and duration."""
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    shape = boxed.agg(
        F.count(F.lit(1)).alias("trajectories"), F.round(F.avg(area), 5).alias("mean_area"), F.round(F.median(area), 5).alias("median_area"),
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.lit(1).alias("one"),
    )
    p = points.groupBy("tid").agg(F.count(F.lit(1)).alias("k"), (F.max("x") - F.min("x")).alias("hours"))
    length = p.join(path_length(points), "tid").agg(
        F.sum("k").cast("long").alias("points"), F.round(F.avg("length"), 4).alias("mean_length"), F.round(F.median("length"), 4).alias("median_length"),
        F.round(F.avg("hours"), 5).alias("mean_hours"), F.round(F.median("hours"), 5).alias("median_hours"), F.lit(1).alias("one"),
    )
    return shape.join(length, "one").drop("one")


def hotspots(points: DataFrame, box: tuple[float, float, float, float], parts: int = 10, share: float = 0.2) -> DataFrame:
    """(gx, gy, n): the densest fifth of the squares in use, one at least; ties by position."""
    at = lambda c, low, high: F.least(F.lit(parts - 1), F.floor((F.col(c) - low) / (high - low) * parts)).cast("int")
    inside = points.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    grid = inside.groupBy(at("x", box[0], box[2]).alias("gx"), at("y", box[1], box[3]).alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    ranked = grid.withColumns({"rn": F.row_number().over(Window.orderBy(F.desc("n"), "gx", "gy")), "total": F.count(F.lit(1)).over(everything)})
    return ranked.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(share * F.col("total")))).select("gx", "gy", "n")


def moving_average(points: DataFrame, window: int = 10) -> DataFrame:
    """(tid, seq, avg): the mean of the last ``window`` values, null before there are so many."""
    order = Window.partitionBy("tid").orderBy("seq")
    rows = order.rowsBetween(-(window - 1), 0)
    return points.select("tid", "seq", F.when(F.count("y").over(rows) == window, F.round(F.avg("y").over(rows), 8)).alias("avg"))


def centre(points: DataFrame, extent: tuple[float, float]) -> DataFrame:
    """Mean and population deviation of the points; a quarter of the extent where there is no deviation."""
    sd = lambda c, e: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(e / 4))
    return points.agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.round(sd("x", extent[0]), 6).alias("sd_x"), F.round(sd("y", extent[1]), 6).alias("sd_y"))
