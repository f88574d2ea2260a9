"""Counts and static features of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayquad.functions import codes
from wayquad.functions.geometry import Grid, box, cell_box, meet_once, tiled

TINY, TINY_LOG = 1e-6, 1e-8


def trajectory_statistics(trajectories: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(quad_code, n_ee, n_int, n_cov, density_x, density_y); boxes here are closed and exact, unlike in the search."""
    placed = cells.withColumns(dict(zip(("c0", "c1", "c2", "c3"), cell_box(grid, F.col("level"), F.col("ix"), F.col("iy")), strict=True)))
    t = trajectories.select("min_x", "min_y", "max_x", "max_y")
    a = box()
    meets = (F.col("c2") >= a[0]) & (F.col("c0") <= a[2]) & (F.col("c3") >= a[1]) & (F.col("c1") <= a[3])
    covers = (F.col("c0") <= a[0]) & (F.col("c2") >= a[2]) & (F.col("c1") <= a[1]) & (F.col("c3") >= a[3])
    there = tiled(placed.select("quad_code", "c0", "c1", "c2", "c3"), grid, tuple(map(F.col, ("c0", "c1", "c2", "c3"))), "b_")
    met = tiled(t, grid, a, "a_").join(there, ["tx", "ty"]).where(meet_once("a_", "b_") & meets)
    counts = met.groupBy("quad_code").agg(F.count(F.lit(1)).alias("n_int"), F.count_if(covers).alias("n_cov"))
    density = trajectories.groupBy("quad_code").agg(F.avg((F.col("min_x") + F.col("max_x")) / 2).alias("dx"), F.avg((F.col("min_y") + F.col("max_y")) / 2).alias("dy"))
    joined = placed.join(counts, "quad_code", "left").join(density, "quad_code", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "quad_code",
        F.col("n").alias("n_ee"),
        F.coalesce("n_int", zero).alias("n_int"),
        F.coalesce("n_cov", zero).alias("n_cov"),
        F.coalesce("dx", (F.col("c0") + F.col("c2")) / 2).alias("density_x"),
        F.coalesce("dy", (F.col("c1") + F.col("c3")) / 2).alias("density_y"),
    )


def static_features(stats: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(quad_code, f1 .. f10) of every cell, relative to all cells of the table."""
    x0, y0, x1, y1 = cell_box(grid, F.col("level"), F.col("ix"), F.col("iy"))
    e = cell_box(grid, F.col("level"), F.col("ix"), F.col("iy"), grid.alpha, grid.beta)
    rows = stats.join(cells.select("quad_code", "level", "ix", "iy"), "quad_code")
    cx, cy, dx, dy = (x0 + x1) / 2, (y0 + y1) / 2, F.col("density_x"), F.col("density_y")
    rows = rows.withColumns(
        {
            "dist": F.sqrt((dx - cx) ** 2 + (dy - cy) ** 2),
            "f5": (cx - (grid.min_x + grid.max_x) / 2) / (grid.width + TINY),
            "f6": (cy - (grid.min_y + grid.max_y) / 2) / (grid.height + TINY),
            "ox": (dx - (e[0] + e[2]) / 2) / (e[2] - e[0] + TINY),
            "oy": (dy - (e[1] + e[3]) / 2) / (e[3] - e[1] + TINY),
            "area": F.log((x1 - x0) * (y1 - y0) + TINY_LOG),
        }
    )
    # One row about all cells.
    about = rows.agg(
        *(f(c).alias(f"{c}_{n}") for c in ("ox", "oy") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))), F.min("area").alias("low"), F.max("area").alias("high"), F.max("n_ee").alias("n_most")
    )
    rows = rows.join(F.broadcast(about), F.lit(True))

    def standard(c: str) -> Column:
        return (F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_sd") + TINY)

    low, high = F.col("low"), F.col("high")
    most = F.greatest("n_most", F.lit(1))
    features = {
        "f1": F.log1p("n_ee") / F.log1p(most),
        "f2": F.sqrt(F.col("n_ee") / (F.col("n_int") + TINY)),
        "f3": F.sqrt(F.col("n_cov") / (F.col("n_int") + TINY)),
        "f4": F.log1p(10 * F.col("dist")),
        "f5": F.col("f5"),
        "f6": F.col("f6"),
        "f7": standard("ox"),
        "f8": standard("oy"),
        "f9": (F.col("area") - low) / (high - low + TINY_LOG),
        "f10": F.col("quad_code") / (codes.subtree_size(0, grid.levels) + TINY_LOG),
    }
    return rows.select("quad_code", *(F.round(v, 5).alias(k) for k, v in features.items()))
