"""The grid inside a cell, chosen per cell: occupancy and discrimination of signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayquad.functions.geometry import Grid, cell_box
from wayquad.functions.signature import LARGEST, square
from wayquad.operators import index
from wayquad.session import small

OCCUPANCY_WEIGHT, DISCRIMINATION_WEIGHT = 0.3, 0.7
SAMPLE, GAIN = 64, 1.1


def scores(trajectories: DataFrame, grid: Grid, options: list[tuple[int, int]], sample: int = SAMPLE) -> DataFrame:
    """(quad_code, alpha, beta, n, occupancy, discrimination, score) of each cell under each option.

    At most ``sample`` trajectories of a cell count, those with the smallest hashes (the rule of the feature).
    The summed Hamming distance of all pairs is the sum over bits of k * (n - k), so no pairs are made.
    """
    pick = Window.partitionBy("quad_code").orderBy(F.xxhash64("tid"), "tid")
    chosen = trajectories.withColumn("_rn", F.row_number().over(pick)).where(F.col("_rn") <= sample).drop("_rn")
    ee = cell_box(grid, F.col("level"), F.col("ix"), F.col("iy"), grid.alpha, grid.beta)
    listed = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in options))
    each = chosen.withColumns(dict(zip(("e0", "e1", "e2", "e3"), ee, strict=True))).select("quad_code", "points", "e0", "e1", "e2", "e3", F.explode(listed).alias("o"))

    def bit(p: Column) -> Column:
        return square(p["x"], F.col("e0"), F.col("e2") - F.col("e0"), F.col("o.alpha")) * F.col("o.beta") + square(p["y"], F.col("e1"), F.col("e3") - F.col("e1"), F.col("o.beta"))

    # The bits of a trajectory are made distinct in its row.
    bits = each.select("quad_code", F.col("o.alpha").alias("alpha"), F.col("o.beta").alias("beta"), F.explode(F.array_distinct(F.transform("points", bit))).alias("bit"))
    per_bit = bits.groupBy("quad_code", "alpha", "beta", "bit").agg(F.count(F.lit(1)).alias("k"))
    n = chosen.groupBy("quad_code").agg(F.count(F.lit(1)).alias("n"))
    counted = per_bit.join(n, "quad_code").groupBy("quad_code", "alpha", "beta", "n").agg(F.count(F.lit(1)).alias("used"), F.sum(F.col("k") * (F.col("n") - F.col("k"))).alias("apart"))
    squares = F.col("alpha") * F.col("beta")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    rated = counted.withColumns({"occupancy": F.col("used") / squares, "discrimination": F.when(F.col("n") > 1, F.col("apart") / (pairs * squares)).otherwise(0.0)})
    score = OCCUPANCY_WEIGHT * F.col("occupancy") + DISCRIMINATION_WEIGHT * F.col("discrimination")
    return rated.select("quad_code", "alpha", "beta", "n", F.round("occupancy", 9).alias("occupancy"), F.round("discrimination", 9).alias("discrimination"), F.round(score, 9).alias("score"))


def choose(rated: DataFrame) -> DataFrame:
    """(quad_code, alpha, beta): options in ascending order, each replaces the best if it is more than a tenth better."""
    listed = rated.groupBy("quad_code").agg(F.array_sort(F.collect_list(F.struct("alpha", "beta", "score"))).alias("o"))
    best = F.aggregate(F.slice("o", 2, LARGEST * LARGEST), F.col("o")[0], lambda b, x: F.when(x["score"] > b["score"] * GAIN, x).otherwise(b))
    return listed.withColumn("b", best).select("quad_code", "b.alpha", "b.beta")


def options(grid: Grid, largest: int = LARGEST) -> list[tuple[int, int]]:
    return [(a, b) for a in range(min(grid.alpha, largest), largest + 1) for b in range(min(grid.beta, largest), largest + 1)]


def adapted(trajectories: DataFrame, cells: DataFrame, chosen: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Both tables with each cell's own grid: the cells get alpha and beta, the trajectories new signatures.

    ``chosen`` is (quad_code, alpha, beta) with sides of ``LARGEST`` at most; other cells keep the grid of all.
    Enlarged elements stay those of the grid of all.  Trajectories without a cell fall out.
    """
    own = chosen.select("quad_code", F.col("alpha").alias("_a"), F.col("beta").alias("_b"))
    sized = small(cells.drop("alpha", "beta").join(own, "quad_code", "left").withColumns({"alpha": F.coalesce("_a", F.lit(grid.alpha)), "beta": F.coalesce("_b", F.lit(grid.beta))}).drop("_a", "_b"))
    placed = trajectories.drop("sig", "alpha", "beta").join(sized.select("quad_code", "alpha", "beta"), "quad_code")
    return index.signed(placed, grid, "alpha", "beta").drop("alpha", "beta"), sized


def shrunk(cells: DataFrame, grid: Grid) -> DataFrame:
    """One row (shrunk_alpha, shrunk_beta, both_shrunk): how many cells have a coarser grid than that of all."""
    a, b = F.col("alpha") < grid.alpha, F.col("beta") < grid.beta
    return cells.agg(F.count_if(a).alias("shrunk_alpha"), F.count_if(b).alias("shrunk_beta"), F.count_if(a & b).alias("both_shrunk"))
