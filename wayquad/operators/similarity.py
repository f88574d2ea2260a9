"""Similarity of cells by the trajectories they share, and by their merged signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayquad.functions.geometry import Grid, box, cell_box, intersects, meet_once, tiled


def jaccard(trajectories: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(code_a, code_b, sim) of pairs a < b that share trajectories.

    Each trajectory lives in one cell, so the shared ones of two cells are those of a that meet b's box and
    those of b that meet a's.  Cells are bounded; counts are made per ordered pair of cells.
    """
    boxes = cells.withColumns(dict(zip(("c_min_x", "c_min_y", "c_max_x", "c_max_y"), cell_box(grid, F.col("level"), F.col("ix"), F.col("iy")), strict=True)))
    boxes = boxes.select(F.col("quad_code").alias("other"), "c_min_x", "c_min_y", "c_max_x", "c_max_y")
    own = trajectories.select("quad_code", "min_x", "min_y", "max_x", "max_y")
    # Boxes meet by equal tiles, and each pair counts in one of them.
    met = tiled(own, grid, box(), "a_").join(tiled(boxes, grid, box("c_"), "b_"), ["tx", "ty"]).where(meet_once("a_", "b_") & intersects(box(), box("c_")) & (F.col("quad_code") != F.col("other")))
    counts = met.groupBy(F.least("quad_code", "other").alias("code_a"), F.greatest("quad_code", "other").alias("code_b")).agg(F.count(F.lit(1)).alias("shared"))
    n = cells.select("quad_code", "n")
    joined = counts.join(F.broadcast(n.select(F.col("quad_code").alias("code_a"), F.col("n").alias("na"))), "code_a").join(F.broadcast(n.select(F.col("quad_code").alias("code_b"), F.col("n").alias("nb"))), "code_b")
    return joined.select("code_a", "code_b", F.round(F.col("shared") / (F.col("na") + F.col("nb")), 9).alias("sim"))


def stats(sims: DataFrame, cells: DataFrame) -> DataFrame:
    """One row over the full symmetric matrix: cells, mean, population deviation, largest entry, share of zeros.

    The diagonal is 1, and pairs of empty cells are 1 as well.
    """
    n = cells.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("e"), F.lit(1).alias("one"))
    s = sims.agg(F.coalesce(F.sum("sim"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("sim") * F.col("sim")), F.lit(0.0)).alias("s2"), F.count_if(F.col("sim") > 0).alias("k"), F.max("sim").alias("m"), F.lit(1).alias("one"))
    j = n.join(s, "one")
    ones = F.col("n") + F.col("e") * (F.col("e") - 1)
    total = F.col("n") * F.col("n")
    mean = (2 * F.col("s") + ones) / total
    return j.select(
        F.col("n").alias("cells"), F.round(mean, 8).alias("mean"), F.round(F.sqrt((2 * F.col("s2") + ones) / total - mean * mean), 8).alias("std"), F.lit(1.0).alias("largest"), F.round(1 - (2 * F.col("k") + ones) / total, 8).alias("sparsity")
    )


def signature_jaccard(trajectories: DataFrame) -> DataFrame:
    """(code_a, code_b, sim) of the merged signatures of cells of one level that share a bit."""
    merged = trajectories.groupBy("level", "quad_code").agg(F.bit_or("sig").alias("s"))
    bits = merged.select("level", "quad_code", "s", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftright(s, b) & 1) = 1)")).alias("bit"))
    b = bits.select("level", F.col("quad_code").alias("code_b"), F.col("s").alias("sb"), "bit")
    pairs = bits.select("level", F.col("quad_code").alias("code_a"), F.col("s").alias("sa"), "bit").join(b, ["level", "bit"]).where("code_a < code_b").select("code_a", "code_b", "sa", "sb").distinct()
    both, either = F.bit_count(F.col("sa").bitwiseAND(F.col("sb"))), F.bit_count(F.col("sa").bitwiseOR(F.col("sb")))
    return pairs.select("code_a", "code_b", F.round(both / F.greatest(either, F.lit(1)), 9).alias("sim"))


def top_similar(sims: DataFrame, k: int) -> DataFrame:
    """(code, rank, other, sim): the ``k`` most similar cells of each cell, ties to the smaller code."""
    both = sims.select(F.col("code_a").alias("code"), F.col("code_b").alias("other"), "sim").union(sims.select("code_b", "code_a", "sim"))
    order = Window.partitionBy("code").orderBy(F.desc("sim"), "other")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("code", "rank", "other", "sim")
