"""The index as tables: trajectories with their cells, cells after pruning, and enumerations.

A tree of L levels has (4^(L+1) - 1) / 3 cells (87,381 for L = 8).  Tables of cells are bounded by that
number whatever the number of trajectories, so they may be broadcast; tables of trajectories never are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayquad.functions import codes, signature
from wayquad.functions.geometry import Grid, cell_box, index_at, let, level_of

#: Cells of a tree that may be broadcast.
MAX_CELLS = (4**11 - 1) // 3


def mbr(trajectories: DataFrame) -> DataFrame:
    """Add the bounding box of ``points``; no points give 0, 0, 0, 0."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    sides = {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}
    return trajectories.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in sides.items()})


def assign(trajectories: DataFrame, grid: Grid) -> DataFrame:
    """Add box, level, ix, iy and quad_code; trajectories that start outside the root box get null codes."""
    x, y = F.col("min_x"), F.col("min_y")
    inside = (x >= grid.min_x) & (x <= grid.max_x) & (y >= grid.min_y) & (y <= grid.max_y)

    def place(level: Column) -> Column:
        return F.struct(level.alias("level"), index_at(x, grid.min_x, grid.width, level).alias("ix"), index_at(y, grid.min_y, grid.height, level).alias("iy"))

    def number(c: Column) -> Column:
        return F.struct(c["level"].alias("level"), c["ix"].alias("ix"), c["iy"].alias("iy"), codes.encode(grid.levels, c["level"], c["ix"], c["iy"]).alias("quad_code"))

    cell = let(let(level_of(grid), place), number)
    return mbr(trajectories).withColumn("_cell", F.when(inside, cell)).select("*", "_cell.level", "_cell.ix", "_cell.iy", "_cell.quad_code").drop("_cell")


def signed(assigned: DataFrame, grid: Grid, alpha: int | str | None = None, beta: int | str | None = None) -> DataFrame:
    """Add ``sig``, the signature in the enlarged element of the trajectory's cell; ``alpha`` and ``beta`` may name columns."""
    ee = cell_box(grid, F.col("level"), F.col("ix"), F.col("iy"), grid.alpha, grid.beta)
    named = assigned.withColumns(dict(zip(("_a", "_b", "_c", "_d"), ee, strict=True)))
    return named.withColumn("sig", signature.of_points("points", ("_a", "_b", "_c", "_d"), alpha or grid.alpha, beta or grid.beta)).drop("_a", "_b", "_c", "_d")


def occupied(assigned: DataFrame) -> DataFrame:
    """(level, ix, iy, n) of the cells that hold trajectories."""
    return assigned.where("quad_code IS NOT NULL").groupBy("level", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def prune_targets(assigned: DataFrame, grid: Grid, least: int) -> DataFrame:
    """(level, ix, iy) of every occupied cell and the cell (to_level, to_ix, to_iy) its trajectories move to.

    From the deepest level up, cells with fewer than ``least`` trajectories give them to their parents.
    Works on counts of cells only.
    """
    if codes.subtree_size(0, grid.levels) > MAX_CELLS:
        raise ValueError(f"a table of cells for {grid.levels} levels is too large")
    state = occupied(assigned).withColumns({"to_level": F.col("level"), "to_ix": F.col("ix"), "to_iy": F.col("iy")})
    if least <= 0:
        return state
    here = Window.partitionBy("to_level", "to_ix", "to_iy")
    for level in range(grid.levels, 0, -1):
        up = (F.col("to_level") == level) & (F.sum("n").over(here) < least)
        state = state.withColumn("_up", up).withColumns(
            {
                "to_level": F.when(F.col("_up"), F.col("to_level") - 1).otherwise(F.col("to_level")),
                "to_ix": F.when(F.col("_up"), F.shiftright("to_ix", 1)).otherwise(F.col("to_ix")),
                "to_iy": F.when(F.col("_up"), F.shiftright("to_iy", 1)).otherwise(F.col("to_iy")),
            }
        ).drop("_up")
    return state


def prune(assigned: DataFrame, grid: Grid, least: int) -> DataFrame:
    """Trajectories in the cells that pruning leaves them in."""
    targets = prune_targets(assigned, grid, least).drop("n")
    moved = assigned.join(F.broadcast(targets), ["level", "ix", "iy"])
    moved = moved.drop("level", "ix", "iy", "quad_code").withColumnsRenamed({"to_level": "level", "to_ix": "ix", "to_iy": "iy"})
    return moved.withColumn("quad_code", codes.encode(grid.levels))


def active_cells(pruned: DataFrame, grid: Grid) -> DataFrame:
    """Cells that hold trajectories after pruning, and the root: (quad_code, level, ix, iy, n)."""
    held = pruned.where("quad_code IS NOT NULL").groupBy("quad_code", "level", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    root = pruned.sparkSession.range(1).selectExpr("0L AS quad_code", "0 AS level", "0L AS ix", "0L AS iy", "0L AS n")
    return held.unionByName(root).groupBy("quad_code", "level", "ix", "iy").agg(F.sum("n").alias("n"))


def all_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell of the tree, decoded from its number."""
    numbers = spark.range(codes.subtree_size(0, grid.levels)).withColumnRenamed("id", "quad_code")
    return numbers.withColumn("_c", codes.decode(grid.levels)).select("quad_code", "_c.level", "_c.ix", "_c.iy")


def z_order(cells: DataFrame) -> DataFrame:
    """Add ``ord``, the position in depth-first order (a table of cells is bounded)."""
    return cells.withColumn("ord", (F.row_number().over(Window.orderBy("quad_code")) - 1).cast("long"))


def neighbours(cells: DataFrame) -> DataFrame:
    """(quad_code, neighbour): the up to eight cells of the same level around a cell that are in the table."""
    offsets = F.expr("explode(filter(transform(sequence(0, 8), k -> struct(k div 3 - 1 AS dx, k % 3 - 1 AS dy)), o -> o.dx <> 0 OR o.dy <> 0))")
    around = cells.where("level > 0").select("quad_code", "level", "ix", "iy", offsets.alias("o"))
    wanted = around.select(F.col("quad_code"), "level", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    return wanted.join(cells.select(F.col("quad_code").alias("neighbour"), "level", "ix", "iy"), ["level", "ix", "iy"]).select("quad_code", "neighbour")


def tree_stats(cells: DataFrame, grid: Grid) -> DataFrame:
    total = codes.subtree_size(0, grid.levels)
    return cells.agg(F.count(F.lit(1)).alias("active_cells")).select(F.lit(total).cast("long").alias("total_cells"), "active_cells", (F.lit(total) - F.col("active_cells")).cast("long").alias("muted_cells"), F.lit(grid.levels).alias("max_level"))


def nearest_active(cells: DataFrame, active: DataFrame) -> DataFrame:
    """(quad_code, ancestor): the deepest cell of ``active`` that holds a cell (level, ix, iy), itself included; null if none does."""
    up = cells.select("quad_code", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("k"), "level", "ix", "iy")
    at = lambda c: F.call_function("shiftright", F.col(c), F.col("k")).alias(c)
    above = up.select("quad_code", (F.col("level") - F.col("k")).alias("level"), at("ix"), at("iy"))
    found = above.join(active.select(F.col("quad_code").alias("code"), "level", "ix", "iy"), ["level", "ix", "iy"]).groupBy("quad_code").agg(F.max_by("code", "level").alias("ancestor"))
    return cells.select("quad_code").join(found, "quad_code", "left")


def unique_active(order: DataFrame, cells: DataFrame) -> DataFrame:
    """(quad_code, ord): the root first if it is in ``cells``, then the others at their first place in ``order`` (quad_code, pos)."""
    first = order.groupBy("quad_code").agg(F.min("pos").alias("pos")).join(cells.select("quad_code"), "quad_code", "left_semi")
    root = cells.where("quad_code = 0").select("quad_code", F.lit(None).cast("long").alias("pos"))
    listed = first.where("quad_code <> 0").select("quad_code", F.col("pos").cast("long").alias("pos")).union(root)
    return listed.select("quad_code", (F.row_number().over(Window.orderBy(F.col("pos").asc_nulls_first(), "quad_code")) - 1).cast("long").alias("ord"))


def reassigned(assigned: DataFrame) -> DataFrame:
    """(tid, cells): trajectories that are given more than once, with different cells."""
    return assigned.groupBy("tid").agg(F.count_distinct("level", "ix", "iy").alias("cells")).where("cells > 1")


def check_prune(assigned: DataFrame, pruned: DataFrame, least: int) -> DataFrame:
    """(name, n): all 0 if pruning lost, added, repeated or left too few trajectories."""
    before, after = assigned.where("quad_code IS NOT NULL").select("tid"), pruned.select("tid")
    few = pruned.where("level > 0").groupBy("quad_code").count().where(F.col("count") < least)
    repeated = after.groupBy("tid").count().where("count > 1")
    checks = {"lost": before.exceptAll(after), "added": after.exceptAll(before), "repeated": repeated, "too_few": few}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in checks.items()]
    return reduce(DataFrame.union, rows)
