"""Range queries over the index: candidates, row-key intervals, exact refinement.

A breadth-first walk with pruning equals flat predicates, since a child's enlarged element lies inside its
parent's.  Tables of queries and cells are written, counted and broadcast where that count is small; trajectories
meet them by equal cell codes, points and segments meet boxes by equal tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayquad.functions import codes, signature
from wayquad.functions.geometry import Grid, box, cell_box, contains, contains_point, intersects, meet_once, tile_of, tiled
from wayquad.operators.cost import merge_intervals
from wayquad.session import pin, small

#: Queries of one batch that may be broadcast.
MAX_QUERIES = 10_000
ROOT = Grid()


def related(queries: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """Queries with the cells whose enlarged elements they contain ('C') or intersect ('I'), and the box's signature there.

    The signature is in the cell's own grid where ``cells`` has alpha and beta, as the trajectories' must be then.
    """
    parts = (F.col("alpha"), F.col("beta")) if {"alpha", "beta"} <= set(cells.columns) else (grid.alpha, grid.beta)
    ee = cell_box(grid, F.col("level"), F.col("ix"), F.col("iy"), grid.alpha, grid.beta)
    placed = cells.withColumns(dict(zip(("ee_min_x", "ee_min_y", "ee_max_x", "ee_max_y"), ee, strict=True)))
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one batch")
    met = placed.join(F.broadcast(queries), contains(box(), box("ee_")) | intersects(box(), box("ee_")))
    held = contains(box(), box("ee_"))
    return met.select("query_id", "quad_code", "level", "n", F.when(held, "C").otherwise("I").alias("rel"), signature.of_box(box(), box("ee_"), *parts, rows=max(grid.alpha, signature.LARGEST)).alias("qsig"))


def _top(rel: DataFrame, grid: Grid) -> DataFrame:
    """Contained cells without a contained ancestor."""
    inside = rel.where("rel = 'C'")
    above = inside.select(F.col("query_id").alias("qq"), F.col("quad_code").alias("up"), (F.col("quad_code") + codes.subtree_size_of(F.col("level"), grid.levels)).alias("up_end"))
    return inside.join(above, (F.col("query_id") == F.col("qq")) & (F.col("quad_code") > F.col("up")) & (F.col("quad_code") < F.col("up_end")), "left_anti")


Plan = tuple[DataFrame, DataFrame, DataFrame]


def plan(queries: DataFrame, cells: DataFrame, grid: Grid) -> Plan:
    """Topmost contained cells; all cells of their subtrees; intersecting cells outside of these.

    The functions below make it themselves, or take it where several of them ask about the same queries.
    """
    rel = pin(related(queries, cells, grid))
    top = _top(rel, grid).select("query_id", "quad_code", "level")
    tops = top.select(F.col("query_id").alias("qq"), F.col("quad_code").alias("up"), (F.col("quad_code") + codes.subtree_size_of(F.col("level"), grid.levels)).alias("up_end"))
    same = (F.col("query_id") == F.col("qq")) & (F.col("quad_code") >= F.col("up")) & (F.col("quad_code") < F.col("up_end"))
    # Subtrees of contained cells are contained, so they are among the related cells.
    under = rel.join(tops, same, "left_semi").select("query_id", "quad_code")
    crossing = rel.where("rel = 'I'").join(tops, same, "left_anti").select("query_id", "quad_code", "qsig")
    return pin(top), small(under, 32), small(crossing, 40)


def _matched(crossing: DataFrame, trajectories: DataFrame) -> DataFrame:
    hit = (F.col("sig") != 0) & (F.col("sig").bitwiseAND(F.col("qsig")) != 0)
    return trajectories.select("tid", "quad_code", "sig").join(crossing, "quad_code").where(hit)


def candidates(queries: DataFrame, trajectories: DataFrame, cells: DataFrame, grid: Grid, planned: Plan | None = None) -> DataFrame:
    """(query_id, tid) that the index cannot rule out."""
    _, under, crossing = planned or plan(queries, cells, grid)
    whole = trajectories.select("tid", "quad_code").join(under, "quad_code").select("query_id", "tid")
    return whole.union(_matched(crossing, trajectories).select("query_id", "tid")).distinct()


def code_intervals(queries: DataFrame, trajectories: DataFrame, cells: DataFrame, grid: Grid, planned: Plan | None = None) -> DataFrame:
    """Merged scan ranges of cell codes: leaf ranges of contained subtrees, single codes of matching cells."""
    top, _, crossing = planned or plan(queries, cells, grid)
    lo, hi = codes.leaf_range(grid.levels, F.col("quad_code"), F.col("level"))
    single = _matched(crossing, trajectories).select("query_id", "quad_code").distinct()
    raw = top.select("query_id", lo.cast("long").alias("lo"), hi.alias("hi")).union(single.select("query_id", F.col("quad_code").alias("lo"), (F.col("quad_code") + 1).alias("hi")))
    return merge_intervals(raw)


def order_intervals(queries: DataFrame, trajectories: DataFrame, cells: DataFrame, order: DataFrame, grid: Grid, planned: Plan | None = None) -> DataFrame:
    """Merged scan ranges of positions in ``order`` (quad_code, ord)."""
    _, under, crossing = planned or plan(queries, cells, grid)
    single = _matched(crossing, trajectories).select("query_id", "quad_code").distinct()
    positions = under.union(single).join(order.select("quad_code", "ord"), "quad_code")
    return merge_intervals(positions.select("query_id", F.col("ord").alias("lo"), (F.col("ord") + 1).alias("hi")))


def coverage_intervals(queries: DataFrame, trajectories: DataFrame, cells: DataFrame, order: DataFrame, grid: Grid, planned: Plan | None = None) -> DataFrame:
    """Merged scan ranges of positions in an order whose subtrees are contiguous (``order.covers`` of its file).

    ``order`` is (quad_code, ord, effective_subtree_count): a contained cell stands for one range over its subtree.
    Contained cells without a position or a count give the positions of their subtrees one by one.
    """
    top, under, crossing = planned or plan(queries, cells, grid)
    counted = order.where("ord IS NOT NULL AND effective_subtree_count IS NOT NULL")
    whole = top.join(counted.select("quad_code", "ord", "effective_subtree_count"), "quad_code")
    bare = top.join(counted.select("quad_code"), "quad_code", "left_anti")
    ends = bare.select(F.col("query_id").alias("qq"), F.col("quad_code").alias("up"), (F.col("quad_code") + codes.subtree_size_of(F.col("level"), grid.levels)).alias("up_end"))
    rest = under.join(ends, (F.col("query_id") == F.col("qq")) & (F.col("quad_code") >= F.col("up")) & (F.col("quad_code") < F.col("up_end")), "left_semi")
    single = _matched(crossing, trajectories).select("query_id", "quad_code").distinct()
    units = rest.select("query_id", "quad_code").union(single).join(order.select("quad_code", "ord"), "quad_code")
    raw = whole.select("query_id", F.col("ord").alias("lo"), (F.col("ord") + F.col("effective_subtree_count") + 1).alias("hi"))
    return merge_intervals(raw.union(units.select("query_id", F.col("ord").alias("lo"), (F.col("ord") + 1).alias("hi"))))


def exact_points(queries: DataFrame, points: DataFrame, grid: Grid = ROOT) -> DataFrame:
    """(query_id, tid) with a point in the box; ``grid`` only gives the tiles by which they meet."""
    placed = points.select("tid", "x", "y", tile_of(F.col("x"), grid.min_x, grid.width).alias("tx"), tile_of(F.col("y"), grid.min_y, grid.height).alias("ty"))
    return placed.join(tiled(queries, grid, box(), "a_"), ["tx", "ty"]).where(contains_point(box(), F.col("x"), F.col("y"))).select("query_id", "tid").distinct()


def segment_hits(x0: str, y0: str, x1: str, y1: str) -> str:
    """SQL: does a segment meet the closed box (min_x, ...), by clipping the parameter range on both axes."""

    def span(a: str, b: str, low: str, high: str) -> tuple[str, str]:
        d = f"({b} - {a})"
        t0, t1 = f"(({low} - {a}) / {d})", f"(({high} - {a}) / {d})"
        inside = f"{a} >= {low} AND {a} <= {high}"
        return f"CASE WHEN {d} = 0 THEN CASE WHEN {inside} THEN 0D ELSE 2D END ELSE least({t0}, {t1}) END", f"CASE WHEN {d} = 0 THEN CASE WHEN {inside} THEN 1D ELSE -1D END ELSE greatest({t0}, {t1}) END"

    enter_x, leave_x = span(x0, x1, "min_x", "max_x")
    enter_y, leave_y = span(y0, y1, "min_y", "max_y")
    return f"greatest(0D, {enter_x}, {enter_y}) <= least(1D, {leave_x}, {leave_y})"


def exact_segments(queries: DataFrame, trajectories: DataFrame, grid: Grid = ROOT) -> DataFrame:
    """(query_id, tid) whose polyline meets the closed box; ``grid`` only gives the tiles by which they meet."""
    segments = trajectories.select("tid", F.explode(F.expr("transform(sequence(1, size(points) - 1), i -> struct(points[i - 1] AS p, points[i] AS q))")).alias("s"))
    extent = (F.least("s.p.x", "s.q.x"), F.least("s.p.y", "s.q.y"), F.greatest("s.p.x", "s.q.x"), F.greatest("s.p.y", "s.q.y"))
    met = tiled(segments, grid, extent, "a_").join(tiled(queries, grid, box(), "b_"), ["tx", "ty"])
    return met.where(meet_once("a_", "b_") & F.expr(segment_hits("s.p.x", "s.p.y", "s.q.x", "s.q.y"))).select("query_id", "tid").distinct()
