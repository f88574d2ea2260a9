"""Cell orders: coverage of subtrees, export, merging with partitions, and a greedy order."""

from __future__ import annotations

import bisect
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayquad.functions import codes
from wayquad.functions.geometry import Grid, cell_box


def subtree_orders(ordered: DataFrame, grid: Grid) -> DataFrame:
    """(quad_code, ord, effective_subtree_count, effective_subtree_orders): active descendants of every cell and their positions."""
    size = codes.subtree_size_of(F.col("level"), grid.levels)
    top = ordered.select("quad_code", "ord", (F.col("quad_code") + size).alias("end"))
    below = ordered.select(F.col("quad_code").alias("code"), F.col("ord").alias("o"))
    pairs = top.join(F.broadcast(below), (F.col("code") > F.col("quad_code")) & (F.col("code") < F.col("end")), "left")
    return pairs.groupBy("quad_code", "ord").agg(F.count("o").alias("effective_subtree_count"), F.array_sort(F.collect_list("o")).alias("effective_subtree_orders"))


def entries(ordered: DataFrame, grid: Grid, partitions: DataFrame | None = None) -> DataFrame:
    """One row a cell as an order file holds it."""
    x, y, _, _ = cell_box(grid, F.col("level"), F.col("ix"), F.col("iy"))
    rows = ordered.join(subtree_orders(ordered, grid).drop("effective_subtree_orders"), ["quad_code", "ord"])
    rows = rows.withColumns({"alpha": F.lit(grid.alpha), "beta": F.lit(grid.beta), "xmin": x, "ymin": y})
    return merge_partitions(rows, partitions) if partitions is not None else rows


def merge_partitions(order: DataFrame, partitions: DataFrame) -> DataFrame:
    """Take alpha and beta of cells from ``partitions`` (quad_code, alpha, beta) where it has them."""
    new = partitions.select("quad_code", F.col("alpha").alias("_a"), F.col("beta").alias("_b"))
    joined = order.join(new, "quad_code", "left")
    return joined.withColumns({"alpha": F.coalesce("_a", "alpha"), "beta": F.coalesce("_b", "beta")}).drop("_a", "_b")


def metadata(cells: DataFrame, trajectories: DataFrame, partitions: DataFrame, grid: Grid, least: int) -> DataFrame:
    """One row: counts, largest partition, largest number of distinct signatures in a cell, box and depth."""
    shapes = trajectories.groupBy("quad_code").agg(F.countDistinct("sig").alias("s")).agg(F.max("s").alias("max_shape_count"))
    counts = cells.agg(F.count(F.lit(1)).alias("total_cells"), F.sum("n").cast("long").alias("total_trajectories"))
    largest = partitions.agg(F.max(F.col("alpha") * F.col("beta")).alias("max_partition"))
    one = F.lit(1).alias("one")
    joined = counts.select("*", one).join(shapes.select("*", one), "one").join(largest.select("*", one), "one").drop("one")
    return joined.withColumns({"min_trajectories": F.lit(least), "max_level": F.lit(grid.levels)})


def write_order(entry_rows: DataFrame, path: str, grid: Grid, source: str = "z", facts: dict | None = None) -> None:
    """The order file: a table of cells is bounded, so the driver writes it.

    Orders whose ``source`` names xz are marked as contiguous if every subtree follows its cell without a gap;
    all others list the positions of their subtrees.  ``facts`` are more metadata, such as the row of ``metadata``.
    """
    rows = entry_rows.orderBy("ord").collect()
    by_code = sorted((r["quad_code"], r["ord"]) for r in rows)
    at = [c for c, _ in by_code]

    def below(r) -> list[int]:
        end = r["quad_code"] + codes.subtree_size(r["level"], grid.levels)
        return sorted(o for _, o in by_code[bisect.bisect_right(at, r["quad_code"]) : bisect.bisect_left(at, end)])

    subtrees = [below(r) for r in rows]
    contiguous = "xz" in source.lower() and all(s == list(range(r["ord"] + 1, r["ord"] + 1 + len(s))) for r, s in zip(rows, subtrees, strict=True))
    ordering = [
        {
            "quad_code": r["quad_code"],
            "order": r["ord"],
            "parent": {"alpha": r["alpha"], "beta": r["beta"], "level": r["level"], "element_code": r["quad_code"], "xmin": r["xmin"], "ymin": r["ymin"]},
            "coverage": {"effective_subtree_count": len(s)} | ({} if contiguous else {"effective_subtree_orders": s}),
        }
        for r, s in zip(rows, subtrees, strict=True)
    ]
    meta = {
        **(facts or {}),
        "version": "1.4",
        "order_source": source,
        "effective_subtree_contiguous": contiguous,
        "quadtree_max_level": grid.levels,
        "total_cells": codes.subtree_size(0, grid.levels),
        "active_cells": len(rows),
        "spatial_boundary": dict(zip(("xmin", "ymin", "xmax", "ymax"), (grid.min_x, grid.min_y, grid.max_x, grid.max_y), strict=True)),
        "global_alpha": grid.alpha,
        "global_beta": grid.beta,
        "max_partition": max((r["alpha"] * r["beta"] for r in rows), default=grid.alpha * grid.beta),
    }
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"ordering": ordering, "metadata": meta}, file)


#: The parts of an order file that are read.  Codes and positions are cast one by one, so a bad one costs its entry only.
ORDER_FILE = (
    "ordering array<struct<quad_code:string,`order`:string,coverage:struct<effective_subtree_count:bigint>>>,"
    " metadata struct<quadtree_max_level:int,order_source:string,effective_subtree_contiguous:boolean>"
)


def _order_file(spark, path: str) -> DataFrame:
    if not path.endswith(".json"):
        raise ValueError(f"not an order file: {path}")
    return spark.read.schema(ORDER_FILE).json(path, multiLine=True)


def read_metadata(spark, path: str) -> dict:
    """quadtree_max_level, order_source and effective_subtree_contiguous (None where absent) of an order file."""
    row = _order_file(spark, path).first()
    if row is None or row["ordering"] is None or row["metadata"] is None or row["metadata"]["quadtree_max_level"] is None:
        raise ValueError("an order file has ordering and metadata with quadtree_max_level")
    return row["metadata"].asDict()


def covers(meta: dict) -> bool:
    """May ``search.coverage_intervals`` be used with the order of this file?"""
    return "xz" in (meta["order_source"] or "").lower() and meta["effective_subtree_contiguous"] is True


def read_order(spark, path: str) -> DataFrame:
    """(quad_code, ord, level, ix, iy, effective_subtree_count) of an order file.

    An entry names one code or a list of them.  Entries without a position or a code that a cell of the file's tree
    has fall out; of repeated codes the smallest position counts.  The count is null where the file has none.
    """
    levels = read_metadata(spark, path)["quadtree_max_level"]
    rows = _order_file(spark, path).select(F.explode("ordering").alias("e"))
    named = rows.select(F.explode(F.split(F.translate("e.quad_code", "[] ", ""), ",")).alias("code"), F.expr("try_cast(e.`order` AS BIGINT)").alias("ord"), "e.coverage.effective_subtree_count")
    valid = named.withColumn("quad_code", F.expr("try_cast(code AS BIGINT)")).where("quad_code IS NOT NULL AND ord IS NOT NULL")
    first = valid.groupBy("quad_code").agg(F.min(F.struct("ord", "effective_subtree_count")).alias("m"))
    placed = first.withColumn("c", codes.decode(levels)).where("c IS NOT NULL")
    return placed.select("quad_code", "m.ord", "c.level", "c.ix", "c.iy", "m.effective_subtree_count")


def complete_order(prefix: DataFrame, default: DataFrame) -> DataFrame:
    """(quad_code, ord): a given beginning, then the rest in the default order."""
    rest = default.join(prefix.select("quad_code"), "quad_code", "left_anti")
    both = prefix.select("quad_code", F.lit(0).alias("part"), "ord").union(rest.select("quad_code", F.lit(1).alias("part"), "ord"))
    from pyspark.sql.window import Window

    return both.select("quad_code", (F.row_number().over(Window.orderBy("part", "ord")) - 1).cast("long").alias("ord"))


def greedy_order(cells: list[dict], similarity: dict[tuple[int, int], float], grid: Grid) -> list[int]:
    """Codes in the order of a walk from the root cell that always goes on to the best candidate.

    Candidates are unvisited same-level neighbours and the nearest unvisited layers of ancestors and of
    descendants, or else the nearest cell; the best has the largest sum of proximity and similarity,
    then the smallest code.  A sequential walk over a bounded table of cells, on the driver.
    """
    by_place = {(c["level"], c["ix"], c["iy"]): c for c in cells}
    diagonal = math.hypot(grid.width, grid.height)

    def centre(c: dict) -> tuple[float, float]:
        w, h = grid.width * 0.5 ** c["level"], grid.height * 0.5 ** c["level"]
        return grid.min_x + (c["ix"] + 0.5) * w, grid.min_y + (c["iy"] + 0.5) * h

    def distance(a: dict, b: dict) -> float:
        (x0, y0), (x1, y1) = centre(a), centre(b)
        return math.hypot(x0 - x1, y0 - y1)

    left = {c["quad_code"]: c for c in cells}
    at = left.pop(min(left))
    out = [at["quad_code"]]

    def open_at(places: set[tuple[int, int, int]]) -> list[dict]:
        return [by_place[p] for p in places if p in by_place and by_place[p]["quad_code"] in left]

    while left:
        level, ix, iy = at["level"], at["ix"], at["iy"]
        around = {(level, ix + dx, iy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy} if level else set()
        beside = open_at(around)
        start = {(level, ix, iy), *((c["level"], c["ix"], c["iy"]) for c in beside)}
        candidates = list(beside)
        layer = start
        while layer := {(lv - 1, x >> 1, y >> 1) for lv, x, y in layer if lv}:
            if found := open_at(layer):
                candidates += found
                break
        layer = start
        while layer and next(iter(layer))[0] < grid.levels:
            layer = {(lv + 1, 2 * x + dx, 2 * y + dy) for lv, x, y in layer for dx in (0, 1) for dy in (0, 1)}
            # Only places above a cell that is left can lead to one.
            layer = {p for p in layer if p in by_place or any(q[0] > p[0] and (q[1] >> (q[0] - p[0]), q[2] >> (q[0] - p[0])) == p[1:] for q in by_place)}
            if found := open_at(layer):
                candidates += found
                break
        if not candidates:
            candidates = [min(left.values(), key=lambda c: (distance(at, c), c["quad_code"]))]
        here = at

        def worth(c: dict, here: dict = here) -> tuple[float, int]:
            pair = tuple(sorted((here["quad_code"], c["quad_code"])))
            return 0.5 * (1 - min(distance(here, c) / diagonal, 1)) + 0.5 * similarity.get(pair, 0.0), -c["quad_code"]

        at = max(candidates, key=worth)
        out.append(at["quad_code"])
        del left[at["quad_code"]]
    return out
