"""Boxes, cells and enlarged elements as Column expressions.

Boxes are four flat columns (min_x, min_y, max_x, max_y), which keeps them open to pushdown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tolerance of the box predicates and of the level search.
EPS = 1e-10
#: Tolerance of the grids inside an enlarged element.
GRID_EPS = 1e-12
SIDES = ("min_x", "min_y", "max_x", "max_y")


@dataclass(frozen=True)
class Grid:
    """The root box, the depth of the tree, and by how many cells an enlarged element extends."""

    min_x: float = 0.0
    min_y: float = 0.0
    max_x: float = 720.0
    max_y: float = 600.0
    levels: int = 8
    alpha: int = 3
    beta: int = 3

    def __post_init__(self):
        if self.alpha < 2 or self.beta < 2:
            raise ValueError("alpha and beta must be 2 at least: one step up must always hold a trajectory")
        if self.alpha * self.beta > 64:
            raise ValueError("a signature has 64 bits at most")

    @property
    def width(self) -> float:
        return self.max_x - self.min_x

    @property
    def height(self) -> float:
        return self.max_y - self.min_y


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + s) for s in SIDES)


def intersects(a: tuple, b: tuple) -> Column:
    """Boxes that merely touch do not intersect."""
    return ~((a[2] < b[0] + EPS) | (a[0] > b[2] - EPS) | (a[3] < b[1] + EPS) | (a[1] > b[3] - EPS))


def contains(a: tuple, b: tuple) -> Column:
    """``a`` holds ``b``, with tolerance."""
    return (b[0] >= a[0] - EPS) & (b[1] >= a[1] - EPS) & (b[2] <= a[2] + EPS) & (b[3] <= a[3] + EPS)


def contains_point(a: tuple, x: Column, y: Column) -> Column:
    return (x >= a[0]) & (x <= a[2]) & (y >= a[1]) & (y <= a[3])


def cell_box(grid: Grid, level: Column, ix: Column, iy: Column, alpha: int = 1, beta: int = 1) -> tuple[Column, ...]:
    """The box of a cell, or of its enlarged element of ``alpha`` x ``beta`` cells, anchored lower left."""
    w, h = F.lit(grid.width) * F.pow(F.lit(0.5), level), F.lit(grid.height) * F.pow(F.lit(0.5), level)
    x, y = ix * w + grid.min_x, iy * h + grid.min_y
    return x, y, x + alpha * w, y + beta * h


#: Tiles of the root box along each axis, the keys of joins of boxes.
TILES = 32


def tile_of(value: Column, low: float, extent: float) -> Column:
    """The number of a tile along one axis; values beyond the root box have the outermost tiles."""
    return F.greatest(F.lit(0), F.least(F.lit(TILES - 1), F.floor((value - low) / extent * TILES))).cast("int")


def tiled(rows: DataFrame, grid: Grid, sides: tuple[Column, ...], prefix: str) -> DataFrame:
    """One row for each tile (tx, ty) that the box ``sides`` meets; ``prefix`` + x and y name the first tiles."""
    x0, x1 = tile_of(sides[0], grid.min_x, grid.width), tile_of(sides[2], grid.min_x, grid.width)
    y0, y1 = tile_of(sides[1], grid.min_y, grid.height), tile_of(sides[3], grid.min_y, grid.height)
    named = rows.withColumns({f"{prefix}x": x0, f"{prefix}y": y0, "_x1": x1, "_y1": y1})
    return named.withColumn("tx", F.explode(F.sequence(F.col(f"{prefix}x"), F.col("_x1")))).withColumn("ty", F.explode(F.sequence(F.col(f"{prefix}y"), F.col("_y1")))).drop("_x1", "_y1")


def meet_once(a: str, b: str) -> Column:
    """Of all tiles that two boxes share, the one where both begin: each pair of ``tiled`` boxes counts there."""
    return (F.col("tx") == F.greatest(f"{a}x", f"{b}x")) & (F.col("ty") == F.greatest(f"{a}y", f"{b}y"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, so that expressions built on it stay as long as they are written."""
    return F.transform(F.array(value), body)[0]


def level_of(grid: Grid) -> Column:
    """The deepest level at which the enlarged element of the box's lower left cell holds the box."""
    x1, y1, x2, y2 = box()
    d = F.greatest((x2 - x1) / (grid.alpha * grid.width), (y2 - y1) / (grid.beta * grid.height))
    asked = F.when(d <= 0, grid.levels).otherwise(F.greatest(F.lit(0), F.least(F.lit(grid.levels), F.floor(-F.log2(d))))).cast("int")

    def settle(level: Column) -> Column:
        w, h = F.lit(grid.width) * F.pow(F.lit(0.5), level), F.lit(grid.height) * F.pow(F.lit(0.5), level)
        gx = F.floor((x1 - grid.min_x + EPS) / w) * w + grid.min_x
        gy = F.floor((y1 - grid.min_y + EPS) / h) * h + grid.min_y
        held = (gx + grid.alpha * w >= x2 - EPS) & (gy + grid.beta * h >= y2 - EPS)
        return F.greatest(F.lit(0), F.when(held, level).otherwise(level - 1)).cast("int")

    return let(asked, settle)


def index_at(value: Column, low: float, extent: float, level: Column) -> Column:
    """The cell number along one axis, the last one for the far border."""
    n = F.pow(F.lit(2.0), level)
    return F.least(F.floor((value - low + EPS) / extent * n), n - 1).cast("long")
