"""Bitmaps of the grid squares that a trajectory or a box covers in an enlarged element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayquad.functions.geometry import GRID_EPS

#: Rows and columns of the grid that a cell may choose for itself.
LARGEST = 8


def square(value: Column, low: Column, extent: Column, parts: Column | int) -> Column:
    """Number of the grid square along one axis, clipped."""
    parts = parts if isinstance(parts, Column) else F.lit(parts)
    at = F.floor((value - low + GRID_EPS) / (extent / (parts + GRID_EPS)))
    return F.greatest(F.lit(0), F.least(parts - 1, at)).cast("int")


def point_bit(x: Column, y: Column, ee: tuple, alpha: Column | int, beta: Column | int) -> Column:
    """The position of a point's bit."""
    return square(x, ee[0], ee[2] - ee[0], alpha) * beta + square(y, ee[1], ee[3] - ee[1], beta)


def of_points(points: str, ee: tuple[str, str, str, str], alpha: int | str, beta: int | str) -> Column:
    """Signature of an array of points (x, y) in a grid of ``alpha`` x ``beta`` (numbers or names of columns); empty arrays give 0."""

    def at(value: str, low: str, high: str, parts: int | str) -> str:
        return f"greatest(0L, least(CAST({parts} AS BIGINT) - 1L, floor((p.{value} - {low} + {GRID_EPS}D) / (({high} - {low}) / ({parts} + {GRID_EPS}D)))))"

    bit = f"CAST({at('x', ee[0], ee[2], alpha)} * {beta} + {at('y', ee[1], ee[3], beta)} AS INT)"
    return F.expr(f"aggregate({points}, 0L, (a, p) -> a | shiftleft(1L, {bit}))")


def of_box(q: tuple, ee: tuple, alpha: Column | int, beta: Column | int, rows: int = LARGEST) -> Column:
    """Signature of the squares that a box covers; 0 if it lies beside the element.

    ``rows`` bounds ``alpha`` where that is a column.
    """
    rows = alpha if isinstance(alpha, int) else rows
    alpha, beta = (F.lit(v) if isinstance(v, int) else v for v in (alpha, beta))

    def bounds(low: Column, high: Column, start: Column, end: Column, parts: Column) -> tuple[Column, Column]:
        step = (end - start) / (parts + GRID_EPS)
        first, last = F.floor((low - start + GRID_EPS) / step), F.floor((high - start - GRID_EPS) / step)
        return F.greatest(F.lit(0), F.least(parts, first)).cast("int"), F.greatest(F.lit(-1), F.least(parts - 1, last)).cast("int")

    i0, i1 = bounds(q[0], q[2], ee[0], ee[2], alpha)
    j0, j1 = bounds(q[1], q[3], ee[1], ee[3], beta)
    run = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), j1 - j0 + 1))
    # A run over all 64 columns of a single row is the one that the shift cannot make.
    run = F.when(j1 - j0 + 1 >= 64, F.lit(-1).cast("long")).otherwise(run - 1)
    bits = F.lit(0).cast("long")
    for i in range(rows):
        bits = bits.bitwiseOR(F.when((i0 <= i) & (F.lit(i) <= i1), F.call_function("shiftleft", run, beta * i + j0)).otherwise(F.lit(0).cast("long")))
    return bits
