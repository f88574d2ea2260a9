"""Numbers of quadtree cells in depth-first order, as arithmetic on columns.

The children of a cell are numbered 0 (lower left), 1 (lower right), 2 (upper left), 3 (upper right).
A subtree is the code range [code, code + subtree size).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtree_size(level: int, levels: int) -> int:
    return (4 ** (levels - level + 1) - 1) // 3


def subtree_size_of(level: Column, levels: int) -> Column:
    return ((F.pow(F.lit(4.0), F.lit(levels + 1) - level) - 1) / 3).cast("long")


def encode(levels: int, level: Column | None = None, ix: Column | None = None, iy: Column | None = None) -> Column:
    """The code of a cell; by default of the columns level, ix and iy."""
    level, ix, iy = (F.col(n) if c is None else c for n, c in (("level", level), ("ix", ix), ("iy", iy)))
    code = F.lit(0).cast("long")
    for i in range(1, levels + 1):
        bit = lambda v: F.call_function("shiftright", v, level - i).bitwiseAND(F.lit(1))  # noqa: B023, E731
        code = code + F.when(level >= i, 1 + (bit(ix) + 2 * bit(iy)) * subtree_size(i, levels)).otherwise(0)
    return code.cast("long")


def decode(levels: int, code: str = "quad_code") -> Column:
    """struct(level, ix, iy) of a code, null for codes that no cell has."""
    start = f"named_struct('rest', CAST({code} AS BIGINT), 'level', 0, 'ix', 0L, 'iy', 0L)"
    for i in range(1, levels + 1):
        size = subtree_size(i, levels)
        start = (
            f"transform(array({start}), s -> IF(s.rest > 0, named_struct('rest', (s.rest - 1) % {size}L, 'level', s.level + 1,"
            f" 'ix', s.ix * 2 + ((s.rest - 1) div {size}L) % 2, 'iy', s.iy * 2 + ((s.rest - 1) div {size}L) div 2), s))[0]"
        )
    return F.expr(f"CASE WHEN {code} >= 0 AND {code} < {subtree_size(0, levels)}L THEN transform(array({start}), s -> named_struct('level', s.level, 'ix', s.ix, 'iy', s.iy))[0] END")


def leaf_range(levels: int, code: Column, level: Column) -> tuple[Column, Column]:
    """From the first leaf of a subtree to behind its last; the cell itself and its left spine lie outside."""
    return code + (F.lit(levels) - level), code + subtree_size_of(level, levels)
