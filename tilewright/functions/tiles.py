"""Column expressions of the tile grid. Everything here stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four neighbours that come later in (tx, ty) order; with their reverses they are all eight.
HALF_MOORE = ((0, 1), (1, -1), (1, 0), (1, 1))


def scale_factor(precision: float) -> float:
    """Tiles per unit: ten to the precision, which may be a fraction or negative."""
    return 10.0**precision


def tile(value: Column, scalar: float, on_invalid: str = "error") -> Column:
    """Tile number of a coordinate: value times scalar, truncated towards zero.

    NaN and what no BIGINT holds raise with "error" and are null with "null".
    """
    scaled = value.cast("double") * F.lit(float(scalar))
    if on_invalid == "error":
        return scaled.cast("bigint")
    if on_invalid == "null":
        return scaled.try_cast("bigint")
    raise ValueError(f"on_invalid is 'error' or 'null', not {on_invalid!r}")


def descaled(number: Column, scalar: float) -> Column:
    return number / F.lit(float(scalar))


def unit(value: Column, intervals: int) -> Column:
    """Interval of a coordinate among ``intervals`` per unit length; coordinates count modulo one."""
    n = F.lit(float(intervals))
    return F.floor(F.pmod(value.cast("double") * n, n)).cast("int")


def slab(tx: Column, width: int) -> Column:
    """Vertical slab of a tile, ``width`` tiles wide, over any domain."""
    return F.floor(tx / F.lit(width)).cast("bigint")


def half(tx: Column) -> Column:
    """Slab 0 left of the y axis, else 1."""
    return F.when(tx < 0, 0).otherwise(1)
