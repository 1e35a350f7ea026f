"""Adjacency as an equi-join on shifted coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tiles import HALF_MOORE


def half_edges(tiles: DataFrame) -> DataFrame:
    """``(tx, ty, nx, ny)``, each pair of neighbouring tiles once, the smaller first."""
    moved = F.explode(F.array(*[F.struct((F.col("tx") + dx).alias("nx"), (F.col("ty") + dy).alias("ny")) for dx, dy in HALF_MOORE]))
    shifted = tiles.select("tx", "ty", moved.alias("to")).select("tx", "ty", "to.nx", "to.ny")
    return shifted.join(tiles.select(F.col("tx").alias("nx"), F.col("ty").alias("ny")), ["nx", "ny"], "left_semi").select("tx", "ty", "nx", "ny")


def edges(tiles: DataFrame) -> DataFrame:
    """``(tx, ty, nx, ny)`` for both directions of all eight neighbours."""
    one = half_edges(tiles)
    return one.unionByName(one.select(F.col("nx").alias("tx"), F.col("ny").alias("ty"), F.col("tx").alias("nx"), F.col("ty").alias("ny")))
