"""Vertical slabs: clustering in parts whose border components are joined afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tiles import half, slab
from tilewright.operators.clusters import contracted_components, local_components, ranked
from tilewright.operators.neighbors import edges


def split(tiles: DataFrame, width: int) -> DataFrame:
    return tiles.select("tx", "ty", slab(F.col("tx"), width).alias("slab"))


def split_dual(tiles: DataFrame) -> DataFrame:
    return tiles.select("tx", "ty", half(F.col("tx")).cast("long").alias("slab"))


def width_for(tiles: DataFrame, slabs: int) -> int:
    """Width that cuts the tiles' own extent into ``slabs``."""
    low, high = tiles.agg(F.min("tx"), F.max("tx")).first()
    return 1 if low is None else max(1, -(-(high - low + 1) // slabs))


def edge_flags(tiles: DataFrame, width: int) -> DataFrame:
    """``(slab, rx, ry, tiles, left_edge, right_edge)`` of each slab's own components."""
    local = local_components(split(tiles, width), "slab").withColumnRenamed("part", "slab")
    left, right = F.col("tx") == F.col("slab") * width, F.col("tx") == (F.col("slab") + 1) * width - 1
    return local.groupBy("slab", "rx", "ry").agg(F.count("*").alias("tiles"), F.bool_or(left).alias("left_edge"), F.bool_or(right).alias("right_edge"))


def border_edges(tiles: DataFrame, width: int) -> DataFrame:
    """Neighbouring tiles in different slabs; only border columns take part."""
    cut = split(tiles, width)
    rim = cut.where((F.pmod("tx", F.lit(width)) == 0) | (F.pmod("tx", F.lit(width)) == width - 1))
    return edges(rim.select("tx", "ty")).where(slab(F.col("tx"), width) != slab(F.col("nx"), width))


def clusters_slab(tiles: DataFrame, width: int, min_size: int) -> DataFrame:
    return ranked(contracted_components(split(tiles, width), "slab"), min_size)


def clusters_dual(tiles: DataFrame, min_size: int) -> DataFrame:
    return ranked(contracted_components(split_dual(tiles), "slab"), min_size)
