"""Projection of points onto tiles and the aggregations over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tiles import descaled, scale_factor, tile


def project(points: DataFrame, precision: float, on_invalid: str = "error") -> DataFrame:
    """``points`` with the tile of each; with on_invalid="drop" points without one go."""
    scalar = scale_factor(precision)
    mode = "null" if on_invalid == "drop" else on_invalid
    out = points.withColumn("tx", tile(F.col("x"), scalar, mode)).withColumn("ty", tile(F.col("y"), scalar, mode))
    return out.where("tx is not null and ty is not null") if on_invalid == "drop" else out


def tile_counts(points: DataFrame, precision: float, on_invalid: str = "error") -> DataFrame:
    """``(tx, ty, n)``: partial and final hash aggregation; only the tiles are shuffled."""
    return project(points.select("x", "y"), precision, on_invalid).groupBy("tx", "ty").agg(F.count("*").alias("n"))


def significant_tile_counts(points: DataFrame, precision: float, threshold: int, on_invalid: str = "error") -> DataFrame:
    return tile_counts(points, precision, on_invalid).where(F.col("n") >= threshold)


def significant_tiles(points: DataFrame, precision: float, threshold: int, on_invalid: str = "error") -> DataFrame:
    return significant_tile_counts(points, precision, threshold, on_invalid).select("tx", "ty")


def significant_points(points: DataFrame, precision: float, threshold: int, on_invalid: str = "error") -> DataFrame:
    """Points in significant tiles, with their tiles: a semi-join, so no tile's points are gathered."""
    return project(points, precision, on_invalid).join(significant_tiles(points, precision, threshold, on_invalid), ["tx", "ty"], "left_semi")


def nested(points: DataFrame, *keys: str) -> DataFrame:
    """Tile or cluster with its points in one array, ordered; for results known to be small."""
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))


def descale(tiles: DataFrame, precision: float) -> DataFrame:
    s = scale_factor(precision)
    return tiles.withColumn("x", descaled(F.col("tx"), s)).withColumn("y", descaled(F.col("ty"), s)).drop("tx", "ty")
