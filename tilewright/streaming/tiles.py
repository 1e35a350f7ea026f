"""Tile counts over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tilewright.operators.tiles import tile_counts


def running_tile_counts(points: DataFrame, precision: float) -> DataFrame:
    """Counts over a streaming ``points``, for output mode complete or update: the batch plan as it is."""
    return tile_counts(points, precision, on_invalid="drop")
