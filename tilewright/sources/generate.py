"""Synthetic points. All are deterministic in their seed; rows are made by the executors."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_PER_GROUP = 500
#: Least distance of two centres on either axis, and the spread around a centre.
LEAST_GAP, SPREAD = 0.0050, 0.0010


def _around(centres: DataFrame, spread: float, seed: int) -> DataFrame:
    points = centres.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(POINTS_PER_GROUP))))
    # a point's own reach is uniform below a uniform bound, so groups are dense in the middle
    points = points.withColumn("reach", F.rand(seed + 1) * F.rand(seed + 2) * F.lit(spread))
    x, y = (F.col(c) + (F.rand(seed + k) * 2 - 1) * F.col("reach") for c, k in (("x", 3), ("y", 4)))
    return points.select(x.alias("x"), y.alias("y"), "group").orderBy(F.rand(seed + 5))


def grouped(spark: SparkSession, groups: int, seed: int = 0, spread: float = SPREAD) -> DataFrame:
    """``(x, y, group)``: groups of 500 around random centres that are far enough from each other on both axes.

    The centres are drawn by the driver, one after another, since each depends on those before it. An axis has room
    for so many only; for more than half of it use :func:`on_grid`.
    """
    if groups > 90 / LEAST_GAP:
        raise ValueError(f"no room for {groups} groups, {90 / LEAST_GAP:.0f} at most")
    rng = random.Random(seed)
    cells: dict[tuple[str, int], list[float]] = {}

    def clear(axis: str, v: float) -> bool:
        k = int(v // LEAST_GAP)
        return all(abs(v - w) > LEAST_GAP for j in (k - 1, k, k + 1) for w in cells.get((axis, j), ()))

    centres = []
    while len(centres) < groups:
        x, y = rng.uniform(-180, 180), rng.uniform(-90, 90)
        if clear("x", x) and clear("y", y):
            for axis, v in (("x", x), ("y", y)):
                cells.setdefault((axis, int(v // LEAST_GAP)), []).append(v)
            centres.append((x, y, len(centres)))
    return _around(spark.createDataFrame(centres, "x double, y double, group int"), spread, seed)


def on_grid(spark: SparkSession, groups: int, seed: int = 0, spread: float = SPREAD) -> DataFrame:
    """``(x, y, group)``: groups of 500 around distinct corners of a grid of 0.1 degrees over the globe."""
    cells = spark.range(3600 * 1800).orderBy(F.rand(seed), "id").limit(groups)
    corner = cells.select((F.floor(F.col("id") / 1800) / 10.0 - 180).alias("x"), (F.col("id") % 1800 / 10.0 - 90).alias("y"), F.col("id").alias("group"))
    return _around(corner, spread, seed)


def toy(spark: SparkSession, kind: str, n: int = 1500, seed: int = 0) -> DataFrame:
    """``(point_id, x, y, truth)``: circles, moons, blobs, varied, aniso or uniform."""
    base = spark.range(n).withColumnRenamed("id", "point_id")
    u, a, b = F.rand(seed + 1), F.randn(seed + 2), F.randn(seed + 3)
    i = F.col("point_id")
    if kind in ("circles", "moons"):
        base = base.withColumn("truth", (i % 2).cast("int")).withColumn("t", u * (2 * 3.141592653589793 if kind == "circles" else 3.141592653589793))
        if kind == "circles":
            r = F.when(F.col("truth") == 0, 1.0).otherwise(0.5)
            x, y = r * F.cos("t"), r * F.sin("t")
        else:
            x = F.when(F.col("truth") == 0, F.cos("t")).otherwise(1 - F.cos("t"))
            y = F.when(F.col("truth") == 0, F.sin("t")).otherwise(0.5 - F.sin("t"))
        return base.select("point_id", (x + 0.05 * a).alias("x"), (y + 0.05 * b).alias("y"), "truth")
    if kind == "uniform":
        return base.select("point_id", u.alias("x"), F.rand(seed + 4).alias("y"), F.lit(None).cast("int").alias("truth"))
    if kind not in ("blobs", "varied", "aniso"):
        raise ValueError(f"unknown kind {kind!r}")
    rng = random.Random(seed)
    centres = [(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(3)]
    truth = (i % 3).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), truth)
    sd = pick((1.0, 2.5, 0.5) if kind == "varied" else (1.0, 1.0, 1.0))
    x, y = pick([c[0] for c in centres]) + sd * a, pick([c[1] for c in centres]) + sd * b
    out = base.select("point_id", x.alias("x"), y.alias("y"), truth.alias("truth"))
    if kind == "aniso":
        from tilewright.operators.metrics import linear_transform

        out = linear_transform(out, [[0.6, -0.6], [-0.4, 0.8]])
    return out
