"""Readers of point files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "x double, y double"


def with_point_id(points: DataFrame) -> DataFrame:
    """Adds ``point_id``, unique but without gaps only within a file's part; rows have no order of their own."""
    return points.withColumn("point_id", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Lines ``x,y`` without a header. PERMISSIVE keeps the first two fields of longer lines."""
    return spark.read.schema(POINT).option("header", False).option("mode", mode).csv(path)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The data lines of an ARFF file with two numeric attributes."""
    line = F.trim("value")
    data = spark.read.text(path).where((line != "") & ~line.startswith("%") & ~line.startswith("@"))
    field = F.split(line, ",")
    return data.select(F.trim(field[0]).cast("double").alias("x"), F.trim(field[1]).cast("double").alias("y"))


def read_features(spark: SparkSession, path: str, features: list[int], label: int | None = None, sep: str = " ") -> DataFrame:
    """Chosen columns ``f0, f1, ...`` of a delimited file with ``#`` comments, and ``label``, cut to ten characters."""
    width = max([*features, -1 if label is None else label]) + 1
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("sep", sep).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(path)
    out = [F.col(f"c{i}").cast("double").alias(f"f{k}") for k, i in enumerate(features)]
    return raw.select(*out, *([] if label is None else [F.substring(f"c{label}", 1, 10).alias("label")]))


def check_size(points: DataFrame, groups: int, per_group: int = 500) -> DataFrame:
    """``points``, or an error unless there are ``per_group`` for each of the groups."""
    n = points.count()
    if n != groups * per_group:
        raise ValueError(f"{n} points are not {groups} groups of {per_group}")
    return points
