"""Estimators: ``fit`` finds clusters, ``transform`` labels points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tiles import scale_factor
from tilewright.operators import clique
from tilewright.operators.clusters import clusters, label_points
from tilewright.storage import materialize


@dataclass
class TileModel:
    precision: float
    labels: DataFrame
    on_invalid: str = "error"

    @property
    def scalar(self) -> float:
        return scale_factor(self.precision)

    def transform(self, points: DataFrame) -> DataFrame:
        return label_points(points, self.labels, self.precision, self.on_invalid)


@dataclass
class TileClusterer:
    """Contraction clustering of points (x, y); other columns, classes and weights are not used in fitting."""

    precision: float = 1.0
    threshold: int = 1
    min_size: int = 1
    on_invalid: str = "error"

    def fit(self, points: DataFrame) -> TileModel:
        found = clusters(points, self.precision, self.threshold, self.min_size, self.on_invalid)
        return TileModel(self.precision, materialize(found, "labels"), self.on_invalid)

    def fit_transform(self, points: DataFrame) -> DataFrame:
        return self.fit(points).transform(points)


@dataclass
class SubspaceModel:
    columns: list[str]
    intervals: int
    clusters: DataFrame

    def transform(self, points: DataFrame) -> DataFrame:
        """``points`` with ``label``, from 0 among the clusters of all dimensions; -1 for points in none."""
        whole = self.clusters.where(F.size("dims") == len(self.columns))
        first = whole.agg(F.min("cluster_id")).first()[0] or 0
        vectors = clique.unit_vectors(points, self.columns, self.intervals)
        member = vectors.join(whole.select("cluster_id", F.col("units").alias("u")), "u").select("point_id", (F.col("cluster_id") - first).cast("long").alias("label"))
        return points.join(member, "point_id", "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))


@dataclass
class SubspaceClusterer:
    """Subspace clustering of the named columns of points with a ``point_id``."""

    columns: list[str]
    intervals: int = 3
    tau: float = 0.1

    def fit(self, points: DataFrame) -> SubspaceModel:
        return SubspaceModel(self.columns, self.intervals, materialize(clique.run(points, self.columns, self.intervals, self.tau), "subspaces"))

    def fit_transform(self, points: DataFrame) -> DataFrame:
        return self.fit(points).transform(points)
