"""Bottom-up subspace clustering over grid units.

A unit is a set of dimensions with an interval in each; it is dense if more than ``tau`` of all points lie in
it. Dense units of k dimensions are sought among those whose every (k-1)-dimensional face is dense. Clusters
are the connected components of dense units of the same dimensions that share a face.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.tiles import unit
from tilewright.operators.components import connected_components, numbered
from tilewright.operators.metrics import validity_scores
from tilewright.storage import materialize

_FACE = "dims", "units"


def unit_vectors(points: DataFrame, columns: list[str], intervals: int) -> DataFrame:
    """``(point_id, u)``: the interval of each point in every dimension."""
    return points.select("point_id", F.array(*[unit(F.col(c), intervals) for c in columns]).alias("u"))


def units_1d(vectors: DataFrame) -> DataFrame:
    return vectors.select("point_id", F.posexplode("u").alias("dim", "unit"))


def dense_1d(vectors: DataFrame, tau: float, n: int) -> DataFrame:
    """``(dims, units, n)`` of dense intervals."""
    counted = units_1d(vectors).groupBy("dim", "unit").agg(F.count("*").alias("n")).where(F.col("n") > tau * n)
    return counted.select(F.array("dim").alias("dims"), F.array("unit").alias("units"), "n")


def candidates(dense: DataFrame, k: int) -> DataFrame:
    """Units of k dimensions that join two dense ones alike but in the last dimension: an equi-join."""
    a = dense.select(F.slice("dims", 1, k - 2).alias("d"), F.slice("units", 1, k - 2).alias("u"), F.get("dims", F.lit(k - 2)).alias("ad"), F.get("units", F.lit(k - 2)).alias("au"))
    b = a.select("d", "u", F.col("ad").alias("bd"), F.col("au").alias("bu"))
    joined = a.join(b, ["d", "u"]).where("ad < bd")
    return joined.select(F.concat("d", F.array("ad", "bd")).alias("dims"), F.concat("u", F.array("au", "bu")).alias("units"))


def pruned(found: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Candidates all of whose faces are dense."""
    def without(c: str, i: int):
        return F.concat(F.slice(c, 1, i), F.slice(c, i + 2, k))

    faces = F.explode(F.array(*[F.struct(without("dims", i).alias("fd"), without("units", i).alias("fu")) for i in range(k)]))
    each = found.select("dims", "units", faces.alias("f")).select("dims", "units", F.col("f.fd").alias("fd"), F.col("f.fu").alias("fu"))
    known = dense.select(F.col("dims").alias("fd"), F.col("units").alias("fu"))
    return each.join(known, ["fd", "fu"], "left_semi").groupBy("dims", "units").agg(F.count("*").alias("k")).where(F.col("k") == k).select("dims", "units")


def dense_units(vectors: DataFrame, among: DataFrame, tau: float, n: int, dims: int, k: int) -> DataFrame:
    """Dense ones of the units ``among``, counting each point once for each set of k of ``dims`` dimensions."""
    sets = [list(c) for c in combinations(range(dims), k)]
    keys = F.explode(F.array(*[F.struct(F.array(*[F.lit(i) for i in c]).alias("dims"), F.array(*[F.get("u", F.lit(i)) for i in c]).alias("units")) for c in sets]))
    counted = vectors.select(keys.alias("key")).groupBy("key.dims", "key.units").agg(F.count("*").alias("n")).where(F.col("n") > tau * n)
    return counted.join(among, list(_FACE), "left_semi")


def face_edges(units: DataFrame, k: int) -> DataFrame:
    """``(u, v)``: dense units that differ by one interval in one dimension."""
    def raised(i: int):
        return F.transform("units", lambda x, j: x + F.when(j == i, 1).otherwise(0))

    up = [raised(i) for i in range(k)]
    moved = units.select(F.struct(*_FACE).alias("u"), F.explode(F.array(*[F.struct("dims", c.alias("units")) for c in up])).alias("v"))
    return moved.join(units.select(F.struct(*_FACE).alias("v")), "v", "left_semi").select("u", "v")


def clusters_of(units: DataFrame, k: int) -> DataFrame:
    """``(root, dims, units)``: dense units with the smallest of their component."""
    units = units.select(*_FACE)
    found = connected_components(face_edges(units, k))
    out = units.withColumn("node", F.struct(*_FACE)).join(found, "node", "left")
    return out.select(F.coalesce("root", "node").alias("root"), *_FACE)


def run(points: DataFrame, columns: list[str], intervals: int, tau: float) -> DataFrame:
    """``(cluster_id, dims, units)`` over all levels; ids from 1 by dimensions, then the smallest unit."""
    vectors = unit_vectors(points, columns, intervals)
    n = vectors.count()
    dense = materialize(dense_1d(vectors, tau, n), "dense")
    levels = []
    for k in range(1, len(columns) + 1):
        if dense.isEmpty():
            break
        levels.append(clusters_of(dense, k))
        if k < len(columns):
            among = pruned(candidates(dense, k + 1), dense, k + 1)
            dense = materialize(dense_units(vectors, among, tau, n, len(columns), k + 1), "dense")
    if not levels:
        return points.sparkSession.createDataFrame([], "cluster_id int, dims array<int>, units array<int>")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = materialize(out, "subspaces")
    roots = out.select("root").distinct().withColumn("k", F.size("root.dims"))
    ids = numbered(roots, ["k", "root"], "cluster_id", 1).withColumn("cluster_id", F.col("cluster_id").cast("int"))
    return out.join(ids, "root").select("cluster_id", *_FACE)


def cluster_points(vectors: DataFrame, found: DataFrame, dims: int) -> DataFrame:
    """``(cluster_id, point_id)``: points in any of a cluster's units."""
    sets = [list(c) for k in range(1, dims + 1) for c in combinations(range(dims), k)]
    keys = F.explode(F.array(*[F.struct(F.array(*[F.lit(i) for i in c]).alias("dims"), F.array(*[F.get("u", F.lit(i)) for i in c]).alias("units")) for c in sets]))
    return vectors.select("point_id", keys.alias("key")).select("point_id", "key.*").join(found, list(_FACE)).select("cluster_id", "point_id")


def scores_by_dimensions(truth: DataFrame, found: DataFrame, members: DataFrame, dims: int) -> DataFrame:
    """``(k, ari, homogeneity, completeness, v_measure, fmi)``: validity of the clusters of k dimensions, for every k.

    ``truth``: point_id, truth. A point in several clusters of a level is in the one of the smallest id, a point in none is
    in a class of its own, 0. Levels without clusters are scored too.
    """
    out = None
    for k in range(1, dims + 1):
        level = found.where(F.size("dims") == k).select("cluster_id").distinct()
        own = members.join(level, "cluster_id").groupBy("point_id").agg(F.min("cluster_id").alias("cluster"))
        scored = truth.join(own, "point_id", "left").select("truth", F.coalesce("cluster", F.lit(0)).alias("cluster"))
        one = validity_scores(scored).select(F.lit(k).alias("k"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def describe(found: DataFrame, members: DataFrame, with_points: bool = False) -> DataFrame:
    """One text line for each cluster: units, dimensions, size and, if asked for, the ids of its points in order, which one task gathers."""
    more = [F.array_sort(F.collect_list("point_id")).alias("points")] if with_points else []
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_points"), *more)
    units = found.groupBy("cluster_id").agg(F.array_sort(F.collect_list("units")).alias("units"), F.first("dims").alias("dims"))
    line = F.format_string("Cluster %d: dimensions %s, dense units %s, %d points", "cluster_id", F.to_json("dims"), F.to_json("units"), F.coalesce("n_points", F.lit(0)))
    return units.join(sizes, "cluster_id", "left").select((F.concat(line, F.lit(" "), F.to_json("points")) if with_points else line).alias("value"))
