"""Clusters of tiles: connected components of significant tiles under eight-neighbour contact.

Tiles are first joined within square blocks, each in one task and no larger than the square of its side,
whatever the data. What is left is the graph of block components that touch across a border, which is small
and goes through the distributed fixpoint. A table of few tiles is one block and needs no fixpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.components import connected_components, numbered
from tilewright.operators.neighbors import half_edges
from tilewright.operators.tiles import project, significant_tiles
from tilewright.storage import materialize, ship

#: Up to so many tiles are one block.
ONE_BLOCK_TILES = 250_000
#: Side of a block beyond that.
BLOCK_SIDE = 512

_LOCAL = "tx long, ty long, part long, rx long, ry long"


def union_find(tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """For each tile, the row of its component's smallest tile by (tx, ty). Tiles are distinct."""
    order = np.lexsort((ty, tx))
    xs, ys = tx[order].tolist(), ty[order].tolist()
    at = {t: i for i, t in enumerate(zip(xs, ys))}
    parent = list(range(len(xs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (x, y) in enumerate(zip(xs, ys)):
        for t in ((x, y + 1), (x + 1, y - 1), (x + 1, y), (x + 1, y + 1)):
            j = at.get(t)
            if j is not None:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    top = np.fromiter((root(i) for i in range(len(xs))), np.int64, len(xs))
    out = np.empty(len(xs), np.int64)
    out[order] = order[top]
    return out


def local_components(tiles: DataFrame, part: str) -> DataFrame:
    """``(tx, ty, part, rx, ry)``: the smallest tile of each tile's component within its part."""
    ship(tiles.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        tx, ty = np.asarray(table["tx"]), np.asarray(table["ty"])
        top = union_find(tx, ty)
        return pa.table({"tx": table["tx"], "ty": table["ty"], "part": table["part"], "rx": pa.array(tx[top]), "ry": pa.array(ty[top])})

    return tiles.select("tx", "ty", F.col(part).cast("long").alias("part")).groupBy("part").applyInArrow(run, _LOCAL)


def contracted_components(tiles: DataFrame, part: str) -> DataFrame:
    """``(tx, ty, rx, ry)`` from the components within parts and the contacts between parts."""
    local = materialize(local_components(tiles, part), "local")
    node = F.struct("part", "rx", "ry")
    near = half_edges(local.select("tx", "ty"))
    ends = local.select("tx", "ty", "part", node.alias("u"))
    far = local.select(F.col("tx").alias("nx"), F.col("ty").alias("ny"), F.col("part").alias("npart"), node.alias("v"))
    border = near.join(ends, ["tx", "ty"]).join(far, ["nx", "ny"]).where("part != npart").select("u", "v").distinct()
    roots = connected_components(border)
    merged = local.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    smallest = merged.groupBy("root").agg(F.min(F.struct("rx", "ry")).alias("r"))
    return merged.select("tx", "ty", "root").join(smallest, "root").select("tx", "ty", "r.rx", "r.ry")


def tile_components(tiles: DataFrame) -> DataFrame:
    """``(tx, ty, rx, ry)``: each distinct tile with its component's smallest tile by (tx, ty)."""
    side = F.lit(BLOCK_SIDE)
    block = F.struct(F.floor(F.col("tx") / side), F.floor(F.col("ty") / side))
    return contracted_components(tiles.withColumn("part", F.xxhash64(block)), "part")


def ranked(components: DataFrame, min_size: int) -> DataFrame:
    """``(label, tx, ty)`` of components with at least ``min_size`` tiles, labelled from 0 by their smallest tile."""
    components = materialize(components, "components")
    kept = components.groupBy("rx", "ry").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("rx", "ry")
    return components.join(numbered(kept, ["rx", "ry"], "label"), ["rx", "ry"]).select("label", "tx", "ty")


def _one_block(tiles: DataFrame, min_size: int) -> DataFrame:
    """What :func:`ranked` gives, for tiles that one task holds."""
    ship(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        tx, ty = np.asarray(table["tx"]), np.asarray(table["ty"])
        top = union_find(tx, ty)
        roots, of, size = np.unique(top, return_inverse=True, return_counts=True)
        order = np.lexsort((ty[roots], tx[roots]))
        label = np.full(len(roots), -1, np.int64)
        large = order[size[order] >= min_size]
        label[large] = np.arange(len(large))
        keep = label[of] >= 0
        yield pa.RecordBatch.from_arrays([pa.array(label[of][keep]), pa.array(tx[keep]), pa.array(ty[keep])], ["label", "tx", "ty"])

    return tiles.coalesce(1).mapInArrow(run, "label long, tx long, ty long")


def cluster_tiles(tiles: DataFrame, min_size: int) -> DataFrame:
    """``(label, tx, ty)`` from a table of distinct tiles, which is not changed."""
    tiles = materialize(tiles.select("tx", "ty"), "tiles")
    if tiles.count() <= ONE_BLOCK_TILES:
        return _one_block(tiles, min_size)
    return ranked(tile_components(tiles), min_size)


def clusters(points: DataFrame, precision: float, threshold: int, min_size: int, on_invalid: str = "error") -> DataFrame:
    return cluster_tiles(significant_tiles(points, precision, threshold, on_invalid), min_size)


def label_points(points: DataFrame, labels: DataFrame, precision: float, on_invalid: str = "error") -> DataFrame:
    """``points`` with ``label``, -1 for noise. AQE broadcasts the labels where they are small."""
    return project(points, precision, on_invalid).join(labels, ["tx", "ty"], "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long"))).drop("tx", "ty")


def cluster_points(points: DataFrame, precision: float, threshold: int, min_size: int, on_invalid: str = "error") -> DataFrame:
    """``(label, tx, ty, ...)``: the points of each cluster, flat."""
    found = clusters(points, precision, threshold, min_size, on_invalid)
    return project(points, precision, on_invalid).join(found, ["tx", "ty"]).select("label", "tx", "ty", *points.columns)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("tiles"))


def cluster_count(labels: DataFrame) -> DataFrame:
    return labels.where("label >= 0").agg(F.count_distinct("label").alias("clusters"))


def noise_tiles(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles in no cluster."""
    return tiles.join(labels, ["tx", "ty"], "left_anti").select("tx", "ty")
