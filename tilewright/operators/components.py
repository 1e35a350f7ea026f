"""Connected components of an edge list, by alternating large-star and small-star rounds.

An edge list of a few thousand edges, whose number is counted first, takes one task instead of the rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): O(log^2 n) rounds, each a
pre-aggregated minimum per node and an equi-join. No node's neighbourhood is ever gathered: the
minimum has a map-side part, and the join on a hub is one that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.storage import discard, materialize, ship

#: Up to so many edges are joined in one task.
ONE_TASK_EDGES = 16_384


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # u > v holds on every edge
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def _state(e: DataFrame) -> tuple:
    """Count and order-free digest of the edge set."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(h)).first())


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node on an edge; root is the component's smallest node.

    Nulls: an edge with a null end is ignored. Self-loops keep their node as its own root. Repeated
    edges count once. Empty input gives an empty result. Ids may be of any orderable type.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    first = now = materialize(pairs, "edges")
    if _comparable(first.schema["u"].dataType) and first.count() <= ONE_TASK_EDGES:
        return _in_one_task(first)
    loops = first.where("u = v").select(F.col("u").alias("node"))
    now, seen = first.where("u != v"), None
    for _ in range(max_rounds):
        state = _state(now)
        if state == seen or state[0] == 0:
            break
        seen, before = state, now
        now = materialize(_small_star(_large_star(now)), "stars")
        discard(before)
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    lone = loops.join(found.select("node").unionByName(roots.select("node")), "node", "left_anti").withColumn("root", F.col("node"))
    return found.unionByName(roots).unionByName(lone)


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``rows``, distinct in ``order``, with their place in that order from ``start`` on as ``name``.

    A few thousand rows, counted first, are numbered in one task. More go to ranges; a row's place is that in its range after the sizes of the ranges before, so no task holds
    them all. Only the sizes are summed in one task.
    """
    rows = materialize(rows, "rows")
    if rows.count() <= ONE_TASK_EDGES:
        return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)).cast("long"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")  # range << 33 | place
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start)
    return placed.join(F.broadcast(sizes), "__range").select(*rows.columns, place.cast("long").alias(name))  # a row for each partition


def _comparable(kind: T.DataType) -> bool:
    """Are values of this type ordered in Python as they are in Spark?"""
    if isinstance(kind, T.StructType):
        return all(isinstance(f.dataType, T.IntegralType) for f in kind.fields)
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegralType)


def _in_one_task(edges: DataFrame) -> DataFrame:
    ship(edges.sparkSession)
    kind = edges.schema["u"].dataType

    def key(x):
        parts = x.values() if isinstance(x, dict) else x if isinstance(x, list) else (x,)
        return tuple((p is not None, p) for p in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, pairs, of = {}, [], None
        for batch in batches:
            of = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = key(u), key(v)
                value[a], value[b] = u, v
                pairs.append((a, b))
        parent = {x: x for x in value}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if value:
            yield pa.RecordBatch.from_arrays([pa.array(list(value.values()), of), pa.array([value[root(x)] for x in value], of)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
