"""Power iteration on the k-NN graph, after Lin and Cohen, "Power Iteration Clustering" (2010).

Nodes are numbered by x, so a block of numbers is a strip of the plane and few edges leave it. A block's edges are packed
once; a round multiplies every block by its own part of the vector and by the few numbers that other blocks send it, and
writes the blocks anew. No round shuffles edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import metrics
from tilewright.operators.components import numbered
from tilewright.storage import discard, materialize, ship

#: Nodes of a block: at least BLOCK, and so many times the root of all, as a strip's edge grows with that root.
BLOCK, BLOCK_ROOTS = 32_768, 32
#: Numbers sent in a round, at most, that are broadcast; more are joined by a shuffle.
BROADCAST_NUMBERS = 2_000_000

_BLOCK = "block long, ends binary, cols binary, sends array<struct<to:long,at:binary>>, v binary, was binary"


def _packed(edges: DataFrame, start: DataFrame, size: int) -> DataFrame:
    """Blocks of ``_BLOCK`` from edges (block, a, b), each in the blocks of both ends, and (block, at, v).

    ``ends`` has where a node's entries end in ``cols``, the places of its neighbours: first the block's nodes, then those
    of other blocks by number. An edge is an entry at either end, so one told by both ends weighs twice that of one.
    """

    def pack(key: tuple, e: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({c: [] for c in ("block", "ends", "cols", "sends", "v", "was")})
        nodes = nodes.sort_values("at")
        low, n = key[0] * size, len(nodes)
        a, b = (e[c].to_numpy(dtype=np.int64) - low for c in "ab")
        mine, theirs = (a >= 0) & (a < n), (b >= 0) & (b < n)
        i, j = np.concatenate([a[mine], b[theirs]]), np.concatenate([b[mine], a[theirs]])
        outside = (j < 0) | (j >= n)
        halo, place = np.unique(j[outside], return_inverse=True)
        to = (j[outside] + low) // size
        sends = [{"to": int(t), "at": np.unique(i[outside][to == t]).astype(np.int32).tobytes()} for t in np.unique(to)]
        j[outside] = n + place
        ends = np.cumsum(np.bincount(i, minlength=n))
        cols = j[np.argsort(i, kind="stable")].astype(np.int32)
        v = nodes.v.to_numpy(dtype=np.float64).tobytes()
        return pd.DataFrame({"block": [key[0]], "ends": [ends.tobytes()], "cols": [cols.tobytes()], "sends": [sends], "v": [v], "was": [v]})

    return edges.groupBy("block").cogroup(start.groupBy("block")).applyInPandas(pack, _BLOCK)


def _sent(blocks: DataFrame) -> DataFrame:
    """``(block, heard)``: what a block hears, in the order of the numbers of the senders' nodes."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = [np.frombuffer(v)[np.frombuffer(at, np.int32)].tobytes() for v, at in zip(f.v, f["at"])]
            yield pd.DataFrame({"block": f["to"], "sender": f.block, "told": told})

    each = blocks.select("block", "v", F.explode("sends").alias("s")).select("block", "v", "s.*").mapInPandas(send, "block long, sender long, told binary")
    return each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("sender", "told"))).alias("heard")).select("block", F.col("heard.told").alias("heard"))


def _multiplied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        new = []
        for ends, cols, v, heard in zip(f.ends, f.cols, f.v, f.heard):
            ends, cols = np.frombuffer(ends, np.int64), np.frombuffer(cols, np.int32)
            all_ = np.frombuffer(b"".join([v, *(heard if heard is not None else [])]))
            many = np.diff(ends, prepend=0)
            total = np.bincount(np.repeat(np.arange(len(ends)), many), weights=all_[cols], minlength=len(ends))
            new.append((total / np.maximum(many, 1)).tobytes())
        sends = [[{"to": int(s["to"]), "at": bytes(s["at"])} for s in x] for x in f.sends]
        yield f.assign(was=f.v, v=new, sends=sends)[["block", "ends", "cols", "sends", "v", "was"]]


def _sum(blocks: DataFrame, of) -> float:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"block": f.block, "s": [float(of(np.frombuffer(v), np.frombuffer(was))) for v, was in zip(f.v, f.was)]})

    return float(np.sum([r["s"] for r in blocks.select("block", "v", "was").mapInPandas(run, "block long, s double").orderBy("block").collect()]))


def embedded(points: DataFrame, neighbors: int, rounds: int = 20) -> DataFrame:
    """``(point_id, v)``: the vector after ``rounds`` rounds, or as many as it takes for the change of a round to
    stay the same; nothing for points without neighbours. It starts at a normal number drawn from the id's hash. An edge's
    weight is a half for each end that has the other among its nearest."""
    spark = points.sparkSession
    ship(spark)
    u = [(F.xxhash64("point_id", F.lit(i)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53)) for i in (0, 1)]
    drawn = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1])
    nodes = materialize(numbered(metrics.finite(points, "point_id"), ["x", "y", "point_id"], "at"), "nodes")
    n = nodes.count()
    size = max(BLOCK, int(BLOCK_ROOTS * sqrt(n)))
    block = lambda c: F.expr(f"{c} div {size}")
    edges = materialize(metrics.neighbor_lists(nodes, neighbors, "at").select("at", F.transform("near", lambda x: x["at"]).alias("near")), "edges")
    each = edges.select(F.col("at").alias("a"), F.explode("near").alias("b"))
    both = each.select(F.explode(F.array_distinct(F.array(block("a"), block("b")))).alias("block"), "a", "b")
    now = materialize(_packed(both, nodes.select(block("at").alias("block"), "at", drawn.alias("v")), size), "blocks")
    tolerance, before, norm = max(1e-5 / max(1, n), 1e-8), None, _sum(now, lambda v, _: np.abs(v).sum()) or 1.0
    few = (now.agg(F.sum(F.expr("aggregate(sends, 0L, (n, s) -> n + octet_length(s.at) div 4)"))).first()[0] or 0) <= BROADCAST_NUMBERS
    for _ in range(rounds):
        heard = _sent(now)
        last, now = now, materialize(now.join(F.broadcast(heard) if few else heard, "block", "left").mapInPandas(_multiplied, _BLOCK), "blocks")
        discard(last)
        new = _sum(now, lambda v, _: np.abs(v).sum()) or 1.0
        change = _sum(now, lambda v, was: np.abs(v / new - was / norm).sum())
        norm = new
        if before is not None and abs(change - before) <= tolerance:
            break
        before = change

    def flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b, ends, v in zip(f.block, f.ends, f.v):
                on = np.flatnonzero(np.diff(np.frombuffer(ends, np.int64), prepend=0))
                yield pd.DataFrame({"at": b * size + on, "v": np.frombuffer(v)[on] / norm})

    return nodes.join(now.select("block", "ends", "v").mapInPandas(flat, "at long, v double"), "at").select("point_id", "v")
