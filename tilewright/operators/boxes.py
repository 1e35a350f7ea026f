"""Rows of the plane in boxes of near ones, so that a box is compared with the boxes it can need and no others.

Rows are dealt by ranges of x into strips and each strip is cut by y. Bounds of a box come from its rows, so where the
cuts fall bears on the cost only. Squared distances are taken as dx * dx + dy * dy everywhere; rounding keeps order, so the
least and the greatest between two boxes bound all those between their rows, to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.storage import materialize, ship

#: Rows of a box, and boxes at most: beyond BOX_ROWS * MOST_BOXES rows, boxes are larger. Their bounds go to all tasks.
BOX_ROWS, MOST_BOXES = 256, 65_536
#: A task has the boxes of so many neighbouring strips, and as many of each.
SIDE = 8


@dataclass(frozen=True)
class Bounds:
    """Ends and weights of all boxes, in the order of their numbers."""

    box: np.ndarray
    lx: np.ndarray
    hx: np.ndarray
    ly: np.ndarray
    hy: np.ndarray
    weight: np.ndarray

    def spans(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of box ``q`` (a place) to every box."""
        gx = np.maximum(0.0, np.maximum(self.lx - self.hx[q], self.lx[q] - self.hx))
        gy = np.maximum(0.0, np.maximum(self.ly - self.hy[q], self.ly[q] - self.hy))
        sx = np.maximum(self.hx - self.lx[q], self.hx[q] - self.lx)
        sy = np.maximum(self.hy - self.ly[q], self.hy[q] - self.ly)
        return gx * gx + gy * gy, sx * sx + sy * sy

    def needed(self, q: int, k: int) -> tuple[int, np.ndarray]:
        """For the ``k``-th smallest distance of each row of box ``q``: the weight that certainly lies nearer, and the
        places of the boxes that may hold it. ``k`` is at most the weight of all."""
        least, most = self.spans(q)

        def reach(d: np.ndarray) -> float:
            order = np.argsort(d)
            return d[order[np.searchsorted(np.cumsum(self.weight[order]), k)]]

        low, high = reach(least), reach(most)
        inside = most < low
        return int(self.weight[inside].sum()), np.flatnonzero(~inside & (least <= high))

    def within(self, q: int, k: int) -> np.ndarray:
        """Places of the boxes that may hold any of the ``k`` nearest of a row of box ``q``."""
        least, most = self.spans(q)
        order = np.argsort(most)
        return np.flatnonzero(least <= most[order[min(len(order) - 1, np.searchsorted(np.cumsum(self.weight[order]), k))]])


def boxed(rows: DataFrame) -> DataFrame:
    """``rows`` (x, y, ...), finite ones, with ``box``. Rows of one place share a box."""
    ship(rows.sparkSession)
    rows = materialize(rows, "places")
    n = rows.count()
    size = max(BOX_ROWS, -(-n // MOST_BOXES))
    schema = T.StructType([*rows.schema.fields, T.StructField("box", T.LongType())])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            strip = pd.concat(held).sort_values(["y", "x"], kind="stable", ignore_index=True)
            new = (strip.x.ne(strip.x.shift()) | strip.y.ne(strip.y.shift())).to_numpy()
            first = np.maximum.accumulate(np.where(new, np.arange(len(strip)), 0))
            yield strip.assign(box=(np.int64(TaskContext.get().partitionId()) << 32) + first // size)

    strips = max(1, ceil(sqrt(n / size)))
    return materialize(rows.repartitionByRange(strips, "x", "y").mapInPandas(cut, schema), "boxes")


def bounds(cut: DataFrame, weight: str | None = None) -> Bounds:
    """The ends of all boxes: MOST_BOXES rows or not many more, the only ones that reach the driver."""
    of = F.sum(weight) if weight else F.count("*")
    rows = cut.groupBy("box").agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"), of.alias("weight")).orderBy("box").toPandas()
    return Bounds(*[rows[c].to_numpy() for c in ("box", "lx", "hx", "ly", "hy", "weight")])


def _group(box):
    return ((box >> 32) // SIDE << 32) + (box & 0xFFFFFFFF) // SIDE


def against_needed(cut: DataFrame, ends: Bounds, needs: Callable[[Bounds, int], np.ndarray], fn: Callable[[Bounds, int, dict], pd.DataFrame], schema: str) -> DataFrame:
    """``fn(bounds, place, rows)`` for every box, where ``rows`` has a frame of rows for its own place and for each place
    that ``needs`` names. A task has some neighbouring boxes and the rows that any of them needs."""
    spark = cut.sparkSession
    shared = spark.sparkContext.broadcast(ends)
    groups = len(np.unique(_group(ends.box)))

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = shared.value
        for f in frames:
            parts = []
            for group, places in f.groupby(_group(all_.box[f.id.to_numpy()])):
                held = np.unique(np.concatenate([np.append(needs(all_, q), q) for q in places.id]))
                parts.append(pd.DataFrame({"group": group, "box": all_.box[held]}))
            yield pd.concat(parts).drop_duplicates()

    tasks = max(1, min(groups, 2000))
    need = spark.range(0, len(ends.box), numPartitions=min(tasks, 64)).mapInPandas(name, "group long, box long").distinct()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        all_ = shared.value
        held = {int(np.searchsorted(all_.box, box)): part for box, part in rows.groupby("box")}
        out = [fn(all_, q, held) for q in held if _group(all_.box[q]) == key[0]]
        return pd.concat(out)

    return cut.join(need, "box").repartition(tasks, "group").groupBy("group").applyInPandas(run, schema)
