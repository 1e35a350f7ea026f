"""Other clusterings for comparison, on (point_id, x, y)."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import power
from tilewright.operators.components import connected_components, numbered
from tilewright.operators.metrics import knn
from tilewright.storage import discard, materialize


def _fitted(model, points: DataFrame) -> DataFrame:
    data = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(points)
    return model.fit(data).transform(data).select(*points.columns, F.col("prediction").cast("long").alias("label"))


def kmeans(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return _fitted(KMeans(k=k, seed=seed), points)


def hierarchical(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Divisive, where others merge: the nearest that scales."""
    return _fitted(BisectingKMeans(k=k, seed=seed), points)


def gaussian_mixture(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return _fitted(GaussianMixture(k=k, seed=seed), points)


def spectral(points: DataFrame, k: int, neighbors: int = 10) -> DataFrame:
    """Power iteration on the k-NN graph, and k-means of its vector; null for points without neighbours."""
    vector = materialize(power.embedded(points, neighbors), "vector")
    if vector.isEmpty():
        return points.withColumn("label", F.lit(None).cast("long"))
    data = VectorAssembler(inputCols=["v"], outputCol="features").transform(vector)
    found = KMeans(k=k, seed=0).fit(data).transform(data).select("point_id", F.col("prediction").cast("long").alias("label"))
    return points.join(found, "point_id", "left")


#: Rounds of messages between two tables; longer plans cost more than the tables save.
ROUNDS_A_TABLE = 3


def affinity_propagation(points: DataFrame, neighbors: int = 10, preference: float | None = None, damping: float = 0.5, stable: int = 5, rounds: int = 200) -> DataFrame:
    """``points`` with ``label``, the id of the exemplar, -1 for a point none of whose neighbours is one.

    Messages go along the edges of the k-NN graph, from a point to those it may choose, and not between all pairs; the
    similarity is the squared distance below zero, that to oneself the ``preference``, by default the median of all. A round
    is a window over a point's few edges and a sum by exemplar. It ends when the exemplars have stayed the same for
    ``stable`` checks, ROUNDS_A_TABLE rounds apart. Messages that still swing after ``rounds`` rounds, as ties make them, are
    an error; more ``damping`` calms them.
    """
    near = materialize(knn(points, neighbors).select(F.col("point_id").alias("i"), F.col("neighbor_id").alias("k"), (-F.col("distance") ** 2).alias("s")), "near")
    own = preference if preference is not None else near.agg(F.median("s")).first()[0]
    loops = points.select(F.col("point_id").alias("i"), F.col("point_id").alias("k"), F.lit(float(own or 0.0)).alias("s"))
    now = near.unionByName(loops).withColumns({"a": F.lit(0.0), "r": F.lit(0.0)})
    kept = lambda old, new: F.lit(damping) * F.col(old) + F.lit(1 - damping) * new
    mine = Window.partitionBy("i")
    state, same, before = None, 0, None
    for _ in range(0, rounds, ROUNDS_A_TABLE):
        for _ in range(ROUNDS_A_TABLE):
            t = now.withColumn("t", F.col("a") + F.col("s")).withColumn("place", F.row_number().over(mine.orderBy(F.desc("t"), "k")))
            first, second = (F.max(F.when(F.col("place") == n, F.col("t"))).over(mine) for n in (1, 2))
            rival = F.coalesce(F.when(F.col("place") == 1, second).otherwise(first), F.lit(0.0))
            sent = t.withColumn("rival", rival).select("i", "k", "s", "a", kept("r", F.col("s") - F.col("rival")).alias("r"))
            loop = F.col("i") == F.col("k")
            heard = sent.groupBy("k").agg(F.sum(F.when(~loop, F.greatest("r", F.lit(0.0))).otherwise(0.0)).alias("others"), F.max(F.when(loop, F.col("r"))).alias("itself"))
            answer = F.when(loop, F.col("others")).otherwise(F.least(F.lit(0.0), F.col("itself") + F.col("others") - F.greatest("r", F.lit(0.0))))
            now = sent.join(heard, "k").select("i", "k", "s", kept("a", answer).alias("a"), "r")
        now = materialize(now, "messages")
        discard(before)
        before = now
        exemplars = now.where("i = k and a + r > 0").select("k")
        last, state = state, tuple(exemplars.agg(F.count("*"), F.bit_xor(F.xxhash64("k")), F.sum(F.xxhash64("k").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        same = same + 1 if state == last and state[0] else 0
        if same >= stable:
            break
    else:
        if points.isEmpty():
            return points.withColumn("label", F.lit(-1).cast("long"))
        raise RuntimeError(f"exemplars still change after {rounds} rounds")
    chosen = now.join(exemplars, "k").groupBy("i").agg(F.max(F.struct(F.col("i") == F.col("k"), "s", -F.col("k"), F.col("k").alias("label"))).alias("m"))
    return points.join(chosen.select(F.col("i").alias("point_id"), "m.label"), "point_id", "left").select(*points.columns, F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def birch(points: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """Points summed up (count and sums) by cells of side ``threshold``, their means by weighted k-means: the leaves are
    those of a grid, not of a tree, so they do not depend on the points' order. A point has the label of its cell."""
    cell = [F.floor(F.col(c) / F.lit(threshold)).cast("long").alias(f"__c{c}") for c in ("x", "y")]
    leaves = points.groupBy(*cell).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").cast("double").alias("__n"))
    leaves = materialize(leaves, "leaves")
    found = _fitted(KMeans(k=k, seed=0, weightCol="__n"), leaves).select("__cx", "__cy", "label")
    return points.select("*", *cell).join(found, ["__cx", "__cy"], "left").select(*points.columns, "label")


#: Of a cell's side and the reach: two points of a cell are always within reach of each other.
INSIDE = 0.7071
#: Two boxes of points that lie neither all within reach nor all beyond are compared point by point if the product of
#: their sizes is at most this, else halved.
FEW_PAIRS = 4096


def _cells(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """``(point_id, x, y, cx, cy, full)``: points with their cells; a full cell has ``min_points`` points or more."""
    side = F.lit(eps * INSIDE)
    p = points.select("point_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y")], *[F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in ("x", "y")])
    full = p.groupBy("cx", "cy").agg((F.count("*") >= min_points).alias("full"))
    return materialize(p.join(full, ["cx", "cy"]).select("point_id", "x", "y", "cx", "cy", "full"), "cells")


def _within(few: DataFrame, others: DataFrame, eps: float) -> DataFrame:
    """``(a, acx, acy, b, bcx, bcy)``: points of ``few``, fewer than min_points a cell, with the points of ``others`` within
    ``eps``, of the 25 cells around. A point of ``others`` so meets 25 * min_points others at most."""
    around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in range(-2, 3) for j in range(-2, 3)]))
    q = few.select(F.col("point_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cx").alias("acx"), F.col("cy").alias("acy"), around.alias("c")).select("a", "ax", "ay", "acx", "acy", "c.*")
    near = q.join(others, ["cx", "cy"]).where((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= eps * eps)
    return near.select("a", "acx", "acy", F.col("point_id").alias("b"), F.col("cx").alias("bcx"), F.col("cy").alias("bcy"))


def _core(cells: DataFrame, eps: float, min_points: int) -> DataFrame:
    sparse = cells.where(~F.col("full"))
    counted = _within(sparse, cells, eps).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("point_id"))
    return cells.where("full").unionByName(sparse.join(counted, "point_id", "left_semi"))


def core_points(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """Points with ``min_points`` points within ``eps``, themselves counted; those of full cells without comparing any."""
    return _core(_cells(points, eps, min_points), eps, min_points).select("point_id")


def _full_links(full: DataFrame, eps: float) -> DataFrame:
    """``(u, v)``: pairs of full cells, at most two apart, that hold two points within ``eps`` of each other.

    Two cells are compared by the boxes of their points: all within reach is a link, all beyond is none. Otherwise both
    are halved on either axis and the parts compared, until a part is small enough to be compared point by point. A box
    is a grouped minimum and maximum, so no cell's points are gathered, however many they are.
    """
    at = lambda level: [F.floor(F.col(c) / F.lit(eps * INSIDE / 2**level)).cast("long").alias(f"s{c}") for c in ("x", "y")]
    away = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    cell = F.struct("cx", "cy")
    held = full.select("x", "y", cell.alias("cell"))
    cells = held.select("cell").distinct()
    others = F.explode(F.array(*[F.struct((F.col("cell.cx") + i).alias("cx"), (F.col("cell.cy") + j).alias("cy")) for i, j in away]))
    pairs = cells.select(F.col("cell").alias("u"), others.alias("v")).join(cells.select(F.col("cell").alias("v")), "v", "left_semi")
    pairs = pairs.select("u", "v", F.col("u").alias("p"), F.col("v").alias("q")).withColumns({c: F.struct(F.col(f"{c}.cx").alias("sx"), F.col(f"{c}.cy").alias("sy")) for c in ("p", "q")})
    links, level = None, 0
    while True:
        parts = held.select("cell", F.struct(*at(level)).alias("part"), "x", "y")
        box = parts.groupBy("cell", "part").agg(F.struct(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"), F.count("*").alias("n")).alias("box"))
        side = lambda cell, part, name: box.select(F.col("cell").alias(cell), F.col("part").alias(part), F.col("box").alias(name))
        both = pairs.join(side("u", "p", "a"), ["u", "p"]).join(side("v", "q", "b"), ["v", "q"])
        gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b.l{c}") - F.col(f"a.h{c}"), F.col(f"a.l{c}") - F.col(f"b.h{c}"))
        span = lambda c: F.greatest(F.col(f"b.h{c}") - F.col(f"a.l{c}"), F.col(f"a.h{c}") - F.col(f"b.l{c}"))
        least, most = gap("x") ** 2 + gap("y") ** 2, span("x") ** 2 + span("y") ** 2
        told = both.where(least <= eps * eps).select("u", "v", "p", "q", (most <= eps * eps).alias("all"), (F.col("a.n") * F.col("b.n") <= FEW_PAIRS).alias("few"))
        told = materialize(told, "boxes")
        sure = told.where("all").select("u", "v").distinct()
        open_ = told.where("not all").join(sure, ["u", "v"], "left_anti")
        here = lambda cell, part, p: parts.select(F.col("cell").alias(cell), F.col("part").alias(part), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
        each = open_.where("few").join(here("u", "p", "a"), ["u", "p"]).join(here("v", "q", "b"), ["v", "q"])
        met = each.where((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 <= eps * eps).select("u", "v").distinct()
        found = materialize(sure.unionByName(met).distinct(), "links")
        links = found if links is None else links.unionByName(found)
        halves = lambda c: F.explode(F.array(*[F.struct((F.col(f"{c}.sx") * 2 + i).alias("sx"), (F.col(f"{c}.sy") * 2 + j).alias("sy")) for i in (0, 1) for j in (0, 1)]))
        rest = materialize(open_.where("not few").join(found, ["u", "v"], "left_anti").select("u", "v", "p", "q"), "open")
        if not rest.take(1):
            return links
        pairs = rest.select("u", "v", halves("p").alias("p"), "q").select("u", "v", "p", halves("q").alias("q"))
        level += 1


def dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """``points`` with ``label``, the smallest core point of the cluster, -1 for noise.

    A border point goes to the cluster with the smallest label among its core neighbours. Clusters are components of
    cells of side 0.7071 * eps; only points of cells that are not full are compared one by one.
    """
    cells = _cells(points, eps, min_points)
    core = materialize(_core(cells, eps, min_points), "core")
    cell = lambda p="": F.struct(F.col(f"{p}cx").alias("cx"), F.col(f"{p}cy").alias("cy"))
    near = _within(core.where(~F.col("full")), core, eps).select(cell("a").alias("u"), cell("b").alias("v")).distinct()
    roots = connected_components(_full_links(core.where("full"), eps).unionByName(near).unionByName(core.select(cell().alias("u"), cell().alias("v")).distinct()))
    rooted = core.select("point_id", cell().alias("node")).join(roots, "node").select("point_id", "root")
    labels = rooted.groupBy("root").agg(F.min("point_id").alias("label"))
    inside = materialize(rooted.join(labels, "root").select("point_id", "label"), "inside")
    lone = cells.where(~F.col("full")).join(core.select("point_id"), "point_id", "left_anti")
    own = _within(lone, core, eps).select(F.col("a").alias("id"), "b").join(inside, F.col("b") == inside.point_id).groupBy(F.col("id").alias("point_id")).agg(F.min("label").alias("label"))
    return points.join(inside.unionByName(own), "point_id", "left").select(*points.columns, F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def _fullest(modes: DataFrame, bandwidth: float) -> DataFrame:
    """Of modes (mx, my, n) those that no kept fuller one (more points, then the smaller place) lies within a bandwidth of.

    A round keeps each mode that is the fullest around and drops those within its reach; the modes between wait for the next.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(bandwidth)).cast("long")
    rank = F.struct("n", (-F.col("mx")).alias("x"), (-F.col("my")).alias("y"))
    left = materialize(modes.select("mx", "my", "n", rank.alias("rank"), cell("mx").alias("cx"), cell("my").alias("cy")), "modes")
    around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))

    def reached(by: DataFrame, fuller: bool = False) -> DataFrame:
        """What is left and lies within reach of a mode of ``by``, of a fuller one if so asked."""
        q = by.select(F.col("mx").alias("ox"), F.col("my").alias("oy"), F.col("rank").alias("other"), around.alias("c")).select("ox", "oy", "other", "c.*")
        close = left.join(q, ["cx", "cy"]).where((F.col("ox") - F.col("mx")) ** 2 + (F.col("oy") - F.col("my")) ** 2 <= bandwidth**2)
        return (close.where("other > rank") if fuller else close).select("rank").distinct()

    kept = None
    while kept is None or left.take(1):
        top = materialize(left.join(reached(left, True), "rank", "left_anti").select(*left.columns), "modes")
        kept = top if kept is None else kept.unionByName(top)
        left = materialize(left.join(reached(top), "rank", "left_anti").select(*left.columns), "modes")
    return kept.select("mx", "my", "n")


def mean_shift(points: DataFrame, bandwidth: float, rounds: int = 50) -> DataFrame:
    """Flat-kernel mean shift of one seed for each cell of side ``bandwidth``; far points get -1.

    Every round moves all seeds to the mean of the points within the bandwidth, found through the nine cells
    around. Seeds that end in the same hundredth of a bandwidth are one mode, found by a grouped aggregation;
    of the modes, one that is within a bandwidth of a fuller one that stays gives way to it.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(bandwidth)).cast("long")
    p = points.select("point_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    seeds = materialize(p.groupBy("cx", "cy").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy")).select(F.xxhash64("cx", "cy").alias("seed"), "sx", "sy"), "seeds")

    def around(s: DataFrame) -> DataFrame:
        near = F.explode(F.array(*[F.struct((F.floor(F.col("sx") / bandwidth) + i).cast("long").alias("cx"), (F.floor(F.col("sy") / bandwidth) + j).cast("long").alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        return s.select("seed", "sx", "sy", near.alias("c")).select("seed", "sx", "sy", "c.*").join(p, ["cx", "cy"]).where((F.col("sx") - F.col("x")) ** 2 + (F.col("sy") - F.col("y")) ** 2 <= bandwidth**2)

    for _ in range(rounds):
        moved = around(seeds).groupBy("seed", "sx", "sy").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
        moved = materialize(moved.withColumn("step", F.hypot(F.col("mx") - F.col("sx"), F.col("my") - F.col("sy"))), "seeds")
        seeds = moved.select("seed", F.col("mx").alias("sx"), F.col("my").alias("sy"))
        if (moved.agg(F.max("step")).first()[0] or 0.0) < 1e-3 * bandwidth:
            break
    else:
        raise RuntimeError(f"seeds still move after {rounds} rounds")
    near = [F.floor(F.col(c) / F.lit(bandwidth / 100)) for c in ("mx", "my")]
    ended = moved.groupBy(*near).agg(F.max_by(F.struct("mx", "my", "n"), F.struct("n", -F.col("mx"), -F.col("my"))).alias("m")).select("m.*")
    modes = materialize(_fullest(ended, bandwidth), "modes")
    table = numbered(modes.select((-F.col("n")).alias("less"), "mx", "my"), ["less", "mx", "my"], "seed").select("seed", F.col("mx").alias("sx"), F.col("my").alias("sy"))
    best = around(table).groupBy("point_id").agg(F.min(F.struct(((F.col("sx") - F.col("x")) ** 2 + (F.col("sy") - F.col("y")) ** 2).alias("d"), "seed")).alias("m"))
    return points.join(best.select("point_id", "m.seed"), "point_id", "left").select(*points.columns, F.coalesce("seed", F.lit(-1)).cast("long").alias("label"))
