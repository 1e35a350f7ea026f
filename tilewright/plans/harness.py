"""Timed comparisons: clusterings among each other, subspace clusterings, and the two phases of tile clustering.

A run ends when its result has gone to the noop sink or, where a later step reads it, to a table of the shared
folder. Results are one record for each algorithm; the metrics are those of its last run.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.operators import comparators, metrics, slabs
from tilewright.operators import clusters as cl
from tilewright.operators import tiles as tl
from tilewright.plans.estimators import SubspaceClusterer, TileClusterer
from tilewright.sources import generate, points, sinks
from tilewright.storage import discard, materialize

#: Sizes and precisions of the full bench, fixed values: in one part, and in slabs.
WHOLE = {"groups": (100, 1000, 10_000, 100_000, 1_000_000), "precisions": (3.0, 3.5, 4.0, 5.0), "cores": (1,)}
PARTED = {"groups": (100_000, 1_000_000), "precisions": (3.0, 3.5, 4.0), "cores": (1, 2, 4, 8)}
#: Groups from which on the costlier comparators are left out, fixed values.
MOST_FOR_MERGING, MOST_FOR_GRAPHS = 1000, 100
#: Fields of a bench record in their order, fixed values.
RECORD = (
    "#clusters", "#clusters identified [ratio]", "#cores", "mean [s]", "sample std_dev [s]", "mean projection [s]", "mean clustering [s]",
    "sample std_dev projection [s]", "sample std_dev clustering [s]", "times projection [s]", "times clustering [s]",
)


def points_of(spark: SparkSession, groups: int, data: str | None = None) -> DataFrame:
    """``(point_id, x, y)`` of the file ``data`` (``{}`` in its name is the number of groups), which must have 500 points
    a group, or generated ones."""
    if data:
        found = points.check_size(points.read_csv(spark, data.format(groups)), groups)
    else:
        found = (generate.grouped if groups <= 10_000 else generate.on_grid)(spark, groups).select("x", "y")
    return materialize(points.with_point_id(found).select("point_id", "x", "y"), "points")


def deviation(times: list[float]) -> float:
    """The sample's; 0 for a single run."""
    return statistics.stdev(times) if len(times) > 1 else 0.0


def _sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], DataFrame], repeats: int) -> tuple[list[float], DataFrame]:
    """Seconds of each run, and the last one's result as a table."""
    times, last = [], None
    for _ in range(repeats):
        began = time.perf_counter()
        now = materialize(run(), "run")
        times.append(time.perf_counter() - began)
        discard(last)
        last = now
    return times, last


def _report(algorithms: dict[str, Callable[[], DataFrame]], groups: int, repeats: int, with_metrics: bool) -> dict[str, dict]:
    if repeats < 1:
        raise ValueError("at least one run")
    out = {}
    for name, run in algorithms.items():
        try:
            times, labelled = timed(run, repeats)
        except RuntimeError as e:  # a comparator that finds no fixpoint; the others go on
            out[name] = {"error": str(e)}
            continue
        out[name] = {"mean": statistics.mean(times), "stdev": deviation(times), "timings": times}
        if with_metrics:
            out[name]["ratio"] = metrics.cluster_ratio(labelled, groups).first()[0]
            out[name]["silhouette"] = metrics.silhouette(labelled).first()[0]
        discard(labelled)
    return out


def compare(data: DataFrame, groups: int, repeats: int = 1, with_metrics: bool = False, everything: bool = False) -> dict[str, dict]:
    """A record for each clustering of ``data`` (point_id, x, y): mean, stdev and timings, and if asked for the ratio of
    clusters found to ``groups`` and the silhouette. Those that grow steeply with the groups are left out from some size on;
    ``everything`` adds the fast ones that are not compared by default."""
    found = {
        "tiles": lambda: TileClusterer(4, 5, 5).fit_transform(data),
        "mean shift": lambda: comparators.mean_shift(data, 0.1),
    }
    if everything:
        found |= {
            "dbscan": lambda: comparators.dbscan(data, 0.3, 5),
            "k-means": lambda: comparators.kmeans(data, groups),
            "birch": lambda: comparators.birch(data, groups),
            "gaussian mixture": lambda: comparators.gaussian_mixture(data, groups),
        }
    if groups < MOST_FOR_MERGING:
        found["hierarchical"] = lambda: comparators.hierarchical(data, groups)
    if groups < MOST_FOR_GRAPHS:
        found["spectral"] = lambda: comparators.spectral(data, groups).fillna(-1, ["label"])
        found["affinity propagation"] = lambda: comparators.affinity_propagation(data, preference=-0.0001, damping=0.9)
    return _report(found, groups, repeats, with_metrics)


def compare_subspace(data: DataFrame, groups: int, intervals: list[int], repeats: int = 1, with_metrics: bool = False, tiles: bool = True) -> dict[str, dict]:
    """Records as of :func:`compare`, of subspace clustering at each number of intervals, and of tiles unless left out.
    A unit is dense from five values of all coordinates on."""
    tau = 5 / (2 * max(1, data.count()))
    found = {"tiles": lambda: TileClusterer(4, 5, 5).fit_transform(data)} if tiles else {}
    for n in intervals:
        found[f"subspace {n}"] = lambda n=n: SubspaceClusterer(["x", "y"], n, tau).fit_transform(data)
    return _report(found, groups, repeats, with_metrics)


def results(spark: SparkSession, records: dict[str, dict]) -> DataFrame:
    """``(algorithm, mean, stdev, timings, ratio, silhouette, error)``, null where no metrics were asked for, and all but the
    error where a clustering found no fixpoint."""
    rows = [(name, *[r.get(c) for c in ("mean", "stdev", "timings", "ratio", "silhouette", "error")]) for name, r in records.items()]
    return spark.createDataFrame(rows, "algorithm string, mean double, stdev double, timings array<double>, ratio double, silhouette double, error string")


def bench_tiles(data: DataFrame, groups: int, precision: float, threshold: int = 5, min_size: int = 4, cores: int | None = None, repeats: int = 5, prime: bool = False, parted: bool = False) -> DataFrame:
    """One bench record: both phases of tile clustering, each run timed. A run that finds another number of clusters than
    the first is an error.

    ``cores``: partitions that the points are dealt to before, which bounds the tasks of the projection; None leaves them as
    they are. ``parted``: clusters by slabs, one a core. ``prime``: clusters with their points.
    """
    if repeats < 1:
        raise ValueError("at least one run")
    spark = data.sparkSession
    source = materialize(data.select("x", "y").repartition(cores), "dealt") if cores else data.select("x", "y")
    projection, clustering, counts = [], [], set()
    for _ in range(repeats):
        began = time.perf_counter()
        tiles = materialize(tl.significant_tiles(source, precision, threshold), "tiles")
        projected = time.perf_counter()
        if parted:
            found = slabs.clusters_slab(tiles, slabs.width_for(tiles, cores or spark.sparkContext.defaultParallelism), min_size)
        else:
            found = cl.cluster_tiles(tiles, min_size)
        found = materialize(found, "found")
        if prime:
            _sink(tl.project(source, precision).join(found, ["tx", "ty"]))
        projection.append(projected - began)
        clustering.append(time.perf_counter() - projected)
        counts.add(cl.cluster_count(found).first()[0])
        discard(tiles, found)
    if len(counts) > 1:
        raise RuntimeError(f"runs found {sorted(counts)} clusters")
    whole = [a + b for a, b in zip(projection, clustering)]
    row = (
        groups, counts.pop() / groups, cores or spark.sparkContext.defaultParallelism, statistics.mean(whole), deviation(whole), statistics.mean(projection),
        statistics.mean(clustering), deviation(projection), deviation(clustering), projection, clustering,
    )
    kinds = ("bigint", "double", "int", *["double"] * 6, *["array<double>"] * 2)
    return spark.createDataFrame([row], ", ".join(f"`{c}` {k}" for c, k in zip(RECORD, kinds)))


def bench(spark: SparkSession, out: str, groups: list[int], precisions: list[float], cores: list[int | None], data: str | None = None, threshold: int = 5, min_size: int = 4, repeats: int = 5, prime: bool = False, parted: bool = False) -> None:
    """Bench records of all groups, cores and precisions, a folder below ``out`` for each precision; what an earlier bench
    left there goes."""
    name = ("slabs" if parted else "tiles") + ("_prime" if prime else "")
    folder = lambda p: f"{out}/{name}_precision{p:g}_threshold{threshold}_min_size{min_size}"
    for p in precisions:
        sinks.remove(spark, folder(p))
    for n in groups:
        held = points_of(spark, n, data)
        for c in cores:
            for p in precisions:
                sinks.append_record(bench_tiles(held, n, p, threshold, min_size, c, repeats, prime, parted), folder(p))
        discard(held)
