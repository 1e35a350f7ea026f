"""``python -m tilewright tiles|subspace|compare|compare-subspace|bench``, for spark-submit too."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tilewright.operators import clique, metrics
from tilewright.operators import clusters as cl
from tilewright.plans import harness
from tilewright.sources import points, sinks


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tilewright")
    commands = parser.add_subparsers(dest="command", required=True)
    tiles = commands.add_parser("tiles", help="clusters of tiles of a point file, or its labelled points")
    tiles.add_argument("input")
    tiles.add_argument("output")
    tiles.add_argument("-p", "--precision", type=float, default=3.5)
    tiles.add_argument("-t", "--threshold", type=int, default=5)
    tiles.add_argument("-m", "--min-size", type=int, default=4)
    tiles.add_argument("--points", action="store_true", help="write each point with its label")
    tiles.add_argument("--prime", action="store_true", help="write the clusters with their points")
    sub = commands.add_parser("subspace", help="subspace clusters of a delimited file")
    sub.add_argument("input")
    sub.add_argument("output")
    sub.add_argument("--columns", type=int, nargs="+", default=[0, 1])
    sub.add_argument("--label", type=int, help="column with the true class; prints validity scores")
    sub.add_argument("--intervals", type=int, default=3)
    sub.add_argument("--tau", type=float, default=0.1)
    sub.add_argument("--sep", default=" ")
    sub.add_argument("--raw", action="store_true", help="do not normalise")
    sub.add_argument("--ids", action="store_true", help="write the ids of each cluster's points")
    compare = commands.add_parser("compare", help="time clusterings of groups of 500 points, and score them")
    compare.add_argument("power", type=int, choices=range(1, 6), help="10 to this power is the number of groups")
    compare.add_argument("--all", action="store_true", help="DBSCAN, k-means, BIRCH and mixture too")
    levels = commands.add_parser("compare-subspace", help="time subspace clusterings, and score them")
    levels.add_argument("groups", type=int, choices=(1, 10, 100, 1000))
    levels.add_argument("-x", "--intervals", type=int, nargs="+", default=[20])
    levels.add_argument("--no-tiles", action="store_true")
    for p in (compare, levels):
        p.add_argument("-r", "--repeats", type=int, default=1)
        p.add_argument("-m", "--metrics", action="store_true", help="ratio of clusters found, silhouette")
    bench = commands.add_parser("bench", help="time projection and clustering of tiles; one record for each case")
    bench.add_argument("-p", "--precision", type=float, nargs="+", default=[3.5])
    bench.add_argument("-t", "--threshold", type=int, default=5)
    bench.add_argument("-m", "--min-size", type=int, default=4)
    bench.add_argument("-i", "--iterations", type=int, default=5)
    bench.add_argument("-n", "--groups", type=int, nargs="+", default=[1000])
    bench.add_argument("--cores", type=int, nargs="+", default=[None])
    bench.add_argument("--prime", action="store_true", help="clusters with their points")
    bench.add_argument("--par", action="store_true", help="clusters by slabs, one a core")
    bench.add_argument("--bench", action="store_true", help="all sizes, precisions and cores of the full bench")
    for p in (compare, levels, bench):
        p.add_argument("output")
        p.add_argument("--data", help="point file; {} in its name is the number of groups; else points are generated")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tilewright").getOrCreate()
    if a.command == "tiles":
        data = points.read_csv(spark, a.input)
        if a.prime:
            cl.cluster_points(data, a.precision, a.threshold, a.min_size).write.mode("overwrite").csv(a.output, header=True)
            return
        found = cl.clusters(data, a.precision, a.threshold, a.min_size)
        if a.points:
            cl.label_points(data, found, a.precision).write.mode("overwrite").csv(a.output, header=True)
        else:
            sinks.write_clusters(found, a.output, a.precision)
        return
    if a.command == "compare":
        held = harness.points_of(spark, 10**a.power, a.data)
        sinks.write_results(harness.results(spark, harness.compare(held, 10**a.power, a.repeats, a.metrics, a.all)), a.output)
        return
    if a.command == "compare-subspace":
        held = harness.points_of(spark, a.groups, a.data)
        records = harness.compare_subspace(held, a.groups, a.intervals, a.repeats, a.metrics, not a.no_tiles)
        sinks.write_results(harness.results(spark, records), a.output)
        return
    if a.command == "bench":
        full = (harness.PARTED if a.par else harness.WHOLE) if a.bench else {"groups": a.groups, "precisions": a.precision, "cores": a.cores}
        harness.bench(spark, a.output, **full, data=a.data, threshold=a.threshold, min_size=a.min_size, repeats=a.iterations, prime=a.prime, parted=a.par)
        return
    data = points.with_point_id(points.read_features(spark, a.input, a.columns, a.label, a.sep))
    names = [f"f{k}" for k in range(len(a.columns))]
    data = data if a.raw else metrics.normalize_minmax(data, names)
    found = clique.run(data, names, a.intervals, a.tau)
    members = clique.cluster_points(clique.unit_vectors(data, names, a.intervals), found, len(names))
    sinks.write_descriptions(clique.describe(found, members, a.ids), a.output)
    if a.label is not None:
        clique.scores_by_dimensions(data.select("point_id", F.col("label").alias("truth")), found, members, len(names)).orderBy("k").show()


if __name__ == "__main__":
    main()
