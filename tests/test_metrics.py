import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import clique, comparators, components, metrics
from tilewright.operators.components import connected_components
from tilewright.plans.estimators import SubspaceClusterer
from tilewright.sources import generate, points, sinks


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 7), (9, 8), (3, 1), (None, 4), (1, 2)], "u long, v long")
    assert {(r["node"], r["root"]) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)}
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert connected_components(path).select("root").distinct().collect()[0][0] == 0
    assert connected_components(e.where("u > 100")).count() == 0


def test_places_by_ranges_equal_places_in_one_task(spark, monkeypatch):
    rows = spark.range(500).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b")).distinct()
    want = {(r["a"], r["b"]): i + 5 for i, r in enumerate(sorted(rows.collect()))}
    for limit in (16_384, 0):
        monkeypatch.setattr(components, "ONE_TASK_EDGES", limit)
        assert {(r["a"], r["b"]): r["place"] for r in components.numbered(rows, ["a", "b"], "place", 5).collect()} == want


@pytest.mark.parametrize("limit", [16_384, 0])
def test_components_of_structs_and_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", limit)
    e = spark.createDataFrame([(3, 2), (2, 1), (9, 8), (7, 7), (None, 1), (2, 3)], "u long, v long")
    assert {(r["node"], r["root"]) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)}
    s = e.where("u is not null").select(F.struct(F.lit(1).alias("p"), "u").alias("u"), F.struct(F.lit(1).alias("p"), F.col("v").alias("u")).alias("v"))
    assert {(r["node"]["u"], r["root"]["u"]) for r in connected_components(s).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)}


def test_log_gamma_and_expectation():
    x = np.array([0.5, 1, 2, 3.7, 10, 1e3, 1e8])
    assert metrics.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    n, a, b = 30, 12, 9
    want = sum(math.comb(a, i) * math.comb(n - a, b - i) / math.comb(n, b) * i / n * math.log(n * i / (a * b)) for i in range(1, b + 1))
    assert metrics.expected_information(a, b, n) == pytest.approx(want)


def test_scores_by_dimensions(spark):
    rng = random.Random(4)
    rows = [(i, 0.15 + 0.01 * rng.random() + (0.5 if i % 2 else 0.0), 0.35 + 0.01 * rng.random() + (0.3 if i % 2 else 0.0)) for i in range(60)]
    p = spark.createDataFrame(rows, "point_id long, x double, y double")
    found = clique.run(p, ["x", "y"], 10, 0.1)
    members = clique.cluster_points(clique.unit_vectors(p, ["x", "y"], 10), found, 2)
    got = {r["k"]: r for r in clique.scores_by_dimensions(p.select("point_id", (F.col("point_id") % 2).alias("truth")), found, members, 2).collect()}
    assert got[2]["ari"] == pytest.approx(1.0) and set(got) == {1, 2}
    lines = [r["value"] for r in clique.describe(found, members, True).collect()]
    assert sum(line.endswith(str(list(range(0, 60, 2))).replace(" ", "")) for line in lines) == 2 + 1


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    from tilewright.operators.tiles import tile_counts
    from tilewright.streaming.tiles import running_tile_counts

    p = spark.createDataFrame([(float(i % 7), float(i % 3)) for i in range(100)], "x double, y double")
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    q = running_tile_counts(stream, 0).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("counts").collect()) == sorted(tile_counts(p, 0).collect())


def test_sample_deviation(spark):
    runs = spark.createDataFrame([("a", x) for x in (9.0, 2.0, 5.0, 4.0)] + [("b", 1.0)], "algorithm string, seconds double")
    got = {r["algorithm"]: r for r in metrics.speedup(metrics.bench_stats(runs, "algorithm"), "algorithm", "a").collect()}
    assert got["a"]["stdev"] == pytest.approx(math.sqrt(26 / 3)) and got["b"]["stdev"] == 0.0
    assert got["b"]["speedup"] == pytest.approx(5.0) and got["a"]["median"] == 4.5


def test_validity_of_equal_and_single_partitions(spark):
    same = spark.createDataFrame([(i % 3, 10 - i % 3) for i in range(30)], "truth long, cluster long")
    assert set(metrics.validity_scores(same).first().asDict().values()) == {1.0}
    assert metrics.adjusted_mutual_information(same).first()[0] == pytest.approx(1.0)
    one = spark.createDataFrame([(0, 0)] * 5, "truth long, cluster long")
    assert metrics.validity_scores(one).first()["ari"] == 1.0


def test_silhouette_and_neighbours_across_blocks(spark, monkeypatch):
    rows = [(i, float(i % 5), float(i // 5), i // 10) for i in range(40)] + [(40, 99.0, 99.0, 9), (41, 0.0, 0.0, -1)]
    p = spark.createDataFrame(rows, "point_id long, x double, y double, label long")
    one = metrics.silhouette(p).first()[0], metrics.knn(p, 3).orderBy("point_id", "rank").collect()
    monkeypatch.setattr(metrics, "PAIR_BLOCK", 7)
    assert metrics.silhouette(p).first()[0] == pytest.approx(one[0])
    assert metrics.knn(p, 3).orderBy("point_id", "rank").collect() == one[1]
    inside = [r for r in rows if r[3] >= 0]

    def s(r):
        mean = {}
        for q in inside:
            mean.setdefault(q[3], []).append(math.dist(r[1:3], q[1:3]))
        if len(mean[r[3]]) == 1:
            return 0.0
        a = sum(mean[r[3]]) / (len(mean[r[3]]) - 1)
        b = min(sum(v) / len(v) for k, v in mean.items() if k != r[3])
        return (b - a) / max(a, b)

    assert one[0] == pytest.approx(sum(map(s, inside)) / len(inside))


def test_silhouette_of_copies_and_of_one_cluster(spark, monkeypatch):
    """Copies of a place weigh as they are many and are compared once; one cluster is not compared at all."""
    rows = [(i % 7 * 1.5, i % 3 * 1.0, i % 7 // 4) for i in range(42)] + [(50.0, 0.0, 2)]
    mean = lambda p, label, own: sum(math.dist(p[:2], q[:2]) for q in rows if q[2] == label) / (sum(q[2] == label for q in rows) - own)
    want = 0.0
    for p in rows[:42]:
        a, b = mean(p, p[2], 1), min(mean(p, c, 0) for c in {0, 1, 2} - {p[2]})
        want += (b - a) / max(a, b)
    copies = [(i, *r) for i, r in enumerate(rows)]
    seen, schema = [], "point_id long, x double, y double, label long"
    compared = metrics._against_all
    monkeypatch.setattr(metrics, "_against_all", lambda places, *more: (seen.append(places.count()), compared(places, *more))[1])
    assert metrics.silhouette(spark.createDataFrame(copies, schema)).first()[0] == pytest.approx(want / 43)
    assert seen == [22]
    assert metrics.silhouette(spark.createDataFrame(copies, schema).withColumn("label", F.lit(3).cast("long"))).first()[0] == 0.0
    assert metrics.silhouette(spark.createDataFrame([], schema)).first()[0] is None and seen == [22]


def test_subspace_clusters(spark):
    dense = [(i, 0.11 + 0.001 * i, 0.21, 0.5) for i in range(40)] + [(40 + i, 0.71, 0.31 + 0.001 * i, 0.025 * i) for i in range(40)]
    p = spark.createDataFrame(dense, "point_id long, x double, y double, z double")
    got = clique.run(p, ["x", "y", "z"], 10, 0.2).collect()
    whole = [r for r in got if len(r["dims"]) == 3]
    assert {tuple(r["units"]) for r in whole} == {(1, 2, 5)}
    assert {tuple(r["dims"]) for r in got} >= {(0,), (1,), (2,), (0, 1)}
    labels = SubspaceClusterer(["x", "y"], 10, 0.2).fit_transform(p).groupBy("label").count().collect()
    assert sum(r["count"] for r in labels) == 80 and {r["label"] for r in labels} == {0, 1}
    found = clique.run(p, ["x", "y"], 10, 0.2)
    members = clique.cluster_points(clique.unit_vectors(p, ["x", "y"], 10), found, 2)
    assert clique.describe(found, members).count() == found.select("cluster_id").distinct().count()


def test_candidates_with_a_face_that_is_not_dense_go(spark):
    """(0, 1, 2) in units (5, 5, 5) joins two dense faces, but (1, 2) in (5, 5) is not dense."""
    rows = [([0, 1], [5, 5]), ([0, 2], [5, 5]), ([0, 1], [7, 8]), ([0, 2], [7, 9]), ([1, 2], [8, 9]), ([1, 2], [8, 5])]
    dense = spark.createDataFrame(rows, "dims array<int>, units array<int>")
    found = clique.candidates(dense, 3)
    assert sorted(tuple(r["units"]) for r in found.collect()) == [(5, 5, 5), (7, 8, 9)]
    assert [(r["dims"], r["units"]) for r in clique.pruned(found, dense, 3).collect()] == [([0, 1, 2], [7, 8, 9])]


def test_subspaces_equal_plain_python(spark):
    from itertools import combinations

    rng = random.Random(21)
    rows = [tuple(min(0.999, max(0.0, rng.gauss(c, 0.12))) for c in rng.choice(((0.2, 0.3, 0.7), (0.7, 0.8, 0.3)))) for _ in range(300)]
    units, tau, want = [tuple(int(v * 6) for v in r) for r in rows], 0.03, set()
    for k in (1, 2, 3):
        for dims in combinations(range(3), k):
            counts = {}
            for u in units:
                key = tuple(u[d] for d in dims)
                counts[key] = counts.get(key, 0) + 1
            left = {u for u, n in counts.items() if n > tau * len(rows)}
            while left:
                todo = [left.pop()]
                one = set(todo)
                while todo:
                    at = todo.pop()
                    near = {u for u in left if sum(abs(a - b) for a, b in zip(at, u)) == 1}
                    left, one, todo = left - near, one | near, todo + list(near)
                want.add((dims, tuple(sorted(one))))
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "point_id long, x double, y double, z double")
    got = {}
    for r in clique.run(p, ["x", "y", "z"], 6, tau).collect():
        got.setdefault((r["cluster_id"], tuple(r["dims"])), []).append(tuple(r["units"]))
    assert {(dims, tuple(sorted(u))) for (_, dims), u in got.items()} == want and len(got) == len(want)
    assert [len(dims) for _, dims in sorted(got)] == sorted(len(d) for d, _ in want)


def test_units_count_modulo_one(spark):
    p = spark.createDataFrame([(0, 1.25, -0.05)], "point_id long, x double, y double")
    assert clique.unit_vectors(p, ["x", "y"], 20).first()["u"] == [5, 19]


def test_density_clusters(spark):
    rows = [(i, 0.1 * i, 0.0) for i in range(10)] + [(20 + i, 50 + 0.1 * i, 0.0) for i in range(10)] + [(99, 25.0, 25.0)]
    p = spark.createDataFrame(rows, "point_id long, x double, y double")
    got = {r["point_id"]: r["label"] for r in comparators.dbscan(p, 0.25, 3).collect()}
    assert got[99] == -1 and len({got[i] for i in range(10)}) == 1 and got[0] != got[20]
    shifted = {r["point_id"]: r["label"] for r in comparators.mean_shift(p, 2.0).collect()}
    assert len({shifted[i] for i in range(10)}) == 1 and shifted[0] != shifted[20]
    assert metrics.estimate_bandwidth(p).first()[0] > 0


def test_generators(spark):
    g = generate.grouped(spark, 5)
    assert g.count() == 2500 and sorted(map(tuple, g.collect())) == sorted(map(tuple, generate.grouped(spark, 5).collect()))
    assert generate.on_grid(spark, 3).groupBy("group").count().where("count = 500").count() == 3
    for kind in ("circles", "moons", "blobs", "varied", "aniso", "uniform"):
        assert generate.toy(spark, kind, 30).where("x is not null and y is not null").count() == 30
    with pytest.raises(ValueError):
        generate.toy(spark, "other")
    radius = {r["truth"]: r["r"] for r in generate.toy(spark, "circles", 400).groupBy("truth").agg(F.avg(F.hypot("x", "y")).alias("r")).collect()}
    assert radius[0] == pytest.approx(1.0, abs=0.05) and radius[1] == pytest.approx(0.5, abs=0.05)
    sd = {r["truth"]: r["s"] for r in generate.toy(spark, "varied", 1500).groupBy("truth").agg(F.stddev("x").alias("s")).collect()}
    assert [round(sd[t], 1) for t in range(3)] == pytest.approx([1.0, 2.5, 0.5], abs=0.2)
    assert generate.toy(spark, "uniform", 200).where("x between 0 and 1 and y between 0 and 1 and truth is null").count() == 200


def test_round_trips(spark, tmp_path):
    c = spark.createDataFrame([(0, 10, -20), (1, 5, 5)], "label long, tx long, ty long")
    sinks.write_clusters(c, str(tmp_path / "c"), 1)
    text = sorted(r["value"] for r in spark.read.text(str(tmp_path / "c")).collect())
    assert "1, 1.0, -2.0" in text and any(t.startswith("Cluster Number, X-Position") for t in text)
    sinks.append_record(spark.createDataFrame([(1, [0.5, 0.25])], "n int, times array<double>"), str(tmp_path / "b"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "b")).count() == 1
    (tmp_path / "p.arff").write_text("% c\n@relation r\n@attribute x numeric\n@attribute y numeric\n@data\n\n1.5, -2\n3,4\n")
    assert sorted(map(tuple, points.read_arff(spark, str(tmp_path / "p.arff")).collect())) == [(1.5, -2.0), (3.0, 4.0)]
    (tmp_path / "f.txt").write_text("## x\n0.5 1.5 Left_ear_point\n2 3 Head\n")
    assert sorted(map(tuple, points.read_features(spark, str(tmp_path / "f.txt"), [0, 1], 2).collect())) == [(0.5, 1.5, "Left_ear_p"), (2.0, 3.0, "Head")]
    (tmp_path / "bad.csv").write_text("1,2\nx,3\n")
    with pytest.raises(Exception):
        points.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_transforms(spark):
    p = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "x double, y double")
    assert sorted(map(tuple, metrics.linear_transform(p, [[1, 0], [1, 1]]).collect())) == [(3.0, 2.0), (9.0, 6.0)]
    assert sorted(map(tuple, metrics.standardize(p, ["x", "y"]).collect())) == [(-1.0, -1.0), (1.0, 1.0)]
    top = [r["x"] for r in metrics.normalize_minmax(p, ["x"]).collect()]
    assert 0 < min(top) < 1e-4 and 0.9999 < max(top) < 1
