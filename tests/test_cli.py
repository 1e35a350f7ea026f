import json
import math
from collections import Counter

from test_tiles import plain_clusters

from tilewright.__main__ import main
from tilewright.functions.tiles import scale_factor
from tilewright.plans import harness


def test_tiles(spark, resources, tmp_path):
    source = str(resources / "one_group.csv")
    rows = [tuple(map(float, line.split(","))) for line in (resources / "one_group.csv").read_text().split()]

    def plain(precision):
        """Tiles in clusters of at least four tiles, and points in them."""
        counts = Counter(tuple(math.trunc(v * scale_factor(precision)) for v in r) for r in rows)
        inside = {t for c in plain_clusters([t for t, n in counts.items() if n >= 5], 4) for t in c}
        return len(inside), sum(counts[t] for t in inside)

    main(["tiles", source, str(tmp_path / "c")])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == plain(3.5)[0]
    main(["tiles", source, str(tmp_path / "p"), "--points"])
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).where("label >= 0").count() == plain(3.5)[1]
    main(["tiles", source, str(tmp_path / "q"), "--prime", "-p", "4"])
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).count() == plain(4)[1]


def test_subspace(spark, tmp_path):
    (tmp_path / "f.txt").write_text("## f\n" + "".join(f"{0.1 + 0.001 * i} 0.2 A\n{0.9 - 0.001 * i} 0.8 B\n" for i in range(40)))
    main(["subspace", str(tmp_path / "f.txt"), str(tmp_path / "o"), "--label", "2"])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert len(lines) == 6 and all(x.endswith("40 points") for x in lines)


def test_compare(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(harness, "MOST_FOR_GRAPHS", 10)
    main(["compare", "1", str(tmp_path / "o"), "-m"])
    got = {r["algorithm"]: r for r in spark.read.json(str(tmp_path / "o")).collect()}
    assert set(got) == {"tiles", "mean shift", "hierarchical"}
    assert got["tiles"]["ratio"] == 1.0 and got["tiles"]["silhouette"] > 0.99
    assert all(r["timings"] == [r["mean"]] and r["stdev"] == 0 for r in got.values())


def test_compare_subspace(spark, tmp_path):
    main(["compare-subspace", "10", str(tmp_path / "o"), "-x", "20", "--no-tiles", "-r", "2"])
    row = spark.read.json(str(tmp_path / "o")).first()
    assert row["algorithm"] == "subspace 20" and len(row["timings"]) == 2 and min(row["timings"]) <= row["mean"] <= max(row["timings"])


def test_bench_records(spark, tmp_path, resources):
    """Both forms find the cluster, a record for each number of cores, and an earlier bench's records go."""
    for _ in range(2):
        for form in ([], ["--par", "--prime"]):
            main(["bench", str(tmp_path), "-n", "1", "-i", "2", "--data", str(resources / "one_group.csv"), "--cores", "1", "2", *form])
    for name in ("tiles", "slabs_prime"):
        rows = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / f"{name}_precision3.5_threshold5_min_size4")).collect()
        assert sorted(r["#cores"] for r in rows) == ["1", "2"] and {r["#clusters identified [ratio]"] for r in rows} == {"1.0"}
        assert all(len(json.loads(r["times clustering [s]"])) == 2 for r in rows)


def test_a_clustering_without_fixpoint_leaves_the_others(spark):
    def none():
        raise RuntimeError("no fixpoint")

    got = harness._report({"a": none, "b": lambda: spark.createDataFrame([(0, 0.0, 0.0, 0)], "point_id long, x double, y double, label long")}, 1, 1, False)
    rows = {r["algorithm"]: r for r in harness.results(spark, got).collect()}
    assert rows["a"]["error"] == "no fixpoint" and rows["a"]["mean"] is None and rows["b"]["error"] is None and len(rows["b"]["timings"]) == 1
