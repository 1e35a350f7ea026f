import math
import random

import pytest

from tilewright.operators import comparators


def frame(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "point_id long, x double, y double")


def plain_dbscan(rows, eps, least):
    near = [[j for j, q in enumerate(rows) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in rows]
    core = {i for i, n in enumerate(near) if len(n) >= least}
    label = {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = i
                todo += [j for j in near[k] if j in core]
    return [label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in range(len(rows))]


def test_mean_shift_does_not_end_on_moving_seeds(spark):
    points = spark.createDataFrame([(i, i * 0.1 + (i / 20) ** 2, 0.0) for i in range(15)], "point_id long, x double, y double")
    with pytest.raises(RuntimeError):
        comparators.mean_shift(points, 0.6, rounds=1)
    assert comparators.mean_shift(points, 0.6).count() == 15


def test_kept_modes_equal_one_after_another(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-6, 6), rng.uniform(-3, 3), rng.randrange(1, 9)) for _ in range(120)]
    kept = []
    for x, y, n in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if all((x - a) ** 2 + (y - b) ** 2 > 1 for a, b, _ in kept):
            kept.append((x, y, n))
    got = comparators._fullest(spark.createDataFrame(rows, "mx double, my double, n long"), 1.0).collect()
    assert sorted(map(tuple, got)) == sorted(kept)


@pytest.mark.parametrize(("few", "eps", "least"), [(4096, 1.0, 5), (2, 1.0, 5), (64, 0.45, 4)])
def test_density_clusters_equal_plain_python(spark, monkeypatch, few, eps, least):
    """Full cells that touch, that only face each other, and that hold many copies of a point; sparse ones between."""
    monkeypatch.setattr(comparators, "FEW_PAIRS", few)
    rng = random.Random(8)
    rows = [(rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(110)]
    rows += [(rng.gauss(10, 0.2), rng.gauss(1, 0.2)) for _ in range(90)] + [(11.5, 1.0)] * 30 + [(12.5, 1.0)] * 30 + [(13.5001, 1.0)] * 30
    rows += [(20 + math.cos(t / 9), math.sin(t / 9)) for t in range(57)] + [(-30.0, 4.0), (-30.5, 4.0)]
    got = {r["point_id"]: r["label"] for r in comparators.dbscan(frame(spark, rows), eps, least).collect()}
    assert [got[i] for i in range(len(rows))] == plain_dbscan(rows, eps, least)


def test_density_clusters_of_no_points(spark):
    assert comparators.dbscan(frame(spark, []), 1.0, 3).count() == 0
    assert {r["label"] for r in comparators.dbscan(frame(spark, [(0, 0), (0, 0)]), 1.0, 3).collect()} == {-1}


def test_birch_labels_groups(spark):
    rng = random.Random(6)
    rows = [(c * 10 + rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for c in range(3) for _ in range(40)]
    got = {r["point_id"]: r["label"] for r in comparators.birch(frame(spark, rows), 3).collect()}
    assert [len({got[c * 40 + i] for i in range(40)}) for c in range(3)] == [1, 1, 1] and len(set(got.values())) == 3


def plain_affinity(rows, k, preference, damping, rounds):
    """Messages on the k-NN graph, in plain loops."""
    s = {}
    for i, p in enumerate(rows):
        near = sorted((math.dist(p, q) ** 2, j) for j, q in enumerate(rows) if j != i)[:k]
        s |= {(i, j): -d for d, j in near} | {(i, i): preference}
    a, r = dict.fromkeys(s, 0.0), dict.fromkeys(s, 0.0)
    out = {i: [j for x, j in s if x == i] for i in range(len(rows))}
    into = {j: [i for i, x in s if x == j] for j in range(len(rows))}
    for _ in range(rounds):
        for i, js in out.items():
            new = {j: s[i, j] - max(a[i, x] + s[i, x] for x in js if x != j) for j in js}
            for j in js:
                r[i, j] = damping * r[i, j] + (1 - damping) * new[j]
        for j, ones in into.items():
            total = sum(max(0, r[i, j]) for i in ones if i != j)
            for i in ones:
                new = total if i == j else min(0, r[j, j] + total - max(0, r[i, j]))
                a[i, j] = damping * a[i, j] + (1 - damping) * new
    stars = {j for j in out if a[j, j] + r[j, j] > 0}
    return [i if i in stars else max(((s[i, j], -j, j) for j in out[i] if j in stars), default=(0, 0, -1))[2] for i in out]


def test_affinity_equals_plain_python(spark):
    rng = random.Random(12)
    rows = [(c * 5 + rng.gauss(0, 0.5), rng.gauss(0, 0.5)) for c in range(3) for _ in range(20)]
    got = {r["point_id"]: r["label"] for r in comparators.affinity_propagation(frame(spark, rows), 12, -6.0, 0.5, 3).collect()}
    assert [got[i] for i in range(60)] == plain_affinity(rows, 12, -6.0, 0.5, 120)
    assert 3 <= len(set(got.values())) < 12
