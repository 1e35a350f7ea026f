"""Neighbours and distances by boxes of near points, held against all pairs."""

import math
import random

import numpy as np
import pytest

from tilewright.operators import boxes, comparators, metrics, power

POINTS = "point_id long, x double, y double"


def some(seed, n):
    """Scattered points, points on lines, one place many times, far ones."""
    rng = random.Random(seed)
    rows = [(rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(n)] + [(rng.uniform(0, 99), 200.0 * rng.randrange(3)) for _ in range(n)]
    rows += [(7.0, 7.0)] * (n // 4) + [(round(rng.gauss(20, 3)), round(rng.gauss(20, 3))) for _ in range(n)] + [(1e6, -1e6), (-3.5, 1e7)]
    ids = rng.sample(range(10 * len(rows)), len(rows))
    return [(i, float(x), float(y)) for i, (x, y) in zip(ids, rows)]


def plain(rows):
    """Each point's others as (d2, id), nearest first."""
    return {i: sorted(((x - u) * (x - u) + (y - v) * (y - v), j) for j, u, v in rows if j != i) for i, x, y in rows}


@pytest.mark.parametrize("size", [5, 64, 256])
def test_kth_distances_equal_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(boxes, "BOX_ROWS", size)
    monkeypatch.setattr(boxes, "SIDE", 2)
    rows = some(size, 70)
    p, near = spark.createDataFrame(rows, POINTS), plain(rows)
    for k in (1, 20, 110, len(rows) - 1):
        got = {(r["x"], r["y"]): r["distance"] for r in metrics.kth_distance(p, k).collect()}
        assert got == pytest.approx({(x, y): near[i][k - 1][0] ** 0.5 for i, x, y in rows}, rel=1e-15)
    assert metrics.kth_distance(p, len(rows)).count() == 0
    k = int(len(rows) * 0.3) - 1
    assert metrics.estimate_bandwidth(p, 0.3).first()[0] == pytest.approx(sum(n[k - 1][0] ** 0.5 for n in near.values()) / len(rows))


def test_weighted_ranks_equal_repeated_ones():
    rng = np.random.default_rng(3)
    d2 = rng.integers(0, 50, (9, 40)).astype(float)
    for weight in (np.ones(40, int), np.full(40, 6), rng.integers(1, 3, 40), rng.integers(1, 90, 40)):
        each = np.sort(np.repeat(d2, weight, axis=1), axis=1)
        for k in (1, 7, int(weight.sum())):
            assert (metrics._kth(d2, weight, k) == each[:, k - 1]).all()


def test_few_boxes_are_compared(spark):
    """The share of all pairs that far neighbours need falls with the number of points; near ones need a few boxes."""
    rng = random.Random(1)
    p = spark.createDataFrame([(rng.uniform(0, 1), rng.uniform(0, 1), 1) for _ in range(20_000)], "x double, y double, n long")
    ends = boxes.bounds(boxes.boxed(p), "n")
    of = range(len(ends.box))
    assert ends.weight.sum() == 20_000 and ends.weight.max() <= boxes.BOX_ROWS
    assert np.mean([len(ends.needed(q, 1000)[1]) for q in of]) < 0.4 * len(of)
    assert np.mean([len(ends.within(q, 6)) for q in of]) < 30


@pytest.mark.parametrize("size", [5, 256])
def test_neighbours_equal_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(boxes, "BOX_ROWS", size)
    monkeypatch.setattr(boxes, "SIDE", 2)
    rows = some(4, 60)
    odd = [(-1, None, 1.0), (-2, 1.0, float("nan")), (-3, float("inf"), 0.0)]
    for k in (1, 6):
        got = metrics.knn(spark.createDataFrame(rows + odd, POINTS), k).collect()
        want = {(i, at + 1): (j, math.sqrt(d2)) for i, near in plain(rows).items() for at, (d2, j) in enumerate(near[:k])}
        assert len(got) == len(want)
        assert {(r["point_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in got} == want


def test_neighbours_of_few_points(spark):
    assert metrics.knn(spark.createDataFrame([], POINTS), 3).count() == 0
    assert metrics.knn(spark.createDataFrame([(1, 0.0, 0.0)], POINTS), 3).count() == 0
    got = metrics.knn(spark.createDataFrame([(1, 0.0, 0.0), (2, -0.0, 0.0), (3, 1e200, 0.0)], POINTS), 3).collect()
    assert sorted((r["point_id"], r["rank"], r["neighbor_id"]) for r in got) == [(1, 1, 2), (2, 1, 1)]


def test_copies_of_a_place_are_not_paired(spark):
    """Of 30,000 points at one place, six go to the comparison; all get their neighbours."""
    p = spark.range(30_000).selectExpr("id AS point_id", "1.0D AS x", "2.0D AS y")
    got = metrics.knn(p, 5)
    assert "cogroup" not in got._jdf.queryExecution().toString().lower()
    assert got.where("neighbor_id > 5 or neighbor_id = point_id or distance > 0").count() == 0 and got.count() == 150_000


@pytest.mark.parametrize(("size", "few"), [(40, 2_000_000), (40, 0), (32_768, 2_000_000)])
def test_power_iteration_equals_matrix(spark, monkeypatch, size, few):
    """By blocks, sent by broadcast or by a shuffle, the vector is that of the whole matrix."""
    monkeypatch.setattr(power, "BLOCK", size)
    monkeypatch.setattr(power, "BLOCK_ROOTS", 0)
    monkeypatch.setattr(power, "BROADCAST_NUMBERS", few)
    rows = some(6, 60)
    p = spark.createDataFrame([*rows, (-1, None, 0.0)], POINTS)
    got = [{r["point_id"]: r["v"] for r in power.embedded(p, 6, rounds).collect()} for rounds in (0, 4)]
    assert len(got[0]) == len(rows) and sum(map(abs, got[0].values())) == pytest.approx(1)
    ids = sorted(got[0])
    place, near = {i: at for at, i in enumerate(ids)}, plain(rows)
    w = np.zeros((len(ids), len(ids)))
    for i in ids:
        for _, j in near[i][:6]:
            w[place[i], place[j]] += 0.5
            w[place[j], place[i]] += 0.5
    v = np.array([got[0][i] for i in ids])
    for _ in range(4):
        v = (w / w.sum(axis=1, keepdims=True)) @ v
        v = v / np.abs(v).sum()
    assert [got[1][i] for i in ids] == pytest.approx(v.tolist(), rel=1e-9)


def test_spectral_labels(spark):
    rng = random.Random(9)
    rows = [(100 * (i % 3) + i, 50.0 * (i % 3) + rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(150)]
    got = {r["point_id"]: r["label"] for r in comparators.spectral(spark.createDataFrame([*rows, (-1, None, 0.0)], POINTS), 3, 5).collect()}
    assert len(got) == 151 and got[-1] is None and {got[r[0]] for r in rows} == {0, 1, 2}
    assert comparators.spectral(spark.createDataFrame(rows[:1], POINTS), 3).first()["label"] is None
