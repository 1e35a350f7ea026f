import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions.tiles import scale_factor
from tilewright.operators import clusters as cl
from tilewright.operators import neighbors as nb
from tilewright.operators import slabs
from tilewright.operators import tiles as tl
from tilewright.plans.estimators import TileClusterer
from tilewright.sources import points as src


def frame(spark, rows):
    return spark.createDataFrame([(float(x), float(y)) for x, y in rows], "x double, y double")


def tiles_of(spark, rows):
    return spark.createDataFrame(rows, "tx long, ty long")


def partition(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["label"], set()).add((r["tx"], r["ty"]))
    return sorted(sorted(x) for x in out.values())


def test_projection_truncates_towards_zero(spark):
    got = tl.project(frame(spark, [(-0.05, 0.05), (1.05, 23.28), (-2.7, 2.7)]), 1).select("tx", "ty").collect()
    assert [tuple(r) for r in got] == [(0, 0), (10, 232), (-27, 27)]


def test_threshold_is_inclusive(spark):
    p = frame(spark, [(1, 23.22), (1.05, 23.28)])
    assert [tuple(r) for r in tl.significant_tiles(p, 1, 2).collect()] == [(10, 232)]
    assert tl.significant_tiles(p, 1, 3).collect() == []
    assert scale_factor(1) == 10.0


def test_invalid_points(spark):
    p = frame(spark, [(math.nan, 1), (1e300, 1), (1, 1)])
    assert tl.tile_counts(p, 0, "drop").count() == 1
    with pytest.raises(Exception):
        tl.tile_counts(p, 0).collect()
    with pytest.raises(ValueError):
        tl.tile_counts(p, 0, "other")


def plain_clusters(tiles, min_size):
    """Connected tiles, by flooding."""
    left, out = set(tiles), []
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            x, y = todo.pop()
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            found |= near
            todo += near
        if len(found) >= min_size:
            out.append(sorted(found))
    return sorted(out)


def test_neighbours_equal_plain_python(spark):
    rng = random.Random(9)
    rows = sorted({(rng.randrange(-5, 5), rng.randrange(-5, 5)) for _ in range(40)})
    got = {((r["tx"], r["ty"]), (r["nx"], r["ny"])) for r in nb.edges(tiles_of(spark, rows)).collect()}
    assert got == {(a, b) for a in rows for b in rows if a != b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1}
    assert nb.edges(tiles_of(spark, rows[:1])).count() == 0


#: An L of three tiles that touch at corners and sides, a bar of four, and one alone.
SHAPES = [(-3, 7), (-2, 8), (-2, 9), (10, -4), (11, -4), (12, -5), (13, -4), (30, 30)]


def test_shapes_make_their_clusters(spark):
    for size, clusters in ((1, 3), (2, 2), (4, 1), (5, 0)):
        got = partition(cl.cluster_tiles(tiles_of(spark, SHAPES), size))
        assert got == plain_clusters(SHAPES, size) and len(got) == clusters
    assert cl.cluster_tiles(tiles_of(spark, []), 1).count() == 0


def test_a_cluster_that_joins_two_borders_keeps_all_its_tiles(spark):
    """A bar through a slab of width 2, touched from both sides, is one cluster; from one side it is too small."""
    bar, left, right = [(4, 0), (5, 0)], [(3, 1), (2, 1)], [(6, -1), (7, -1)]
    for tiles, size in ((bar + left + right, 6), (bar + left, 5), (bar + right, 4)):
        for found in (slabs.clusters_slab(tiles_of(spark, tiles), 2, size), slabs.clusters_dual(tiles_of(spark, tiles), size)):
            assert partition(found) == plain_clusters(tiles, size)


def test_slabs_cover_all_tiles_once(spark):
    rng = random.Random(11)
    rows = sorted({(rng.randrange(-40, 40), rng.randrange(-3, 3)) for _ in range(150)})
    got = slabs.split(tiles_of(spark, rows), 7).collect()
    assert sorted((r["tx"], r["ty"]) for r in got) == rows and all(r["slab"] == r["tx"] // 7 for r in got)


def test_slabs_equal_the_whole(spark, monkeypatch):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(-12, 12), rng.randrange(-6, 6)) for _ in range(120)})
    t = tiles_of(spark, rows)
    want = partition(cl.cluster_tiles(t, 3))
    for width in (1, 5):
        assert partition(slabs.clusters_slab(t, width, 3)) == want
    assert partition(slabs.clusters_dual(t, 3)) == want
    monkeypatch.setattr(cl, "ONE_BLOCK_TILES", 0)
    monkeypatch.setattr(cl, "BLOCK_SIDE", 4)
    assert partition(cl.cluster_tiles(t, 3)) == want


def test_u_shape_touches_a_border_twice(spark):
    u = [(-2, 0), (-1, 0), (0, 0), (-2, 4), (-1, 4), (0, 4)] + [(1, y) for y in range(5)]
    assert len(partition(slabs.clusters_dual(tiles_of(spark, u), 1))) == 1


def test_labels_are_ranked_by_their_smallest_tile(spark):
    got = cl.cluster_tiles(tiles_of(spark, SHAPES), 2).groupBy("label").agg(F.min(F.struct("tx", "ty")).alias("m")).orderBy("label").collect()
    assert [(r["label"], tuple(r["m"])) for r in got] == [(0, (-3, 7)), (1, (10, -4))]


@pytest.mark.parametrize("precision", [3, 3.5, 4, 5])
@pytest.mark.parametrize("min_size", [4, 5])
def test_points_of_one_group(spark, resources, precision, min_size):
    from collections import Counter

    rows = [tuple(map(float, line.split(","))) for line in (resources / "one_group.csv").read_text().split()]
    tile = lambda r: tuple(math.trunc(v * scale_factor(precision)) for v in r)
    counts = Counter(map(tile, rows))
    want = plain_clusters([t for t, n in counts.items() if n >= 5], min_size)
    inside = {t for c in want for t in c}
    p = src.check_size(src.read_csv(spark, str(resources / "one_group.csv")), 1)
    assert tl.tile_counts(p, precision).count() == len(counts)
    assert tl.significant_tiles(p, precision, 5).count() == sum(n >= 5 for n in counts.values())
    model = TileClusterer(precision, 5, min_size).fit(p)
    assert model.labels.count() == len(inside) and partition(model.labels.select("label", "tx", "ty")) == want
    got = model.transform(p)
    assert got.count() == 500 and got.where("label >= 0").count() == sum(tile(r) in inside for r in rows)
    assert cl.cluster_points(p, precision, 5, min_size).count() == sum(tile(r) in inside for r in rows)


def test_order_and_copies_do_not_matter(spark, resources):
    p = src.read_csv(spark, str(resources / "one_group.csv"))
    one = partition(cl.clusters(p, 4, 5, 4))
    assert partition(cl.clusters(p.orderBy(F.rand(5)).repartition(7), 4, 5, 4)) == one
    swapped = cl.clusters(p.select(F.col("y").alias("x"), F.col("x").alias("y")), 4, 5, 4)
    assert [sorted((y, x) for x, y in c) for c in partition(swapped)] == one


def test_dataset_size_check(spark):
    with pytest.raises(ValueError):
        src.check_size(frame(spark, [(1, 1)]), 1)
