"""The library's registered queries and, where SQL can express them, their SQL for the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions.tiles import scale_factor
from tilewright.operators import clique, comparators, metrics, slabs
from tilewright.operators import clusters as cl
from tilewright.operators import neighbors as nb
from tilewright.operators import tiles as tl
from tilewright.sources import generate, points, sinks
from tilewright.storage import shared_dir, ship


@dataclass(frozen=True)
class View:
    """Points of a table, and the parameters that suit them."""

    table: str
    x: str
    y: str
    duck_x: str
    duck_y: str
    precision: float
    threshold: int
    min_size: int
    point_id: str = ""

    def frame(self, spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        own = [F.expr(self.point_id).cast("long").alias("point_id")] if self.point_id else []
        return t.select(*own, F.expr(self.x).cast("double").alias("x"), F.expr(self.y).cast("double").alias("y"), *[F.expr(m) for m in more])

    @property
    def scalar(self) -> str:
        return f"{scale_factor(self.precision)!r}::DOUBLE"

    def sql(self, more: str = "", upto: str = "clusters") -> str:
        """CTEs: pts, tiles, sig and, with the fixpoint, clusters."""
        own = f"({self.point_id})::BIGINT AS point_id, " if self.point_id else ""
        extra = f", {more}" if more else ""
        out = f"""pts AS (SELECT {own}({self.duck_x})::DOUBLE AS x, ({self.duck_y})::DOUBLE AS y{extra} FROM {self.table}),
placed AS (SELECT *, trunc(x * {self.scalar})::BIGINT AS tx, trunc(y * {self.scalar})::BIGINT AS ty FROM pts),
tiles AS (SELECT tx, ty, count(*)::BIGINT AS n FROM placed GROUP BY tx, ty),
sig AS (SELECT tx, ty, n FROM tiles WHERE n >= {self.threshold})"""
        return out if upto == "sig" else out + ",\n" + components_sql("sig", self.min_size)


def components_sql(tiles: str, min_size: int) -> str:
    return f"""ids AS (SELECT tx, ty, row_number() OVER (ORDER BY tx, ty) AS id FROM {tiles}),
links AS (SELECT a.id AS src, b.id AS dst FROM ids a JOIN ids b ON b.tx BETWEEN a.tx - 1 AND a.tx + 1 AND b.ty BETWEEN a.ty - 1 AND a.ty + 1 AND a.id <> b.id),
reach AS (SELECT id AS root, id FROM ids UNION SELECT r.root, l.dst FROM reach r JOIN links l ON l.src = r.id WHERE l.dst > r.root),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
sized AS (SELECT root, count(*) AS size FROM comp GROUP BY root),
clusters AS (SELECT (dense_rank() OVER (ORDER BY c.root) - 1)::BIGINT AS label, i.tx, i.ty FROM comp c JOIN sized s ON s.root = c.root JOIN ids i ON i.id = c.id WHERE s.size >= {min_size})"""


EVENTS = View("events", "value", "user_id", "value", "user_id", 0, 3, 2)
PART = View("part", "p_retailprice", "p_size * 10", "p_retailprice", "p_size * 10", -1, 5, 4, "p_partkey")
CUSTOMER = View("customer", "c_acctbal", "c_nationkey * 200", "c_acctbal", "c_nationkey * 200", -2.3, 3, 2, "c_custkey")
EMBEDDINGS = View("embeddings", "embedding[0]", "embedding[1]", "embedding[1]", "embedding[2]", 1.3, 5, 4)
LINEITEM = View("lineitem", "l_extendedprice", "l_quantity * 100", "l_extendedprice", "l_quantity * 100", -2, 3, 4)

#: Tiles of a slab in the slab queries, intervals and density of the subspace queries.
SLAB_WIDTH, INTERVALS, TAU = 16, 10, 0.02

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return register


def _with(view: View, select: str, upto: str = "clusters", more: str = "", extra: str = "") -> str:
    return f"WITH {'RECURSIVE ' if upto == 'clusters' else ''}{view.sql(more, upto)}{extra}\n{select}"


# Projection and aggregation


@query("SELECT -1::DOUBLE AS precision, 0.1::DOUBLE AS scalar UNION ALL SELECT 0::DOUBLE, 1::DOUBLE UNION ALL SELECT 3.5::DOUBLE, 3162.2776601683795::DOUBLE")
def scale_factor_(spark, sf_dir):
    return spark.createDataFrame([(p, scale_factor(p)) for p in (-1.0, 0.0, 3.5)], "precision double, scalar double")


QUERIES["scale_factor"], ORACLES["scale_factor"] = QUERIES.pop("scale_factor_"), ORACLES.pop("scale_factor_")


@query(_with(CUSTOMER, "SELECT point_id, x, y, tx, ty FROM placed", "sig"))
def project_tiles(spark, sf_dir):
    return tl.project(CUSTOMER.frame(spark, sf_dir), CUSTOMER.precision)


@query(_with(LINEITEM, "SELECT tx, ty, n FROM tiles", "sig"))
def tile_counts(spark, sf_dir):
    return tl.tile_counts(LINEITEM.frame(spark, sf_dir), LINEITEM.precision)


@query(_with(EVENTS, "SELECT tx, ty FROM sig", "sig"))
def significant_tiles(spark, sf_dir):
    return tl.significant_tiles(EVENTS.frame(spark, sf_dir), EVENTS.precision, EVENTS.threshold)


@query(_with(LINEITEM, "SELECT tx, ty, n FROM sig", "sig"))
def significant_tile_counts(spark, sf_dir):
    return tl.significant_tile_counts(LINEITEM.frame(spark, sf_dir), LINEITEM.precision, LINEITEM.threshold)


@query(_with(EMBEDDINGS, "SELECT tx, ty FROM sig", "sig"))
def tile_keys(spark, sf_dir):
    return tl.significant_tile_counts(EMBEDDINGS.frame(spark, sf_dir), EMBEDDINGS.precision, EMBEDDINGS.threshold).select("tx", "ty")


@query(_with(PART, "SELECT p.tx, p.ty, p.x, p.y FROM placed p JOIN sig s ON p.tx = s.tx AND p.ty = s.ty", "sig"))
def tile_points(spark, sf_dir):
    kept = tl.significant_points(PART.frame(spark, sf_dir), PART.precision, PART.threshold)
    return tl.nested(kept, "tx", "ty").select("tx", "ty", F.explode("points").alias("p")).select("tx", "ty", "p.x", "p.y")


@query(_with(EVENTS, "SELECT p.tx, p.ty, p.x, p.y FROM placed p JOIN sig s ON p.tx = s.tx AND p.ty = s.ty", "sig"))
def significant_points(spark, sf_dir):
    return tl.significant_points(EVENTS.frame(spark, sf_dir), EVENTS.precision, EVENTS.threshold).select("tx", "ty", "x", "y")


# Adjacency and clusters

_NEAR = "SELECT a.tx, a.ty, b.tx AS nx, b.ty AS ny FROM {0} a JOIN {0} b ON b.tx BETWEEN a.tx - 1 AND a.tx + 1 AND b.ty BETWEEN a.ty - 1 AND a.ty + 1 AND (a.tx <> b.tx OR a.ty <> b.ty)"


@query(_with(EVENTS, _NEAR.format("sig"), "sig"))
def tile_neighbors(spark, sf_dir):
    return nb.edges(tl.significant_tiles(EVENTS.frame(spark, sf_dir), EVENTS.precision, EVENTS.threshold))


def _clusters(view: View, spark, sf_dir) -> DataFrame:
    return cl.clusters(view.frame(spark, sf_dir), view.precision, view.threshold, view.min_size)


@query(_with(EVENTS, "SELECT label, tx, ty FROM clusters"))
def clusters(spark, sf_dir):
    return _clusters(EVENTS, spark, sf_dir)


@query(_with(CUSTOMER, f"SELECT label + 1 AS cluster_number, tx / {CUSTOMER.scalar} AS x, ty / {CUSTOMER.scalar} AS y FROM clusters"))
def clusters_descaled(spark, sf_dir):
    return sinks.cluster_table(_clusters(CUSTOMER, spark, sf_dir), CUSTOMER.precision)


@query(_with(LINEITEM, "SELECT label, count(*)::BIGINT AS tiles FROM clusters GROUP BY label"))
def cluster_sizes(spark, sf_dir):
    return cl.cluster_sizes(_clusters(LINEITEM, spark, sf_dir))


@query(_with(PART, "SELECT count(DISTINCT label)::BIGINT AS clusters FROM clusters"))
def cluster_count(spark, sf_dir):
    return cl.cluster_count(_clusters(PART, spark, sf_dir))


@query(_with(EVENTS, "SELECT count(DISTINCT label) / 100.0::DOUBLE AS ratio FROM clusters"))
def cluster_ratio(spark, sf_dir):
    return metrics.cluster_ratio(_clusters(EVENTS, spark, sf_dir), 100)


@query(_with(EVENTS, "SELECT tx, ty FROM sig EXCEPT SELECT tx, ty FROM clusters"))
def noise_tiles(spark, sf_dir):
    return cl.noise_tiles(tl.significant_tiles(EVENTS.frame(spark, sf_dir), EVENTS.precision, EVENTS.threshold), _clusters(EVENTS, spark, sf_dir))


_LABELLED = "SELECT p.point_id, p.x, p.y, coalesce(c.label, -1)::BIGINT AS label FROM placed p LEFT JOIN clusters c ON p.tx = c.tx AND p.ty = c.ty"


def _labelled(view: View, spark, sf_dir, *more: str) -> DataFrame:
    frame = view.frame(spark, sf_dir, *more)
    return cl.label_points(frame, cl.clusters(frame, view.precision, view.threshold, view.min_size), view.precision)


@query(_with(CUSTOMER, _LABELLED))
def label_points(spark, sf_dir):
    return _labelled(CUSTOMER, spark, sf_dir).select("point_id", "x", "y", "label")


@query(_with(PART, f"SELECT * FROM ({_LABELLED}) WHERE label >= 0"))
def labelled_only(spark, sf_dir):
    return _labelled(PART, spark, sf_dir).where("label >= 0").select("point_id", "x", "y", "label")


@query(_with(EMBEDDINGS, "SELECT c.label, c.tx, c.ty, p.x, p.y FROM clusters c JOIN placed p ON p.tx = c.tx AND p.ty = c.ty"))
def clusters_prime(spark, sf_dir):
    e = EMBEDDINGS
    return cl.cluster_points(e.frame(spark, sf_dir), e.precision, e.threshold, e.min_size)


# Slabs

_SLAB = f"floor(tx / {SLAB_WIDTH}.0)::BIGINT"


def _sig(view: View, spark, sf_dir) -> DataFrame:
    return tl.significant_tiles(view.frame(spark, sf_dir), view.precision, view.threshold)


@query(_with(LINEITEM, f"SELECT tx, ty, {_SLAB} AS slab FROM sig", "sig"))
def slab_split(spark, sf_dir):
    return slabs.split(_sig(LINEITEM, spark, sf_dir), SLAB_WIDTH)


@query(_with(CUSTOMER, "SELECT tx, ty, CASE WHEN tx < 0 THEN 0 ELSE 1 END::BIGINT AS slab FROM sig", "sig"))
def slab_dual(spark, sf_dir):
    return slabs.split_dual(_sig(CUSTOMER, spark, sf_dir))


_IN_SLABS = f""",
ids AS (SELECT tx, ty, {_SLAB} AS slab, row_number() OVER (ORDER BY tx, ty) AS id FROM sig),
links AS (SELECT a.id AS src, b.id AS dst FROM ids a JOIN ids b ON a.slab = b.slab AND b.tx BETWEEN a.tx - 1 AND a.tx + 1 AND b.ty BETWEEN a.ty - 1 AND a.ty + 1 AND a.id <> b.id),
reach AS (SELECT id AS root, id FROM ids UNION SELECT r.root, l.dst FROM reach r JOIN links l ON l.src = r.id WHERE l.dst > r.root),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


@query(f"""WITH RECURSIVE {LINEITEM.sql(upto='sig')}{_IN_SLABS}
SELECT i.slab, r.tx AS rx, r.ty AS ry, count(*)::BIGINT AS tiles, bool_or(i.tx = i.slab * {SLAB_WIDTH}) AS left_edge, bool_or(i.tx = (i.slab + 1) * {SLAB_WIDTH} - 1) AS right_edge
FROM comp c JOIN ids i ON i.id = c.id JOIN ids r ON r.id = c.root GROUP BY i.slab, r.tx, r.ty""")
def slab_edge_flags(spark, sf_dir):
    return slabs.edge_flags(_sig(LINEITEM, spark, sf_dir), SLAB_WIDTH)


@query(_with(LINEITEM, f"SELECT * FROM ({_NEAR.format('sig')}) WHERE {_SLAB} <> floor(nx / {SLAB_WIDTH}.0)::BIGINT", "sig"))
def slab_border_edges(spark, sf_dir):
    return slabs.border_edges(_sig(LINEITEM, spark, sf_dir), SLAB_WIDTH)


@query(_with(EVENTS, "SELECT tx, ty FROM sig", "sig"))
def slab_union(spark, sf_dir):
    cut = slabs.split_dual(_sig(EVENTS, spark, sf_dir))
    return cut.where("slab = 0").unionByName(cut.where("slab = 1")).select("tx", "ty")


@query(_with(LINEITEM, f"SELECT {_SLAB} AS slab, count(*)::BIGINT AS tiles FROM sig GROUP BY 1", "sig"))
def slab_cover(spark, sf_dir):
    return slabs.split(_sig(LINEITEM, spark, sf_dir), SLAB_WIDTH).groupBy("slab").agg(F.count_distinct("tx", "ty").alias("tiles"))


@query(_with(LINEITEM, "SELECT label, tx, ty FROM clusters"))
def clusters_slab(spark, sf_dir):
    return slabs.clusters_slab(_sig(LINEITEM, spark, sf_dir), SLAB_WIDTH, LINEITEM.min_size)


@query(_with(CUSTOMER, "SELECT label, tx, ty FROM clusters"))
def clusters_dual(spark, sf_dir):
    return slabs.clusters_dual(_sig(CUSTOMER, spark, sf_dir), CUSTOMER.min_size)


# Subspace clustering, on normalised parts

_NORMAL = """pts AS (SELECT p_partkey::BIGINT AS point_id, p_retailprice::DOUBLE AS x, p_size::DOUBLE AS y FROM part),
ends AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM pts),
normal AS (SELECT point_id, (x - lx + 1e-5::DOUBLE) * (1.0::DOUBLE / (hx - lx + 1e-5::DOUBLE + 1e-5::DOUBLE)) AS x, (y - ly + 1e-5::DOUBLE) * (1.0::DOUBLE / (hy - ly + 1e-5::DOUBLE + 1e-5::DOUBLE)) AS y FROM pts, ends)"""
_UNIT = f"floor((({{0}} * {INTERVALS}.0::DOUBLE) % {INTERVALS}.0::DOUBLE + {INTERVALS}.0::DOUBLE) % {INTERVALS}.0::DOUBLE)::INTEGER"
_UNITS = f"{_NORMAL},\nunits AS (SELECT point_id, {_UNIT.format('x')} AS u0, {_UNIT.format('y')} AS u1 FROM normal)"
_DENSE1 = f"""{_UNITS},
one AS (SELECT dim, unit, count(*)::BIGINT AS n FROM (SELECT 0 AS dim, u0 AS unit FROM units UNION ALL SELECT 1, u1 FROM units) GROUP BY dim, unit HAVING count(*) > {TAU}::DOUBLE * (SELECT count(*) FROM units))"""
_CAND = f"{_DENSE1},\ncand AS (SELECT a.unit AS u0, b.unit AS u1 FROM one a JOIN one b ON a.dim = 0 AND b.dim = 1)"
_DENSE2 = f"""{_CAND},
two AS (SELECT u0, u1, count(*)::BIGINT AS n FROM units JOIN cand USING (u0, u1) GROUP BY u0, u1 HAVING count(*) > {TAU / 2}::DOUBLE * (SELECT count(*) FROM units))"""
_COMP2 = f"""{_DENSE2},
ids AS (SELECT u0, u1, row_number() OVER (ORDER BY u0, u1) AS id FROM two),
links AS (SELECT a.id AS src, b.id AS dst FROM ids a JOIN ids b ON abs(a.u0 - b.u0) + abs(a.u1 - b.u1) = 1),
reach AS (SELECT id AS root, id FROM ids UNION SELECT r.root, l.dst FROM reach r JOIN links l ON l.src = r.id WHERE l.dst > r.root),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
found AS (SELECT dense_rank() OVER (ORDER BY root)::INTEGER AS cluster_id, u0, u1 FROM comp JOIN ids USING (id))"""


def _parts(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("point_id"), F.col("p_retailprice").cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    return metrics.normalize_minmax(p, ["x", "y"])


def _vectors(spark, sf_dir) -> DataFrame:
    return clique.unit_vectors(_parts(spark, sf_dir), ["x", "y"], INTERVALS)


def _flat(units: DataFrame, *more: str) -> DataFrame:
    return units.select(*more, F.get("units", F.lit(0)).alias("u0"), F.get("units", F.lit(1)).alias("u1"))


def _dense_2d(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    n = v.count()
    one = clique.dense_1d(v, TAU, n)
    return clique.dense_units(v, clique.pruned(clique.candidates(one, 2), one, 2), TAU / 2, n, 2, 2)


@query(f"WITH {_UNITS}\nSELECT point_id, u0, u1 FROM units")
def clique_units(spark, sf_dir):
    return _vectors(spark, sf_dir).select("point_id", F.get("u", F.lit(0)).alias("u0"), F.get("u", F.lit(1)).alias("u1"))


@query(f"WITH {_DENSE1}\nSELECT dim, unit, n FROM one")
def clique_dense_1d(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return clique.dense_1d(v, TAU, v.count()).select(F.get("dims", F.lit(0)).alias("dim"), F.get("units", F.lit(0)).alias("unit"), "n")


@query(f"WITH {_CAND}\nSELECT u0, u1 FROM cand")
def clique_candidates_2d(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _flat(clique.candidates(clique.dense_1d(v, TAU, v.count()), 2))


@query(f"WITH {_CAND}\nSELECT u0, u1 FROM cand")
def clique_pruned_2d(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    one = clique.dense_1d(v, TAU, v.count())
    return _flat(clique.pruned(clique.candidates(one, 2), one, 2))


@query(f"WITH {_DENSE2}\nSELECT u0, u1, n FROM two")
def clique_dense_2d(spark, sf_dir):
    return _flat(_dense_2d(spark, sf_dir), "n")


@query(f"WITH {_DENSE2}\nSELECT a.u0, a.u1, b.u0 AS v0, b.u1 AS v1 FROM two a JOIN two b ON (b.u0 = a.u0 + 1 AND b.u1 = a.u1) OR (b.u0 = a.u0 AND b.u1 = a.u1 + 1)")
def clique_edges_2d(spark, sf_dir):
    e = clique.face_edges(_dense_2d(spark, sf_dir), 2)
    return e.select(*[F.get(f"{s}.units", F.lit(i)).alias(f"{s}{i}") for s in "uv" for i in (0, 1)])


def _clusters_2d(spark, sf_dir) -> DataFrame:
    out = clique.clusters_of(_dense_2d(spark, sf_dir), 2)
    return out.withColumn("cluster_id", F.dense_rank().over(Window.orderBy("root")))  # a row for each dense unit


@query(f"WITH RECURSIVE {_COMP2}\nSELECT cluster_id, u0, u1 FROM found")
def clique_clusters_2d(spark, sf_dir):
    return _flat(_clusters_2d(spark, sf_dir), "cluster_id")


@query(f"WITH RECURSIVE {_COMP2}\nSELECT cluster_id, point_id FROM units JOIN found USING (u0, u1)")
def clique_cluster_points(spark, sf_dir):
    return clique.cluster_points(_vectors(spark, sf_dir), _clusters_2d(spark, sf_dir).select("cluster_id", "dims", "units"), 2)


@query(f"""WITH RECURSIVE {_DENSE1},
two AS (SELECT u0, u1 FROM units GROUP BY u0, u1 HAVING count(*) > {TAU}::DOUBLE * (SELECT count(*) FROM units)),
dense AS (SELECT 1 AS k, dim AS d0, unit AS u0, -1 AS u1 FROM one UNION ALL SELECT 2, 0, two.u0, two.u1 FROM two JOIN one a ON a.dim = 0 AND a.unit = two.u0 JOIN one b ON b.dim = 1 AND b.unit = two.u1),
ids AS (SELECT *, row_number() OVER (ORDER BY k, d0, u0, u1) AS id FROM dense),
links AS (SELECT a.id AS src, b.id AS dst FROM ids a JOIN ids b ON a.k = b.k AND a.d0 = b.d0 AND abs(a.u0 - b.u0) + abs(a.u1 - b.u1) = 1),
reach AS (SELECT id AS root, id FROM ids UNION SELECT r.root, l.dst FROM reach r JOIN links l ON l.src = r.id WHERE l.dst > r.root),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT dense_rank() OVER (ORDER BY root)::INTEGER AS cluster_id, k::INTEGER AS k, d0::INTEGER AS d0, u0::INTEGER AS u0, u1::INTEGER AS u1 FROM comp JOIN ids USING (id)""")
def clique_all(spark, sf_dir):
    out = clique.run(_parts(spark, sf_dir), ["x", "y"], INTERVALS, TAU)
    return out.select("cluster_id", F.size("dims").alias("k"), F.get("dims", F.lit(0)).alias("d0"), F.get("units", F.lit(0)).alias("u0"), F.coalesce(F.get("units", F.lit(1)), F.lit(-1)).alias("u1"))


# Normalisation and quality


@query(f"WITH {_NORMAL}\nSELECT point_id, round(x, 9) AS x, round(y, 9) AS y FROM normal")
def normalize_minmax(spark, sf_dir):
    return _parts(spark, sf_dir).select("point_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(_with(CUSTOMER, "SELECT point_id, round((x - (SELECT avg(x) FROM pts)) / (SELECT stddev_pop(x) FROM pts), 6) AS x, round((y - (SELECT avg(y) FROM pts)) / (SELECT stddev_pop(y) FROM pts), 6) AS y FROM pts", "sig"))
def standardize(spark, sf_dir):
    return metrics.standardize(CUSTOMER.frame(spark, sf_dir), ["x", "y"]).select("point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_with(PART, "SELECT point_id, round(x * 0.6::DOUBLE + y * (-0.4)::DOUBLE, 6) AS x, round(x * (-0.6)::DOUBLE + y * 0.8::DOUBLE, 6) AS y FROM pts", "sig"))
def linear_transform(spark, sf_dir):
    return metrics.linear_transform(PART.frame(spark, sf_dir), [[0.6, -0.6], [-0.4, 0.8]]).select("point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_with(CUSTOMER, """SELECT round(avg(CASE WHEN size = 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END), 6) AS silhouette
FROM (SELECT point_id, max(size) FILTER (other = label) AS size, max(total / nullif(size - 1, 0)) FILTER (other = label) AS a, min(total / size) FILTER (other <> label) AS b FROM each JOIN sizes USING (other) GROUP BY point_id)""", extra=f""",
labelled AS (SELECT * FROM ({_LABELLED}) WHERE label >= 0),
sizes AS (SELECT label AS other, count(*) AS size FROM labelled GROUP BY label),
each AS (SELECT p.point_id, p.label, q.label AS other, sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS total FROM labelled p, labelled q GROUP BY p.point_id, p.label, q.label)"""))
def silhouette(spark, sf_dir):
    return metrics.silhouette(_labelled(CUSTOMER, spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


_TRUTH = """,
lab AS (SELECT p.truth, coalesce(c.label, -1) + 1 AS cluster FROM placed p LEFT JOIN clusters c ON p.tx = c.tx AND p.ty = c.ty),
cells AS (SELECT truth, cluster, count(*)::DOUBLE AS n FROM lab GROUP BY truth, cluster),
ts AS (SELECT truth, sum(n) AS m FROM cells GROUP BY truth), cs AS (SELECT cluster, sum(n) AS m FROM cells GROUP BY cluster),
s AS (SELECT (SELECT sum(n) FROM cells) AS n, (SELECT sum(n * (n - 1) / 2) FROM cells) AS s, (SELECT sum(m * (m - 1) / 2) FROM ts) AS t, (SELECT sum(m * (m - 1) / 2) FROM cs) AS c,
  (SELECT sum(n * ln(n)) FROM cells) AS e, (SELECT sum(m * ln(m)) FROM ts) AS te, (SELECT sum(m * ln(m)) FROM cs) AS ce),
i AS (SELECT *, ln(n) - te / n AS ht, ln(n) - ce / n AS hc, ln(n) - te / n + ln(n) - ce / n - ln(n) + e / n AS mi FROM s),
r AS (SELECT (s - t * c / (n * (n - 1) / 2)) / ((t + c) / 2 - t * c / (n * (n - 1) / 2)) AS ari, CASE WHEN abs(ht) < 1e-12 THEN 1 ELSE mi / ht END AS h, CASE WHEN abs(hc) < 1e-12 THEN 1 ELSE mi / hc END AS k, s / sqrt(t * c) AS fmi FROM i)"""


def _truth(spark, sf_dir) -> DataFrame:
    return _labelled(CUSTOMER, spark, sf_dir, "c_nationkey AS truth").select("truth", (F.col("label") + 1).alias("cluster"))


@query(_with(CUSTOMER, "SELECT round(ari, 6) + 0.0::DOUBLE AS ari, round(h, 6) + 0.0::DOUBLE AS homogeneity, round(k, 6) + 0.0::DOUBLE AS completeness, round(2 * h * k / (h + k), 6) + 0.0::DOUBLE AS v_measure, round(fmi, 6) + 0.0::DOUBLE AS fmi FROM r", more="c_nationkey AS truth", extra=_TRUTH))
def validity_scores(spark, sf_dir):
    return metrics.validity_scores(_truth(spark, sf_dir)).select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("ari", "homogeneity", "completeness", "v_measure", "fmi")])


@query(_with(CUSTOMER, "SELECT round((mi - x) / ((ht + hc) / 2 - x), 6) + 0.0::DOUBLE AS ami FROM i, emi", more="c_nationkey AS truth", extra=_TRUTH + """,
emi AS (SELECT sum(k / i.n * ln(i.n * k / (ts.m * cs.m)) * exp(lgamma(ts.m + 1) + lgamma(cs.m + 1) + lgamma(i.n - ts.m + 1) + lgamma(i.n - cs.m + 1) - lgamma(i.n + 1) - lgamma(k + 1.0) - lgamma(ts.m - k + 1) - lgamma(cs.m - k + 1) - lgamma(i.n - ts.m - cs.m + k + 1))) AS x
  FROM ts, cs, i, unnest(generate_series(greatest(1, (ts.m + cs.m - i.n)::BIGINT), least(ts.m, cs.m)::BIGINT)) AS g(k))"""))
def validity_ami(spark, sf_dir):
    return metrics.adjusted_mutual_information(_truth(spark, sf_dir)).select((F.round("ami", 6) + F.lit(0.0)).alias("ami"))


@query("""SELECT point_id, rank, neighbor_id, round(sqrt(d2), 6) AS distance FROM (
  SELECT p.c_custkey::BIGINT AS point_id, q.c_custkey::BIGINT AS neighbor_id,
    (p.c_acctbal::DOUBLE - q.c_acctbal::DOUBLE) * (p.c_acctbal::DOUBLE - q.c_acctbal::DOUBLE) + (p.c_nationkey * 200 - q.c_nationkey * 200)::DOUBLE * (p.c_nationkey * 200 - q.c_nationkey * 200)::DOUBLE AS d2,
    row_number() OVER (PARTITION BY p.c_custkey ORDER BY d2, q.c_custkey)::INTEGER AS rank
  FROM customer p JOIN customer q ON p.c_custkey <> q.c_custkey) WHERE rank <= 5""")
def knn_graph(spark, sf_dir):
    return metrics.knn(CUSTOMER.frame(spark, sf_dir), 5).select("point_id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"))


@query("SELECT l_returnflag AS algorithm, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(coalesce(stddev_samp(l_quantity), 0), 6) AS stdev, count(*)::BIGINT AS runs FROM lineitem GROUP BY l_returnflag")
def bench_stats(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("algorithm"), F.col("l_quantity").cast("double").alias("seconds"))
    out = metrics.bench_stats(runs, "algorithm")
    return out.select("algorithm", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")], "runs")


@query("""WITH RECURSIVE p AS (SELECT p_partkey::BIGINT AS point_id, p_retailprice::DOUBLE AS x, p_size::DOUBLE * 10 AS y FROM part),
near AS (SELECT a.point_id AS a, b.point_id AS b FROM p a JOIN p b ON abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 16),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4),
links AS (SELECT n.a AS src, n.b AS dst FROM near n JOIN core c ON c.a = n.a JOIN core d ON d.a = n.b WHERE n.a <> n.b),
reach AS (SELECT a AS root, a AS id FROM core UNION SELECT r.root, l.dst FROM reach r JOIN links l ON l.src = r.id WHERE l.dst > r.root),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
border AS (SELECT n.b AS id, min(c.root) AS root FROM near n JOIN comp c ON c.id = n.a GROUP BY n.b)
SELECT p.point_id, (core.a IS NOT NULL) AS is_core, coalesce(comp.root, border.root, -1)::BIGINT AS label
FROM p LEFT JOIN core ON core.a = p.point_id LEFT JOIN comp ON comp.id = p.point_id LEFT JOIN border ON border.id = p.point_id""")
def dbscan_members(spark, sf_dir):
    p = PART.frame(spark, sf_dir)
    out = comparators.dbscan(p, 4.0, 4)
    near = comparators.core_points(p, 4.0, 4)
    return out.join(near.withColumn("core", F.lit(True)), "point_id", "left").select("point_id", F.coalesce("core", F.lit(False)).alias("is_core"), "label")


@query("""SELECT round(avg(sqrt(d2)), 6) AS bandwidth FROM (
  SELECT (p.c_acctbal::DOUBLE - q.c_acctbal::DOUBLE) * (p.c_acctbal::DOUBLE - q.c_acctbal::DOUBLE) + (p.c_nationkey * 200 - q.c_nationkey * 200)::DOUBLE * (p.c_nationkey * 200 - q.c_nationkey * 200)::DOUBLE AS d2,
    row_number() OVER (PARTITION BY p.c_custkey ORDER BY d2, q.c_custkey) AS rank
  FROM customer p JOIN customer q ON p.c_custkey <> q.c_custkey) WHERE rank = (SELECT floor(count(*) * 0.05::DOUBLE)::BIGINT - 1 FROM customer)""")
def bandwidth(spark, sf_dir):
    return metrics.estimate_bandwidth(CUSTOMER.frame(spark, sf_dir), 0.05).select(F.round("bandwidth", 6).alias("bandwidth"))


# Sources: what is written is read again


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(_with(PART, "SELECT x, y FROM pts", "sig"))
def scan_points_csv(spark, sf_dir):
    path = _folder(spark, "points-csv")
    PART.frame(spark, sf_dir).select("x", "y").write.csv(path)
    return points.read_csv(spark, path)


@query(_with(PART, "SELECT x, y FROM pts", "sig"))
def scan_points_arff(spark, sf_dir):
    path = _folder(spark, "points-arff")
    head = spark.createDataFrame([(x,) for x in ("% points", "@relation points", "@attribute x numeric", "@attribute y numeric", "@data", "")], "value string")
    lines = PART.frame(spark, sf_dir).select(F.concat_ws(",", "x", "y").alias("value"))
    head.unionByName(lines).write.text(path)
    return points.read_arff(spark, path)


@query("SELECT p_retailprice::DOUBLE AS f0, p_size::DOUBLE AS f1, substr(p_brand, 1, 10) AS label FROM part")
def scan_features(spark, sf_dir):
    path = _folder(spark, "features")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(";", "p_retailprice", "p_size", "p_brand").alias("value"))
    spark.createDataFrame([("## features",)], "value string").unionByName(part).write.text(path)
    return points.read_features(spark, path, [0, 1], 2, sep=";")


@query()
def gen_points(spark, sf_dir):
    return generate.grouped(spark, 100)


@query()
def gen_points_grid(spark, sf_dir):
    return generate.on_grid(spark, 100)


@query()
def gen_toy(spark, sf_dir):
    kinds = ("circles", "moons", "blobs", "varied", "aniso", "uniform")
    out = None
    for k in kinds:
        one = generate.toy(spark, k).withColumn("kind", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def kmeans(spark, sf_dir):
    return comparators.kmeans(PART.frame(spark, sf_dir), 8)


@query()
def gaussian_mixture(spark, sf_dir):
    return comparators.gaussian_mixture(PART.frame(spark, sf_dir), 4)


@query()
def hierarchical(spark, sf_dir):
    return comparators.hierarchical(PART.frame(spark, sf_dir), 8)


@query()
def birch(spark, sf_dir):
    return comparators.birch(PART.frame(spark, sf_dir), 8, 20.0)


@query()
def mean_shift(spark, sf_dir):
    return comparators.mean_shift(PART.frame(spark, sf_dir), 200.0)


@query()
def spectral(spark, sf_dir):
    return comparators.spectral(PART.frame(spark, sf_dir), 4)
