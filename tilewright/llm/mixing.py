"""Mixing sources to target weights.

Tokens are summed by source; weights and a limit on repetition give each source a target, and target over
size its rate. Each document is taken floor(rate) times, and once more with the fraction's probability by
a hash of its id, so a rerun takes the same documents. Only the table of sources is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.storage import materialize

#: No source is taken more often than this.
MOST_REPEATS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A table of up to so many sources is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def token_count(text: Column) -> Column:
    """Words of a text, runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``(source, source_size, target)``, one row for each row of ``sizes`` (source, source_size).

    Weights go to the sources in the order of their code points, null last. A target stops at ``most``
    times its source's size; the excess goes to the others by weight until none is above. Sources reach
    their limit in the order of limit over weight, so the level at which the rest share is a running sum.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.cast("long").alias("weight"))
    t = t.withColumn("ratio", (most * F.col("source_size")).cast("double") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    t = t.select(
        "*",
        F.sum("source_size").over(everywhere).alias("total"),
        F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)).alias("full"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("sharing"),
    )
    level = (F.col("total") - F.col("full")).cast("double") / F.col("sharing")
    first_open = F.min(F.when(level <= F.col("ratio"), F.struct("ratio", level.alias("level")))).over(everywhere)["level"]
    t = t.withColumn("level", first_open)
    target = F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _chance(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: 48 bits of the MD5 of "seed:id"."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs``, or all, as ``row``, with ``size``, ``source_size``, ``target`` and ``copies``.

    Null text has no words. A null source is a source, the last one. Rows with the same id draw alike, as
    do all rows with a null id. A source without words has target zero and none of its rows is taken. An
    empty table gives an empty result.
    """
    kept = docs.columns if keep is None else keep
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), docs[f"`{source_col}`"].alias("source"), docs[f"`{id_col}`"].alias("id"), token_count(docs[f"`{text_col}`"]).alias("size"))
    if text_col not in kept:  # rows without their texts: written once, so that words are counted once
        sized = materialize(sized, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = materialize(targets(sizes, weights, most).withColumnRenamed("source", "__source"), "targets")
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    out = sized.join(t, sized.source.eqNullSafe(t.__source), "left")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(_chance(F.col("id"), seed) < rate - whole, 1).otherwise(0)).cast("int")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    out = mixed(docs, keep=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    out = mixed(docs, seed=seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sizes
), ratios AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS ratio FROM weighed
), sums AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_size,
    (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS sharing
  FROM ratios
), levels AS (
  SELECT *, (total - full_size)::DOUBLE / sharing AS own_level FROM sums
), targets AS (
  SELECT source, source_size, coalesce(least((3 * source_size)::DOUBLE,
    (SELECT own_level FROM levels WHERE own_level <= ratio ORDER BY ratio, own_level LIMIT 1) * weight), 0.0) AS target
  FROM levels
), rates AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS rate,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS chance
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates
"""
