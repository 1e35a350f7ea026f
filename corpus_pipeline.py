"""Corpus pipeline over documents: rules, near copies, repeated strings, source mix, sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of ``documents``, and any others that ``docs`` has, whatever they are called. Between stages the
rows are written as Parquet and read again, so a lost executor costs no more than the stage it was in. Every stage
gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import mixing, nearcopies, packing, quality, repeats
from tilewright.storage import discard, materialize, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or pass a risk-controlled cutoff go.

    A null or empty text fails the base rule. A null language is a stratum of its own. Repeated rows are judged alike.
    """
    ship(spark)
    return quality.only_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id stays.

    SimHash by bit-sliced comparison rules out, the exact similarity decides. Texts without a word are one group. Of rows
    that repeat id and text one stays; rows without an id stay, and their texts count for the groups of others.
    """
    ship(spark)
    return nearcopies.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occur twice go from the texts; every row stays.

    A null text stays null, and an empty or short one as it is. Repeated rows repeat each other's strings.
    """
    ship(spark)
    return repeats.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null or empty text has size 0. A null source is the last one. Rows with the same id, or none, draw alike.
    """
    ship(spark)
    return mixing.repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048.

    A null or empty text is its end id alone. Repeated rows keep pieces and places of their own.
    """
    ship(spark)
    return packing.packed(docs, "word_bpe_49k.json", length=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
