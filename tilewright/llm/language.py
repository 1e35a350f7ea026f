"""Language identification by Bayesian fusion of evidence.

* Text: log-likelihoods of hashed byte n-grams under a model of each language, trained on a bounded sample
  of the documents of that language. Every language of the documents has a model. Neighbouring n-grams overlap, so their sum is divided by their length.
* Declared markup language: right with a rate that is estimated over all pages from its agreement with the
  text's own verdict; a wrong one is any other language alike.
* Address: for each host, the text's own posteriors are summed over its pages; a host's prior is smoothed
  towards its suffix's (what follows the last dot), and that towards all pages' by Dirichlet weights. A page's own
  posterior is taken out of the sums, so no text counts twice.

The sums are grouped aggregations over all rows; hosts are joined, never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.maintext import BlockField, main_text, trained_field
from tilewright.llm.textscore import GRAM, SLOTS_BITS, gram_rows, mean_scores, slots
from tilewright.llm.words import flat_bytes, give_back, slices
from tilewright.storage import hinted, materialize

#: Documents, about, of each language that its text model is trained on.
SAMPLE_DOCS = 5000
#: Numbers that a table of priors may hold if it is broadcast.
BROADCAST_NUMBERS = 2_000_000
#: Pages that a prior further up counts as.
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 5.0
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def language_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in order and, for each, the log-probabilities of the slots.

    A language of at most ``sample_docs`` documents is trained on all of them, however many others there are.
    """
    sizes = materialize(docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count(), "languages")
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    code = {x: k for k, x in enumerate(languages)}
    drawn = F.pmod("draw", F.lit(1 << 40)) < F.lit(float(sample_docs)) / F.col("count") * F.lit(float(1 << 40))
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    known = texts.join(F.broadcast(sizes), "lang").where(drawn).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat_bytes(part.column("text"))
                at = slots(data, fold=True)
                for lang, a, b in zip(part.column("lang").to_pylist(), *(x.tolist() for x in gram_rows(offsets))):
                    k = code[lang]
                    if k not in total:
                        total[k] = np.zeros(1 << SLOTS_BITS, np.int64)
                    total[k] += np.bincount(at[a:b], minlength=1 << SLOTS_BITS)
        for k, counts in total.items():
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), k, np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[slot])], ["lang", "slot", "n"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.full(1 << SLOTS_BITS, 0.5)
                counts[row["slots"]] += row["ns"]
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]], pa.int32()), pa.array([np.log(counts / counts.sum()).astype(np.float32).tobytes()])], ["lang", "log"])

    out = np.full((len(languages), 1 << SLOTS_BITS), -np.log(1 << SLOTS_BITS), np.float32)
    counted = known.mapInArrow(run, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    grouped = counted.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("all")).select("lang", F.col("all.slot").alias("slots"), F.col("all.n").alias("ns"))
    for r in grouped.mapInArrow(model, "lang int, log binary").toLocalIterator():  # a row for each language
        out[r["lang"]] = np.frombuffer(r["log"], np.float32)
    return languages, out


def by_text(table: DataFrame, models: np.ndarray, languages: list[str], field: BlockField | None) -> DataFrame:
    """``table`` (key, host, declared, text) with ``log``: log-likelihoods of the languages over that of the likeliest;
    ``table`` may have html in place of text, where ``field`` is given."""
    schema = T.StructType([table.schema["key"], table.schema["host"], *T.StructType.fromDDL("declared string, log array<float>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, declared = part.column("text"), part.column("declared")
                if field is not None:
                    pages = text.to_pylist()
                    found = [_DECLARED.search(p or "") for p in pages]
                    declared = pa.array([m[1].lower() if m else None for m in found], pa.string())
                    text = pa.array([main_text(p, field) for p in pages], pa.string())
                data, offsets = flat_bytes(text)
                mean, size = mean_scores(data, offsets, models, fold=True)
                log = mean * (size / GRAM)[:, None]
                log = (log - log.max(axis=1, keepdims=True)).astype(np.float32) if log.size else log.astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("host"), declared, pa.array(list(log), pa.list_(pa.float32()))], schema.names)
        give_back()

    return table.mapInArrow(run, schema)


def identify(table: DataFrame, languages: list[str]) -> DataFrame:
    """``(key, lang, posterior, text_lang, declared)`` from rows (key, host, declared, log).

    A null host has the prior of all rows. A declared language without a model says nothing. A row without
    text is decided by its declaration and host. Ties go to the first language in order.
    """
    k = len(languages)
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    rows = materialize(table.select("key", "host", F.substring_index("host", ".", -1).alias("suffix"), "declared", F.col("log").cast("array<double>").alias("log")), "by-text")
    rows = rows.withColumn("text_lang", F.get(names, (F.array_position("log", F.array_max("log")) - 1).cast("int")))
    e = F.transform("log", lambda x: F.exp(x - F.array_max("log")))
    rows = rows.withColumn("__e", e).withColumn("__sum", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("own", F.transform("__e", lambda x: x / F.col("__sum"))).drop("__e", "__sum")
    sums = [F.sum(F.get("own", F.lit(i))) for i in range(k)]
    # what suffixes and all rows sum to follows from the sums by host, a row for each
    counts = [F.count("*").alias("n"), F.sum((F.col("declared") == F.col("text_lang")).cast("long")).alias("agree"), F.sum(F.array_contains(names, F.col("declared")).cast("long")).alias("declared")]
    hosts = materialize(rows.groupBy("host", "suffix").agg(F.array(*sums).cast("array<double>").alias("by_host"), *counts), "hosts")
    add = [F.sum(F.get("by_host", F.lit(i))) for i in range(k)]
    totals = hosts.agg(F.sum("agree").alias("agree"), F.sum("declared").alias("declared"), F.array(*add).cast("array<double>").alias("sums")).first()
    right = ((totals["agree"] or 0) + 1) / ((totals["declared"] or 0) + 2)
    wrong = (1 - right) / max(k - 1, 1)
    everywhere = [(x or 0.0) + 1.0 for x in totals["sums"]]
    everywhere = [x / sum(everywhere) for x in everywhere]
    suffixes = materialize(hosts.where("suffix is not null").groupBy("suffix").agg(F.array(*add).cast("array<double>").alias("by_suffix")), "suffixes")
    few = max(1, BROADCAST_NUMBERS // max(k, 1))
    known = hosts.where("host is not null").select(F.col("host").alias("at_host"), "suffix", "by_host").join(hinted(suffixes, few), "suffix").drop("suffix")
    if hosts.count() <= few // 2:
        known = F.broadcast(known)
    # rows without a host match none: dealt by their key, they don't meet in one task; hot hosts are split as skewed
    at_host = F.coalesce("host", F.concat(F.lit("\x00"), F.pmod(F.xxhash64("key", "log"), F.lit(1024)).cast("string")))
    joined = rows.withColumn("at_host", at_host).join(known, "at_host", "left")

    def smoothed(column: str, weight: float, above):
        sums = F.coalesce(column, F.array_repeat(F.lit(0.0), k))
        less = F.zip_with(sums, "own", lambda s, o: F.greatest(F.lit(0.0), F.coalesce(s - o, F.lit(0.0))))  # without the row itself
        return F.aggregate(less, F.lit(0.0), lambda a, x: a + x, lambda total: F.zip_with(less, above, lambda x, p: (x + weight * p) / (total + weight)))

    if k:
        joined = joined.withColumn("p", smoothed("by_suffix", SUFFIX_WEIGHT, F.array(*[F.lit(x) for x in everywhere])))
        joined = joined.withColumn("p", smoothed("by_host", HOST_WEIGHT, F.col("p")))
        joined = joined.withColumn("at", F.coalesce(F.array_position(names, F.col("declared")), F.lit(0)))
        says = lambda i: F.when(F.col("at") == 0, 0.0).when(F.col("at") == i + 1, float(np.log(right))).otherwise(float(np.log(max(wrong, 1e-12))))
        fused = F.transform(F.zip_with("log", "p", lambda x, p: x + F.ln(p)), lambda x, i: x + says(i))
    else:
        fused = F.array().cast("array<double>")
    joined = joined.withColumn("fused", fused).withColumn("best", F.array_max("fused"))
    weight = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return joined.select("key", F.get(names, (F.array_position("fused", F.col("best")) - 1).cast("int")).alias("lang"), F.round(1.0 / weight, 6).alias("posterior"), "text_lang", "declared")


def digest(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each page and each document: page_id or doc_id, lang, posterior, text_lang, declared.

    A page's text is its main text; a document has no address and no markup, and its source is its host. Null
    text, html and urls are no evidence. Repeated rows are judged alike. Without documents of known language
    there is no language to tell, and lang is null.
    """
    languages, models = language_models(docs)
    host = F.lower(F.nullif(F.regexp_extract("url", r"://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    web = pages.select(F.struct(F.lit(None).cast("long").alias("doc_id"), "page_id").alias("key"), host.alias("host"), F.lit(None).cast("string").alias("declared"), F.col("html").alias("text"))
    plain = docs.select(F.struct("doc_id", F.lit(None).cast("long").alias("page_id")).alias("key"), F.concat(F.col("source"), F.lit(".source")).alias("host"), F.lit(None).cast("string").alias("declared"), "text")
    rows = by_text(web, models, languages, trained_field()).unionByName(by_text(plain, models, languages, None))
    return identify(rows, languages).select("key.*", "lang", "posterior", "text_lang", "declared")
