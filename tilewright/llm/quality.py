"""Quality rules whose cutoffs limit the risk of rejecting good documents.

Base statistics are counted over whole texts. On top of the fixed base rule, each ratio rule rejects a
document whose ratio passes a cutoff. Cutoffs come from labelled documents: within a stratum (language), a
sequence of vectors, a cutoff for each rule, is tested from the loosest to the tightest, and a vector holds
while the exact binomial test rejects, at its level, that all rules together would lose more than ``risk`` of
the good documents. Testing in a fixed order needs no correction; over strata the level is divided
(Bonferroni). So with probability 1 - ``delta`` no stratum loses more than ``risk``.

The sequence must not depend on the documents it is tested on. Where a stratum has labels enough for two tests,
half of them (by a hash of the id) set the sequence, so that at each step every rule alone would lose the same
share of that half, and the other half tests it. With fewer, all rules have the same cutoff of the grid, and
all labels test. Below about log(level) / log(1 - risk) labels no cutoff can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.words import flat_bytes, give_back, per_row, slices, split_words
from tilewright.storage import BROADCAST_ROWS, discard, hinted, materialize

#: Allowed share of good documents rejected in a stratum, and the probability of a cutoff set wrong.
RISK, DELTA = 0.05, 0.05
#: Texts are counted in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 2 << 20
#: Bounds of the base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Ratio rules: name, numerator, denominator. A document goes if the ratio exceeds the cutoff.
RULES = (("symbols", "n_symbols", "n_words"), ("capitals", "n_capitals", "n_letters"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeat_words", "n_repeat_words", "n_words"), ("marks", "n_marks", "n_words"))
#: Cutoffs from the loosest to the tightest.
GRID = tuple(round(x, 4) for x in [3.0, 2.0, 1.5, 1.0, *(0.9 - 0.05 * i for i in range(14)), 0.2, 0.175, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05])
#: Steps of a sequence: places of the grid looser than what loses nothing, then shares that a rule alone may lose.
LOOSER, SHARES = (8, 4, 2, 1), (0.0, *(0.0025 * i for i in range(1, 21)))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_marks")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!#*$%&|<>{}[]\\^~=@")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(range(65, 91))] = True
_LETTER = _UPPER.copy()
_LETTER[list(range(97, 123))] = True


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The base statistics of each text; null has no word.

    n_symbols, n_letters and others count bytes that are ASCII characters; word_chars counts code points.
    n_repeat_words: words in 3-word windows that occur at least twice in the text, the first included.
    """
    n = len(column)
    data, offsets = flat_bytes(column)
    words, rows = split_words(column)
    out = {"n_words": per_row(rows, n)}
    out["word_chars"] = per_row(rows, n, np.asarray(pc.utf8_length(words), dtype=np.int64))

    def bytes_in(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    out |= {"n_symbols": bytes_in(_SYMBOL), "n_marks": bytes_in(_MARK), "n_letters": bytes_in(_LETTER), "n_capitals": bytes_in(_UPPER)}
    out["n_repeat_words"] = _repeats(words, rows, n)
    lines = pc.split_pattern(pc.fill_null(column.cast(pa.large_string()), ""), "\n")
    line_rows = np.asarray(pc.list_parent_indices(lines), dtype=np.int64)
    values = lines.flatten()
    worded = np.asarray(pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(values)), 0).to_numpy(zero_copy_only=False), dtype=bool)
    code = np.asarray(values.dictionary_encode().indices, dtype=np.int64)[worded]
    line_rows = line_rows[worded]
    out["n_lines"] = per_row(line_rows, n)
    size = int(code.max(initial=0)) + 1
    distinct = np.unique(line_rows * size + code)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct // size, minlength=n)
    return out


def _repeats(words: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    code = np.asarray(words.dictionary_encode().indices, dtype=np.int64)
    if len(code) < 3:
        return np.zeros(n, np.int64)
    size = int(code.max()) + 1
    inside = np.flatnonzero(rows[2:] == rows[:-2])
    # pairs of neighbours get dense numbers first, so that a window is one exact number
    pair, pair_of = np.unique(code[:-1] * size + code[1:], return_inverse=True)
    key = pair_of[inside] * size + code[inside + 2] if len(pair) * size < 1 << 62 else None
    if key is None:
        key = np.unique(np.stack([pair_of[inside], code[inside + 2]]), axis=1, return_inverse=True)[1]
    order = np.lexsort((key, rows[inside]))
    k, r = key[order], rows[inside][order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    hit = np.zeros(len(code), bool)
    for d in range(3):
        hit[at + d] = True
    return np.bincount(rows[hit], minlength=n).astype(np.int64)


def counted(source: DataFrame) -> DataFrame:
    """``source`` with the counts of each text in place of ``text``, its last column."""
    rest = source.columns[:-1]
    schema = T.StructType([*(source.schema[c] for c in rest), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                got = text_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], schema.names)
        give_back()

    return source.mapInArrow(run, schema)


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _ratio(over: str, under: str):
    return F.coalesce(F.try_divide(F.col(over), F.col(under)), F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of probability p: the exact test's p-value of "the rate is
    at least p" after k hits. The Clopper-Pearson bound lies below p exactly where this is below the level."""
    if n == 0 or k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def last_held(lost: list[int], n: int, share: float, level: float) -> int | None:
    """The last step of a fixed sequence that holds, given the good documents that each would lose."""
    found = None
    for i, k in enumerate(lost):
        if k / max(n, 1) >= share or binomial_tail(k, n, share) > level:
            break
        found = i
    return found


def choose(lost: list[int], n: int, share: float, level: float) -> float | None:
    """The tightest cutoff of the grid that holds."""
    found = last_held(lost[: len(GRID)], n, share, level)
    return None if found is None else GRID[found]


def sequence(lost: list[list[int]], n: int) -> list[list[float | None]]:
    """Vectors of cutoffs from the loosest to the tightest, given what each rule's grid loses of ``n`` documents.

    At a step all rules have the tightest cutoff that alone loses at most the step's share; the first steps
    are some places of the grid looser than what loses nothing. None: the rule is off.
    """
    if not n:
        return [[c] * len(lost) for c in GRID]
    out = []
    for looser, share in [*((x, 0.0) for x in LOOSER), *((0, x) for x in SHARES)]:
        at = [sum(k <= share * n for k in rule) - 1 for rule in lost]  # losses grow along the grid
        out.append([None if i < 0 else GRID[max(i - looser, 0)] for i in at])
    return out


def thresholds(labelled: DataFrame, stratum: str = "stratum", risk: float = RISK, delta: float = DELTA, id_col: str = "id") -> DataFrame:
    """``(stratum, symbols, capitals, ...)``: a cutoff for each rule, null where none is safe.

    ``labelled`` holds the counts of the good documents of the holdout. All are counted, in two grouped
    aggregations: what each rule's cutoffs lose of one half, and what the sequence's steps lose of the other.
    """
    names = [name for name, _, _ in RULES]
    held = labelled.where(~_base_failed()).select(stratum, (F.pmod(F.xxhash64(id_col), F.lit(2)) == 0).alias("first"), *[_ratio(a, b).alias(name) for name, a, b in RULES])
    held = held_table = materialize(held, "held")
    sizes = materialize(held.groupBy(stratum).agg(F.count("*").alias("labels")), "strata")
    level = delta / max(1, sizes.count())
    least = ceil(log(level) / log1p(-risk))
    # only how many labels there are decides whether half of them set the sequence
    held = held.join(hinted(sizes), stratum).withColumn("sets", F.col("first") & (F.col("labels") >= 3 * least))
    sums = [F.sum((F.col("sets") & (F.col(name) > c)).cast("long")).alias(f"{name}_{i}") for name in names for i, c in enumerate(GRID)]
    strata = held.groupBy(stratum).agg(F.sum(F.col("sets").cast("long")).alias("n"), *sums)
    lists = strata.select(stratum, "n", *[F.array(*[f"{name}_{i}" for i in range(len(GRID))]).alias(name) for name in names])
    steps = T.StructType([labelled.schema[stratum], T.StructField("step", T.IntegerType()), *(T.StructField(x, T.DoubleType()) for x in names)])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = sequence([row[x] for x in names], row["n"])
                cols = [pa.array([v[i] for v in path], pa.float64()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array([row[stratum]] * len(path), batch.schema.field(stratum).type), pa.array(range(len(path)), pa.int32()), *cols], steps.names)

    path = materialize(lists.mapInArrow(vectors, steps), "steps")
    over = F.lit(False)
    for name in names:
        over = over | F.coalesce(F.col(name) > F.col(f"cut_{name}"), F.lit(False))
    cuts = path.select(stratum, "step", *[F.col(x).alias(f"cut_{x}") for x in names])
    lost = held.where(~F.col("sets")).join(F.broadcast(cuts) if path.count() <= BROADCAST_ROWS else cuts, stratum).groupBy(stratum, "step").agg(F.count("*").alias("n"), F.sum(over.cast("long")).alias("lost"))
    tested = lost.groupBy(stratum).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("step", "lost"))), lambda x: x["lost"]).alias("lost"))
    last = T.StructType([labelled.schema[stratum], T.StructField("step", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [last_held(k, n, risk, level) for k, n in zip(batch.column("lost").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(stratum), pa.array(found, pa.int32())], last.names)

    out = materialize(path.join(tested.mapInArrow(run, last), [stratum, "step"]).drop("step"), "cutoffs")
    discard(held_table, sizes, path)
    return out


def judged(docs: DataFrame, labels: DataFrame | None, keep: list[str], id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``row`` (the ``keep`` columns), the counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null text has no word and fails the base rule. A null stratum is one of its own. Rows that repeat an
    id share its label, and labels of unknown documents are not used; a document labelled both ways is no
    good one. Without labels only the base rule holds. Columns may have any names. An empty table gives an empty result.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in keep])
    source = docs.select(row.alias("row"), docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{stratum_col}`"].cast("string"), F.lit("")).alias("stratum"), docs[f"`{text_col}`"].cast("string").alias("text"))
    counts = materialize(counted(source).withColumn("base_failed", _base_failed()), "counts")
    if labels is not None:
        good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("id")
        sample = counts.select("id", "stratum", *COUNTS).join(good, "id", "left_semi")
        # the rows, with their texts, stay where they are: a stratum may hold most of them
        counts = counts.join(hinted(thresholds(sample, "stratum", risk, delta)), "stratum", "left")
    else:
        counts = counts.select("*", *[F.lit(None).cast("double").alias(name) for name, _, _ in RULES])
    passes = [F.coalesce(_ratio(a, b) <= F.col(name), F.lit(True)) for name, a, b in RULES]
    kept = ~F.col("base_failed")
    for p in passes:
        kept = kept & p
    return counts.select("row", *COUNTS, "base_failed", kept.alias("kept"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judged(docs, labels, ["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def only_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return judged(docs, labels, docs.columns).where("kept").select("row.*")
