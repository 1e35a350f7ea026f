"""Quality classifier from weak labels.

Several heuristics each vote good or bad on the documents they know something about, and overlap.
Expectation-maximisation over the counts of vote patterns, which cover all documents and are at most 3^k,
estimates how often each heuristic votes on good and on bad documents, and the share of good ones. The posterior of a
document's pattern is its label; on a bounded sample of documents these labels train a linear scorer over
hashed byte n-grams. The scorer judges every document, those that no heuristic speaks on included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.quality import SLICE_BYTES, text_counts
from tilewright.llm.textscore import SLOTS_BITS, gram_rows, mean_scores, slots
from tilewright.llm.words import flat_bytes, give_back, slices
from tilewright.storage import materialize

#: Documents at most that the scorer is trained on, and passes over them.
SAMPLE_DOCS, EPOCHS = 4000, 5
#: A text is bad if the scorer gives less than this.
CUTOFF = 0.5
#: n-gram shares are scaled by this.
SCALE = 100.0
HEURISTICS = ("symbols", "capitals", "repetition", "line_copies", "bars", "fragments", "prose", "plain_words", "sentences")
PRAISING = HEURISTICS[-3:]


def votes(c: dict[str, np.ndarray], bars: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A column for each heuristic: 1 good, 0 bad, 2 nothing."""
    words = np.maximum(c["n_words"], 1)
    symbols, capitals, repeats = c["n_symbols"] / words, c["n_capitals"] / np.maximum(c["n_letters"], 1), c["n_repeat_words"] / words
    length, stop, bar = c["word_chars"] / words, stops / words, bars / words
    enough = c["n_words"] >= 20
    bad = [
        symbols > 0.2,
        enough & (capitals > 0.4),
        enough & (repeats > 0.4),
        (c["n_lines"] > 2) & (c["n_dup_lines"] > 0.3 * c["n_lines"]),
        bar > 0.1,
        (c["n_words"] < 5) | (length > 14) | (length < 2),
    ]
    some = c["n_words"] >= 3
    good = [
        some & (symbols < 0.05) & (capitals < 0.25) & (repeats < 0.25) & (bar < 0.05),
        some & (symbols < 0.05) & (bar < 0.05) & (length > 2) & (length < 10) & (capitals < 0.3),
        some & (capitals < 0.25) & (symbols < 0.1) & (bar < 0.05) & (stop > 0.01) & (stop < 0.5),
    ]
    return np.stack([np.where(x, 0, 2) for x in bad] + [np.where(x, 1, 2) for x in good], axis=1).astype(np.int64)


def pattern(column: pa.Array) -> np.ndarray:
    """The votes of each text as one number, in base 3."""
    data, offsets = flat_bytes(column)

    def count(chars: bytes) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(chars, np.uint8)))])
        return total[offsets[1:]] - total[offsets[:-1]]

    v = votes(text_counts(column), count(b"|"), count(b".?!"))
    return v @ 3 ** np.arange(v.shape[1])


def estimate(patterns: np.ndarray, counts: np.ndarray, k: int = len(HEURISTICS), rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: posterior of good for each pattern, vote probabilities [heuristic, class, vote], the share of good.

    Keeping silent counts as a vote of its own. It starts from heuristics that seldom err and of which each
    sees a third of the bad documents or nine tenths of the good ones, which tells the two classes apart.
    """
    v = patterns[:, None] // 3 ** np.arange(k) % 3
    one = np.eye(3)[v]
    blames, praises = [[0.35, 0.01, 0.64], [0.02, 0.01, 0.97]], [[0.01, 0.1, 0.89], [0.01, 0.9, 0.09]]
    prob = np.array([praises if name in PRAISING else blames for name in HEURISTICS[:k]])
    share, post = 0.8, np.full(len(v), 0.5)
    for _ in range(rounds):
        ll = np.einsum("pkv,kcv->pc", one, np.log(prob)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        weight = np.stack([1 - post, post]) * counts
        prob = np.einsum("cp,pkv->kcv", weight, one) + 0.1
        prob /= prob.sum(axis=2, keepdims=True)
        share = float(np.clip(((post * counts).sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        if done:
            break
    return post, prob, share


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = SLOTS_BITS, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on n-gram shares, with AdaGrad steps; soft labels, both classes weighed alike."""
    w, b = np.zeros(1 << bits), 0.0
    square, b_square = np.full(1 << bits, 1e-3), 1e-3
    rng = np.random.default_rng(seed)
    y = np.array([r[2] for r in rows])
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-3), 0.5 / max((y <= 0.5).mean(), 1e-3)) if len(y) else y
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            at, x, label = rows[i]
            g = weight[i] * (1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30))) - label)
            square[at] += (g * x) ** 2
            w[at] -= rate * g * x / np.sqrt(square[at])
            b_square += g * g
            b -= rate * g / np.sqrt(b_square)
    return w, b


def sampled(texts: DataFrame, n: int, most: int) -> DataFrame:
    """Of the distinct texts of ``texts``, ``n`` rows, those ``most`` with the smallest hashes, as column ``h``.

    However often a text is repeated it counts once, so copies cannot swell the sample.
    """
    share = min(1.0, 2.0 * most / max(n, 1))  # twice as many as wanted come to the sort, which takes the first
    hashed = texts.withColumn("h", F.xxhash64("text")).where((F.col("h").cast("double") / float(1 << 64) + 0.5) < F.lit(share if share < 1 else 2.0))
    return hashed.dropDuplicates(["h"]).orderBy("h").limit(most)


def scored(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``row`` (the ``keep`` columns), ``weak_label``, ``score`` and ``good`` for every row of ``docs``.

    weak_label is the posterior of the document's votes, score the scorer's probability of good. Null text
    is empty; an empty text has score 0. Null and repeated ids are judged like others. An empty table gives an
    empty result; where all weak labels are of one kind the scorer gives their mean.
    """
    text = docs[f"`{text_col}`"].cast("string")
    source = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), text.alias("text"))
    with_pattern = T.StructType([*source.schema.fields, T.StructField("pattern", T.LongType())])

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pattern(part.column("text")))], with_pattern.names)
        give_back()

    source = materialize(source.mapInArrow(patterns, with_pattern), "voted")
    table = np.array([(r["pattern"], r["count"]) for r in source.groupBy("pattern").count().collect()], dtype=np.int64).reshape(-1, 2)  # at most 3^k rows
    post = dict(zip(table[:, 0].tolist(), estimate(table[:, 0], table[:, 1])[0].tolist()))
    n = int(table[:, 1].sum())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat_bytes(part.column("text"))
                at = slots(data, fold=False)
                labels = [post.get(p, 0.5) for p in part.column("pattern").to_pylist()]
                got = [np.unique(at[a:b], return_counts=True) for a, b in zip(*(x.tolist() for x in gram_rows(offsets)))]
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32())), pa.array([(c / max(c.sum(), 1) * SCALE).astype(np.float32) for _, c in got], pa.list_(pa.float32())), pa.array(labels, pa.float64())], ["h", "at", "x", "label"])

    few = sampled(source.select("text", "pattern"), n, sample_docs)
    sample = few.mapInArrow(features, "h long, at array<int>, x array<float>, label double").orderBy("h")
    rows = [(np.array(r["at"], dtype=np.int64), np.array(r["x"]), r["label"]) for r in sample.toLocalIterator() if r["at"]]
    w, b = train(rows)
    model = (w * SCALE).astype(np.float32)[None]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat_bytes(part.column("text"))
                mean, size = mean_scores(data, offsets, model, fold=False)
                score = np.where(size > 0, 1 / (1 + np.exp(-np.clip(mean[:, 0] + b, -500, 500))), 0.0)
                label = [post.get(p, 0.5) for p in part.column("pattern").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(label, pa.float64()), pa.array(score), pa.array(score >= CUTOFF)], ["row", "weak_label", "score", "good"])
        give_back()

    schema = T.StructType([source.schema["row"], *T.StructType.fromDDL("weak_label double, score double, good boolean").fields])
    return source.mapInArrow(judge, schema)


def digest(docs: DataFrame) -> DataFrame:
    out = scored(docs, ["doc_id"])
    return out.select("row.doc_id", F.round("weak_label", 6).alias("weak_label"), F.round("score", 6).alias("score"), F.col("good").alias("kept"))
