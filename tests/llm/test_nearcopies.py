import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import nearcopies as N

LEAST = Fraction(4, 5)


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_groups(rows):
    """Each row's smallest linked id, by all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (x, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(x)
    low = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return [low[root(i)] for i in range(len(rows))]


def planted(seed=3):
    """Texts with copies of which up to six words in 160 are changed: similarities from about 0.65 on."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, line = [], [word() for _ in range(40)]
    for g in range(12):
        base = [word() for _ in range(160)] + (line if g % 2 else [])
        for _ in range(9):
            copy = list(base)
            for i in rng.sample(range(160), rng.randint(0, 6)):
                copy[i] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block_sets,rounds", [(2048, 3), (4, 3), (4, 0)])
def test_groups_equal_brute_force(spark, monkeypatch, block_sets, rounds):
    monkeypatch.setattr(N, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(N, "PIVOT_ROUNDS", rounds)
    rows = planted()
    got = {r[0]: r[1] for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute_groups(rows)


def test_the_pipeline_stage_drops_near_copies_of_similarity_0_8(spark):
    rows = planted(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(brute_groups(rows))


def test_rows_of_all_kinds(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text), (3, text), (None, text), (9, None), (7, ""), (8, " \t"), (1, "other words here now"), (4, "Other  words\nhere NOW"), (2, text.replace("w150", "x")), (6, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text_hash", F.lit("clash")).withColumn("th", F.lit(1)).withColumn("id", F.lit(2))
    got = N.near_copies(docs).collect()
    want = brute_groups(rows)
    assert sorted(map(str, ((r[0], r[1]) for r in got))) == sorted(map(str, ((i, w) for (i, _), w in zip(rows, want))))
    assert sorted(map(str, (r["doc_id"] for r in N.keep_one(docs).collect()))) == sorted(map(str, {*want, None}))
    assert N.keep_one(docs).columns == docs.columns and {r["__text_hash"] for r in N.keep_one(docs).collect()} == {"clash"}
    assert N.near_copies(docs.limit(0)).count() == 0


def test_sketches_bound_the_difference_and_forests_span():
    rng = np.random.default_rng(5)
    for n in (3, 40, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)]))
        assert sum((x ^ y).bit_count() for x, y in zip(N._sketch(a), N._sketch(b))) <= len(np.setxor1d(a, b))
    i, j = np.array([1, 2, 3, 3, 5, 6, 6, 7]), np.array([0, 1, 0, 2, 4, 0, 5, 6])
    left, right = N._forest(9, i, j)
    assert len(left) == 7 and {(a, b) for a, b in zip(left.tolist(), right.tolist())} <= set(zip(i.tolist(), j.tolist()))


def test_wide_fingerprints_pass_what_is_similar():
    """Bits differ as often as the angle says, and no pair of similarity 0.8 is ruled out."""
    rng = np.random.default_rng(3)
    for n in (64, 80, 500):
        far = []
        for _ in range(300):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = a.copy()
            b[: n // 9] = rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)
            far.append(int(np.bitwise_count(N.wide_fingerprint(a) ^ N.wide_fingerprint(b)).sum()))
        assert max(far) <= N.RADIUS and 30 < np.mean(far) < 42
    other = [int(np.bitwise_count(N.wide_fingerprint(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) ^ N.wide_fingerprint(a)).sum()) for _ in range(200)]
    assert min(other) > N.RADIUS


def test_sets_and_bounds_are_exact():
    rng = random.Random(1)
    texts = [None, "", "a", "A b", "a b c d e", "a b c d e f a b c d e", "é\x0bx y z w v"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    h, offsets = N.shingle_sets(pa.array(texts), 5)
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            x, y = h[offsets[i] : offsets[i + 1]], h[offsets[j] : offsets[j + 1]]
            assert len(np.intersect1d(x, y)) == len(shingles(texts[i]) & shingles(texts[j]))
    assert N.prefix_size(np.array([0, 1, 4, 5, 10, 11]), LEAST).tolist() == [0, 1, 1, 2, 3, 3]
