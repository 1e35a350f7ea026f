import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import simhash as S

SCHEMA = "doc_id long, text string, lang string"


def brute_groups(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    low = {g: min([x for x in v if x is not None], default=None) for g, v in groups.items()}
    return [low[root(i)] for i in range(len(ids))]


def test_fingerprint_is_the_majority_of_shingle_hashes(spark):
    """Against Spark's own XXH64, whose seed is 42."""
    text = "The  quick\tbrown fox\njumps over THE lazy dog the quick brown fox ÀÉ"
    words = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).split()
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    rows = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()
    h = [r[0] & (1 << 64) - 1 for r in rows]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert S.fingerprint(text) == want
    one = spark.createDataFrame([("a b",)], "s string").select(F.xxhash64("s")).first()[0] & (1 << 64) - 1
    assert S.fingerprint("A\x0b B ") == one and S.fingerprint(" \n") == S.fingerprint(None) == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    for radius in (0, 1, 3, 4, 7):
        near = S.within(S.bit_planes(fps), fps[:70], radius)
        got = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(70, -1, 8), axis=2, bitorder="little").reshape(70, -1)[:, :300]
        assert (got.astype(bool) == (np.bitwise_count(fps[:70, None] ^ fps[None]) <= radius)).all()


@pytest.mark.parametrize("block_rows", [32_768, 4])
def test_groups_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(S, "BLOCK_ROWS", block_rows)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = []
    for _ in range(150):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(fps)], "fp long")
    from tilewright.operators.components import connected_components

    found = {r["node"] & (1 << 64) - 1: r["root"] for r in connected_components(S.links(df, 4)).collect()}
    order = sorted(set(fps))
    want = brute_groups(order, order)
    for a, b in zip(order, want):
        for c, d in zip(order, want):
            assert (b == d) == (a == c or (a in found and c in found and found[a] == found[c]))


def test_rows_of_all_kinds(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, None), (9, None, "c"), (7, "", "d"), (8, " \t", "e"), (1, "other words here now", "f"), (2, text.replace("w150", "x"), "g"), (6, "long " * 50_000, "h")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    ids, fps = [r["doc_id"] for r in got], [int(r["fingerprint"], 16) for r in got]
    assert [r["component_id"] for r in got] == brute_groups(ids, fps)
    assert all(r["fingerprint"] == "0" * 16 for r in got if r["doc_id"] in (7, 8, 9))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    groups = {r["component_id"] for r in got}
    assert {r["doc_id"] for r in kept.collect()} == groups | {None}
    assert S.near_duplicates(df.limit(0)).count() == 0
