import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import repeats as R


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        a, z = R.runs_of(gone)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), len(a), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    w = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, line, base = w(350), w(64), w(600)
    out = [w(500) + passage + w(300) for _ in range(6)] + [None, "", "x" * 1000, "ab" * 400, w(100) + "ab" * 150 + w(50), w(199), w(200)]
    out += [base, base, base[:350] + "Z" + base[350:], base[100:420], base[:200]]
    out += [w(rng.randint(0, 300)) + (passage[k:] if k % 2 else passage[: 330 - k]) + w(40) for k in range(30)]
    return out + [w(160) + line + w(160) for _ in range(40)]


@pytest.mark.parametrize("group_windows", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, group_windows):
    monkeypatch.setattr(R, "GROUP_WINDOWS", group_windows)
    all_texts = texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in R.digest(df).collect()}
    assert [got[i] for i in range(len(all_texts))] == brute(all_texts)


def test_index_gives_the_longest_matches_elsewhere():
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(12)] + [b"abab" * 9, b"\x00\x00a", b"\x00"]
    got = R.RunLengthIndex(parts)
    assert got.runs <= got.n
    stats = got.matching_statistics()
    where = [(k, i) for k, p in enumerate(parts) for i in range(len(p))]

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for at, (k, i) in enumerate(where):
        assert stats[at] == max(common(parts[k][i:], parts[m][j:]) for m, j in where if (m, j) != (k, i))


def test_rows_of_all_kinds(spark):
    rng = random.Random(8)
    same = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(1, same), (1, same), (None, same), (None, "short"), (2, "é" * 150 + "x"), (3, "y" + "é" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("did", F.lit(1)).withColumn("row", F.lit("r")).withColumn("gone", F.lit(0))
    got = [tuple("" if x is None else x for x in r) for r in R.digest(df).collect()]
    want = [("" if i is None else i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    out = R.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    kept = [r["text"] for r in out.where("doc_id = 1 or doc_id is null").collect()]
    assert sorted(kept) == ["", "", "", "short"]
    assert R.digest(df.limit(0)).count() == 0


def test_texts_without_id_whose_short_hashes_collide(spark):
    """Two equal texts, and another whose 32-bit hash is theirs: only the two lose anything."""
    made = spark.range(200_000).select(F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{k}"))) for k in range(8)]).alias("t"))
    pair = made.groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).where(F.size("ts") > 1).first()["ts"][:2]
    rows = [(None, pair[0]), (None, pair[0]), (None, pair[1])]
    got = R.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r[1:]) for r in got) == sorted(brute([t for _, t in rows]))


def test_long_texts_and_string_ids(spark):
    rng = np.random.default_rng(2)
    long = rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), 3_000_000).tobytes().decode()
    passage = long[1_000_000:1_000_400]
    df = spark.createDataFrame([("a", long), ("b", "x" + passage), (None, "short")], "doc_id string, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in R.digest(df).collect()}
    assert got == {"a": (400, 1), "b": (400, 1), None: (0, 0)}
