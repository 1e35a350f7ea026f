"""Every stage of the pipeline against plain Python on a small corpus, and the run against its stages."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_nearcopies import brute_groups
from test_repeats import brute
from test_text_operators import base_counts

import corpus_pipeline
from tilewright.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    passage = " ".join(words(60))
    texts = []
    for g in range(10):
        base = words(150)
        for _ in range(4):  # near copies, of similarities about the bound
            copy = list(base)
            for i in rng.sample(range(150), rng.randint(0, 5)):
                copy[i] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(words(70)) + " " + passage + " " + " ".join(words(70)) for _ in range(8)]
    texts += [" ".join(words(30)), "same word again " * 40, "", None, " ".join(words(5000)), texts[0], texts[0]]
    rows = [(i, t, ("en", "de", None)[i % 3], (f"s{i % 4}", None)[i % 11 == 0], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[1], "en", "s1", len(texts[1])), (None, " ".join(words(80)), "en", "s2", 1)]
    return rows


def removed(texts):
    """Texts without their repeated strings, by the rule of the stage."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for t, b in zip(texts, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(t if t is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def copies(rows):
    """How often each row is taken."""
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = [len((r[1] or "").split()) for r in rows]
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in order}
    weight, full = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        left, open_ = sum(total.values()) - sum(3 * total[s] for s in full), [s for s in order if s not in full]
        want = {s: 3 * total[s] if s in full else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        more = {s for s in open_ if want[s] > 3 * total[s]}
        if not more:
            break
        full |= more
    out = []
    for r in rows:
        rate = want[r[3]] / total[r[3]] if total[r[3]] else 0.0
        chance = int(hashlib.md5(f"0:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) / (1 << 48)
        out.append(int(rate) + (chance < rate - int(rate)))
    return out


def bag(rows):
    return Counter(map(str, (tuple(r) for r in rows)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_equal_plain_python(spark, folder):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_dedup", "suffix_dedup", "source_mix", "best_fit_packing"]
    rows = corpus()
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)

    # too few labels for a cutoff in any language: the base rule decides
    good = [r for r in rows if (c := base_counts(r[1]))["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"]]
    got = stage["quality_rules"](spark, make(rows), folder)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")] and bag(got.collect()) == bag(good)

    low = brute_groups([(r[0], r[1]) for r in good])
    firsts = {x for x in low if x is not None}
    once = list(dict.fromkeys(r for r in good if r[0] in firsts)) + [r for r in good if r[0] is None]
    got = stage["near_dedup"](spark, make(good), folder)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")] and bag(got.collect()) == bag(once)
    assert 10 < len(once) < len(good) - 10

    cut = [(r[0], t, r[2], r[3], None if t is None else len(t)) for r, t in zip(once, removed([r[1] for r in once]))]
    got = stage["suffix_dedup"](spark, make(once), folder)
    assert bag(got.collect()) == bag(cut) and sum(a != b for a, b in zip(once, cut)) >= 8
    assert [x[1] for x in brute([r[1] for r in once])] == [len((r[1] or "").encode()) - len((c[1] or "").encode()) for r, c in zip(once, cut)]

    taken = [r for r, n in zip(cut, copies(cut)) for _ in range(n)]
    got = stage["source_mix"](spark, make(cut), folder)
    assert bag(got.collect()) == bag(taken)

    got = stage["best_fit_packing"](spark, make(taken), folder).collect()
    assert pieces_of(got) == expected_pieces(taken)

    ran = corpus_pipeline.run(spark, folder).collect()
    assert pieces_of(ran) == expected_pieces(taken)


def expected_pieces(rows):
    encoder, out = packing._encoder("word_bpe_49k.json"), Counter()
    for r in rows:
        ids = np.array([*encoder.encode_full(r[1] or ""), 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            out[str((r[0], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())))] += 1
    return out


def pieces_of(rows):
    """The pieces, once their places are known to be gapless and within a sequence."""
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= 2048
    return Counter(str(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in rows)


def test_stages_take_empty_tables_and_more_columns(spark, folder):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        more = docs.select("*", *[F.lit("clash").alias(c) for c in ("row", "id", "th", "gone", "size", "stratum", "length", "__id", "__text_hash")])
        got = stage(spark, more, folder)
        assert got.count() > 0 and (name == "best_fit_packing" or got.columns == more.columns), name
