import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.llm import classifier, language, maintext, merkle, mixing, packing, quality, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0d]+")
ODD = [None, "", " \n\t", "a", "Don't we'll 'S", "<|endoftext|> hi<|startoftext|>x", "İstanbul ǅ ﬁ 中文字 １２³½", "a\x1cb\x85c d", "é ́a", "ΣΑΣ", "🎉x🎉 1234a5", "a a a\na a a\n\n a a a\nb|c", "w " * 30_000]


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(hit)}


def test_counts_equal_brute_force():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab \n#*é\t") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = quality.text_counts(pa.array(texts))
    for k, t in enumerate(texts):
        assert {c: int(got[c][k]) for c in base_counts(t)} == base_counts(t)


def test_cutoffs_hold_their_risk():
    assert quality.binomial_tail(0, 100, 0.05) == pytest.approx(0.95**100)
    assert quality.binomial_tail(3, 3, 0.5) == 1.0
    assert quality.choose([0] * len(quality.GRID), 100_000, 0.01, 1e-3) == quality.GRID[-1]
    assert quality.choose([0] * len(quality.GRID), 20, 0.01, 1e-3) is None
    assert quality.choose([0, 0, 900] + [0] * 30, 10_000, 0.01, 1e-3) == quality.GRID[1]


def test_rules_keep_good_and_drop_bad(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [(i, " ".join(word() for _ in range(80)), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(word() + "###" for _ in range(80)), "en") for i in range(50)]
    rows = good + bad + [(9001, None, "en"), (9002, "few words", None), (None, good[0][1], "fr"), good[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("kept", "stratum", "n_words", "__id", "__stratum", "__text", "id", "row"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(5000, 0)], "doc_id long, quality int")
    kept = quality.only_good(docs, labels)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == 3002 and all(i is None or i < 3000 for i in ids)
    assert quality.judged(docs, None, ["doc_id"]).where("kept").count() == 3052
    assert quality.only_good(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("labels", [100, 475])
def test_rules_act_on_few_labels(spark, labels):
    """Two languages need 72 good labels each; 475 of them set the sequence with one half."""
    rng = random.Random(labels)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [(2 * i + k, " ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(80)), lang) for k, lang in enumerate(("de", "fr")) for i in range(labels)]
    bad = [(5000 + i, " ".join(word() + "###" for _ in range(80)), ("de", "fr")[i % 2]) for i in range(50)] + [(6000 + i, " ".join(word().upper() for _ in range(80)), "de") for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.only_good(docs, spark.createDataFrame([(i, 1) for i, _, _ in good], "doc_id long, quality int")).collect()}
    assert kept == {i for i, _, _ in good}


def test_sequences_tighten_and_lose_what_their_step_allows():
    grid = len(quality.GRID)
    lost = [[0] * 10 + list(range(1, grid - 9)), [0] * grid, [5] * grid, [0] * grid, [0] * grid]
    path = quality.sequence(lost, 100)
    for a, b in zip(path, path[1:]):
        assert all(x is None or y <= x for x, y in zip(a, b) if y is not None)
    assert path[len(quality.LOOSER)][:3] == [quality.GRID[9], quality.GRID[-1], None] and path[-1][2] == quality.GRID[-1]
    assert quality.sequence(lost, 0) == [[c] * 5 for c in quality.GRID]
    assert quality.last_held([0] * 5, 85, 0.05, 0.0125) is None and quality.last_held([0] * 5, 86, 0.05, 0.0125) == 4


def test_ids_are_the_tokenizers():
    encoder = packing._encoder("word_bpe_49k.json")
    assert encoder.exact
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abZ 'sS1é́ß \t🎉<|>.,ªÀ ") for _ in range(60)) for _ in range(400)]
    ids, offsets = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder.encode_full(t or ""), t


def test_sum_of_squares_rule():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 100, 400))[::-1]
    where, offset = packing.sum_of_squares(sizes, 100)
    count, at = Counter(), {}
    for s, b, o in zip(sizes.tolist(), where.tolist(), offset.tolist()):  # each step against all choices
        gaps = {g for g in count if count[g] and g >= s}
        if not gaps:
            assert o == 0 and b not in at
            g = 100
        else:
            def total(g):
                c = Counter(count)
                c[g] -= 1
                c[g - s] += g > s
                return sum(v * v for v in c.values())

            g = at[b]
            assert g in gaps and o == 100 - g and total(g) == min(map(total, gaps))
            count[g] -= 1
        at[b] = g - s
        count[g - s] += g > s
    assert where.max() + 1 <= -(-sizes.sum() // 100) * 1.05 + 1


def test_packing(spark):
    rows = [(i, "word " * n) for i, n in enumerate([0, 1, 2047, 2048, 5000, 10, 10, 700, 1400])] + [(None, "a b"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("piece", F.lit(1))
    got = packing.packed(docs, "word_bpe_49k.json").collect()
    encoder = packing._encoder("word_bpe_49k.json")
    want = []
    for i, t in rows:
        ids = np.array([*encoder.encode_full(t or ""), 0], "<u4")
        want += [(str(i), k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= 2048
    assert packing.packed(docs.limit(0), "word_bpe_49k.json").count() == 0


def test_equal_rows_are_spread_over_the_shards(spark):
    table = spark.createDataFrame([(None, 0, 0, 500, 7)] * 3000, "id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(table, shard_pieces=100).groupBy((F.col("sequence_id") / (1 << 40)).cast("int").alias("shard")).count().collect()
    assert len(got) == 30 and max(r["count"] for r in got) < 160


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(2000)] + [(9000, "w " * 5, None), (None, None, "s0"), (9001, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = {r["doc_id"]: r for r in mixing.digest(docs).collect()}
    total = sum(r["size"] for r in got.values())
    sizes, targets, taken = {}, {}, Counter()
    for i, _, s in rows:
        sizes[s], targets[s] = got[i]["source_size"], got[i]["target"]
        taken[s] += got[i]["taken"]
        assert got[i]["taken"] <= 3 * got[i]["size"]
    order = ["s0", "s1", "s2", "s3", "s4", "t", None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, full = {}, set()
    while True:  # shares of what is left, until none passes its limit
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        want = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        more = {s for s in open_ if want[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    assert {s: pytest.approx(v) for s, v in want.items()} == targets
    assert all(abs(taken[s] - targets[s]) < 0.2 * targets[s] + 20 for s in order)
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns and copies.count() > 1000
    assert sorted(map(str, copies.collect())) == sorted(map(str, mixing.repeated(docs.repartition(5)).collect()))
    assert mixing.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("range_rows", [4096, 2])
def test_fingerprints(spark, monkeypatch, range_rows):
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    rng = random.Random(6)
    text = lambda n: ". ".join(" ".join("".join(rng.choice("abcdéf") for _ in range(4)) for _ in range(6)) + rng.choice(("\n", "", "\n\n")) for _ in range(n))
    rows = [(10 * i, text(12)) for i in range(20)]
    rows += [(55, None), (57, ""), (58, "abc"), (59, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.lit("clash")).withColumn("range", F.lit(1))
    got = {r["doc_id"]: r for r in merkle.digest(docs).collect()}
    order = sorted(rows)
    fingerprints = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + after[:quarter]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        fingerprints.setdefault(t, set()).add(r["fingerprint"])
        assert (r["near_edited"] == 1.0) == (edited == t)
        if len(t) > 200:
            assert r["near_edited"] > 0.5 > r["near_next"]
    assert all(len(v) == 1 for v in fingerprints.values()) and len({min(v) for v in fingerprints.values()}) == len(fingerprints)
    assert merkle.digest(docs.limit(0)).count() == 0


def test_fingerprints_with_null_and_repeated_ids(spark):
    rows = [(1, "a b c d."), (1, "a b c d."), (None, "x"), (None, "yy yy"), (2, None)]
    got = merkle.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 5
    alone = merkle.digest(spark.createDataFrame([(5, "hello world")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"hello worhe").hexdigest()


def plain_tree(text):
    """The tree in plain Python: sections and paragraphs as (hash, children), and leaves."""
    import xxhash

    def x(value, seed, size=8):
        raw = value.encode() if isinstance(value, str) else (value & (1 << 8 * size) - 1).to_bytes(size, "little")
        h = xxhash.xxh64_intdigest(raw, seed & (1 << 64) - 1)
        return h - (1 << 64) * (h >> 63)

    sections, paragraphs, leaves, open_, n = [], [], [], 0, 0
    for line in text.split("\n"):
        own = [x(m, 42) for m in re.findall(r"(?s)[^.!?]{1,40}+[.!?]{0,8}+|[.!?]{1,8}+", line)]
        h = 42
        for leaf in own:
            h = x(leaf, h)
        h = x(len(line), h, 4)
        paragraphs.append((h, len(own)))
        leaves += own
        open_, n = x(h, x(open_, 42)), n + 1
        if not line.strip(" ") or h % 8 == 0:
            sections.append((open_, n))
            open_, n = 0, 0
    return [*sections, (open_, n)], paragraphs, leaves


def plain_likeness(a, b):
    """Descent in plain Python: likeness, first differing paragraph, paragraphs from it on."""
    if a[0] == b[0]:
        return 1.0, None, 0

    def trim(x, y, below_x, below_y):
        i = 0
        while i < min(len(x), len(y)) and x[i][0] == y[i][0]:
            i += 1
        k = 0
        while k < min(len(x), len(y)) - i and x[-1 - k][0] == y[-1 - k][0]:
            k += 1
        first, last = sum(n for _, n in x[:i]), sum(n for _, n in x[len(x) - k :])
        return i, len(x) - i - k, first, below_x[first : len(below_x) - last], below_y[first : len(below_y) - last]

    _, _, before, px, py = trim(a[0], b[0], a[1], b[1])
    start = [sum(n for _, n in t[1][:before]) for t in (a, b)]
    lx, ly = (t[2][s : s + sum(n for _, n in p)] for t, s, p in ((a, start[0], px), (b, start[1], py)))
    i, n, _, mx, my = trim(px, py, lx, ly)
    most = max(len(a[2]), len(b[2]))
    both = len(a[2]) - len(mx) + len(set(mx) & set(my))
    return (min(both, most - 0.5) / most if most else 0.0), before + i, n


@pytest.mark.parametrize("string_ids", [False, True])
def test_trees_equal_plain_python(spark, monkeypatch, string_ids):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 3)
    monkeypatch.setattr(merkle, "OVERSAMPLE", 1)
    rng = random.Random(12)
    line = lambda: "".join(rng.choice("abcé .!?") for _ in range(rng.randint(0, 90)))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["", " \n\n ", "one.\ntwo.\nthree.", "x" * 200_000, "line\n" * 20_000]
    for k in range(0, 50, 5):  # neighbours that share most of their lines
        part = texts[k].split("\n")
        part[len(part) // 2] = "changed here."
        texts[k + 1] = "\n".join(part)
    rows = [(f"id{k:03d}" if string_ids else 3 * k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id {'string' if string_ids else 'long'}, text string").withColumn("key", F.lit("clash")).withColumn("known", F.lit(0))
    got = {r["doc_id"]: r for r in merkle.digest(docs).collect()}
    for k, (i, t) in enumerate(rows):
        after = texts[(k + 1) % len(texts)]
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + after[:quarter]
        r, tree = got[i], plain_tree(t)
        parts = r["fingerprint"].split("/")
        hexed = lambda level: ".".join(f"{(h[0] if isinstance(h, tuple) else h) & 0xFFFFFFFF:08X}" for h in level)
        assert parts[1:] == [hexed(tree[0]), hexed(tree[1]), hexed(tree[2])]
        like, first, n = plain_likeness(tree, plain_tree(edited))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"], r["edited_from"], r["edited_paragraphs"]) == (pytest.approx(like), first, n)
        assert r["near_next"] == pytest.approx(plain_likeness(tree, plain_tree(after))[0])


def test_edits_are_located(spark):
    a = spark.createDataFrame([("one.\ntwo.\nthree.", "one.\nTWO.\nthree.")], "a string, b string")
    both = merkle.compared(merkle.with_tree(merkle.with_tree(a, "a", "a_"), "b", "b_"), "a_tree", "b_tree", "")
    assert tuple(both.select("from", "paragraphs").first()) == (1, 1)
    assert both.first()["likeness"] == pytest.approx(2 / 3)


def test_url_rules(spark):
    urls = [None, "x", "http://A.ORG", "http://a.org/", "https://q.Example.org/es/1?x#y", "http://example.org/en/1", "http://borg/", "http://u.com/de/", "http://u.com/fr", "http://u.com/fr/z", "http://u.net#f"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {r["page_id"]: r for r in urlfilter.digest(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("a.org", "", None), ("a.org", "/", "org/"), ("q.example.org", "/es/1", "example.org/es/"),
        ("example.org", "/en/1", "example.org/en/1"), ("borg", "/", None), ("u.com", "/de/", "com/de/"), ("u.com", "/fr", None), ("u.com", "/fr/z", "com/fr/"), ("u.net", "", None),
    ]
    assert [got[i]["verdict"] for i in (3, 4, 5, 7, 9)] == ["allow", "block", "block", "block", "allow"]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert urlfilter.digest(df.limit(0)).count() == 0


def test_url_models_tell_held_out_urls_apart(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [f"http://{word('abcdef')}.org/{word('abcdef')}" for _ in range(600)] + [f"http://{word('uvwxyz')}.com/de/{word('uvwxyz')}" for _ in range(600)]
    new = [f"http://{word('abcdef')}.net/{word('abcdef')}" for _ in range(100)] + [f"http://{word('uvwxyz')}.net/{word('uvwxyz')}" for _ in range(100)]
    got = urlfilter.digest(spark.createDataFrame(list(enumerate(rows + new)), "page_id long, url string")).where("rule is null").orderBy("page_id").collect()
    right = sum((r["verdict"] == "allow") == (r["page_id"] < 1300) for r in got)
    assert len(got) == 200 and right > 190


def plain_url_scores(urls):
    """Scores and cutoff worked out symbol by symbol, in plain Python."""
    import math

    import xxhash

    def codes(url):
        text = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").lower().translate(str.maketrans("123456789", "000000000"))
        return [0, 0, 0] + [urlfilter.ALPHABET.find(c) + 1 for c in text]

    def rule(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), v) for v, r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fits)[1] if fits else None

    held = lambda u: xxhash.xxh64_intdigest(u.encode(), 42) % (1 << 64) - (1 << 64) * (xxhash.xxh64_intdigest(u.encode(), 42) >> 63)
    seen = {"allow": Counter(), "block": Counter()}
    for u in urls:
        if rule(u) and held(u) % urlfilter.HOLDOUT:
            c = codes(u)
            for i in range(3, len(c)):
                for k in range(1, 5):
                    seen[rule(u)][tuple(c[i - k + 1 : i + 1])] += 1
                    seen[rule(u)][("context", *c[i - k + 1 : i])] += 1
    total = {v: sum(n for x, n in seen[v].items() if x[0] != "context" and len(x) == 4) for v in seen}
    factor = {v: min(total.values()) / total[v] for v in seen}

    def p(v, last):
        if not last:
            return 1 / 32
        return (seen[v][tuple(last)] * factor[v] + 4 * p(v, last[1:])) / (seen[v][("context", *last[:-1])] * factor[v] + 4)

    def score(u):
        c = codes(u)
        return sum(math.log(p("allow", c[i - 3 : i + 1]) / p("block", c[i - 3 : i + 1])) for i in range(3, len(c))) / (len(c) - 3) if len(c) > 3 else 0.0

    return [score(u) if u else 0.0 for u in urls]


def test_url_scores_equal_plain_python(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcuvw19-é") for _ in range(rng.randint(0, 9)))
    urls = [f"{rng.choice(('http', 'https'))}://{word()}.{rng.choice(('org', 'com', 'net'))}/{rng.choice(('de', 'fr', 'en'))}/{word()}?{word()}" for _ in range(300)] + [None, "", "abc", "://"]
    urls += urls[:20]
    got = urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).select("row.page_id", "score").orderBy("page_id").collect()
    assert [r["score"] for r in got] == pytest.approx(plain_url_scores(urls), abs=1e-9)


def test_long_urls(spark):
    import time

    urls = [f"http://a{i}.org/x" for i in range(50)] + [f"http://b{i}.com/de/y" for i in range(50)]
    long = "http://c.net/" + "path-seg/" * 23_000
    before = time.time()
    got = urlfilter.digest(spark.createDataFrame(list(enumerate([*urls, long, long, long + "x"])), "page_id long, url string")).collect()
    assert len(got) == 103 and len({r["score"] for r in got if r["page_id"] in (100, 101)}) == 1
    assert time.time() - before < 60


def test_grams_equal_plain_python(spark):
    url = "http://Ab1.org/x-é?"
    text = "ab0.org/x-é?"
    codes = [0, 0, 0] + [urlfilter.ALPHABET.find(c) + 1 for c in text]
    want = [((codes[i] * 32 + codes[i + 1]) * 32 + codes[i + 2]) * 32 + codes[i + 3] for i in range(len(text))]
    got = [r["gram"] for r in urlfilter.exploded(spark.createDataFrame([(url,)], "url string")).collect()]
    assert got == want


def test_main_text(spark):
    field = maintext.trained_field()
    held = maintext.labelled_pages(150, 99)
    right = total = 0
    for page, labels in held:
        found = field.decode(maintext.blocks(page))
        right, total = right + sum(a == b for a, b in zip(found, labels)), total + len(labels)
    assert right / total > 0.98
    page = "<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>More</a></li></ul></nav><article><h1>A  head&amp;line</h1><p><b>First one here, it is.<br><p>Second&nbsp;\n one is long enough to be a sentence.</p></article><footer>&copy; me &middot; all</footer>"
    assert maintext.main_text(page, field) == "A head&line\nFirst one here, it is.\nSecond one is long enough to be a sentence."
    rows = [(1, "u", page), (None, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<" * 5000), (4, "u", "<p>" * 20_000 + "x"), (5, "u", "plain & <b unclosed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = maintext.extract(df, field=field)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert maintext.extract(df.limit(0), field=field).count() == 0


def plain_blocks(page):
    """Texts of leaf blocks by the standard parser, for pages whose tags are closed or are p and li."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.held = [], []

        def cut(self):
            text = " ".join("".join(self.held).split())
            self.out += [text] * bool(text)
            self.held = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.held.append(" ")
            elif tag not in ("a", "b", "i", "span", "em"):
                self.cut()

        def handle_endtag(self, tag):
            if tag not in ("a", "b", "i", "span", "em"):
                self.cut()

        def handle_data(self, data):
            self.held.append(data)

    p = Parser()
    p.feed(page)
    p.close()
    p.cut()
    return p.out


def test_blocks_equal_a_plain_parser():
    for page, labels in maintext.labelled_pages(200, 5):
        got = [b[0] for b in maintext.blocks(page)]
        assert got == plain_blocks(page) and len(got) == len(labels)


def test_paths_follow_what_tags_close():
    page = "<div class=a><p>one<p>two<div id='b'>three</div><ul><li>x<li>y<ul><li>z</ul><li>w</ul></i></nope><table><tr><td>1<td>2<tr><td>3</table></div>tail<i><section>in</i>s</section>"
    paths = [(b[0], ">".join(n.tag for n in b[1].path()) if b[1] else "") for b in maintext.blocks(page)]
    assert paths == [("one", "div>p"), ("two", "div>p"), ("three", "div>div"), ("x", "div>ul>li"), ("y", "div>ul>li"), ("z", "div>ul>li>ul>li"), ("w", "div>ul>li"), ("1", "div>table>tr>td"), ("2", "div>table>tr>td"), ("3", "div>table>tr>td"), ("tail", ""), ("ins", "section")]


def test_character_references_of_any_size():
    page = f"<p>&#65;&#0000000000066;&#x000000043;&#{'9' * 9000};&#x{'f' * 50};&eacute;&amp;lt;"
    assert maintext.blocks(page)[0][0] == "ABC\ufffd\ufffdé&lt;"


@pytest.mark.parametrize("page", ["<div>word " * 500_000, "<script " * 600_000, "<div class='c" * 400_000, '<a "x>y" ' * 500_000 + '"', "<b>" * 800_000 + "</i>" * 800_000, "</x><p>" * 600_000, "<i><div>" + "<b>" * 600_000 + "</i>" * 600_000, "".join(f"<div class=w{i}>t" for i in range(250_000)), "</script " * 500_000 + "<script>" * 3, "<" * 5_000_000, "<!--" * 1_000_000, "<a<a" * 1_000_000])
def test_time_is_linear_in_the_page(page):
    import time

    field = maintext.trained_field(40)
    before = time.process_time()
    maintext.main_text(page, field)
    assert time.process_time() - before < 25, len(page)


def test_layouts_that_the_generator_does_not_make():
    field = maintext.trained_field()
    body = "This long paragraph tells what happened in the town last week, and who was there to see it."
    pages = [
        f'<body><div id="wrapper"><div class="topbar"><a href="/">Home</a> <a href="/a">About</a></div><div role="main"><h1>Title of it</h1><p>{body}</p><p>{body}</p></div><div class="footer">&copy; 2020 Us</div></div>',
        f'<table><tr><td><ul class="nav"><li><a href="/1">One</a><li><a href="/2">Two</a></ul></td><td class="content"><h2>Title of it</h2><p>{body}<p>{body}</td></tr></table><footer><p>Imprint</p></footer>',
        f'<header class="site-header"><h2><a href="/">Site</a></h2></header><main><h1>Title of it</h1><p>{body}</p><aside class="related"><h4>More</h4><ul><li><a href="/x">Other</a></li></ul></aside><p>{body}</p></main><section id="comments"><div class="comment"><p>Nice one.</p></div></section>',
    ]
    for page in pages:
        assert maintext.main_text(page, field) == f"Title of it\n{body}\n{body}", page


def test_likelihood_gradient_is_right():
    field = maintext.BlockField()
    rng = np.random.default_rng(0)
    field.step = rng.normal(size=(2, 2))
    scores = rng.normal(size=(4, 2))
    node, edge = field._marginals(scores)
    paths = [[int(b) for b in f"{i:04b}"] for i in range(16)]
    weight = np.array([np.exp(sum(scores[k, y] for k, y in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    weight /= weight.sum()
    assert node[2, 1] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[2] == 1))
    assert edge[0, 1] == pytest.approx(sum(w * sum((a, b) == (0, 1) for a, b in zip(p, p[1:])) for w, p in zip(weight, paths)))
    assert field.viterbi(scores) == paths[int(weight.argmax())]


def test_weak_labels(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(8)) + "." for _ in range(300)]
    bad = [" ".join(word() + rng.choice(("###", "$$$")) for _ in range(60)) for _ in range(60)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, None), (7, good[7]), (5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = classifier.digest(docs).collect()
    assert len(got) == len(rows)
    right = [r["kept"] == (r["doc_id"] < 300) for r in got if r["doc_id"] is not None and r["doc_id"] < 5000]
    assert sum(right) / len(right) > 0.97
    assert classifier.digest(docs.limit(0)).count() == 0


def test_estimate_is_plain_expectation_maximisation():
    import math

    k = len(classifier.HEURISTICS)
    rng = random.Random(4)
    counts = Counter()
    for _ in range(3000):
        good = rng.random() < 0.7
        v = [(1 if good == (rng.random() < 0.9) else 2) if name in classifier.PRAISING else (0 if rng.random() < (0.02 if good else 0.4) else 2) for name in classifier.HEURISTICS]
        counts[sum(x * 3**i for i, x in enumerate(v))] += 1
    patterns = sorted(counts)
    got, prob, share = classifier.estimate(np.array(patterns), np.array([counts[p] for p in patterns]), rounds=7)
    v = {p: [p // 3**i % 3 for i in range(k)] for p in patterns}
    q = [[[0.01, 0.1, 0.89], [0.01, 0.9, 0.09]] if name in classifier.PRAISING else [[0.35, 0.01, 0.64], [0.02, 0.01, 0.97]] for name in classifier.HEURISTICS]
    s = 0.8
    for _ in range(7):
        post = {}
        for p in patterns:
            bad, good = (math.prod(q[i][c][v[p][i]] for i in range(k)) * (s if c else 1 - s) for c in (0, 1))
            post[p] = good / (good + bad)
        for i in range(k):
            for c in (0, 1):
                n = [0.1 + sum(counts[p] * (post[p] if c else 1 - post[p]) for p in patterns if v[p][i] == x) for x in range(3)]
                q[i][c] = [x / sum(n) for x in n]
        s = (sum(post[p] * counts[p] for p in patterns) + 1) / (sum(counts.values()) + 2)
    assert got.tolist() == pytest.approx([post[p] for p in patterns]) and share == pytest.approx(s)
    assert np.abs(prob - np.array(q)).max() < 1e-9


def test_scorer_is_plain_logistic_regression():
    import math

    rng = np.random.default_rng(6)
    rows = [(np.sort(rng.choice(16, 5, replace=False)), rng.random(5), float(rng.random())) for _ in range(30)]
    w, b = classifier.train(rows, bits=4, epochs=3)
    share = sum(y > 0.5 for _, _, y in rows) / len(rows)
    pw, pb, sq, bsq, order = [0.0] * 16, 0.0, [1e-3] * 16, 1e-3, np.random.default_rng(3)
    for _ in range(3):
        for i in order.permutation(len(rows)).tolist():
            at, x, y = rows[i]
            g = (0.5 / share if y > 0.5 else 0.5 / (1 - share)) * (1 / (1 + math.exp(-(sum(pw[j] * z for j, z in zip(at, x)) + pb))) - y)
            for j, z in zip(at, x):
                sq[j] += (g * z) ** 2
                pw[j] -= 0.5 * g * z / math.sqrt(sq[j])
            bsq += g * g
            pb -= 0.5 * g / math.sqrt(bsq)
    assert w.tolist() == pytest.approx(pw) and b == pytest.approx(pb)


def test_sample_is_bounded_whatever_is_repeated(spark):
    texts = spark.createDataFrame([("same",)] * 3000 + [(f"t{i}",) for i in range(500)], "text string")
    assert classifier.sampled(texts, 3500, 100).count() <= 100
    assert classifier.sampled(texts, 3500, 5000).count() == 501
    assert classifier.sampled(texts, 10**15, 100).count() == 0


def test_long_and_odd_texts_are_scored(spark):
    rows = [(1, "word here. " * 300_000), (1, None), (None, "x" * 1_000_000), (None, ""), (2, "a"), (2, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit("clash")).withColumn("h", F.lit(0)).withColumn("row", F.lit(1))
    assert classifier.scored(docs, docs.columns).select("row.*").columns == docs.columns
    assert classifier.digest(docs).count() == len(rows)


def plain_fusion(rows, languages):
    """The fusion of evidence row by row, in plain Python."""
    import math

    own = []
    for _, _, _, log in rows:
        e = [math.exp(x - max(log)) for x in log]
        own.append([x / sum(e) for x in e])
    k = len(languages)
    best = [languages[o.index(max(o))] for o in own]
    agree = sum(r[2] == b for r, b in zip(rows, best))
    right = (agree + 1) / (sum(r[2] in languages for r in rows) + 2)
    add = lambda keep: [sum(o[i] for o, r in zip(own, rows) if keep(r)) for i in range(k)]
    total = [x + 1 for x in add(lambda r: True)]
    everywhere = [x / sum(total) for x in total]
    out = []
    for (key, host, declared, log), o, b in zip(rows, own, best):
        prior = everywhere
        for level, weight in ((lambda r: r[1].split(".")[-1] == host.split(".")[-1], 20.0), (lambda r: r[1] == host, 5.0)):
            sums = add(lambda r: host is not None and r[1] is not None and level(r))
            less = [max(0.0, s - x) if host is not None else 0.0 for s, x in zip(sums, o)]
            prior = [(x + weight * p) / (sum(less) + weight) for x, p in zip(less, prior)]
        says = [0.0 if declared not in languages else math.log(right if declared == x else (1 - right) / (k - 1)) for x in languages]
        fused = [a + math.log(p) + s for a, p, s in zip(log, prior, says)]
        top = max(fused)
        out.append((key, languages[fused.index(top)], round(1 / sum(math.exp(x - top) for x in fused), 6), b, declared))
    return out


@pytest.mark.parametrize("numbers", [2_000_000, 0])
def test_fusion_equals_plain_python(spark, monkeypatch, numbers):
    monkeypatch.setattr(language, "BROADCAST_NUMBERS", numbers)
    rng = random.Random(2)
    languages = ["aa", "bb", "cc"]
    rows = [(i, rng.choice([None, "x.aa", "y.aa", "x.bb", "lone"]), rng.choice([None, "aa", "bb", "cc", "zz"]), [float(np.float32(rng.choice((-3, 0, -0.5)) + rng.random())) for _ in languages]) for i in range(200)]
    rows += [(500, "x.aa", None, [0.0, 0.0, 0.0])]
    got = language.identify(spark.createDataFrame(rows, "key long, host string, declared string, log array<double>"), languages).collect()
    want = {r[0]: r for r in plain_fusion(rows, languages)}
    for r in got:
        w = want[r["key"]]
        assert (r["lang"], r["text_lang"], r["declared"]) == (w[1], w[3], w[4]) and r["posterior"] == pytest.approx(w[2], abs=2e-6)
    assert len(got) == len(rows)


def test_languages_of_long_repeated_and_clashing_rows(spark):
    docs = spark.createDataFrame([(1, "der die das " * 100_000, "de", "s"), (1, "der die das", "de", "s"), (2, "the of and", "en", None), (2, "the of and", "en", None), (None, "", None, "s")], "doc_id long, text string, lang string, source string").withColumn("key", F.lit("clash")).withColumn("host", F.lit("x"))
    pages = spark.createDataFrame([(1, "u", "<p>the of and"), (1, "u", "<p>the of and"), (None, "http://h.x/", "")], "page_id long, url string, html string").withColumn("declared", F.lit("clash")).withColumn("log", F.lit(1))
    got = language.digest(docs, pages).collect()
    assert len(got) == 8 and all(r["lang"] == {1: "de", 2: "en"}[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_language(spark):
    rng = random.Random(9)
    make = lambda letters, n=40: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    kinds = {"aa": "abcd", "bb": "wxyz"}
    docs = spark.createDataFrame([(i, make(kinds[k]), k, "s") for i, k in enumerate(["aa", "bb"] * 60)] + [(None, None, None, None)], "doc_id long, text string, lang string, source string")
    page = lambda k, text: f'<html lang="{k}"><body><article><h1>{text[:20]}</h1><p>{text}.</p></article></body></html>'
    rows = [(i, f"http://{k}.example.{k}/x", page(k, make(kinds[k]))) for i, k in enumerate(["aa", "bb"] * 20)]
    rows += [(100, "http://aa.example.aa/y", "<html><body></body></html>"), (101, "http://aa.example.aa/z", page("bb", make("abcd"))), (102, None, None), (102, None, None)]
    got = language.digest(docs, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 121 + len(rows)
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert all(by[i]["lang"] == k for i, k in enumerate(["aa", "bb"] * 20))
    assert by[100]["lang"] == "aa" and by[101]["lang"] == "aa" and by[101]["declared"] == "bb"
    assert sum(r["lang"] == ("aa", "bb")[r["doc_id"] % 2] for r in got if r["doc_id"] is not None) == 120
    none = language.digest(docs.limit(0), spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert none.where("lang is null").count() == len(rows)


def test_language_models_for_all_languages(spark):
    """Two hundred languages, the rare ones with 3 documents beside 300 of a common one, and a sample of 6 for each."""
    rng = random.Random(10)
    letters = {f"l{chr(97 + i // 26)}{chr(97 + i % 26)}"[-3:]: "".join(rng.sample(string.ascii_lowercase, 4)) for i in range(200)}
    make = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(60))
    kinds = [k for k in letters for _ in range(3)] + [next(iter(letters))] * 300
    docs = spark.createDataFrame([(i, make(k), k, None) for i, k in enumerate(kinds)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(i, None, f'<html lang="{k}"><body></body></html>') for i, k in enumerate(letters)], "page_id long, url string, html string")
    languages, models = language.language_models(docs, sample_docs=6)
    assert languages == sorted(letters) and len(models) == 200 and all(np.ptp(m) > 1 for m in models)
    got = language.digest(docs, pages).collect()
    assert sum(r["lang"] == kinds[r["doc_id"]] for r in got if r["doc_id"] is not None) > 0.97 * len(kinds)
    assert all(r["declared"] == list(letters)[r["page_id"]] for r in got if r["page_id"] is not None)
