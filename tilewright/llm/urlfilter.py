"""URL filter: rules, then the likelihood ratio of two character models, in SQL expressions only.

Rules name a host and a path; the longest that fits decides. The urls that rules decide train two Markov
models of variable order, of accepted and of rejected urls: a character's probability after its last three
is smoothed towards that after its last two, and so on to the uniform one, so that each context counts as
far as it has been seen. A url's score is the mean of its characters' log ratios. The cutoff is calibrated on
urls held out of the training by a hash: it is the one with the fewest errors, both kinds weighed alike.

The alphabet has 32 symbols, so the model's tables have at most 32^4 and twice 32^3 rows whatever the corpus,
which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.storage import materialize

#: (verdict, rule), a rule being a host and a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Symbols 1 to 31; all digits are "0", and what is in none is symbol 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-?"
SIZE, ORDER = 32, 4
#: Weight of the shorter context, in characters seen.
PRIOR = 4.0
#: One url in so many is held out for the cutoff.
HOLDOUT = 5
#: Scores are counted in bins of this width, from -LIMIT to LIMIT.
BIN, LIMIT = 0.01, 4.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)
    return df.withColumn("host", host).withColumn("path", F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit("")))


def fits(rule: str) -> Column:
    """Does the rule fit the host, or a domain above it, and the start of the path?"""
    host, _, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


def matched(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the last that fits wins
        rule, verdict = F.when(fits(r), r).otherwise(rule), F.when(fits(r), v).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """Symbol numbers of the lower-cased url behind its scheme, with three of symbol 0 ahead."""
    text = F.translate(F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")), "123456789", "000000000")
    found = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array_repeat(F.lit(0), ORDER - 1), F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(found))


def grams(codes: Column) -> Column:
    """One number for each symbol and the three before it."""
    places = F.when(F.size(codes) >= ORDER, F.sequence(F.lit(0), F.size(codes) - ORDER)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(codes, i) * SIZE**3 + F.get(codes, i + 1) * SIZE**2 + F.get(codes, i + 2) * SIZE + F.get(codes, i + 3))


def url_key() -> list[Column]:
    """128 bits that stand for ``url`` wherever a row for each of its characters would carry it."""
    return [F.xxhash64("url").alias("k1"), F.xxhash64(F.lit(1), "url").alias("k2")]


def exploded(urls: DataFrame) -> DataFrame:
    """A row for each character of ``url``, with its gram in place of the url."""
    # the generator keeps the symbols from being worked out anew for each gram
    coded = urls.withColumn("codes", F.explode(F.array(symbols(F.col("url"))))).drop("url").withColumn("grams", grams(F.col("codes"))).drop("codes")
    return coded.withColumn("gram", F.explode("grams")).drop("grams").withColumn("gram", F.col("gram").cast("long"))


def model(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the log of p(symbol | context) for accepted over rejected urls.

    ``counts``: gram, good, bad. A gram's last k symbols are its remainder by 32^k. The first table has the
    value of each gram seen; of one that is not, it is the second table's, of its last three symbols, and
    the third's, of the three symbols before its last.
    """
    sides = ("good", "bad")
    short = counts.sparkSession.range(SIZE ** (ORDER - 1), numPartitions=1).withColumnRenamed("id", "short")
    p = {x: F.lit(1.0 / SIZE) for x in sides}

    def smoothed(k: int, above: dict) -> dict:
        return {x: (F.coalesce(F.col(f"n{k}_{x}"), F.lit(0)) + PRIOR * above[x]) / (F.coalesce(F.col(f"m{k}_{x}"), F.lit(0)) + PRIOR) for x in sides}

    def sums(k: int) -> tuple[DataFrame, DataFrame]:
        tail = F.col("gram") % SIZE**k
        return counts.groupBy(tail.alias("tail")).agg(*[F.sum(x).alias(f"n{k}_{x}") for x in sides]), counts.groupBy(F.floor(tail / SIZE).alias("context")).agg(*[F.sum(x).alias(f"m{k}_{x}") for x in sides])

    for k in range(1, ORDER):
        seen, above = sums(k)  # at most 32^k rows
        tail = F.col("short") % SIZE**k
        short = short.withColumn("tail", tail).join(F.broadcast(seen), "tail", "left").drop("tail")
        short = short.withColumn("context", F.floor(tail / SIZE)).join(F.broadcast(above), "context", "left").drop("context")
        p = smoothed(k, p)
    short = materialize(short.select("short", p["good"].alias("p_good"), p["bad"].alias("p_bad")), "url-model")
    _, above = sums(ORDER)
    long = counts.select("gram", *[F.col(x).alias(f"n{ORDER}_{x}") for x in sides], (F.col("gram") % SIZE ** (ORDER - 1)).alias("short"), F.floor(F.col("gram") / SIZE).alias("context"))
    long = long.join(F.broadcast(short), "short").join(F.broadcast(above), "context")
    p = smoothed(ORDER, {x: F.col(f"p_{x}") for x in sides})
    return (
        long.select("gram", F.ln(p["good"] / p["bad"]).alias("value")),
        short.select("short", F.ln(F.col("p_good") / F.col("p_bad")).alias("short_value")),
        above.select("context", F.ln((F.col(f"m{ORDER}_bad") + PRIOR) / (F.col(f"m{ORDER}_good") + PRIOR)).alias("context_value")),
    )


def scores(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``(k1, k2, score)`` for each distinct non-null url that has a character behind its scheme."""
    seen, short, context = model(counts)
    each = exploded(urls.where("url is not null").select(*url_key(), "url"))
    each = each.join(F.broadcast(seen), "gram", "left")  # at most 32^4 rows
    each = each.withColumn("short", F.col("gram") % SIZE ** (ORDER - 1)).join(F.broadcast(short), "short", "left")
    each = each.withColumn("context", F.floor(F.col("gram") / SIZE)).join(F.broadcast(context), "context", "left")
    value = F.coalesce("value", F.coalesce("short_value", F.lit(0.0)) + F.coalesce("context_value", F.lit(0.0)))
    # characters of one url are neighbours, so the map side leaves one row for each; repeated urls sum to the same mean
    return each.groupBy("k1", "k2").agg(F.avg(value).alias("score"))


def judged(pages: DataFrame, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """All columns of ``pages`` as ``row``, with host, path, rule, score and verdict.

    Null urls and those without ``://`` have an empty host and path, fit no rule, and are judged by their
    characters; a url without characters has score 0. At a score of the cutoff or more the verdict is
    allow. Where rules decide no url of one kind, all scores are 0 and the cutoff is too. Repeated rows
    are judged alike; an empty table gives an empty result.
    """
    source = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"), pages[f"`{url_col}`"].cast("string").alias("url"))
    rule, verdict = matched(rules)
    rows = with_parts(source, "url").withColumn("rule", rule).withColumn("by_rule", verdict)
    held = F.pmod(F.xxhash64("url"), F.lit(HOLDOUT)) == 0
    training = rows.where("rule is not null").where(~held)
    counts = exploded(training.select("by_rule", "url")).groupBy("gram").agg(F.sum((F.col("by_rule") == "allow").cast("long")).alias("good"), F.sum((F.col("by_rule") == "block").cast("long")).alias("bad"))
    counts = materialize(counts, "url-grams")
    good, bad = counts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    both = good > 0 and bad > 0
    # the larger kind counts as much as the smaller: what neither has seen then speaks for neither
    least = min(good, bad)
    counts = counts.select("gram", *[(F.col(x) * F.lit(least / max(n, 1))).alias(x) for x, n in (("good", good), ("bad", bad))]).where(F.lit(both))
    table = materialize(scores(source.select("url"), counts), "url-scores")
    scored = rows.withColumns(dict(zip(("k1", "k2"), url_key()))).join(table, ["k1", "k2"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    cut = _cutoff(scored.where("rule is not null").where(held).select("by_rule", F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / BIN).alias("bin"))) if both else 0.0
    final = F.coalesce(F.col("by_rule"), F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("row", "host", "path", "rule", "score", final.alias("verdict"))


def _cutoff(held: DataFrame) -> float:
    """The bin's lower end with the least sum of both error rates; 0 where either kind is missing."""
    bins = held.groupBy("bin").agg(F.sum((F.col("by_rule") == "allow").cast("long")).alias("good"), F.sum((F.col("by_rule") == "block").cast("long")).alias("bad"))
    counted = sorted((r["bin"], r["good"], r["bad"]) for r in bins.collect())  # as many rows as there are bins at most
    good, bad = sum(r[1] for r in counted), sum(r[2] for r in counted)
    if not good or not bad:
        return 0.0
    best, cut, lost, passed = 2.0, 0.0, 0, bad
    for b, g, x in counted:
        error = lost / good + passed / bad
        if error < best:
            best, cut = error, b * BIN
        lost, passed = lost + g, passed - x
    return cut


def digest(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
