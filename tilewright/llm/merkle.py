"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, in SQL expressions only.

A paragraph is a line. Its leaves are its sentences, long ones cut into runs of 40 characters. A section
is a run of paragraphs that ends before a blank line or after a paragraph whose hash says so, so an edit
moves no later section's bounds. A parent's hash is that of its children's, and the root adds the section
count. Equal roots mean equal texts; where roots differ, the branches that differ hold the edit.

The fingerprint is a string, ``root/sections/paragraphs/leaves``, the hashes of each level in hex, joined
by dots. :func:`compared` descends two trees: equal sections at either end are left out, then equal
paragraphs at either end of the sections between, and only the leaves of what is left are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF_CHARS = 40
#: Every paragraph ends its section with probability 1 / SECTION.
SECTION = 8
#: Documents, about, of one range of ids, and the number of ranges beyond which they hold more instead.
RANGE_ROWS, MOST_RANGES = 4096, 1 << 16
#: Ids sampled for each bound.
OVERSAMPLE = 8
_LEAF = rf"(?s)[^.!?]{{1,{LEAF_CHARS}}}+[.!?]{{0,8}}+|[.!?]{{1,8}}+"
_SECTIONS = "array<struct<hash: bigint, n: int>>"


def _hex(hashes: Column, digits: int) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.right(F.lpad(F.hex(h), 16, "0"), F.lit(digits))), ".")


def paragraphs_of(text: Column) -> Column:
    """``array of struct(leaves, hash, blank)`` of a text; null is empty."""

    def paragraph(line: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(line, F.lit(_LEAF), F.lit(0)), lambda x: F.xxhash64(x))
        return F.struct(leaves.alias("leaves"), F.xxhash64(leaves, F.length(line)).alias("hash"), (F.length(F.trim(line)) == 0).alias("blank"))

    return F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), paragraph)


def sections_of(paragraphs: Column) -> Column:
    """``array of struct(hash, n)``, n paragraphs each: a fold that closes a section at a blank line or a chosen paragraph."""
    start = F.struct(F.lit(0).cast("bigint").alias("open"), F.lit(0).alias("n"), F.array().cast(_SECTIONS).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        joined, n = F.xxhash64(acc["open"], p["hash"]), acc["n"] + 1
        close = p["blank"] | (F.pmod(p["hash"], F.lit(SECTION)) == 0)
        done = F.concat(acc["done"], F.array(F.struct(joined.alias("hash"), n.alias("n"))))
        return F.struct(F.when(close, F.lit(0).cast("bigint")).otherwise(joined).alias("open"), F.when(close, 0).otherwise(n).alias("n"), F.when(close, done).otherwise(acc["done"]).alias("done"))

    return F.aggregate(paragraphs, start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["open"].alias("hash"), acc["n"].alias("n")))))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}fingerprint`` and ``{prefix}tree``: sections and paragraphs as (hash, n children), and leaf hashes."""
    p, s = f"__{prefix}p", f"__{prefix}s"
    out = df.withColumn(p, paragraphs_of(F.col(text)))
    out = out.withColumn(s, sections_of(F.col(p)))
    leaves = F.flatten(F.transform(p, lambda x: x["leaves"]))
    paragraphs = F.transform(p, lambda x: F.struct(x["hash"].alias("hash"), F.size(x["leaves"]).alias("n")))
    out = out.withColumn(f"{prefix}tree", F.struct(F.col(s).alias("sections"), paragraphs.alias("paragraphs"), leaves.alias("leaves"))).drop(p, s)
    level = lambda name: F.transform(f"{prefix}tree.{name}", lambda x: x["hash"])
    root = F.substring(F.sha2(F.concat_ws(".", F.size(f"{prefix}tree.sections"), _hex(level("sections"), 16), _hex(level("paragraphs"), 16)), 256), 1, 32)
    whole = F.concat_ws("/", root, _hex(level("sections"), 8), _hex(level("paragraphs"), 8), _hex(F.col(f"{prefix}tree.leaves"), 8))
    return out.withColumn(f"{prefix}fingerprint", whole)


def _equal(a: Column, b: Column) -> Column:
    """How many nodes from the first on have the same hash."""
    same = F.zip_with(a, b, lambda x, y: x["hash"].eqNullSafe(y["hash"]))
    return (F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))).cast("int")


def _rest(x: Column, front: Column, back: Column | int = 0) -> Column:
    return F.slice(x, front + 1, F.greatest(F.size(x) - front - back, F.lit(0)))


def _children(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0), lambda acc, x: acc + x["n"])


def compared(df: DataFrame, a: str, b: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}likeness`` of the trees ``a`` and ``b``, and where the first's edit is: ``{prefix}from`` and
    ``{prefix}paragraphs``, the first paragraph that differs and how many from it on hold all differences.

    likeness, 0 to 1: the share of the larger tree's leaves that lie in equal branches or, among the branches
    that differ, are in both; 1 at equal roots alone. Trees without leaves are like no other than their equals.
    """
    temporary = []

    def named(name: str, value: Column) -> Column:
        nonlocal df
        temporary.append(f"__{prefix}{name}")
        df = df.withColumn(temporary[-1], value)
        return F.col(temporary[-1])

    def descend(level: str, x: Column, y: Column, below_x: Column, below_y: Column) -> tuple[Column, Column, Column]:
        """The children of what differs, of both, and how many children come before."""
        front = named(f"{level}_front", _equal(x, y))
        rx, ry = named(f"{level}_x", _rest(x, front)), named(f"{level}_y", _rest(y, front))
        back = named(f"{level}_back", _equal(F.reverse(rx), F.reverse(ry)))
        before = named(f"{level}_before", _children(F.slice(x, 1, front)))
        after = named(f"{level}_after", _children(F.slice(rx, F.size(rx) - back + 1, back)))
        return named(f"{level}_bx", _rest(below_x, before, after)), named(f"{level}_by", _rest(below_y, before, after)), before

    s, t = F.col(a), F.col(b)
    px, py, before = descend("s", s["sections"], t["sections"], s["paragraphs"], t["paragraphs"])
    skipped = [named(f"lead_{x}", _children(F.slice(tree["paragraphs"], 1, before))) for x, tree in (("x", s), ("y", t))]
    within = [named(f"in_{x}", _children(p)) for x, p in (("x", px), ("y", py))]
    lx, ly, _ = descend("p", px, py, *(named(f"leaves_{x}", F.slice(tree["leaves"], skip + 1, n)) for x, tree, skip, n in (("x", s, skipped[0], within[0]), ("y", t, skipped[1], within[1]))))
    n = [F.size(s["leaves"]), F.size(t["leaves"])]
    most = F.greatest(*n)
    both = (n[0] - F.size(lx)) + F.size(F.array_intersect(lx, ly))
    same = s["sections"] == t["sections"]
    likeness = F.when(same, 1.0).when(most == 0, 0.0).otherwise(F.least(both, most - F.lit(0.5)) / most)
    front, back = F.col(f"__{prefix}p_front"), F.col(f"__{prefix}p_back")
    df = df.withColumn(f"{prefix}likeness", likeness)
    df = df.withColumn(f"{prefix}from", F.when(~same, before + front)).withColumn(f"{prefix}paragraphs", F.when(same, 0).otherwise(F.size(px) - front - back))
    return df.drop(*temporary)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """``(id, text, key, range, copy)`` and a window for further columns of the next document by ascending id.

    Documents go to ranges of (id, text hash) whose bounds are sampled from the table by a hash, ``OVERSAMPLE`` for each
    bound; each row finds its range by halving. Each range also holds a copy of the next one's first document,
    the last range a copy of the first document of all. So the next document is always in the same range,
    and no range holds the table. The bounds are a subquery's value, at most ``MOST_RANGES`` of them.
    """
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    source = docs.select(docs[f"`{id_col}`"].alias("id"), text.alias("text")).withColumn("key", F.struct("id", F.xxhash64("text").alias("th")))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    every = max(1, n // (ranges * OVERSAMPLE))
    chosen = F.when(F.pmod(F.xxhash64("key"), F.lit(every)) == 0, F.col("key")) if ranges > 1 else F.when(F.lit(False), F.col("key"))
    sampled = F.array_sort(F.collect_set(chosen))
    bounds = F.filter(sampled, lambda x, i: i % OVERSAMPLE == OVERSAMPLE - 1)
    known = source.agg(F.struct(bounds.alias("bounds"), F.min("key").alias("low")).alias("known"))
    rows = source.withColumn("known", known.scalar())
    start = F.struct(F.lit(0).alias("lo"), F.size("known.bounds").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = (acc["lo"] < acc["hi"]) & (F.get(F.col("known.bounds"), middle) <= F.col("key"))
        return F.struct(F.when(up, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(middle).alias("hi"))

    steps = max(1, (ranges * 4).bit_length())
    rows = rows.withColumn("mine", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["lo"]))
    copies = F.array_compact(
        F.array(
            F.struct(F.col("mine").alias("range"), F.lit(0).alias("copy")),
            F.when((F.col("mine") > 0) & F.get(F.col("known.bounds"), F.col("mine") - 1).eqNullSafe(F.col("key")), F.struct((F.col("mine") - 1).alias("range"), F.lit(1).alias("copy"))),
            F.when(F.col("key").eqNullSafe(F.col("known.low")), F.struct(F.size("known.bounds").alias("range"), F.lit(2).alias("copy"))),
        )
    )
    dealt = rows.withColumn("c", F.explode(copies)).select("id", "text", "key", "c.*")
    window = Window.partitionBy("range").orderBy(F.col("copy") == 2, "key", "copy")
    return dealt, window


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has its last quarter of code points replaced by as many from the start of the next
    document by ascending id; after the last comes the first. edited_from and edited_paragraphs say where the
    trees locate the edit. Null text is empty. Null ids come first; rows that repeat an id follow each other by
    their texts' hashes. A single row follows itself. Ids may be of any orderable type. Other columns are not
    read. An empty table gives an empty result.
    """
    dealt, window = with_next(docs, id_col, text_col)
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring(F.lead("text").over(window), F.lit(1), quarter))
    rows = dealt.withColumn("edited", F.coalesce(edited, F.col("text")))
    rows = with_tree(rows, "text", "")
    rows = rows.withColumn("next_tree", F.lead("tree").over(window)).where("copy = 0")
    rows = with_tree(rows, "edited", "edited_")
    rows = compared(compared(rows, "tree", "edited_tree", "edited_"), "tree", "next_tree", "next_")
    return rows.select(
        F.col("id").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.col("edited_likeness").alias("near_edited"),
        F.col("next_likeness").alias("near_next"),
        "edited_from",
        "edited_paragraphs",
    )
