"""SimHash near-dedup to an exact bound: texts whose sets of word shingles have a Jaccard similarity of ``least`` or more.

A SimHash of 64 bits cannot tell a similarity of 0.8: such texts differ in about ten of the bits, and radii that
wide meet by chance. So the fingerprint is wider, the bit-sliced comparison rules out, and the sets decide.

1. *Blocks.* Under any one order of all shingles, two sets of similarity t or more share one of the first
   n - ceil(t n) + 1 of each (n: the set's size). So sets meet under the shingles of their prefixes, and no link is
   lost. The order puts shingles that are frequent in a sample of the documents last; it bears on the cost alone.
2. *Bit-sliced comparison.* Within a block, SimHash fingerprints of ``BITS`` bits are compared as in :mod:`simhash`:
   bit planes, carry-save counters, blocks abandoned beyond ``RADIUS``. A bit differs with probability
   acos(8/9) / pi = 0.1515 at most where the similarity is 0.8, so a pair passes the radius by chance once
   in 2.7e7 times. Sets of fewer than ``SMALL`` shingles are not ruled out by fingerprints.
3. *Parity sketches.* Each shingle flips one of ``SKETCH_BITS`` bits. Two sketches differ in at most as many bits as
   the sets differ in shingles, so what differs in more than the similarity allows goes. Only a spanning forest of
   what is left leaves the block, never its pairs.
4. *Exact check.* The forest's pairs are compared shingle by shingle. Where one fails and its ends stay apart, the
   blocks are gone through again for all that lies between their components.
5. *Large blocks.* Members are compared with one of them, the pivot, for some rounds; what is still in several
   components is dealt out in chunks, and each two chunks are compared like a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.simhash import WORD, bit_planes, rows_kept, within
from tilewright.llm.words import give_back, slices, split_words
from tilewright.operators.components import connected_components
from tilewright.storage import discard, hinted, materialize

#: Bits of a fingerprint, and how many may differ.
BITS, RADIUS = 256, 72
#: Smaller sets are not ruled out by their fingerprints: the share of differing bits is an average over shingles.
SMALL = 64
SKETCH_BITS = 2048
#: Documents, about, whose shingles tell which are frequent; how often that is; how many are remembered. Cost only.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 8_000, 3, 200_000
#: Texts are taken in slices of about so many bytes: a byte of text takes some thirty of memory.
SLICE_BYTES = 1 << 20
#: A block of more sets is compared with pivots, for so many rounds, and then in chunks of half as many.
BLOCK_SETS, PIVOT_ROUNDS = 2048, 3
#: Rows of small blocks that share a sweep, and pairs whose sketches are compared at once.
TILE, PAIRS = 512, 1 << 15

_FP = [f"f{i}" for i in range(BITS // 64)]
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct k-word shingles, ascending, end to end, and n + 1 offsets. A text of fewer words is one shingle."""
    n = len(column)
    words, rows = split_words(column)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    coded = words.dictionary_encode()
    digest = np.fromiter((xxhash.xxh64_intdigest(w.lower()) | 1 for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    word = np.concatenate([digest[np.asarray(coded.indices, dtype=np.int64)], np.zeros(k, np.uint64)])
    end = np.searchsorted(rows, rows, side="right")
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    at = np.flatnonzero(first | (np.arange(len(rows)) + k <= end))
    h, stop = np.zeros(len(at), np.uint64), end[at]
    for i in range(k):
        h = (h ^ np.where(at + i < stop, word[at + i], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    row = rows[at]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def prefix_size(n: np.ndarray, least: Fraction) -> np.ndarray:
    """n - ceil(least n) + 1, in whole numbers; 0 for the empty set."""
    return np.where(n > 0, n - -(-n * least.numerator // least.denominator) + 1, 0)


def similar(shared, a, b, least: Fraction):
    """Is shared / (a + b - shared) at least ``least``, in whole numbers?"""
    return shared * (least.numerator + least.denominator) >= least.numerator * (a + b)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of ``BITS`` bits over a set's shingle hashes: four words, each from another mix of the hashes."""
    out = np.zeros(len(_SALTS), np.uint64)
    for i, salt in enumerate(_SALTS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            x = (h[at : at + (1 << 15)] ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            x ^= x >> np.uint64(29)
            ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = ((2 * ones > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()
    return out


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that are frequent in a sample, and their counts."""
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    sample = docs.where(F.pmod(F.col("th"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, _ = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
        give_back()

    counts = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _described(docs: DataFrame, k: int, least: Fraction, id_type: T.DataType) -> DataFrame:
    """``(id, th, rid, sid, size, f0, ..., odd, keys)``: text hash, row number, hash of the set, its size, fingerprint, sketch and prefix."""
    context = docs.sparkSession.sparkContext
    known = context.broadcast(_frequent(docs, k))
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("th long, sid long, size long").fields, *(T.StructField(x, T.LongType()) for x in _FP), T.StructField("odd", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = known.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, offsets = shingle_sets(part.column("text"), k)
                size = np.diff(offsets)
                rank = np.zeros(len(h), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    rank = np.where(hot[at] == h, often[at], 0)
                row = np.repeat(np.arange(len(size)), size)
                ordered = h[np.lexsort((h, rank, row))]
                prefix = prefix_size(size, least)
                take = np.arange(len(h)) - offsets[row] < prefix[row]
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)), pa.array(ordered[take].view(np.int64)))
                cuts = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                sid = np.fromiter((_set_id(h[a:b]) for a, b in cuts), np.uint64, len(cuts)).view(np.int64)
                fp = np.array([wide_fingerprint(h[a:b]) for a, b in cuts], np.uint64).reshape(len(cuts), len(_FP)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(sid), pa.array(size.astype(np.int64)), *(pa.array(fp[:, i].copy()) for i in range(len(_FP))), pa.array([_sketch(h[a:b]) for a, b in cuts], pa.binary()), keys], schema.names)
        give_back()

    return docs.select("id", "th", "text").mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id())


def _set_id(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes())


def _sketch(h: np.ndarray) -> bytes:
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _near_pairs(block: np.ndarray, size: np.ndarray, fps: np.ndarray, odd: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)``, j < i, of sets of one block that neither sizes, fingerprints nor sketches rule out."""
    num, den = least.numerator, least.denominator
    planes, left, right = bit_planes(fps), [], []
    for at in range(0, len(size), TILE):
        stop = min(at + TILE, len(size))
        near = within(planes[:, : -(-stop // WORD)], fps[at:stop], RADIUS)
        ok = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(stop - at, -1), axis=1, bitorder="little")[:, :stop].astype(bool)
        mine, other = size[at:stop, None], size[None, :stop]
        ok |= np.minimum(mine, other) < SMALL
        ok &= (block[at:stop, None] == block[None, :stop]) & np.tri(stop - at, stop, at - 1, dtype=bool)
        ok &= (np.minimum(mine, other) * den >= np.maximum(mine, other) * num)
        i, j = np.nonzero(ok)
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS] + at, j[k : k + PAIRS]
            # J >= t exactly if the sets differ in (1 - t) / (1 + t) of the sum of their sizes at most
            differ = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
            keep = differ * (den + num) <= (den - num) * (size[a] + size[b])
            left.append(a[keep]), right.append(b[keep])
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs, sorted, that make a spanning forest: in each turn the first pair of each component."""
    label, left, right = np.arange(n), [], []
    while len(i):
        _, at = np.unique(label[i], return_index=True)
        for a, b in zip(i[at].tolist(), j[at].tolist()):
            x, y = label[a], label[b]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                left.append(a), right.append(b)
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return np.array(left, np.int64), np.array(right, np.int64)


def _within_blocks(members: DataFrame, least: Fraction, by: list[str], rooted: bool = False) -> DataFrame:
    """``(u, v)``, u < v: near sets of each block, told by the ``by`` columns and of at most ``BLOCK_SETS`` members.

    A spanning forest of them or, given each set's ``root``, all of different roots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("block"))
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1].column("block")[-1].as_py() != key[0]:
                change = np.concatenate([[0], change])
            if len(change):  # the last block may go on
                yield compared(pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))]))
                held, batch = [], batch.slice(int(change[-1]))
            held.append(batch)
        if held:
            yield compared(pa.Table.from_batches(held))
        give_back()

    def compared(rows: pa.Table) -> pa.RecordBatch:
        sid = np.asarray(rows["sid"])
        key = np.asarray(rows["block"])
        order = np.lexsort((sid, np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))))
        size, fps = np.asarray(rows["size"]), np.stack([np.asarray(rows[c]) for c in _FP], axis=1).view(np.uint64)
        odd = np.frombuffer(b"".join(rows["odd"].to_pylist()), np.uint64).reshape(len(sid), -1)
        sid, key, size, fps, odd = (x[order] for x in (sid, key, size, fps, odd))
        root = np.asarray(rows["root"])[order] if rooted else None
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
        u, v, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(cuts) - 1:  # small blocks share a sweep
            to = at + 1
            while to < len(cuts) - 1 and cuts[to + 1] - cuts[at] <= TILE:
                to += 1
            part = slice(cuts[at], cuts[to])
            i, j = _near_pairs(key[part], size[part], fps[part], odd[part], least)
            if rooted:
                apart = root[part][i] != root[part][j]
                i, j = i[apart], j[apart]
            else:
                i, j = _forest(cuts[to] - cuts[at], i, j)
            own = sid[part]
            u.append(np.minimum(own[i], own[j])), v.append(np.maximum(own[i], own[j]))
            at = to
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    dealt = members.select(F.xxhash64(*by).alias("block") if by != ["block"] else F.col("block"), "sid", "size", *_FP, "odd", *(["root"] if rooted else [])).repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _near(a: str, b: str, least: Fraction) -> Column:
    """Do sizes and fingerprints of the structs ``a`` and ``b`` leave it open that the sets are similar?"""
    differ = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in _FP), F.lit(0))
    small, big = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return (small * least.denominator >= big * least.numerator) & ((small < SMALL) | (differ <= RADIUS))


def _checked(pairs: DataFrame, described: DataFrame, docs: DataFrame, k: int, least: Fraction) -> DataFrame:
    """The pairs ``(u, v)`` of a similarity of ``least`` or more; ``pairs`` is materialized."""
    ends = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct()
    wanted = materialize(described.select("sid", "th").join(ends, "sid", "left_semi").groupBy("sid").agg(F.min("th").alias("th")).select("th").distinct(), "wanted")
    texts = docs.select("th", "text").join(hinted(wanted), "th", "left_semi").dropDuplicates(["th"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, offsets = shingle_sets(part.column("text"), k)
                each = [h[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                sid = np.fromiter((_set_id(x) for x in each), np.uint64, len(each)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array([x.tobytes() for x in each], pa.binary())], ["sid", "shingles"])
        give_back()

    sets = materialize(texts.mapInArrow(shingles, "sid long, shingles binary"), "shingles")
    both = pairs.join(sets.select(F.col("sid").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("sid").alias("v"), F.col("shingles").alias("sv")), "v").select("u", "v", "su", "sv")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("su", "sv"))
                ok[i] = similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("u", "v")], ["u", "v"])
        give_back()

    out = materialize(both.mapInArrow(check, "u long, v long").distinct(), "links")
    discard(wanted, sets)
    return out


def set_links(described: DataFrame, docs: DataFrame, k: int, least: Fraction) -> DataFrame:
    """``(u, v)``: links of sets whose components are those of all similar pairs."""
    own = described.groupBy("sid").agg(F.min("rid").alias("own"))
    more = materialize(described.select("sid", "rid").join(own, "sid").where("rid > own").select("rid"), "more")
    sets = described.join(hinted(more), "rid", "left_anti")
    keys = sets.select("sid", F.explode("keys").alias("block"))
    blocks = keys.groupBy("block").agg(F.count("*").alias("n"), F.min("sid").alias("u"), F.max("sid").alias("v"), F.bit_xor("sid").alias("all")).where("n > 1")
    blocks = materialize(blocks.groupBy("n", "u", "v", "all").agg(F.min("block").alias("block")).select("block", "n"), "blocks")  # equal members once
    members = materialize(keys.join(hinted(blocks), "block"), "members")
    known = sets.select("sid", "size", *_FP, "odd")
    check = lambda pairs: _checked(pairs, described, docs, k, least)
    small, large = members.where(F.col("n") <= BLOCK_SETS), members.where(F.col("n") > BLOCK_SETS)

    def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
        roots = connected_components(found).withColumnRenamed("node", "sid")
        return rows.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        roots = materialize(connected_components(found), "roots")
        a, b = (roots.select(F.col("node").alias(s), F.col("root").alias(f"r{s}")) for s in ("u", "v"))
        out = materialize(pairs.join(a, "u", "left").join(b, "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v"), "apart")
        discard(roots)
        return out

    def with_pivot(rows: DataFrame, turn: int) -> DataFrame:
        """Near pairs of a block's member of the smallest hash and each other one: blocks that share members share pivots."""
        low = F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("by"), F.struct("sid", "size", *_FP, "root").alias("p")))
        pivots = rows.groupBy("block").agg(low.alias("low")).select("block", "low.p")
        near = rows.withColumn("me", F.struct("sid", "size", *_FP)).join(pivots, "block").where("root <> p.root").where(_near("me", "p", least))
        return near.select(F.least("sid", "p.sid").alias("u"), F.greatest("sid", "p.sid").alias("v"))

    forest = materialize(_within_blocks(small.join(known, "sid"), least, ["block"]), "forest")
    # at most one pair for each set first, which links most; then what these have left apart
    first = materialize(forest.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "pairs")
    found = check(first)
    rest = apart(forest, found)
    if not rest.isEmpty():
        found = materialize(found.unionByName(check(rest)), "found")
        failed = apart(rest, found)
        if not failed.isEmpty():
            again = small.join(members.join(failed.select(F.col("u").alias("sid")).distinct(), "sid", "left_semi").select("block").distinct(), "block", "left_semi")
            pairs = materialize(_within_blocks(rooted(again, found).join(known, "sid"), least, ["block"], True), "pairs")
            found = materialize(found.unionByName(check(pairs)), "found")
            discard(pairs)
        discard(failed)
    discard(forest, first, rest)
    for turn in range(PIVOT_ROUNDS + 1):
        if large.isEmpty():
            break
        now = rooted(large, found)
        several = now.groupBy("block").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).where("a < b").select("block", "m")
        left = materialize(now.join(several, "block"), "open")
        if turn < PIVOT_ROUNDS:
            pairs = with_pivot(left.join(known, "sid"), turn)
        else:
            chunks = F.ceil(F.col("m") / F.lit(BLOCK_SETS // 4)).cast("int")
            mine = left.withColumn("chunk", F.pmod(F.xxhash64("sid"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
            both = mine.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other"))
            pairs = _within_blocks(both.join(known, "sid"), least, ["block", "a", "b"], True)
        pairs = materialize(pairs.distinct(), "pairs")
        found = materialize(found.unionByName(check(pairs)), "found")
        large = left.select("block", "sid", "n")
    discard(members, blocks)
    return found


def _labelled(docs: DataFrame, id_col: str, text_col: str, k: int, least: Fraction) -> DataFrame:
    """``(id, th, component_id)`` for every row."""
    text = docs[f"`{text_col}`"].cast("string")
    source = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    described = materialize(_described(source, k, least, docs.schema[id_col].dataType), "described")
    roots = materialize(connected_components(set_links(described, source, k, least)), "roots")
    low = described.groupBy("sid").agg(F.min("id").alias("low"))
    label = low.join(roots, low.sid == roots.node, "left").select("sid", F.coalesce("root", "sid").alias("root"), "low")
    component = label.groupBy("root").agg(F.min("low").alias("component_id"))
    return described.select("id", "th", "sid").join(label.select("sid", "root").join(component, "root").select("sid", "component_id"), "sid").select("id", "th", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """``(id_col, component_id)`` for every row.

    Rows whose sets of k-word shingles have a Jaccard similarity of ``least`` or more are linked, and texts
    without a word are linked with each other; component_id is the smallest id reachable. Null ids are as in
    :func:`simhash.near_duplicates`. Other columns are not read. An empty table gives an empty result.
    """
    return _labelled(docs, id_col, text_col, k, least).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` whose id is their group's smallest; rows that share an id or have none as in :func:`simhash.rows_kept`."""
    return rows_kept(docs, _labelled(docs, id_col, text_col, k, least), id_col, text_col)
