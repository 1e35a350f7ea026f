"""SimHash near-duplicate groups with bit-sliced comparison.

Fingerprints are stored as vertical bit planes: bit b of up to 64 fingerprints in one machine word.
The distances from a query to 64 fingerprints at once live in carry-save bit counters that saturate
beyond the radius; a block is abandoned as soon as every distance in it has passed the radius.

Candidates come from the pigeonhole principle, so no link is lost: of ``m`` bit ranges, fingerprints
within ``radius`` agree on at least ``m - radius``. Each choice of that many ranges is one key; ``m``
grows with the number of distinct fingerprints, which keeps the mean block small at any size, and a
block that is still large is keyed again by the bits that its key leaves open. A block yields a
spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.words import slices
from tilewright.operators.components import connected_components
from tilewright.storage import discard, hinted, materialize

WORD = 64
#: Rows of the queries that one sweep over the planes handles.
TILE = 512
#: A block of more fingerprints is keyed again by its open bits.
BLOCK_ROWS = 32_768


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's k-word shingles, repeats included; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), stops[min(k, len(words)) - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """``(id, th, fp)``: the text's hash, and its fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType
    text = docs[f"`{text_col}`"].cast("string")
    source = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.fromiter((fingerprint(t, k, seed) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(fp.view(np.int64))], ["id", "th", "fp"])

    return source.mapInArrow(run, T.StructType([T.StructField("id", id_type), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType())]))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """A row of machine words for each bit: bit j of word w in row b is bit b of fingerprint 64 w + j.

    A fingerprint is one word, or a row of words that follow each other.
    """
    fps = fps.reshape(len(fps), -1)
    n = -(-len(fps) // WORD) * WORD
    padded = np.zeros((n, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, radius: int, check_every: int = 8) -> np.ndarray:
    """A bit for each query and fingerprint: is their distance at most ``radius``?

    The counters hold distance modulo 2^c with 2^c > radius; ``over`` keeps what has passed it.
    """
    queries = queries.reshape(len(queries), -1)
    c = max(1, int(radius + 1).bit_length())
    shape = (len(queries), planes.shape[1])
    count = [np.zeros(shape, np.uint64) for _ in range(c)]
    over = np.zeros(shape, np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(shape[1])  # words in which some distance may still be within the radius
    for b in range(len(planes)):
        mask = (np.uint64(0) - ((queries[:, b // WORD] >> np.uint64(b % WORD)) & np.uint64(1)))[:, None]
        carry = planes[b][None, live] ^ mask
        for i in range(c):
            carry, count[i] = carry & count[i], carry ^ count[i]
        over |= carry
        if b % check_every == check_every - 1 and b > radius:
            past = _exceeds(count, over, radius)
            alive = (past != full).any(axis=0)
            if not alive.any():
                return np.zeros(shape, np.uint64)
            if alive.sum() < 0.5 * len(live):
                live = live[alive]
                count, over = [x[:, alive] for x in count], over[:, alive]
    out = np.zeros(shape, np.uint64)
    out[:, live] = ~_exceeds(count, over, radius)
    return out


def _exceeds(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bitwise comparison of the counters with the radius, from the highest bit."""
    more, same = np.zeros_like(over), np.full_like(over, 0xFFFFFFFFFFFFFFFF)
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            same &= count[i]
        else:
            more |= same & count[i]
            same &= ~count[i]
    return more | over


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within the radius among distinct fingerprints."""
    planes = bit_planes(fps)
    parent = np.arange(len(fps))
    for at in range(0, len(fps), TILE):
        q = fps[at : at + TILE]
        near = within(planes[:, at // WORD :], q, radius)  # later fingerprints only, from the query's word on
        row, word = np.nonzero(near)
        if not len(row):
            continue
        bits = np.unpackbits(near[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, bit = np.nonzero(bits)
        left, right = at + row[i], at // WORD * WORD + word[i] * WORD + bit
        ok = (right > left) & (right < len(fps))
        for a, b in zip(left[ok].tolist(), right[ok].tolist()):
            ra, rb = _root(parent, a), _root(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    top = np.array([_root(parent, i) for i in range(len(fps))], dtype=np.int64) if len(fps) else parent
    own = np.flatnonzero(top != np.arange(len(fps)))
    return fps[own], fps[top[own]]


def _ranges(bits: list[int], m: int) -> list[int]:
    """m masks that share out the given bits evenly."""
    cut = [round(i * len(bits) / m) for i in range(m + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cut, cut[1:])]


def key_masks(distinct: int, radius: int, rows: int = 64) -> list[int]:
    """Bit masks such that fingerprints within the radius agree under one of them at least, and that
    leave about ``rows`` of ``distinct`` uniform fingerprints under one key at most."""
    for m in range(radius + 1, 2 * radius + 3):
        masks = [sum(c) for c in combinations(_ranges(list(range(64)), m), m - radius)]
        if distinct / 2 ** min(x.bit_count() for x in masks) <= rows:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """``(u, v)``: links whose components are those of all pairs of ``distinct.fp`` within the radius."""
    spark = distinct.sparkSession
    masks = key_masks(distinct.count() if n is None else n, radius)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for m in masks])).alias("k")).select("fp", "k.*")
    parts = []
    while True:
        sizes = keyed.groupBy("mask", "part").count()
        large = materialize(sizes.where(F.col("count") > BLOCK_ROWS), "blocks")
        if large.isEmpty():
            parts.append(_compare(keyed, radius))
            break
        parts.append(_compare(keyed.join(large, ["mask", "part"], "left_anti"), radius))
        # within a large block: the open bits, again in ranges of which one at least agrees
        open_masks = {m: [m | sum(1 << b for b in r) for r in _split(m, radius)] for (m,) in ((int(x[0]) & (1 << 64) - 1,) for x in large.select("mask").distinct().toLocalIterator())}
        sub = spark.createDataFrame([(_signed(m), [_signed(x) for x in v]) for m, v in open_masks.items()], "mask long, finer array<long>")
        hot = keyed.join(large, ["mask", "part"], "left_semi").join(F.broadcast(sub), "mask")  # at most one row for each mask
        keyed = materialize(hot.select("fp", F.explode("finer").alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part")).distinct(), "finer")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _split(mask: int, radius: int) -> list[list[int]]:
    bits = [b for b in range(64) if not mask >> b & 1]
    m = min(radius + 1, len(bits))
    cut = [round(i * len(bits) / m) for i in range(m + 1)]
    return [bits[a:z] for a, z in zip(cut, cut[1:])]


def _compare(keyed: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame[["mask", "part"]].to_numpy()
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1  # the last block may go on
            yield from blocks(frame.iloc[:last])
            rest = frame.iloc[last:]
        if rest is not None and len(rest):
            yield from blocks(rest)

    def blocks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(frame):
            return
        key, fps = frame[["mask", "part"]].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        cuts = np.concatenate([[0], change, [len(fps)]])
        size = np.diff(cuts)
        u, v, at = [], [], 0
        keep = [i for i in range(len(size)) if size[i] > 1]
        while at < len(keep):  # small blocks share a sweep: a link between two of them is a true link too
            to, rows = at, 0
            while to < len(keep) and (rows == 0 or rows + size[keep[to]] <= TILE):
                rows += size[keep[to]]
                to += 1
            group = np.unique(np.concatenate([fps[cuts[i] : cuts[i + 1]] for i in keep[at:to]]))
            a, b = forest(group, radius)
            u.append(a), v.append(b)
            at = to
        if u and len(a := np.concatenate(u)):
            yield pd.DataFrame({"u": a.view(np.int64), "v": np.concatenate(v).view(np.int64)})

    dealt = keyed.repartition("mask", "part").sortWithinPartitions("mask", "part")
    return dealt.select("fp", "mask", "part").mapInPandas(run, "u long, v long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, k: int, radius: int, seed: int) -> DataFrame:
    """``(id, th, fp, component_id)`` for every row; th is the text's hash."""
    fp = materialize(fingerprints(docs, id_col, text_col, k, seed), "fingerprints")
    by_fp = fp.groupBy("fp").agg(F.min("id").alias("low"))
    distinct = materialize(by_fp.select("fp"), "distinct")
    roots = materialize(connected_components(links(distinct, radius)), "roots")
    discard(distinct)
    least = by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    component = least.groupBy("root").agg(F.min("low").alias("component_id"))
    label = least.where("fp is not null").select("fp", "root").join(component, "root").select("fp", "component_id")
    return fp.join(label, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    id reachable, the row's own included. Null or blank text has fingerprint zero and is linked like
    any other. A null id keeps its row; it is no component_id unless all ids of the component are null.
    Repeated rows all appear. Other columns are not read, so their names cannot clash. An empty table
    gives an empty result.
    """
    out = _labelled(docs, id_col, text_col, k, radius, seed)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rows_kept(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is their group's smallest, with all their columns, whatever these are called.

    ``labelled``: id, th (XXH64 of the text), component_id. Of rows that repeat both id and text one stays. Rows
    that share an id but not their text are told apart by the text's hash. Rows with a null id stay. Only rows
    that are repeated are shuffled with their text, unless what goes is too much to broadcast.
    """
    known = materialize(labelled.select("id", "th", "component_id").where("id is not null"), "labelled")
    gone = materialize(known.where("id <> component_id").select("id", "th").distinct(), "gone")
    often = materialize(known.where("id = component_id").groupBy("id", "th").count().where("count > 1").select("id", "th"), "often")
    discard(known)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    source = docs.select(row.alias("row"), docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text_col}`"].cast("string")).alias("th"))
    stay = source.join(hinted(gone), ["id", "th"], "left_anti")
    if often.isEmpty():
        return stay.select("row.*")
    often = hinted(often)
    one = stay.join(often, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    return stay.join(often, ["id", "th"], "left_anti").select("row.*").unionByName(one.select("row.*"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row for each group of :func:`near_duplicates`, as :func:`rows_kept` says."""
    return rows_kept(docs, _labelled(docs, id_col, text_col, k, radius, seed), id_col, text_col)
