"""Removal of long repeated byte strings with a run-length compressed suffix index.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same
document or another. Everything is exact and judged on the input.

1. *Routing.* Of every ``length`` bytes in a row, the ``gram``-byte piece of smallest hash is an anchor
   (winnowing; all of equal hash are). Equal strings have equal anchors in equal places, so all that
   a string could match meets under one anchor hash.
2. *Pre-aggregation.* An anchor's window is all that such a string around it may hold. Anchors that
   occur once are done. A window that occurs twice is covered whole, as are all of an anchor whose windows
   are equal. Only the distinct windows of anchors that have several go on.
3. *Run-length index.* The windows of a bucket of anchors, overlapping ones of a document joined, become
   one text. Its Burrows-Wheeler transform is kept as runs; text positions are sampled at the runs' heads
   and ends, where alone the longest match with the lexicographic neighbour has to be measured. Streaming
   through the text, each other position's match is one shorter than the one before it, which gives the
   matching statistics of every position; those of ``length`` or more mark.
4. *Hot anchors.* The windows of an anchor with very many are compared with one of them, the pivot, and
   what agrees is marked. The rest of a window can only match those that leave the pivot at the same place
   by the same byte, so these are the smaller groups that go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.words import flat_bytes, give_back, slices
from tilewright.storage import BROADCAST_ROWS, discard, hinted, materialize

#: Bytes of an anchor.
GRAM = 48
#: An anchor with more distinct windows is keyed anew.
GROUP_WINDOWS = 4096
#: Bytes of text that anchors are sought in at once: the arrays for it stay in a processor's cache.
ANCHOR_SLICE = 1 << 18
#: Bytes of text that windows are cut from at once.
WINDOW_SLICE = 1 << 20
#: Bytes of windows that one index takes, at the end of the group that passes it, likewise.
INDEX_BYTES = 1 << 18

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, little-endian; zeros beyond the end."""
    n = len(data)
    padded = np.zeros(-(-(n + 8) // 8) * 8 + 8, np.uint8)
    padded[:n] = data
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view("<u8")
    return out[:n]


def _mix(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """A hash of a[i] and b[i + shift]."""
    out = a * _A
    m = max(0, len(a) - shift)
    out[:m] += (b[shift:] ^ (b[shift:] >> np.uint64(31))) * _B
    out ^= out >> np.uint64(29)
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A nonzero hash of the ``gram`` bytes (a multiple of 16) from each position on."""
    sixteen = _mix(w := _words8(data), w, 8)
    h = sixteen.copy()
    for at in range(16, gram, 16):
        h = _mix(h, sixteen, at)
    h *= _C
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + width]; near the end over what there is."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(x) - step] = op(out[: len(x) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors in documents that lie end to end."""
    n, width = len(data), length - gram + 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    low = _sliding(h, width, np.minimum)
    step = np.zeros(n + 1, np.int32)  # strings that would pass their document's end don't count
    np.add.at(step, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(step, offsets[1:], -1)
    low[np.cumsum(step[:n]) > 0] = 0
    high = _sliding(low[::-1], width, np.maximum)[::-1]
    at = np.flatnonzero(high == h)
    return at, h[at]


class RunLengthIndex:
    """Run-length Burrows-Wheeler index of several byte strings, with sampled run heads and ends."""

    def __init__(self, parts: list[bytes]):
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.n = n = len(self.data)
        self.stop = np.repeat(self.starts + size, size)
        self.words = _words8(self.data)
        order = self._suffixes()
        head = np.zeros(n, bool)
        head[self.starts[size > 0]] = True
        before = np.concatenate([[0], self.data[:-1]])[order].astype(np.int16) if n else np.zeros(0, np.int16)
        before[head[order]] = -1  # a string's first suffix has a letter of its own before it
        new = np.ones(n, bool)
        new[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        self.runs = int(new.sum())
        heads = np.flatnonzero(new)
        ends = np.concatenate([heads[1:] - 1, [n - 1]]) if n else heads
        lone = np.int64(-1)
        self.head_samples = self._sample(order[heads], np.where(heads > 0, order[heads - 1], lone))
        self.end_samples = self._sample(order[ends], np.where(ends < n - 1, order[np.minimum(ends + 1, n - 1)], lone))

    def _suffixes(self) -> np.ndarray:
        """Suffix order by prefix doubling from eight bytes on; a string's end sorts before all bytes."""
        n, here = self.n, np.arange(self.n)
        left = self.stop - here
        key = self.words.byteswap()
        short = left < 8
        key[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))) - np.uint64(1))
        order = np.argsort(key)
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        h = 8
        while n and rank[order[-1]] < n - 1:
            second = np.where(here + h < self.stop, rank[np.minimum(here + h, n - 1)] + n, here)
            both = rank * (2 * n) + second
            order = np.argsort(both)
            rank[order[1:]] = np.cumsum(both[order[1:]] != both[order[:-1]])
            rank[order[0]] = 0
            h *= 2
        return order

    def _sample(self, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions in order, and the length of the match of each with its neighbour."""
        length = np.zeros(len(at), np.int64)
        most = np.where(other >= 0, np.minimum(self.stop[at] - at, self.stop[np.maximum(other, 0)] - other), 0)
        live = np.flatnonzero(most > 0)
        t = 0
        while len(live):
            i, j = at[live] + t, other[live] + t
            x = self.words[i] ^ self.words[j]
            same = x == 0
            tail = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
            length[live] = t + np.where(same, 8, tail)
            live = live[same & (t + 8 < most[live])]
            t += 8
        order = np.argsort(at)
        return at[order], np.minimum(length, most)[order]

    def _stream(self, samples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, length = samples
        last = np.repeat(np.arange(len(at)), np.diff(np.append(at, self.n)))
        return length[last] - (np.arange(self.n) - at[last])

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match of what follows it, within its string, anywhere else."""
        if not self.n:
            return np.zeros(0, np.int64)
        return np.maximum(self._stream(self.head_samples), self._stream(self.end_samples))

    def marks(self, length: int) -> np.ndarray:
        """The positions covered by strings of ``length`` that occur elsewhere too."""
        cover = np.zeros(self.n + 1, np.int64)
        at = np.flatnonzero(self.matching_statistics() >= length)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        return np.cumsum(cover[: self.n]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Pivots, of some hundred bytes each, that are broadcast.
PIVOT_ROWS = 50_000


def _together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema that :func:`materialize` made, as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._tilewright_path for t in tables])


_RANGE = "did long, tid int, a int, b int"
_WINDOW = "key long, lo int, hi int, did long, tid int, start int, at int, window binary"


class Repeats:
    """The plan for one table, one length and one anchor size."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, length: int, gram: int = GRAM):
        if not 16 <= gram <= length or gram % 16:
            raise ValueError("gram must be a multiple of 16, at most length")
        self.length, self.gram, self.reach = length, gram, length - gram
        text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
        # 96 bits of two hashes of id and text tell documents apart, those without an id too
        did, tid = (f(docs[f"`{id_col}`"], text) for f in (F.xxhash64, F.hash))
        self.docs = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), did.alias("did"), tid.alias("tid"), text.alias("text"))
        self.texts = self.docs.select("did", "tid", "text")

    def anchors(self) -> DataFrame:
        """``(h, w, did, tid, p)``: anchor hash, window hash, document, place."""
        length, gram, reach = self.length, self.gram, self.reach

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest = xxhash.xxh3_64_intdigest
            for batch in batches:
                for part in slices(batch, "text", ANCHOR_SLICE):
                    data, offsets = flat_bytes(part.column("text"))
                    at, h = anchors(data, offsets, length, gram)
                    row = np.searchsorted(offsets, at, side="right") - 1
                    a, b = np.maximum(offsets[row], at - reach), np.minimum(offsets[row + 1], at + length)
                    raw = data.tobytes()
                    w = np.fromiter((digest(raw[i:j], k) for i, j, k in zip(a.tolist(), b.tolist(), (at - a).tolist())), np.uint64, len(at))
                    row_a = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), part.column("did").take(row_a), part.column("tid").take(row_a), pa.array((at - offsets[row]).astype(np.int32))], ["h", "w", "did", "tid", "p"])

        return self.texts.where(F.octet_length("text") >= length).mapInArrow(run, "h long, w long, did long, tid int, p int")

    def windows(self, wanted: DataFrame) -> DataFrame:
        """The bytes of wanted windows; ``wanted``: did, tid, at: array of (p, h)."""
        length, reach = self.length, self.reach

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = None
            for batch in batches:
                for part in slices(batch, "text", WINDOW_SLICE):
                    out: list[list] = [[] for _ in range(8)]
                    for did, tid, text, ps in zip(*(part.column(c).to_pylist() for c in ("did", "tid", "text", "at"))):
                        if (did, tid) == before:  # a repeated row: its windows are there
                            continue
                        before = did, tid
                        raw = text.encode("utf-8", "surrogatepass")
                        for x in ps:
                            p, a = x["p"], max(0, x["p"] - reach)
                            for col, v in zip(out, (x["h"], 0, reach, did, tid, a, p - a, raw[a : p + length])):
                                col.append(v)
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["key", "lo", "hi", "did", "tid", "start", "at", "window"])
            give_back()

        return self.texts.join(wanted, ["did", "tid"]).mapInArrow(run, _WINDOW)

    def ranges(self) -> DataFrame:
        """``(did, tid, a, b)``: byte ranges that go; together they cover all that does."""
        found = materialize(self.anchors(), "anchors")
        often = found.groupBy("h").agg(F.count("*").alias("n"), (F.min("w") != F.max("w")).alias("mixed")).where("n > 1").select("h", "mixed")
        seen = materialize(found.join(materialize(often, "often"), "h"), "seen")  # read again, so that a hot anchor can be split
        discard(found)
        # where all windows of an anchor are equal, each is covered whole; only the others are told apart
        mixed = seen.where("mixed")
        counts = materialize(mixed.groupBy("h", "w").agg(F.count("*").alias("n"), F.min(F.struct("did", "tid", "p")).alias("one")), "windows")
        several = counts.where("n > 1").select("h", "w")
        several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
        twice = seen.where("not mixed").select("did", "tid", "p").unionByName(mixed.join(several, ["h", "w"], "left_semi").select("did", "tid", "p"))
        whole = twice.select("did", "tid", F.greatest(F.lit(0), F.col("p") - self.reach).alias("a"), (F.col("p") + self.length).alias("b"))
        wanted = counts.groupBy("one.did", "one.tid").agg(F.collect_list(F.struct(F.col("one.p").alias("p"), "h")).alias("at"))
        return whole.unionByName(self.indexed(self.windows(wanted)))

    def indexed(self, windows: DataFrame) -> DataFrame:
        """Ranges that matches between distinct windows of one key cover."""
        table = contexts = materialize(windows, "contexts")
        split_off, cold, found = None, [], []
        while True:  # each round a group's windows agree in more bytes around the anchor, so their length bounds the rounds
            sizes = table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_WINDOWS).select("key")
            hot = materialize(sizes, "hot")
            if hot.isEmpty():
                break
            large = table.join(hinted(hot), "key", "left_semi")
            one = F.min(F.struct(F.xxhash64("did", "tid", "start").alias("by"), F.struct("did", "tid", "start", "at", "window").alias("pivot")))
            pivots = materialize(large.groupBy("key").agg(one.alias("one")).select("key", "one.pivot"), "pivots")
            split = materialize(self._against(table.join(hinted(pivots, PIVOT_ROWS), "key")), "split")
            discard(pivots)
            if split_off is None:
                split_off = hot
            else:
                cold.append(materialize(table.join(hinted(hot), "key", "left_anti"), "cold"))
                discard(before, hot)
            found.append(materialize(split.where("window is null").select("did", "tid", F.col("lo").alias("a"), F.col("hi").alias("b")), "found"))
            table, before = split.where("window is not null"), split
        first = contexts if split_off is None else contexts.join(hinted(split_off), "key", "left_anti")
        if split_off is None:
            return self._match(first)
        # however many rounds there were, what they left is one scan
        groups = _together([*cold, materialize(table, "cold")])
        discard(before)
        return self._match(first.unionByName(groups)).unionByName(_together(found))

    def _against(self, large: DataFrame) -> DataFrame:
        """Compare each window with its key's pivot, as multikey quicksort does.

        A window agrees with the pivot for ``a`` bytes to the left of the anchor and ``b`` behind it. The
        strings within that are marked in both (rows without a window: lo to hi). A string that reaches
        further to the left can only match in windows that have the same ``a`` and the same next byte
        there, and likewise to the right: those are the keys for the rest.
        """
        length, gram, reach = self.length, self.gram, self.reach

        def common(x: bytes, y: bytes, end: str) -> int:
            v = int.from_bytes(x, end) ^ int.from_bytes(y, end)
            return ((v & -v).bit_length() - 1) // 8 if v else len(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[] for _ in range(8)]
                mine: dict[tuple, None] = {}
                for r in batch.to_pylist():
                    p, w, at = r["pivot"], r["window"], r["at"]
                    if (r["did"], r["tid"], r["start"], at) == (p["did"], p["tid"], p["start"], p["at"]):
                        continue
                    v, vat = p["window"], p["at"]
                    n, m = min(at, vat), min(len(w) - at, len(v) - vat)
                    a = common(w[at - n : at], v[vat - n : vat], "big")
                    b = common(w[at : at + m], v[vat : vat + m], "little") - gram
                    lo, hi = r["lo"], r["hi"]
                    first, last = max(lo, reach - b), min(hi, a)  # of a string: bytes before the anchor
                    if first <= last:
                        for x, c in (r, at), (p, vat):
                            mine[(x["did"], x["tid"], x["start"] + c - last, x["start"] + c - first + length)] = None
                    sides = []
                    if max(lo, a + 1) <= hi and at > a:
                        sides.append((1, a, w[at - a - 1], max(lo, a + 1), hi))
                    if lo <= min(hi, reach - b - 1) and len(w) - at > gram + b:
                        sides.append((2, b, w[at + gram + b], lo, min(hi, reach - b - 1)))
                    for side, k, byte, low, high in sides:
                        left, right = max(0, at - high), min(len(w), at - low + length)
                        if right - left >= length:
                            key = xxhash.xxh3_64_intdigest(bytes((side, k & 255, k >> 8, byte)), r["key"] & (1 << 64) - 1)
                            for col, x in zip(out, (key - (1 << 64) if key >> 63 else key, low, high, r["did"], r["tid"], r["start"] + left, at - left, w[left:right])):
                                col.append(x)
                for did, tid, x, y in mine:
                    for col, v in zip(out, (0, x, y, did, tid, 0, 0, None)):
                        col.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["key", "lo", "hi", "did", "tid", "start", "at", "window"])

        return large.mapInArrow(run, _WINDOW)

    def _match(self, table: DataFrame) -> DataFrame:
        length = self.length

        def mark(rows: pa.Table) -> pa.RecordBatch:
            did, tid, start = (np.asarray(rows[c]) for c in ("did", "tid", "start"))
            order = np.lexsort((start, tid, did))
            window = rows["window"].to_pylist()
            parts: list[bytearray] = []
            where = []
            for k in order.tolist():  # a document's overlapping windows become one string: no place is in it twice
                d, s, w = (did[k], tid[k]), int(start[k]), window[k]
                if where and where[-1][0] == d and s <= where[-1][1] + len(parts[-1]):
                    parts[-1] += w[where[-1][1] + len(parts[-1]) - s :] if where[-1][1] + len(parts[-1]) < s + len(w) else b""
                else:
                    parts.append(bytearray(w))
                    where.append((d, s))
            index = RunLengthIndex(parts)
            a, b = runs_of_parts(index.marks(length), index.starts)
            part = np.searchsorted(index.starts, a, side="right") - 1
            base = np.array([s for _, s in where], dtype=np.int64)[part] - index.starts[part]
            return pa.RecordBatch.from_arrays([pa.array(np.array([d[0] for d, _ in where], dtype=np.int64)[part]), pa.array(np.array([d[1] for d, _ in where], dtype=np.int32)[part]), pa.array((a + base).astype(np.int32)), pa.array((b + base).astype(np.int32))], ["did", "tid", "a", "b"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = np.asarray(batch.column("key"))
                weight = np.cumsum(np.asarray(pc.binary_length(batch.column("window")), dtype=np.int64))
                done = 0
                last = held[-1].column("key")[-1].as_py() if held else None
                for cut in np.flatnonzero(np.concatenate([[last is not None and key[0] != last], key[1:] != key[:-1]])).tolist():
                    if size + (weight[cut - 1] if cut else 0) - (weight[done - 1] if done else 0) >= INDEX_BYTES:
                        yield mark(pa.Table.from_batches([*held, batch.slice(done, cut - done)]))
                        held, size, done = [], 0, cut
                held.append(batch.slice(done))
                size += int(weight[-1] - (weight[done - 1] if done else 0))
            if held:
                yield mark(pa.Table.from_batches(held))
            give_back()

        several = table.select("key", "did", "tid", "start", "window").repartition("key").sortWithinPartitions("key")
        return several.mapInArrow(run, _RANGE)

    def result(self, out_schema: str, each) -> DataFrame:
        """``each(raw, a, b)`` for every row of the table, with the maximal runs that go."""
        gone = self.ranges().groupBy("did", "tid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("gone"))
        joined = self.docs.join(gone, ["did", "tid"], "left").select("row", "text", "gone")
        row_type = self.docs.schema["row"].dataType
        schema = T.StructType([T.StructField("row", row_type), *T.StructType.fromDDL(out_schema).fields])
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    text, gone = part.column("text").to_pylist(), part.column("gone")
                    flat = gone.flatten()
                    size = np.asarray(pc.fill_null(pc.list_value_length(gone), 0), dtype=np.int64)
                    ends = np.cumsum(size)
                    a, b = np.asarray(flat.field("a"), dtype=np.int64), np.asarray(flat.field("b"), dtype=np.int64)
                    cols: list[list] = [[] for _ in names[1:]]
                    for t, i, j in zip(text, (ends - size).tolist(), ends.tolist()):
                        raw = t.encode("utf-8", "surrogatepass")
                        for col, v in zip(cols, each(raw, *merged(a[i:j], b[i:j], len(raw)))):
                            col.append(v)
                    yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c) for c in cols)], names)

        return joined.mapInArrow(run, schema)


def runs_of_parts(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true, cut where a string begins."""
    edge = np.zeros(len(mask), bool)
    edge[starts[starts < len(mask)]] = True
    on = mask & (edge | ~np.concatenate([[False], mask[:-1]]))
    off = mask & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([mask[1:], [False]]))
    return np.flatnonzero(on), np.flatnonzero(off) + 1


def merged(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """The union of ranges sorted by their starts, as maximal runs within n bytes."""
    if not len(a):
        return [], []
    b = np.minimum(b, n)
    top = np.maximum.accumulate(b)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > top[:-1]]))
    return a[new].tolist(), top[np.append(new[1:] - 1, len(a) - 1)].tolist()


def kept_bytes(raw: bytes, a: list[int], b: list[int]) -> bytes:
    return b"".join(raw[i:j] for i, j in zip([0, *b], [*a, len(raw)])) if a else raw


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept_sha256)`` for every row.

    Null text is empty. Rows with null or repeated ids are documents of their own, and a repeated row
    repeats the text of the other. Texts shorter than ``length`` bytes lose nothing. Other columns are
    not read. An empty table gives an empty result.
    """

    def each(raw: bytes, a: list[int], b: list[int]) -> tuple:
        return len(raw), sum(b) - sum(a), len(a), hashlib.sha256(kept_bytes(raw, a, b)).hexdigest()

    plan = Repeats(docs.select(id_col, text_col), id_col, text_col, length)
    plan.docs = plan.docs.withColumn("row", F.struct(F.col(f"row.{id_col}")))
    return plan.result("n_bytes long, n_removed long, n_spans long, kept_sha256 string", each).select(f"row.{id_col}", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with all columns, the text less its repeated strings.

    Where a removed string begins or ends inside a character, the character's other bytes go too, so
    that the text stays valid. Rows stay even if nothing of their text does.
    """

    def each(raw: bytes, a: list[int], b: list[int]) -> tuple:
        return (kept_bytes(raw, a, b).decode("utf-8", "ignore"),)

    out = Repeats(docs, id_col, text_col, length).result("kept string", each)
    return out.select(*[(F.when(F.col(f"row.`{c}`").isNotNull(), F.col("kept")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
