"""Token sequences of a fixed length, filled by sum-of-squares packing.

Documents become token ids and an end id; only documents longer than a sequence are cut. What fills a
sequence by itself is one. The rest, at most one piece for each document, is packed by the
sum-of-squares rule (Csirik et al., "On the sum-of-squares algorithm for bin packing", 2006): a piece
goes where the sum, over residual gaps, of the squared number of open bins with that gap becomes
smallest.

The pieces are dealt over shards by a hash of a running number, so no task holds them all, however many are
alike; the number of shards follows the number of pieces. Within a shard pieces come longest first, which makes the rule an offline one
and leaves the small pieces to close the gaps.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.words import give_back, slices
from tilewright.storage import materialize

#: Pieces that one shard packs.
SHARD_PIECES = 16_384
#: Bytes, about, of the memory in which a worker keeps the ids of pieces of words; it forgets all when there are more.
CACHE_BYTES = 48 << 20
#: Texts are tokenized in slices of about so many bytes.
TEXT_SLICE = 2 << 20
#: Bytes that an entry of the memory takes besides its letters and ids.
_ENTRY = 180
#: Letters whose NFC form is themselves and whose lower case is one letter of this set.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Printable ASCII but letters, digits, white space and the apostrophe, which starts contractions.
_MARKS = r"!-&(-/:-@\[-`{-~"


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and lower-cases, remembered by word.

    Such a tokenizer never joins what white space parts, so a text's ids are its words' ids in order.
    New words are tokenized many at a time. Words of plain letters, digits and marks go straight to the
    model in the pieces that its splitter would make; all others, and the vocabulary's own special
    strings, go through the whole tokenizer. ``exact`` tells whether the file is of that kind; if it is
    not, every text goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab()
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.exact = '"end_of_word_suffix":"</w>"' in re.sub(r"\s", "", self.full.to_str()) and self._splits()
        self.plain = re.compile(rf"[{_LETTERS}0-9{_MARKS}]+\Z")
        self.pieces = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
        self.bytes = self._byte_letters()
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _splits(self) -> bool:
        """Does the file split and lower-case as this class takes it to?"""
        probe = "Ab c1 2xÄß ,.- %%%"
        apart = [i for w in probe.split() for i in self.encode_full(w)]
        return apart == self.encode_full(probe) == self.encode_full(probe.lower().replace(" ", "\n \t"))

    def encode_full(self, text: str) -> list[int]:
        return self.full.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The printable letter that byte-level vocabularies use for each byte."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _learn_pieces(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            line = " ".join(p if p.isascii() else p.encode().decode("latin-1").translate(self.bytes) for p in part)
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            data = ids.tobytes()
            if len(stops) != len(part) or (stops and stops[-1] != len(ids)):  # a piece that is no chain of vocabulary entries
                for p in part:
                    self.known[p] = np.array(self.encode_full(p), dtype="<u4").tobytes()
                continue
            for p, a, b in zip(part, [0, *stops], stops):
                self.known[p] = data[4 * a : 4 * b]

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.forget()
        known = self.known
        new = [p for p in pieces if p not in known]
        self._learn_pieces(new)
        self.held += sum(_ENTRY + len(p) + len(known[p]) for p in new)
        return [known[p] for p in pieces]

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def _of_words(self, words: list[str]) -> list[bytes]:
        split = {w: self.pieces.findall(w.lower()) for w in words if self.plain.match(w) and not any(s in w for s in self.special)}
        pieces = list({p for x in split.values() for p in x})
        known = dict(zip(pieces, self._of_pieces(pieces)))
        return [b"".join([known[p] for p in split[w]]) if w in split else np.array(self.encode_full(w), dtype="<u4").tobytes() for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not self.exact:
            each = [np.array(self.encode_full(t), dtype="<u4") for t in texts.to_pylist()]
            return np.concatenate([*each, np.zeros(0, "<u4")]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        plain = pc.match_substring_regex(texts, rf"\A[{_LETTERS}0-9{_MARKS} \t\n\v\f\r]*\z")
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, s))
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), rf"([{_MARKS}]+|[0-9])", r" \1 ")
        parts = [(spaced, plain, self._of_pieces), (texts.filter(pc.invert(plain)), pc.invert(plain), self._of_words)]
        parts = [(np.flatnonzero(np.asarray(mask.to_numpy(zero_copy_only=False), dtype=bool)), *self._coded(pc.ascii_split_whitespace(part), ids_of)) for part, mask, ids_of in parts if len(part)]
        size = np.zeros(n, np.int64)
        for rows, _, offsets in parts:
            size[rows] = np.diff(offsets)
        ends = np.cumsum(size)
        if len(parts) == 1:
            return parts[0][1], np.concatenate([[0], ends])
        out = np.zeros(size.sum(), "<u4")
        for rows, ids, offsets in parts:
            out[np.repeat((ends - size)[rows] - offsets[:-1], np.diff(offsets)) + np.arange(len(ids))] = ids
        return out, np.concatenate([[0], ends])

    @staticmethod
    def _coded(parts: pa.Array, ids_of) -> tuple[np.ndarray, np.ndarray]:
        coded = parts.flatten().dictionary_encode()
        ids = ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        code = np.asarray(coded.indices)
        lengths = size[code]
        ends = np.cumsum(lengths)
        out = table[np.repeat(first[code] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[np.asarray(parts.offsets) - parts.offsets[0].as_py()]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` for each cut of each row's token ids and end id."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", TEXT_SLICE):
                ids, offsets = encoder.encode(part.column("text"))
                data, n = ids.tobytes(), np.diff(offsets) + 1
                cuts = -(-n // length)
                row = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * length
                size = np.minimum(length, n[row] - start)
                last = start + size == n[row]
                crc = [zlib.crc32(end, x) if z else x for x, z in zip((zlib.crc32(data[a:b]) for a, b in zip((4 * (offsets[row] + start)).tolist(), (4 * (offsets[row] + start + size - last)).tolist())), last.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(np.array(crc, dtype=np.int64))], schema.names)
        give_back()

    return source.mapInArrow(run, schema)


_ENCODERS: dict[str, WordTokenizer] = {}


def _encoder(path: str) -> WordTokenizer:
    """One encoder for each Python worker and file; its memory of words outlives a task."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if not os.path.exists(path):  # a file of the public collection, by name
            import public_tokenizers

            _ENCODERS[path] = WordTokenizer(public_tokenizers.path(path))
        else:
            _ENCODERS[path] = WordTokenizer(path)
    return _ENCODERS[path]


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each item, in the given order.

    Moving an item of size s into a bin with gap g changes the sum of squared counts by
    2 (N[g - s] - N[g] + 1), or by 1 - 2 N[g] where the bin becomes full; full and empty bins don't
    count. Among equal changes the smallest gap is taken. A bin is opened only where no open one has
    room: with the longest items first, opening more of them for the sum's sake leaves gaps at the end.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    far = np.int64(1) << 40
    for k, s in enumerate(sizes.tolist()):
        here = count[s:]
        rest = count[: capacity - s + 1]
        change = np.where(here > 0, 2 * (rest - here + 1), far)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]  # the bin becomes full: (N - 1)^2 - N^2
        g = int(change.argmin()) + s
        if change[g - s] >= far:
            g, b, opened = capacity, opened, opened + 1
        else:
            b = bins[g].pop()
            count[g] -= 1
        where[k], offset[k] = b, capacity - g
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return where, offset


def pack(table: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``table`` of pieces (a ``length`` column, at most ``capacity``; materialized) with sequence_id and offset."""
    shards = max(1, -(-table.count() // shard_pieces))
    dealt = table.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = table.columns

    def run(part: pa.Table) -> pa.Table:
        order = [(c, "descending") for c in ("length", "ids_crc32", "id", "piece") if c in names]
        part = part.take(pc.sort_indices(part, sort_keys=order))
        size = np.asarray(part["length"], dtype=np.int64)
        alone = size >= capacity
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        seq[alone] = np.arange(alone.sum())
        where, offset = sum_of_squares(size[~alone], capacity)
        seq[~alone], off[~alone] = where + alone.sum(), offset
        shard = part["__shard"][0].as_py()
        return part.select(names).append_column("sequence_id", pa.array(seq + (shard << 40))).append_column("offset", pa.array(off))

    return dealt.groupBy("__shard").applyInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and has the end id alone. Null ids and repeated rows keep their pieces, each with
    a place of its own. Other columns are not read. An empty table gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    return pack(cut, length).withColumnRenamed("id", id_col)
