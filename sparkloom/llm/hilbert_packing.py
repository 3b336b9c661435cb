"""Packing along a space-filling curve.

A document's token counts are hashed to a vector and projected to ``DIMS`` dimensions with signs drawn
from a fixed seed; the direction's Hilbert key places it on a curve. Documents are range-sorted by
that key and packed one after the other, so that neighbours on the curve share sequences. Documents are cut
where a sequence is full. What a range leaves over is cut into sequences of power-of-two lengths, so
nothing is padded.

Tokenising happens once: token ids are written (two or four bytes each) with the key, then sorted. They are
written in rows of ``ROW_TOKENS`` at most, so that ranges with as many rows are of like size, however long their documents are.
Equal keys, such as those of copies, are spread by a hash of the row, so a group of copies may cross ranges.

Defined cases: a null or empty text is the end token alone; rows without doc_id and repeated rows
are packed like others; an empty table gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

END = 1
DIMS = 4
GRID_BITS = 12
BUCKETS = 1 << 16
SEQUENCE = 2048
TOKENS_PER_RANGE = 16_000_000
ROW_TOKENS = 2048
TOKENS = "doc_id long, tie long, key long, start long, length long, tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Text that is tokenised at a time, in bytes; a longer document is a slice of its own.
SLICE_BYTES = 2_000_000
#: Word parts that go to the tokenizer in one text, and that a Python worker remembers; when full, it starts anew.
PARTS_PER_TEXT = 500
CACHE_PARTS = 500_000
_tokenizers: dict = {}
# ASCII punctuation but the apostrophe, around Latin letters whose lower case is one letter and doesn't depend on its neighbours.
_PLAIN = r"^(?P<before>[!-&(-/:-@\[-`{-~]*)(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>[!-&(-/:-@\[-`{-~]*)$"


def _runs(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class Words:
    """Token ids of texts by way of their distinct words.

    The tokenizer splits at white space and never joins over it, so a text's ids are its words' ids
    in order, and each distinct word is encoded once in a slice. Most words are Latin letters with
    punctuation around them; the tokenizer takes these apart, so the distinct letter runs and punctuation runs are
    encoded, many in one text: each run's last id is one that ends a word. Runs are remembered from slice to slice.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = {"": b""}

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *found]), np.array([len(x) for x in found], dtype=np.int64)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_PARTS:
            self.known = {"": b""}
        new = [x for x in parts if x not in self.known]
        pool, _ = self._encode([" ".join(new[k : k + PARTS_PER_TEXT]) for k in range(0, len(new), PARTS_PER_TEXT)])
        raw, stops = pool.tobytes(), ((np.flatnonzero(self.ends[pool]) + 1) * 4).tolist()
        self.known.update(zip(new, (raw[at:to] for at, to in zip([0, *stops], stops, strict=False)), strict=True))
        found = list(map(self.known.__getitem__, parts))
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, length of each)."""
        plain = pc.extract_regex(words, _PLAIN)
        is_plain = pc.and_(plain.is_valid(), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        columns = [pc.fill_null(pc.struct_field(plain, k), "") for k in range(3)]
        columns[1] = pc.utf8_lower(columns[1])
        coded = pa.concat_arrays(columns).dictionary_encode()
        pool, lengths = self._encode_parts(coded.dictionary.to_pylist())
        starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy().reshape(3, -1).T
        # words of other kinds go to the tokenizer whole
        odd = np.flatnonzero(~is_plain)
        whole, sizes = self._encode(words.take(pa.array(odd)).to_pylist())
        runs, spans = starts[codes], lengths[codes]
        spans[odd] = 0
        runs[odd, 0], spans[odd, 0] = len(pool) + np.cumsum(sizes) - sizes, sizes
        return _runs(np.concatenate([pool, whole]), runs.ravel(), spans.ravel()), spans.sum(axis=1)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, length of each); a null text has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten()
        real = pc.not_equal(pc.binary_length(words), 0)
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)]
        coded = words.filter(real).dictionary_encode()
        pool, lengths = self._word_ids(coded.dictionary)
        at = coded.indices.to_numpy()
        starts, spans = (np.cumsum(lengths) - lengths)[at], lengths[at]
        return _runs(pool, starts, spans), np.bincount(owner, weights=spans, minlength=len(texts)).astype(np.int64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of pieces of about ``most`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, stop - start
        start = stop


def words_of(path: str) -> Words:
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def projection(seed: int = 11) -> np.ndarray:
    """Signs of each hash bucket in each dimension."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(BUCKETS, DIMS))


def hilbert_keys(points: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Hilbert curve index of integer points (rows) with ``bits`` bits in each coordinate."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    # Gray-code form of the axes, from the top bit down: exchange or invert the lower bits
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            is_set = (x[i] >> b) & 1 == 1
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> b) & 1 == 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(vector: np.ndarray) -> np.ndarray:
    """Keys of projected vectors (rows); only the direction counts."""
    size = np.linalg.norm(vector, axis=1, keepdims=True)
    unit = np.divide(vector, size, out=np.zeros_like(vector), where=size > 0)
    top = (1 << GRID_BITS) - 1
    return hilbert_keys(np.clip(np.round((unit + 1) / 2 * top), 0, top))


def _tokenise(path: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        bucket = (np.arange(len(words.ends), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        signs = np.ascontiguousarray(projection(seed)[bucket].T)  # of each id, by dimension
        kind = "<u2" if len(words.ends) <= 1 << 16 else "<u4"
        for batch in batches:
            for start, length in slices(batch.column(2)):
                part = batch.slice(start, length)
                ids, lengths = words.ids(part.column(2))
                ends = np.cumsum(lengths)
                vectors = np.empty((length, DIMS))
                for d in range(DIMS):
                    sums = np.cumsum(np.append(np.int8(0), signs[d][ids]), dtype=np.int64)
                    vectors[:, d] = sums[ends] - sums[ends - lengths]
                raw = np.insert(ids, ends, END).astype(kind)  # each document's ids and the end token
                tokens = lengths + 1
                rows = -(-tokens // ROW_TOKENS)
                of = np.repeat(np.arange(length), rows)
                first = (np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)) * ROW_TOKENS
                size = np.minimum(ROW_TOKENS, tokens[of] - first)
                offsets = np.append(0, np.cumsum(size)) * raw.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                at = pa.array(of)
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array(curve_key(vectors)[of]), pa.array(first), pa.array(size), pa.array(tokens[of]), packed]
                yield pa.record_batch(columns, ["doc_id", "tie", "key", "start", "length", "tokens", "ids"])

    return run


def sequence_lengths(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the sequences that the last ``tokens`` (under one sequence) are cut into: powers of two, longest first."""
    return [1 << b for b in range(sequence.bit_length() - 1, -1, -1) if tokens >> b & 1]


def _pack(sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order; the last incomplete sequence is held back and cut again in the end."""
        home, number, offset, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def row(piece: tuple, seq: int, at: int) -> tuple:
            doc_id, start, ids, total = piece
            return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, home + seq, at

        for batch in batches:
            rows = []
            for doc_id, start, length, total, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * length else "<u4")
                while len(ids):
                    own, ids = ids[: sequence - offset], ids[sequence - offset :]
                    last = held[-1] if held else (None, 0, own[:0], 0)
                    if start and (doc_id, start, total) == (last[0], last[1] + len(last[2]), last[3]):  # goes on where the last piece ends
                        held[-1] = (doc_id, last[1], np.concatenate([last[2], own]), total)
                    else:
                        held.append((doc_id, start, own, total))
                    start, offset = start + len(own), offset + len(own)
                    if offset == sequence:
                        at = 0
                        for piece in held:
                            rows.append(row(piece, number, at))
                            at += len(piece[2])
                        number, offset, held = number + 1, 0, []
            if rows:
                yield batch_of(rows)
        rows, at = [], 0
        lengths = iter(sequence_lengths(offset, sequence))
        room = next(lengths, 0)
        full = room
        for doc_id, start, ids, total in held:
            while len(ids):
                take = min(len(ids), room)
                rows.append(row((doc_id, start, ids[:take], total), number, full - room))
                start, ids, room = start + take, ids[take:], room - take
                if not room:
                    number, room = number + 1, next(lengths, 0)
                    full = room
        if rows:
            yield batch_of(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, seed: int = 11, tokens_per_range: int = TOKENS_PER_RANGE) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), "text")
    tokens = materialize(rows.mapInArrow(_tokenise(tokenizer, seed), TOKENS), "pack-tokens")
    ranges = max(1, -(-(tokens.agg(F.sum("length")).first()[0] or 0) // tokens_per_range))
    placed = tokens.repartitionByRange(ranges, "key", "tie", "start").sortWithinPartitions("key", "tie", "start")
    return placed.select("doc_id", "start", "length", "tokens", "ids").mapInArrow(_pack(sequence), PIECES)
