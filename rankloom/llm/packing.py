"""Sequences of token ids from neighbouring documents along a space-filling curve.

Each document's hashed vector of byte 4-grams is projected to three dimensions, quantised and turned
into a Hilbert key. Documents are range-sorted by (key, doc_id), so that even one key that holds a third
of all rows is spread, and each task encodes and packs its range in one pass: documents are cut
wherever a sequence is full. What is left at the end of a range is cut into sequences whose lengths are
powers of two, which need no padding. Shuffled once: the texts.

Defined results: a null text counts as empty and gives the end id alone; repeated rows are packed each;
a null doc_id sorts first; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import alone, bounded, column, mixed, pieces, texts
from .encoding import encoder, ended, tokenizer_path

LENGTH, BUCKETS, DIMENSIONS, BITS = 1024, 1024, 3, 10
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def projection() -> np.ndarray:
    return np.random.default_rng(8).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def vectors(data: np.ndarray, offsets: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projected, length-normalised hashed 4-gram counts of each row of bytes."""
    n = len(offsets) - 1
    if len(data) < 4:
        return np.zeros((n, DIMENSIONS), np.float32)
    b = data.astype(np.uint32)
    gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(22)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for i, (a, e) in enumerate(zip(offsets[:-1].tolist(), (offsets[1:] - 3).tolist(), strict=True)):
        if e > a:
            v = np.bincount(bucket[a:e], minlength=BUCKETS).astype(np.float32)
            out[i] = v @ matrix / np.sqrt(v @ v)
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of unsigned points (rows; columns are dimensions), by the published transpose method."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def keys(text: pa.Array, matrix: np.ndarray) -> np.ndarray:
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(text) else np.empty(0, np.uint8)
    v = vectors(data, offsets - offsets[0], matrix)
    return hilbert(np.clip((v + 1.5) * ((1 << BITS) / 3), 0, (1 << BITS) - 1).astype(np.int64))


def _keyed(batches):
    alone("packing")
    matrix = projection()
    for batch in pieces(batches, limit=2 << 20):
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text"), pa.array(keys(texts(batch), matrix))], ["doc_id", "text", "curve"])


def curve_keys(documents: DataFrame) -> DataFrame:
    """doc_id, text, curve: the Hilbert key of each document."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_keyed, "doc_id long, text string, curve long")


class Packer:
    """Fills sequences of one task; a sequence's number is the task's in the high bits and a counter below."""

    def __init__(self, part: int, length: int):
        self.length, self.sequence, self.filled = length, part << 40, 0
        self.held: list[tuple] = []  # pieces of the sequence that is being filled, without ids of other sequences

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        done, at, n = [], 0, len(ids)
        while at < n:
            take = min(n - at, self.length - self.filled)
            self.held.append((doc, at, ids[at : at + take], n, self.filled))
            at, self.filled = at + take, self.filled + take
            if self.filled == self.length:
                done += self._out(self.held)
                self.held, self.filled = [], 0
        return done

    def _out(self, held: list[tuple]) -> list[tuple]:
        rows = [(doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset, ids.tobytes()) for doc, at, ids, n, offset in held]
        self.sequence += 1
        return rows

    def rest(self) -> list[tuple]:
        """The last, shorter sequence, cut into lengths that are powers of two."""
        held, done, size = self.held, [], self.length
        left = sum(len(h[2]) for h in held)
        while left:
            while size > left:
                size //= 2
            now, filled, later = [], 0, []
            for doc, at, ids, n, _ in held:
                take = min(len(ids), size - filled)
                if take:
                    now.append((doc, at, ids[:take], n, filled))
                if take < len(ids):
                    later.append((doc, at + take, ids[take:], n, 0))
                filled += take
            done += self._out(now)
            held, left = later, left - size
        return done


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECE.split(", ")])


def _packed(path: str, end: int, length: int):
    def run(batches):
        enc, packer = encoder(path), Packer(TaskContext.get().partitionId(), length)
        for batch in pieces(batches, limit=4 << 20):
            ids, offsets = ended(*enc(texts(batch)), end)
            ids = ids.astype("<u2", copy=False)
            rows = []
            for i, doc in enumerate(column(batch, "doc_id").to_pylist()):
                rows += packer.add(doc, ids[offsets[i] : offsets[i + 1]])
            packer.held = [(d, at, x.copy(), n, o) for d, at, x, n, o in packer.held]
            if rows:
                yield _table(rows)
        if rows := packer.rest():
            yield _table(rows)

    return run


def packed(documents: DataFrame, path: str | None = None, end: int = 0, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids (little-endian 16-bit)."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = curve_keys(bounded(documents)).repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "text")
    return ordered.select("doc_id", "text").mapInArrow(_packed(path or tokenizer_path(), end, length), PIECE)
