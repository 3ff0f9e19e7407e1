"""Content-addressed store of token ids.

Each text is encoded whole, an end id is appended, and a rolling hash over the ids cuts the stream
of a document into chunks. The store has three tables:

* ``recipes``: one row per document in ascending doc_id order: its chunks' addresses and lengths (one after
  another), its Merkle root, its place in its part and the part;
* ``chunks``: each distinct chunk once, under the hash of its bytes (ids as little-endian 16-bit);
* ``manifest``: per part the Merkle root over the roots of its documents, their number and their ids'.

Defined results: a null text counts as empty and gives the end id alone; repeated rows give one recipe
each and share chunks; a null doc_id sorts first and is kept; an empty table gives an empty store;
further columns are ignored. Reading fails if an address, a root, a length, a start or a count does not fit.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded, column, pieces, release, saved, texts
from .encoding import encoder, ended, tokenizer_path

WINDOW, LEAST, MEAN_BITS, MOST = 8, 64, 8, 2048
ADDRESS = 16
#: Rows of the encoder: a document's recipe (row: its number), or a chunk (row null).
ENCODED = "row long, doc_id long, n_tokens int, root binary, address binary, data binary"


class Store(NamedTuple):
    recipes: DataFrame
    chunks: DataFrame
    manifest: DataFrame


@lru_cache(1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 32, 1 << 16, dtype=np.uint64).astype(np.uint32)


def cuts(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each row its cut places, the row's start and end included; a cut depends on the WINDOW ids before it and on the last cut only."""
    rolled = np.zeros(len(ids), np.uint32)
    g = _gear()[ids]
    for k in range(min(WINDOW, len(ids))):
        rolled[k:] += g[: len(g) - k] * np.uint32(2 * k * k + 1)
    marks = np.flatnonzero(rolled >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out = []
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), np.searchsorted(marks, offsets[:-1]), np.searchsorted(marks, offsets[1:]), strict=True):
        row, last = [a], a
        for m in [*marks[i:j].tolist(), b]:
            while m - last > MOST:
                last += MOST
                row.append(last)
            if m - last >= LEAST and m < b:
                row.append(m)
                last = m
        if row[-1] != b:
            row.append(b)
        out.append(row)
    return out


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=ADDRESS).digest()


class Merkle:
    """Root of the binary hash tree over leaves as they come, holding one node a level; an odd node at a level moves up as it is."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.nodes and self.nodes[-1][0] == level:
            leaf, level = address(b"\x01" + self.nodes.pop()[1] + leaf), level + 1
        self.nodes.append((level, leaf))

    def root(self) -> bytes:
        out = self.nodes[-1][1] if self.nodes else b""
        for _, left in reversed(self.nodes[:-1]):
            out = address(b"\x01" + left + out)
        return address(b"\x02" + out)


def merkle(addresses: bytes) -> bytes:
    """Root over the addresses that stand one after another."""
    tree = Merkle()
    for i in range(0, len(addresses), ADDRESS):
        tree.add(addresses[i : i + ADDRESS])
    return tree.root()


def _encoded(path: str, end: int):
    """Recipes, and in further rows the chunks not met lately in the task: each text is encoded once."""

    def run(batches):
        enc, seen, number = encoder(path), set(), TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        for batch in pieces(batches, limit=4 << 20):
            ids, offsets = ended(*enc(texts(batch)), end)
            data = ids.astype("<u2", copy=False).tobytes()
            if len(seen) > 100_000:
                seen.clear()
            found, lengths, new = [], [], {}
            for r in cuts(ids, offsets):
                keys = []
                for a, b in zip(r[:-1], r[1:], strict=True):
                    part = data[2 * a : 2 * b]
                    keys.append(k := address(part))
                    if k not in seen:
                        seen.add(k)
                        new[k] = part
                found.append(b"".join(keys))
                lengths.append(np.diff(r).astype("<u2").tobytes())
            n, m = len(found), len(new)
            columns = [
                pa.concat_arrays([pa.array(np.arange(number, number + n)), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([column(batch, "doc_id"), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(np.diff(offsets), pa.int32()), pa.nulls(m, pa.int32())]),
                pa.array([*map(merkle, found), *[None] * m], pa.binary()),
                pa.array([*found, *new], pa.binary()),
                pa.array([*lengths, *new.values()], pa.binary()),
            ]
            number += n
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ENCODED.split(", ")])

    return run


def _placed(batches):
    """Adds the part and the ids before each document in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = column(batch, "n_tokens").to_numpy().astype(np.int64)
        start = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(start)], [*batch.schema.names, "part", "start_in_part"])


def _manifest(batches):
    """The Merkle tree over the roots of each part, in its order: one row per part; in_place: whether each start follows from the lengths before it."""
    part, tree, n, total, fine, out = None, Merkle(), 0, 0, True, []
    for batch in batches:
        for at, root, size, start in zip(*(column(batch, c).to_pylist() for c in ("part", "root", "n_tokens", "start_in_part")), strict=True):
            if at != part:
                out += [(part, n, total, tree.root(), fine)] if n else []
                part, tree, n, total, fine = at, Merkle(), 0, 0, True
            tree.add(root)
            fine &= start == total
            n, total = n + 1, total + size
    if out := out + ([(part, n, total, tree.root(), fine)] if n else []):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "n_docs", "n_tokens", "root", "in_place"])


def manifest_of(recipes: DataFrame) -> DataFrame:
    """One row per part: part, n_docs, n_tokens, root, in_place. A few dozen bytes of each recipe are shuffled."""
    n = int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_part = recipes.select("part", "start_in_part", "root", "n_tokens").repartition(n, "part").sortWithinPartitions("part", "start_in_part")
    return by_part.mapInArrow(_manifest, "part int, n_docs long, n_tokens long, root binary, in_place boolean")


def write_store(documents: DataFrame, path: str | None = None, end: int = 2) -> Store:
    """Encodes (doc_id, text) and writes the three tables under the shared folder.

    Texts are encoded once. Chunks, already distinct within each task, and recipes cross the network
    once, into one table, where equal chunks meet; everything else that is shuffled is a recipe or less.
    """
    path = path or tokenizer_path()
    docs = bounded(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # rows of equal address and bytes become one; two chunks under one address would both stay and be seen when read
    both = saved(docs.mapInArrow(_encoded(path, end), ENCODED).distinct(), "encoded")
    spark = documents.sparkSession
    release(spark)
    light = both.filter("row is not null").select("doc_id", "n_tokens", "root", F.col("address").alias("addresses"), F.col("data").alias("lengths"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = light.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "root")
    recipes = saved(ordered.mapInArrow(_placed, "doc_id long, n_tokens int, root binary, addresses binary, lengths binary, part int, start_in_part long"), "recipes")
    manifest = saved(manifest_of(recipes), "manifest")
    chunks = both.filter("row is null").select("address", F.col("data").alias("ids"))
    return Store(recipes, chunks, manifest)


@lru_cache(64)
def _zeros(bit: int) -> np.ndarray:
    """Four tables that advance a crc32 by 4 << bit zero bytes."""
    if bit:
        half = _zeros(bit - 1)
        return np.stack([advance_once(half, t) for t in half])
    basis = np.array([zlib.crc32(b"\0\0\0\0", 1 << i) ^ zlib.crc32(b"\0\0\0\0", 0) for i in range(32)], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for i in range(8):
            out[byte] ^= np.where(np.arange(256) >> i & 1, basis[byte * 8 + i], 0).astype(np.uint32)
    return out


def advance_once(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def advanced(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """crc32 values as they enter the crc32 of a stream in which so many 32-bit words follow; the stream's crc32 is the xor of its parts'."""
    crc, bit = crc.astype(np.uint32), 0
    while (words >> bit).any():
        on = (words >> bit & 1).astype(bool)
        crc[on] = advance_once(_zeros(bit), crc[on])
        bit += 1
    return crc


def _checked(batches):
    for batch in batches:
        keys, ids = column(batch, "address").to_pylist(), column(batch, "ids")
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        data = memoryview(ids.buffers()[2])[int(at[0]) : int(at[-1])]
        at = (at - at[0]).tolist()
        if bad := sum(address(data[a:b]) != k for k, a, b in zip(keys, at[:-1], at[1:], strict=True)):
            raise ValueError(f"{bad} chunks do not match their address")
        wide = memoryview(np.frombuffer(data, "<u2").astype("<u4")).cast("B")
        crc = [zlib.crc32(wide[2 * a : 2 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "address"), pa.array(crc, pa.int64()), pa.array(np.diff(at) // 2, pa.int32())], ["address", "crc", "n"])


def _advanced(batches):
    for batch in batches:
        crc = advanced(column(batch, "crc").to_numpy(), column(batch, "after").to_numpy())
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("part", "start_in_part", "n", "fits")), pa.array(crc.astype(np.int64))], ["part", "start_in_part", "n", "fits", "crc"])


def _wanted(batches):
    """Holds each recipe against its root, and gives its chunks, each with the number of ids after it in its document."""
    for batch in batches:
        addresses, lengths = column(batch, "addresses").to_pylist(), column(batch, "lengths").to_pylist()
        if not all(merkle(a) == r for a, r in zip(addresses, column(batch, "root").to_pylist(), strict=True)):
            raise ValueError("a recipe does not match its Merkle root")
        n = np.fromiter(map(len, addresses), np.int64, len(addresses)) // ADDRESS
        row, length = pa.array(np.repeat(np.arange(len(n)), n)), np.frombuffer(b"".join(lengths), "<u2").astype(np.int32)
        if len(length) != len(row):
            raise ValueError("a recipe has another number of lengths than of chunks")
        done = np.cumsum(length, dtype=np.int64)
        after = np.repeat(done[np.cumsum(n) - 1], n) - done
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ADDRESS), len(row), [None, pa.py_buffer(b"".join(addresses))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([column(batch, "part").take(row), column(batch, "start_in_part").take(row), flat, pa.array(length), pa.array(after)], ["part", "start_in_part", "address", "length", "after"])


def read_store(store: Store) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32, n_chunks, root.

    Each part's manifest is made again from the recipes and must be the stored one. Each stored chunk is
    read once, checked against its address and reduced to its crc32; a document's crc32 is put together
    from those of its chunks, so no bytes are shuffled. A part's start is the sum over the parts before it:
    one row per part, whose number is the number of shuffle partitions.
    """
    spark = store.recipes.sparkSession
    before, at = [], 0
    stored = store.manifest.orderBy("part").collect()
    if stored != manifest_of(store.recipes).orderBy("part").collect() or not all(r["in_place"] for r in stored):
        raise ValueError("the recipes do not match the manifest")
    for r in stored:
        before.append((r["part"], at))
        at += r["n_tokens"]
    parts = spark.createDataFrame(before, "part int, before long")
    key = ["part", "start_in_part"]
    wanted = store.recipes.select(*key, "addresses", "lengths", "root").mapInArrow(_wanted, "part int, start_in_part long, address binary, length int, after long")
    have = store.chunks.mapInArrow(_checked, "address binary, crc long, n int")
    joined = wanted.join(have, "address").select(*key, "n", "after", "crc", (F.col("n") == F.col("length")).alias("fits"))
    whole = joined.mapInArrow(_advanced, "part int, start_in_part long, n int, fits boolean, crc long").groupBy(*key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_chunks"), F.bit_xor("crc").alias("ids_crc32"), F.bool_and("fits").alias("fits"))
    docs = store.recipes.select(*key, "doc_id", "n_tokens", "root", (F.octet_length("addresses") / ADDRESS).cast("int").alias("expected"))
    out = docs.join(whole, key, "left").join(F.broadcast(parts), "part", "left")
    ok = (F.col("n") == F.col("n_tokens")) & F.col("fits") & (F.col("n_chunks") == F.col("expected"))
    whole_or_fail = F.when(ok, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document cannot be put together from its chunks")).cast("long"))
    return out.select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), whole_or_fail.alias("ids_crc32"), "n_chunks", F.lower(F.hex("root")).alias("root"))


def documents_of(store: Store) -> DataFrame:
    """Whole id streams again: doc_id, ids (array of int), for readers that want the tokens themselves."""
    each = F.transform(F.sequence(F.lit(1), F.octet_length("addresses"), F.lit(ADDRESS)), lambda i: F.substring(F.col("addresses"), i, F.lit(ADDRESS)))
    at = store.recipes.select("doc_id", F.struct("part", "start_in_part").alias("doc_key"), F.posexplode(each).alias("i", "address"))
    rows = at.join(store.chunks, "address").groupBy("doc_key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("c"))

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(x["ids"], "<u2") for x in c]).astype(np.int32) for c in column(batch, "c").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.select("doc_id", "c").mapInArrow(run, "doc_id long, ids array<int>")
