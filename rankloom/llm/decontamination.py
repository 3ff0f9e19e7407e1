"""Benchmark decontamination by SimHash of item-sized windows.

For each item the windows of as many words as it has are compared with it. Every window that could qualify
gets a SimHash of BITS bits, and a multi-index over the items' fingerprints yields the items to compare it with:
the fingerprints are cut into BLOCKS blocks, and if two differ in at most RADIUS bits, some block differs in
at most RADIUS // BLOCKS bits; each block is listed under all flips of one bit less and looked up with one bit flipped
or none, as there are many more windows than items, so every fingerprint within the radius is found. One index holds the items of all sizes; of what it gives, those of the window's
size count. Then the exact weighted shingle similarity (sum of minima
over sum of maxima of the shingles' counts, five words) decides: SIMILARITY or more is contamination.

A window of n shingles can only reach the similarity with an item of m if 3/7 (n + m) of its places hold shingles
that stand in some item; windows with fewer such places get no fingerprint. For similarity 0.75 of shingles that
stand once each the expected distance is at most 22 bits of 128 (angle 31 degrees), and RADIUS 39 leaves it by
four standard deviations; with shingles that stand twice it is at most 30 bits. Two unrelated fingerprints
are within the radius less than once in 10,000 pairs. A shingle that stands more often can swamp a fingerprint:
windows and items that hold one are compared exactly without it. Words of no item are hashed like others,
so runs of them are different shingles.

The benchmark is the stated query set; it is sent to the tasks in blocks of ITEMS items and BYTES bytes of text at most,
each block with its own pass over the documents, so what is broadcast is bounded.

Defined results: null and empty texts or items, and items without words, match nothing; an item of fewer
than five words is one shingle of them all, found where they stand consecutively; a document shorter than
an item is one window; ties are all reported; repeated rows are reported each; an empty table gives an
empty result; further columns are ignored by matches() and kept by decontaminated(), which judges each row
by its own text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import alone, bounded, column, mixed, pieces, spans, texts, words_of

WORDS, SIMILARITY, BITS, RADIUS, BLOCKS, ITEMS, BYTES = 5, 0.75, 128, 39, 8, 2_000, 4 << 20
#: Windows and shingles under way at a time.
WINDOWS, STRETCH = 256, 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs(h: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many consecutive word hashes."""
    value = np.full(max(len(h) - words + 1, 0), words, np.uint64)
    for k in range(words):
        value = value * _STEP + h[k : k + len(value)]
    return mixed(value)


def bit_planes(s: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each shingle."""
    both = np.stack([s, mixed(s ^ _STEP)], 1).astype("<u8")
    return np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def packed_bits(sums: np.ndarray) -> np.ndarray:
    """Signs of sums (rows of BITS) as rows of two 64-bit numbers."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")


def simhash(s: np.ndarray) -> np.ndarray:
    """Fingerprint of a bag of shingles: each bit is the sign of the weighted sum."""
    return packed_bits(bit_planes(s).sum(0)[None])[0]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def thrice(s: np.ndarray) -> np.ndarray:
    """For each place the last place, up to it, from which on some shingle stands three times; -1 where there is none."""
    order = np.argsort(s, kind="stable")
    out = np.full(len(s), -1, np.int64)
    same = s[order[2:]] == s[order[:-2]]
    out[order[2:][same]] = order[:-2][same]
    return np.maximum.accumulate(out)


class HammingIndex:
    """All fingerprints within RADIUS of a query, by blocks of 16 bits; complete by the pigeonhole principle. Its tables have 697 entries of four bytes for each fingerprint and block, 45 MB for ITEMS of them, and are made where they are first used: what is broadcast is the fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block the first place of each of its 65,536 values, and the fingerprints by the values under which they are listed."""
        out, stored = [], self.flips(RADIUS // BLOCKS - 1)
        blocks = np.ascontiguousarray(self.prints).view("<u2").reshape(len(self.prints), BLOCKS)
        for k in range(BLOCKS):
            value = (blocks[:, k, None] ^ stored[None]).ravel()
            order = np.argsort(value, kind="stable")
            out.append((np.searchsorted(value[order], np.arange((1 << 16) + 1)).astype(np.int32), (order // len(stored)).astype(np.int32)))
        return out

    @cached_property
    def asked(self) -> np.ndarray:
        return self.flips(1)

    def __getstate__(self) -> dict:
        return {"prints": self.prints}

    @staticmethod
    def flips(most: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(16), n)], np.uint16)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) of which some block is near enough, each once."""
        blocks, pairs = np.ascontiguousarray(prints).view("<u2").reshape(len(prints), BLOCKS), []
        for k, (first, listed) in enumerate(self.tables):
            asked = (blocks[:, k, None] ^ self.asked[None]).astype(np.int64)
            begin, n = first[asked].astype(np.int64), first[asked + 1] - first[asked]
            query = np.repeat(np.repeat(np.arange(len(prints)), len(self.asked)), n.ravel())
            pairs.append(query * len(self.prints) + listed[spans(begin.ravel(), n.ravel())])
        found = np.unique(np.concatenate(pairs))
        return found // max(1, len(self.prints)), found % max(1, len(self.prints))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) within the radius."""
        q, i = self.candidates(prints)
        keep = distances(prints[q], self.prints[i]) <= RADIUS
        return q[keep], i[keep]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two bags."""
    low = sum((a & b).values())
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def wanted(n: int, m: int) -> int:
    """Places of known shingles that a window of n must have to be similar to an item of m."""
    return math.ceil(SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9)


class Benchmark:
    """Items of one block: their words, shingles, and the index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, sizes, self.bags, often, prints = [], [], [], [], []
        self.vocabulary: dict[str, None] = {}
        known = defaultdict(set)
        for item, text in items:
            values, _ = words_of(pa.array([text or ""], pa.large_string()))
            h = self.hashes(values.to_pylist())
            if not len(h):
                continue
            s = runs(h, min(WORDS, len(h)))
            known[min(WORDS, len(h))].update(s.tolist())
            self.ids.append(item)
            sizes.append(len(h))
            self.bags.append(Counter(s.tolist()))
            often.append(max(self.bags[-1].values()) > 2)
            prints.append(simhash(s))
            self.vocabulary.update(dict.fromkeys(values.to_pylist()))
        self.sizes, self.often = np.array(sizes, np.int64), np.array(often, bool)
        self.prints = np.array(prints, "<u8").reshape(len(prints), BITS // 64)
        self.by_size = {m: np.flatnonzero(self.sizes == m) for m in np.unique(self.sizes).tolist()}
        self.index = HammingIndex(self.prints)
        self.known = {w: np.array(sorted(k), np.uint64) for w, k in known.items()}

    @staticmethod
    def hashes(words: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def windows(self, w: int, n_words: int, places: np.ndarray):
        """(size, starts) of the windows that hold enough known shingles of w words; places: where these stand."""
        held = np.zeros(n_words - w + 2, np.int32)
        held[places + 1] = 1
        np.cumsum(held, out=held)
        sizes = np.unique(self.sizes[np.minimum(self.sizes, WORDS) == w])
        longer = sizes[sizes > n_words]
        for m in [*sizes[sizes <= n_words].tolist(), *([n_words] if len(longer) else [])]:
            n = m - w + 1
            # the whole document is also held against longer items
            starts = np.flatnonzero(held[n:] - held[:-n] >= wanted(n, n))
            if len(starts):
                yield m, starts

    def matches(self, h: np.ndarray, words: pa.Array) -> list[tuple[int, int, float, int]]:
        """(item, first word, similarity, Hamming distance): the best window of each item that a document of these words contains; h: their hashes, 0 for those of no item, which are hashed only where a shingle of an item stands."""
        best: dict[int, tuple[float, int, int]] = {}
        whole_hashes = None
        for w, known in self.known.items():
            if len(h) < w:
                continue
            keys = runs(h, w)
            at = np.flatnonzero(np.convolve(h != 0, np.ones(w, int), "valid") == w)
            at = at[known[np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)] == keys[at]]
            if not len(at):
                continue
            often = None
            for m, starts in self.windows(w, len(h), at):
                if often is None:
                    if whole_hashes is None:
                        whole_hashes = self.hashes(words.to_pylist())
                    keys = runs(whole_hashes, w)
                    often = thrice(keys)
                sizes = [x for x in self.by_size if (x == m or x > m == len(h)) and min(x, WORDS) == w and wanted(m - w + 1, x - w + 1) <= m - w + 1]
                for some in self.stretches(starts):
                    self.compared(best, keys, often, m - w + 1, some, sizes)
        return sorted((self.ids[i], start, s, d) for i, (s, start, d) in best.items())

    @staticmethod
    def stretches(starts: np.ndarray):
        """Parts of starts that lie near each other, WINDOWS at most."""
        cut = np.flatnonzero(np.diff(starts) > WINDOWS) + 1
        for part in np.split(starts, cut):
            for i in range(0, len(part), WINDOWS):
                yield part[i : i + WINDOWS]

    def fingerprints(self, keys: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of windows of n shingles, from running sums over the stretch that they cover."""
        a, end = int(starts[0]), int(starts[-1]) + n
        if n > STRETCH:  # long windows: the sum of the first, then what each step takes away and adds
            total, out, last = sum(bit_planes(keys[i : min(i + STRETCH, a + n)]).sum(0) for i in range(a, a + n, STRETCH)), [], a
            for start in starts.tolist():
                if start > last:
                    total = total - bit_planes(keys[last:start]).sum(0) + bit_planes(keys[last + n : start + n]).sum(0)
                    last = start
                out.append(total)
            return packed_bits(np.array(out))
        sums = np.zeros((end - a + 1, BITS), np.int32)
        np.cumsum(bit_planes(keys[a:end]), axis=0, out=sums[1:])
        return packed_bits(sums[starts - a + n] - sums[starts - a])

    def compared(self, best: dict, keys: np.ndarray, often: np.ndarray, n: int, starts: np.ndarray, sizes: list[int]) -> None:
        """Holds windows against the items of some sizes that the index gives for them, and keeps the best window of each."""
        prints = self.fingerprints(keys, n, starts)
        swamped = often[starts + n - 1] >= starts
        fits = np.isin(self.sizes, sizes)
        q, i = self.index.near(prints)
        pairs = list(zip(q[fits[i]].tolist(), i[fits[i]].tolist(), strict=True))
        if (self.often & fits).any() or swamped.any():
            q, i = np.nonzero((self.often[None] | swamped[:, None]) & fits[None])
            pairs += zip(q.tolist(), i.tolist(), strict=True)
        bags: dict[int, Counter] = {}
        for q_, i_ in sorted(set(pairs)):
            start = int(starts[q_])
            if start not in bags:
                bags[start] = Counter(keys[start : start + n].tolist())
            s = similarity(bags[start], self.bags[i_])
            old = best.get(i_)
            if s >= SIMILARITY and (old is None or s > old[0]):
                best[i_] = (s, start, int(distances(prints[q_], self.prints[i_])))


MATCH = "doc_id long, item_id long, first_word long, similarity double, distance int"


def _contaminated(bench: Benchmark, known: pa.Array, code: np.ndarray, text: pa.Array):
    """(row, matches) of the texts in which items stand."""
    values, offsets = words_of(text)
    at = pa.compute.index_in(values, known).fill_null(-1).to_numpy(zero_copy_only=False)
    # only rows with as many known words in a row as the shortest item's shingle can match
    least = min(bench.known, default=WORDS)
    run_ = np.cumsum(np.concatenate([[0], at >= 0]))
    full = np.zeros(len(at) + 1, bool)
    if len(at) >= least:
        full[: len(at) - least + 1] = run_[least:] - run_[:-least] == least
    some = np.cumsum(np.concatenate([[0], full]))
    for i in np.flatnonzero(some[offsets[1:]] > some[offsets[:-1]]).tolist():
        here = slice(offsets[i], offsets[i + 1])
        if found := bench.matches(code[at[here]], values[here]):
            yield i, found


def _each(shared, rows):
    def run(batches):
        alone("decontamination")
        bench = shared.value
        known = pa.array(list(bench.vocabulary), pa.large_string())
        code = np.append(bench.hashes(list(bench.vocabulary)), np.uint64(0))
        for batch in pieces(batches, limit=4 << 20):
            yield from rows(batch, _contaminated(bench, known, code, texts(batch)))

    return run


def _listed(batch: pa.RecordBatch, found):
    doc = column(batch, "doc_id")
    rows = [(doc[i].as_py(), *m) for i, ms in found for m in ms]
    if rows:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in MATCH.split(", ")])


def _clean(batch: pa.RecordBatch, found):
    keep = np.ones(batch.num_rows, bool)
    keep[[i for i, _ in found]] = False
    yield batch.filter(pa.array(keep))


def _blocks(benchmark: DataFrame):
    """The items in blocks that are broadcast, one after another; at least one block."""
    block, size, n = [], 0, 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1].encode("utf-8", "surrogatepass"))
        if len(block) == ITEMS or size >= BYTES:
            yield block
            block, size, n = [], 0, n + 1
    if block or not n:
        yield block


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents: doc_id, item_id, first_word of the best window, similarity, distance."""
    sc = bounded(documents).sparkSession.sparkContext
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in _blocks(benchmark):
        found = docs.mapInArrow(_each(sc.broadcast(Benchmark(block)), _listed), MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item stands; columns stay as they are."""
    sc, out = bounded(documents).sparkSession.sparkContext, documents
    for block in _blocks(benchmark):
        out = out.mapInArrow(_each(sc.broadcast(Benchmark(block)), _clean), documents.schema)
    return out
