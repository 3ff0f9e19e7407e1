"""Language-model scores by online logistic context mixing, beside a unigram baseline.

A text (A-Z lower-cased) is a sequence of words, each ended by a white space byte or the text's end; between two
white space bytes stands the empty word. A word's probability is mixed from three sources:

* Bit predictors. A word and a terminator are coded as the binary decisions of a Huffman code over the corpus' bytes.
  Five predictors give a logit for each decision from counts under a hashed context: the last 1, 2, 3 or 5 bytes of
  the word, or the word so far, with the code node. Weights are gated by how often a predictor's context was seen
  (CLASSES); they are learned by Newton steps of the logistic loss over all occurrences of all words of the count table,
  with one of each word's occurrences taken out of the counts: tasks add up slopes and curvatures, the driver gets the
  sums. Each document refines them by gradient steps after every BLOCK words: for decisions whose longest context was seen and for the others, a gain of the short contexts, one of the
  long ones, and a bias.
* The count table of all training words, exact and as large as the corpus makes it: frequent words (HEAD of them at
  most, of SHORT bytes at most) are looked up in a broadcast table, the others join it. How much it is worth against the
  bits is learned over the same occurrences.
* The document so far: how often the word has stood in it.

Only what stands before a word (before its block, for the refinement) decides its prediction, and each source is a
distribution over words, so the sum of the logarithms, with those of the white space bytes, is the length of a real code:
score and bits per byte come from it. The predictors' tables have a fixed number of slots, as contexts of a few bytes
do not grow without end; what grows with the corpus is the count table. Tasks add up decisions of distinct words
(of beginnings that neighbours in the sorted count table share, once) in dense tables, which are summed block by block and broadcast as a logit and a class in two bytes for each slot.

The baseline is the add-one unigram score over words.

Defined results: a null text counts as empty (one end token); repeated rows are scored each; no training
document leaves all counts 0; a null doc_id is held out; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import alone, bounded, coded, column, pieces, release, saved, spans, texts, words_of

#: Bytes that the predictors look back (None: the word so far) and the bits of their slots.
ORDERS, SLOT_BITS = (1, 2, 3, 5, None), (16, 18, 20, 21, 21)
LONG = 3  # predictors from this one on are long
HEAD, BLOCK, CELLS, LANES = 1 << 18, 32, 1 << 16, 128
#: Bytes of a word, at most, that the head holds: at most HEAD * SHORT bytes of words reach the driver.
SHORT = 64
#: Weights of the predictors by class before the first Newton step: where the steps begin, which decides how many are needed.
FIRST = (*[(0, 0.75, 0.75, 0.8, 0.85, 0.85, 0.75, 0.4, 0.15, 0)] * 3, (0, 1, 1, 1, 0.9, 0.9, 0.7, 0.5, 0.4, 0.3), (0, 0.4, 0.4, 0.5, 0.6, 0.8, 0.8, 0.7, 0.6, 0.5))
#: Newton steps at most, and the gain in nats a word below which a step is the last one: what it leaves is of the order of its square; and how much the first weights hold.
STEPS, GAIN, NEAR = 12, 1e-3, 1e-5
#: Bins of the count table's odds against the bits: so many in a nat, and nats at most (beyond them the share of either is 1 to the last digit).
FINE, FAR = 256, 64
#: Decisions that are weighed at a time, so that what is held fits a cache.
WEIGHED = 1 << 15
RATE = 0.0002
SCALE, SMALL = 12.0, 0.4  # an 8-bit logit is the logit times SCALE; added to both counts
#: Least counts of the classes that gate the weights.
CLASSES = (0, 1, 2, 3, 5, 9, 17, 65, 257, 4097)
PAD, SPACE = 5, 32
#: Most frequent words whose decisions a worker keeps.
KEPT = 1 << 16
END = "\n"  # stands for the end token in the count table: no word can be it
_MULTIPLY = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
_RADIX = 0xD1342543DE82EF95
_INVERSE = pow(_RADIX, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


class Code:
    """Huffman code of bytes: for each byte its decisions (node, bit)."""

    def __init__(self, counts: np.ndarray):
        self.base = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
        floor = max(1.0, float(counts.sum()) / (1 << 16))
        heap = [(max(float(c), floor), b, b) for b, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        node = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[2]], up[b[2]] = (node, 0), (node, 1)
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        ways = []
        for byte in range(256):
            way, at = [], byte
            while at in up:
                at, bit = up[at]
                way.append((at - 256, bit))
            ways.append(way[::-1])
        self.length = np.array([len(w) for w in ways], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.node = np.array([(n + 1) * 0x2C1B3C6D & 0xFFFFFFFF for w in ways for n, _ in w], np.uint32)
        self.bit = np.array([b for w in ways for _, b in w], np.uint8)


def words_so_far(data: np.ndarray) -> np.ndarray:
    """For each place a 32-bit hash of the bytes since the last white space or end byte before it."""
    n = len(data)
    power = np.full(n + 1, _RADIX, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    back = np.full(n + 1, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    gap = np.where((data == 32) | ((data >= 9) & (data <= 13)) | (data == 0), np.arange(1, n + 1), 0)
    begin = np.concatenate([[0], np.maximum.accumulate(gap)[:-1]]) if n else gap
    value = (sums[:-1] - sums[begin]) * back[begin]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return (value >> np.uint64(32)).astype(np.uint32)


def laid_out(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words (large strings), each with PAD bytes before it, the last a space, and a space after it; first places and lengths (with that space)."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(ends) + 1
    start = np.cumsum(size + PAD) - size
    data = np.zeros(int(start[-1] + size[-1]), np.uint8)
    data[start - 1] = data[start + size - 1] = SPACE
    data[spans(start, size - 1)] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, start, size


def contexts(data: np.ndarray, at: np.ndarray, so_far: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of each predictor's context before each place."""
    value = np.zeros(len(at), np.uint64)
    for k in range(max(x for x in ORDERS if x), 0, -1):
        value = value << np.uint64(8) | data[at - k]
    out = []
    for k, m in zip(ORDERS, _MULTIPLY, strict=True):
        if k is None:
            out.append(so_far[at])
            continue
        c = value & np.uint64((1 << 8 * k) - 1)
        c = (c ^ (c >> np.uint64(20))).astype(np.uint32) * np.uint32(m)
        out.append(c ^ (c >> np.uint32(15)))
    return out


def decided(code: Code, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For the bytes at these places: the number of decisions of each, the slots of each predictor (in its own table), and the bits."""
    byte = data[at]
    n = code.length[byte]
    way = spans(code.first[byte], n)
    node, slots = code.node[way], []
    for k, c in enumerate(contexts(data, at, words_so_far(data))):
        x = np.repeat(c, n)
        x ^= node
        x *= np.uint32(_MULTIPLY[k])
        slots.append(x >> np.uint32(32 - SLOT_BITS[k]))
    return n, slots, code.bit[way]


def decisions(code: Code, words: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For distinct words: the number of decisions of each, the slots of each predictor (in its own table), and the bits."""
    data, start, size = laid_out(words)
    n, slots, bit = decided(code, data, spans(start, size))
    return np.add.reduceat(n, np.cumsum(size) - size) if len(size) else n, slots, bit


def branches(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words laid out, places of the bytes that end a beginning which the word before does not share, the number of such a byte for each byte of each word, and the words' lengths (with a space). In sorted words each beginning is met once."""
    data, start, size = laid_out(words)
    no, at = spans(np.zeros(len(size), np.int64), size), spans(start, size)
    word = np.repeat(np.arange(len(size)), size)
    same = (word > 0) & (no < size[word - 1])
    same &= data[np.where(same, start[word - 1] + no, 0)] == data[at]
    # the first byte that differs, and all after it, are new; the others are the last new ones at their distance from the start
    first = np.minimum.reduceat(np.where(same, size[word], no), np.cumsum(size) - size) if len(size) else size
    new = no >= first[word]
    order = np.argsort(no.astype(np.uint16) if len(no) and size.max() < 1 << 16 else no, kind="stable")
    branch = np.empty(len(no), np.int64)
    branch[order] = np.cumsum(new[order]) - 1
    return data, at[order][new[order]], branch, size


def _byte_words(batches):
    """Words, ends and bytes of a batch, counted."""
    alone("mixing")
    for batch in pieces(batches, limit=4 << 20):
        text = texts(batch)
        values, _ = words_of(text)
        at, names = coded(values)
        n = np.bincount(at, minlength=len(names)).astype(np.int64)
        low = pc.ascii_lower(text)
        rows = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
        b = np.bincount(np.frombuffer(low.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]], minlength=256)
        token = pa.concat_arrays([names.cast(pa.string()), pa.array([END, *[None] * 256], pa.string())])
        which = pa.concat_arrays([pa.nulls(len(n) + 1, pa.int32()), pa.array(np.arange(256), pa.int32())])
        yield pa.RecordBatch.from_arrays([token, which, pa.array(np.concatenate([n, [batch.num_rows], b]), pa.int64())], ["token", "byte", "n"])


def _trained(code):
    """Sums the decisions of words (token, n) in dense tables; gives what is not empty by blocks of CELLS slots."""

    def run(batches):
        alone("mixing")
        code_ = code.value
        total = np.zeros((2, int(code_.base[-1])))
        for batch in pieces(batches, "token", limit=256 << 10):
            data, at, branch, size = branches(column(batch, "token").cast(pa.large_string()))
            n, slots, bit = decided(code_, data, at)
            times = np.repeat(np.bincount(branch, np.repeat(column(batch, "n").to_numpy().astype(np.float64), size), len(at)), n)
            ones = times * bit
            for k, x in enumerate(slots):
                a, b = int(code_.base[k]), int(code_.base[k + 1])
                np.add.at(total[0, a:b], x, times)
                np.add.at(total[1, a:b], x, ones)
        cells = total.reshape(2, -1, CELLS)
        for i in np.flatnonzero(cells[0].any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(cells[:, i].astype("<f4").tobytes(), 1)], pa.binary())], ["block", "counts"])

    return run


def logits(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Slots of the broadcast tables: the count in the high byte (exact to 15, then by powers of two), the logit times SCALE plus 128 in the low one; 0 for contexts not seen."""
    count = np.where(n < 15.5, np.rint(n), 12 + np.floor(np.log2(np.maximum(n, 16))))
    value = np.clip(np.rint(SCALE * np.log((ones + SMALL) / (n - ones + SMALL))), -127, 127) + 128
    return np.where(n > 0, np.maximum(count, 1) * 256 + value, 0).astype("<u2")


def _summed(batches):
    """Sums blocks of counts as they come: a task holds its blocks only, however many tasks counted."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(column(batch, "block").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(c), "<f4").reshape(2, CELLS)
            total[i] = total[i] + got if i in total else got.astype(np.float64)
    for i, (n, ones) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([logits(n, np.minimum(ones, n)).tobytes()], pa.binary())], ["block", "logits"])


def fit_tables(words: DataFrame, code: Code) -> np.ndarray:
    """The slots of all predictors, one after another, from counted words (token, n). Two bytes for each of a fixed number of slots reach the driver."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(code)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = words.select("token", "n").mapInArrow(_trained(shared), "block int, counts binary").repartition(n, "block").mapInArrow(_summed, "block int, logits binary").toArrow()
    out = np.zeros(int(code.base[-1]), "<u2")
    for i, x in zip(got["block"].to_pylist(), got["logits"].to_pylist(), strict=True):
        out[i * CELLS : (i + 1) * CELLS] = np.frombuffer(x, "<u2")
    return out


def class_of() -> np.ndarray:
    """The gate's class of each slot value."""
    count = np.arange(1 << 16) >> 8
    least = np.where(count <= 15, count, 2.0 ** np.minimum(count - 12, 60))
    return np.searchsorted(np.array(CLASSES), least, side="right") - 1


def without_one() -> np.ndarray:
    """For each bit and slot value the value without one decision of that bit; frequent contexts stay as they are."""
    out = np.tile(np.arange(1 << 16, dtype="<u2"), (2, 1))
    n, ones = (x.ravel() for x in np.meshgrid(np.arange(1.0, 16), np.arange(16.0)))
    n, ones = n[ones <= n], ones[ones <= n]
    at = logits(n, ones)
    for bit in (0, 1):
        fine = (ones >= 1) if bit else (ones <= n - 1)
        out[bit, at[fine]] = logits(n[fine] - 1, ones[fine] - bit)
    return out


def cut(code: Code, tables: np.ndarray) -> list[np.ndarray]:
    """The slots of each predictor."""
    return [tables[a:b] for a, b in zip(code.base[:-1].tolist(), code.base[1:].tolist(), strict=True)]


def values() -> np.ndarray:
    """The logit of each slot value; class 0 (not seen) gives nothing."""
    out = ((np.arange(1 << 16) & 255) - 128.0) / SCALE
    out[:256] = 0
    return out


def _weighed(shared, weights: np.ndarray, steps: bool):
    """Goes through all words (token, n). With steps: sums of the logistic loss, its slopes and curvatures under the weights, numbered, and the number of occurrences as number -1. Else: occurrences by bins of ln of the count table's odds against the bits, and their sums of it."""

    def run(batches):
        alone("mixing")
        code, tables, in_all = shared.value
        tables, kinds, depth, left = cut(code, tables), len(CLASSES), len(ORDERS), without_one()
        # for each bit and slot value, without one decision, the class and the logit's byte; all else goes by these
        small = (class_of()[left] * 256 + (left & 255)).astype(np.uint16).ravel()
        value, gate = np.tile(values()[256:512], kinds), np.repeat(np.arange(kinds), 256)
        value[:256] = 0
        parts = [w[gate] * value for w in weights]
        pairs = [(j, k) for j in range(depth) for k in range(j, depth)]
        slopes, curves, lost, occurrences = np.zeros((depth, kinds)), np.zeros((len(pairs), kinds * kinds)), 0.0, 0.0
        odds = np.zeros((2, 2 * FINE * FAR + 1))
        for batch in pieces(batches, "token", limit=256 << 10):
            data, at, branch, size = branches(column(batch, "token").cast(pa.large_string()))
            count = column(batch, "n").to_numpy().astype(np.float64)
            n, slots, bit = decided(code, data, at)
            if steps:
                times, loss = np.repeat(np.bincount(branch, np.repeat(count, size), len(at)), n), None
                occurrences += count.sum()
            else:
                times, loss = None, np.empty(len(bit))
            for a in range(0, len(bit), WEIGHED):
                here = slice(a, a + WEIGHED)
                up = bit[here]
                high = up.astype(np.int32) << 16
                codes = [small[t[s[here]] | high].astype(np.int64) for t, s in zip(tables, slots, strict=True)]
                z = sum(p[c] for p, c in zip(parts, codes, strict=True))
                e = np.exp(-np.clip(z * (up * 2.0 - 1), -20, 20))
                if not steps:
                    loss[here] = np.log1p(e)
                    continue
                lost += float((np.log1p(e) * times[here]).sum())  # no matrix product: its threads would wait for each other
                p = e / (1 + e)
                down = (1 - up * 2.0) * p * times[here]
                curve = p / (1 + e) * times[here]
                x, g = [value[c] for c in codes], [c >> 8 for c in codes]
                for k in range(depth):
                    slopes[k] += np.bincount(g[k], down * x[k], kinds)
                by, row = [curve * y for y in x], [h * kinds for h in g]
                for i, (j, k) in enumerate(pairs):
                    curves[i] += np.bincount(row[j] + g[k], by[j] * x[k], kinds * kinds)
            if not steps:
                whole = np.add.reduceat(loss, np.cumsum(n) - n)[branch] if len(n) else loss
                own = np.add.reduceat(whole, np.cumsum(size) - size) if len(size) else whole
                some = count > 1  # one occurrence is taken out: a word that stands once is never in the table
                ln = np.log((count[some] - 1) / in_all) + own[some]
                near = np.clip(np.rint((ln + FAR) * FINE), 0, odds.shape[1] - 1).astype(np.int64)
                odds[0] += np.bincount(near, count[some], odds.shape[1])
                odds[1] += np.bincount(near, count[some] * ln, odds.shape[1])
                occurrences += count.sum()
        if steps:
            x = np.concatenate([[lost], slopes.ravel(), curves.ravel()])
            some, y = np.arange(len(x)), np.zeros(len(x))
        else:
            some = np.flatnonzero(odds[0])
            x, y = odds[0][some], odds[1][some]
        if occurrences:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(x, occurrences)), pa.array(np.append(y, 0.0))], ["at", "x", "y"])

    return run


def learned(words: DataFrame, code: Code, tables: np.ndarray, in_all: float) -> tuple[np.ndarray, float]:
    """Weights by predictor and class, and the count table's share, from all words (token, n). Sums of a fixed number reach the driver."""
    depth, kinds = len(ORDERS), len(CLASSES)
    first = np.array(FIRST)
    shared = words.sparkSession.sparkContext.broadcast((code, tables, in_all))

    def summed(weights, steps):
        run = _weighed(shared, weights.reshape(depth, kinds), steps)
        got = words.select("token", "n").mapInArrow(run, "at int, x double, y double").groupBy("at").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toArrow()
        at, x, y = (got[c].to_numpy() for c in ("at", "x", "y"))
        return at[at >= 0], x[at >= 0], y[at >= 0], float(x[at < 0].sum())

    w, least, step = first.ravel(), math.inf, np.zeros(first.size)
    for _ in range(STEPS):  # Newton steps of the logistic loss, held near the first weights
        at, x, _, times = summed(w, True)
        if not times:
            return first, 0.5
        sums = np.zeros(at.max() + 1)
        sums[at] = x / times
        away = w - first.ravel()
        loss, down, half = sums[0] + NEAR / 2 * away @ away, sums[1 : 1 + w.size] + NEAR * away, sums[1 + w.size :].reshape(-1, kinds, kinds)
        if loss > least:  # too far: half of the way back
            step = step / 2
            w = w + step
            continue
        curve = np.zeros((depth, kinds, depth, kinds))
        for c, (j, k) in zip(half, [(j, k) for j in range(depth) for k in range(j, depth)], strict=True):
            curve[j, :, k], curve[k, :, j] = c, c.T
        least, best, step = loss, w, np.linalg.solve(curve.reshape(w.size, -1) + NEAR * np.eye(w.size), down)
        w = w - step
        if down @ step < 2 * GAIN:
            break
    else:
        w = best
    # how much the count table is worth against the bits: expectation steps
    _, x, y, times = summed(w, False)
    share, odds = 0.5, np.exp(np.clip(y / np.maximum(x, 1), -FAR, FAR))
    for _ in range(30):
        a = share * odds
        share = float(np.clip((x * (a / (a + 1 - share))).sum() / times, 0.02, 0.98))
    return w.reshape(depth, kinds), share


class Model:
    """Code, tables, gated weights and the mixing of the sources."""

    def __init__(self, code: Code, tables: np.ndarray, weights: np.ndarray, share: float, in_all: float):
        self.code, self.tables, self.weights, self.share, self.in_all = code, cut(code, tables), weights, share, in_all
        #: For each predictor the weighted logit of each slot value.
        self.parts = [(w[class_of()] * values()).astype(np.float32) for w in weights]

    def features(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """For distinct words: first decision and number of decisions of each; for each decision the logit of the short and the long contexts, whether the longest was seen, and the sign of the bit."""
        n, slots, bit = decisions(self.code, words)
        out = [np.zeros(len(bit), np.float32) for _ in range(2)]
        for k, (t, s) in enumerate(zip(self.tables, slots, strict=True)):
            c = t[s]
            out[k >= LONG] += self.parts[k][c]
        return np.cumsum(n) - n, n, *out, (c != 0).view(np.int8), bit.astype(np.float32) * 2 - 1


    def features_of(self, words: pa.Array, place: np.ndarray, known: pa.Array) -> tuple[np.ndarray, ...]:
        """features() of words, of which those at the first KEPT places of the known ones are worked out once in a worker."""
        if not hasattr(self, "kept"):
            self.kept = self.features(known.slice(0, KEPT))
        new = (place < 0) | (place >= KEPT)
        fresh = self.features(words.filter(pa.array(new)))
        first, many = (np.empty(len(words), np.int64) for _ in range(2))
        first[~new], many[~new] = self.kept[0][place[~new]], self.kept[1][place[~new]]
        first[new], many[new] = fresh[0] + len(self.kept[-1]), fresh[1]
        return first, many, *(np.concatenate(x) for x in zip(self.kept[2:], fresh[2:], strict=True))


def word_logs(features: tuple, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ln of the probability that the bits give each word (numbers of distinct words, rows at offsets): blocks of all rows in step, each row with its own refinement."""
    first, many, short, long_, seen, sign = features
    n_rows = len(offsets) - 1
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    row = np.repeat(np.arange(n_rows), blocks)
    no = spans(np.zeros(n_rows, np.int64), blocks)
    order = np.argsort(no, kind="stable")
    row, no = row[order], no[order]
    begin, length = offsets[row] + no * BLOCK, np.minimum(BLOCK, size[row] - no * BLOCK)
    gain = np.ones((2, n_rows * 2), np.float32)  # of the short and the long contexts, by row and gate
    bias = np.zeros(n_rows * 2, np.float32)
    out = np.zeros(len(at))
    rounds = np.searchsorted(no, np.arange(int(no[-1]) + 2 if len(no) else 1))
    for a, b in zip(rounds[:-1].tolist(), rounds[1:].tolist(), strict=True):
        # few blocks at a time, so that what is held fits a cache; a row has one block in a round
        for i in range(a, b, LANES):
            j = min(i + LANES, b)
            lanes, places = row[i:j], spans(begin[i:j], length[i:j])
            w = at[places]
            n = many[w]
            way = spans(first[w], n)
            starts = np.cumsum(n) - n
            lane = np.concatenate([[0], np.cumsum(length[i:j])[:-1]])
            lane_start = starts[lane]
            g = seen[way]
            which = np.repeat(lanes * 2, np.diff(np.append(lane_start, len(way)))) + g
            x, y, up = short[way], long_[way], sign[way]
            z = x * gain[0].take(which)
            z += y * gain[1].take(which)
            z += bias.take(which)
            z *= up
            np.clip(z, -15, 15, out=z)
            e = np.exp(-z)
            out[places] = -np.add.reduceat(np.log1p(e), starts, dtype=np.float64)
            err = e / (1 + e) * up
            for table, value in ((gain[0], err * x), (gain[1], err * y), (bias, err)):
                both, one = np.add.reduceat(value, lane_start), np.add.reduceat(value * g, lane_start)
                table[lanes * 2] += RATE * (both - one)
                table[lanes * 2 + 1] += RATE * one
        np.clip(gain, 0.3, 1.7, out=gain)
        np.clip(bias, -0.5, 0.5, out=bias)
    return out


def repeated(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each word has stood before in its row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = row * np.int64(at.max(initial=0) + 1) + at
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.empty(0, int)
    out = np.empty(len(at), np.int64)
    out[order] = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
    return out


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of lower-cased texts, empty ones too (large strings), their offsets by row, and the byte that ends each (0: the text's end)."""
    low = pc.ascii_lower(text)
    rows = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]
    rows = rows - rows[0]
    # one more byte after each row: its end
    whole = np.zeros(len(data) + len(low), np.uint8)
    ends = rows[1:] + np.arange(len(low))
    keep = np.ones(len(whole), bool)
    keep[ends] = False
    whole[keep] = data
    white = _WHITE[whole]
    white[ends] = True
    stop = np.flatnonzero(white)
    begin = np.concatenate([[0], stop[:-1] + 1])
    at, distinct = coded(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stop), [None, pa.py_buffer(np.concatenate([begin, [len(whole)]]).astype(np.int64)), pa.py_buffer(whole)]))
    # the same bytes without the one that ends them
    names = pc.binary_slice(distinct, 0, -1) if len(distinct) else distinct
    again, names = coded(names)
    return names.cast(pa.large_string()), (again[at], np.concatenate([[0], np.searchsorted(stop, ends) + 1])), whole[stop]


SCORED = "key struct<doc_id:long,hash:long>, token string, free float, rate float, n_tokens long, head_known long, head_logs double, head_score double, bytes long"


def _scored(model, head, ends):
    """For each document a row with what its frequent words give, its token END and its hash, and a row for each other word: ln of the probability without the count table, and ln of what one count adds."""

    def run(batches):
        alone("mixing")
        m, known_words, (counts, logs) = model.value, head.value[0], head.value[1]
        known = pa.array(known_words, pa.large_string())
        for batch in pieces(batches, limit=3 << 20):
            text = texts(batch)
            names, (at, offsets), stop = split(text)
            place = pc.index_in(names, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            empty = pc.equal(names, "").to_numpy(zero_copy_only=False)
            own = word_logs(m.features_of(names, place, known), at, offsets)
            # the document so far: its share is what it would have explained of the words before
            size = np.diff(offsets)
            before = spans(np.zeros(len(size), np.int64), size)
            past = repeated(at, offsets) / np.maximum(before, 1)
            met = 0.05 * past
            met = met / (met + 0.95 * np.exp(own) + 1e-300)
            sums = np.concatenate([[0.0], np.cumsum(met)])
            alpha = (0.5 + sums[:-1] - np.repeat(sums[offsets[:-1]], size)) / (25.0 + before)
            free = np.logaddexp(np.log(alpha * past + 1e-300), np.log((1 - alpha) * (1 - m.share)) + own)
            rate = np.log((1 - alpha) * m.share / m.in_all)
            p, e = place[at], empty[at]
            c = np.where(e, ends["empty"], np.where(p >= 0, counts[p] if len(counts) else 0, 0))
            settled = e | (p >= 0)
            with np.errstate(divide="ignore"):
                score = np.logaddexp(free, rate + np.log(c)) + ends["logs"][stop]
            score = np.where(settled, score, ends["logs"][stop])
            sums = lambda x: np.add.reduceat(x, offsets[:-1]) if len(size) else x
            low = np.where(p >= 0, logs[p] if len(logs) else 0.0, 0.0)
            rare = np.flatnonzero(~settled)
            row = np.searchsorted(offsets, rare, side="right") - 1
            key, k, r = column(batch, "key"), batch.num_rows, len(rare)
            own_token = pa.array([END + str(x["hash"]) for x in key.to_pylist()], pa.string())
            n_bytes = pc.binary_length(text).to_numpy(zero_copy_only=False) + 1
            fill = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(r, kind)])
            yield pa.RecordBatch.from_arrays(
                [
                    key.take(pa.array(np.concatenate([np.arange(k), row]))),
                    pa.concat_arrays([own_token, names.take(pa.array(at[rare])).cast(pa.string())]),
                    pa.concat_arrays([pa.nulls(k, pa.float32()), pa.array(free[rare].astype(np.float32))]),
                    pa.concat_arrays([pa.nulls(k, pa.float32()), pa.array(rate[rare].astype(np.float32))]),
                    fill(sums((~e).astype(np.int64)) + 1, pa.int64()),
                    fill(sums((p >= 0).astype(np.int64)), pa.int64()),
                    fill(sums(low), pa.float64()),
                    fill(sums(score), pa.float64()),
                    fill(n_bytes, pa.int64()),
                ],
                ["key", "token", "free", "rate", "n_tokens", "head_known", "head_logs", "head_score", "bytes"],
            )

    return run


def scored(documents: DataFrame, out_of: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. Learns from rows where out_of is false."""
    spark = bounded(documents).sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    apart = held_out(F.col("doc_id")) if out_of is None else out_of
    both = saved(docs.filter(~apart).select("text").mapInArrow(_byte_words, "token string, byte int, n long").groupBy("token", "byte").agg(F.sum("n").alias("n")).sortWithinPartitions("token"), "counts")
    release(spark)
    counts = both.filter("token is not null").select("token", "n")
    words = counts.filter(F.col("token") != END)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("token") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    n, v, n_ends = int(total["n"]), int(total["v"]), int(total["ends"])
    byte = np.zeros(256)
    for r in both.filter("byte is not null").collect():
        byte[r["byte"]] = r["n"]
    # white space bytes and ends, after words of which some are empty; words are coded with one terminator for all of them
    stops = np.where(_WHITE, byte, 0.0)
    stops[0] = n_ends
    logs = np.zeros(256)
    some = np.append(np.flatnonzero(_WHITE), 0)
    logs[some] = np.log((stops[some] + 1) / (stops[some].sum() + len(some)))
    in_all = max(1.0, float(stops.sum()))
    byte = np.where(_WHITE, 0.0, byte)
    byte[SPACE] = stops.sum()
    code = Code(byte)
    tables = fit_tables(words, code)
    scale = math.log10(n + v + 1)
    model = Model(code, tables, *learned(words, code, tables, in_all), in_all)
    # what reaches the driver is bounded in bytes too: longer words are never in the head; they join the count table
    top = words.filter(F.octet_length("token") <= SHORT).orderBy(F.desc("n"), "token").limit(HEAD).toArrow()
    release(spark)
    c = top["n"].to_numpy().astype(np.float64)
    head = spark.sparkContext.broadcast((top["token"].to_pylist(), (c, np.log10(c + 1.0) - scale)))
    ends = {"empty": max(0.0, in_all - (n - n_ends)), "logs": logs}
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), "text")
    rows = keyed.mapInArrow(_scored(spark.sparkContext.broadcast(model), head, ends), SCORED).join(counts, "token", "left")
    word = F.col("n_tokens").isNull()
    least = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(scale)
    more = F.col("rate").cast("double") + F.log("n")
    mixed = F.when(F.col("n").isNull(), F.col("free").cast("double")).otherwise(F.greatest(F.col("free").cast("double"), more) + F.log1p(F.exp(-F.abs(F.col("free").cast("double") - more))))
    # rows of one document and text that comes several times are added up, and shared out again
    sums = rows.groupBy("key").agg(
        F.count("n_tokens").alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("bytes").alias("bytes"),
        (F.sum(F.coalesce("head_known", F.lit(0))) + F.count_if(word & F.col("n").isNotNull())).alias("known"),
        F.sum(F.when(word, least).otherwise(F.col("head_logs"))).alias("base"),
        F.sum(F.when(word, mixed).otherwise(F.col("head_score"))).alias("score"),
    )
    end_known, end_log = (1 if n_ends else 0), math.log10(n_ends + 1) - scale
    one = sums.withColumn("score", F.col("score") / F.col("copies") / F.lit(math.log(10))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select(
        F.col("key.doc_id").alias("doc_id"),
        (held_out(F.col("key.doc_id")) if out_of is None else F.lit(None).cast("boolean")).alias("held_out"),
        "n_tokens",
        ((F.col("known") / F.col("copies")).cast("long") + F.lit(end_known)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + F.lit(end_log)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
