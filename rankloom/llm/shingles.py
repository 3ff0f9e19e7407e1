"""Sets of word shingles as sorted 64-bit hashes, for whole batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import mixed, spans, words_of

WORDS = 5
LONG = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of words (large strings, none null), byte by byte for all words at once; of the few long ones by a library."""
    if not len(values):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data, size = np.frombuffer(values.buffers()[2], np.uint8), np.diff(ends)
    # longest words first: those with a k-th byte are the first ones
    order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int16), kind="stable")
    start, sizes = ends[:-1][order], size[order]
    value = sizes.astype(np.uint64)
    have = np.searchsorted(-sizes.clip(max=LONG + 1), -np.arange(LONG), side="left")
    for k, m in enumerate(have.tolist()):
        if not m:
            break
        value[:m] *= _STEP
        value[:m] += data[start[:m] + k]
    for i in range(int((sizes > LONG).sum())):
        value[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + sizes[i]])
    out = np.empty_like(value)
    out[order] = mixed(value)
    return out


def shingle_hashes(h: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words of each row, and n + 1 offsets. A row with fewer words has one shingle of them all, one without words none."""
    size = np.diff(offsets)
    n = np.where(size >= words, size - words + 1, (size > 0).astype(size.dtype))
    out = np.concatenate([[0], np.cumsum(n)])
    value = np.full(len(h), words, np.uint64)
    for k in range(words):
        value[: len(h) - k] = value[: len(h) - k] * _STEP + h[k:] if len(h) > k else value[:0]
    value = mixed(value)
    # no run begins at a row's last places
    keep, short = np.ones(len(h), bool), np.flatnonzero((size > 0) & (size < words))
    for k in range(1, words):
        keep[offsets[1:][size >= words] - k] = False
    keep[spans(offsets[:-1][short] + 1, size[short] - 1)] = False
    value = value[keep]
    for i in short.tolist():
        v = np.uint64(size[i])
        for x in h[offsets[i] : offsets[i + 1]]:
            v = v * _STEP + x
        value[out[i]] = mixed(np.array([v], np.uint64))[0]
    return value, out


def sets_of(text: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted. Texts are lower-cased (A-Z) and split at white space."""
    with np.errstate(over="ignore"):
        values, offsets = words_of(text)
        h, ends = shingle_hashes(word_hashes(values), offsets, words)
    return [distinct(h[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
