"""Whole-text encoding with the tokenizers library, at most once for each distinct unit between certain cuts."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import alone, coded, on_leaving, spans

TOKENIZER = "byte_bpe_50k.json"
#: How the byte-level alphabet writes a space.
SPACE = "\u0120"
_LETTER, _SIGN, _BLANK, _LINE, _BODY = 1, 2, 3, 4, 5
#: Kinds of bytes: ASCII letters; ASCII signs but for the apostrophe; space; line feed; what surely is no white space after a space.
_KIND = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = _LETTER if _c.isascii() and _c.isalpha() else _BLANK if _c == " " else _LINE if _c == "\n" else _BODY if _c in "0123456789'" or 0xC3 <= _i <= 0xDF or 0xE4 <= _i <= 0xF4 else _SIGN if 0x21 <= _i <= 0x7E else 0


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Places at which the byte-level pattern starts a new piece whatever stands around them, and before which nothing depends on what follows.

    They are: a space before anything that is not white space; a sign after a letter and a letter after a
    sign; and a line feed between letters or signs, and what follows it.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    before, now = kind[:-1], kind[1:]
    plain = (kind == _LETTER) | (kind == _SIGN)
    cut[1:] = plain[:-1] & plain[1:] & (before != now)
    cut[:-1] |= (before == _BLANK) & (plain[1:] | (now == _BODY))
    line = np.flatnonzero((kind[1:-1] == _LINE) & plain[:-2] & plain[2:]) + 1
    cut[line] = cut[line + 1] = True
    return cut


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts exactly as the library encodes each whole text.

    Texts are cut into units where the byte-level pattern surely starts a new piece (unit_starts), and each
    distinct unit is encoded by the library once and remembered (in two generations, so that memory is
    bounded). A text that holds one of the tokenizer's added tokens is encoded whole.
    """

    def __init__(self, path: str, remembered: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.remembered, self.young, self.old = remembered, {}, {}
        size = self.library.get_vocab_size()
        self.starts = np.array([(self.library.id_to_token(i) or "").startswith(SPACE) for i in range(size)])

    def whole(self, batch: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(batch), 4096):
            out += [np.array(e.ids, dtype="<u2").tobytes() for e in self.library.encode_batch_fast(batch[i : i + 4096], add_special_tokens=False)]
        return out

    def fresh(self, names: list[str]) -> list[bytes]:
        """Encodes distinct units that begin with the only space in them, many to a text: each one's first id is the next whose token starts with a space."""
        joined = ["".join(names[i : i + 256]) for i in range(0, len(names), 256)]
        out: list[bytes] = []
        for i in range(0, len(joined), 256):
            found = [np.array(e.ids, "<u2") for e in self.library.encode_batch_fast(joined[i : i + 256], add_special_tokens=False)]
            ids = np.concatenate(found)
            cut = (np.append(np.flatnonzero(self.starts[ids]), len(ids)) * 2).tolist()
            data = ids.tobytes()
            part = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            want = names[i * 256 : (i + 256) * 256]
            out += part if len(part) == len(want) else self.whole(want)
        return out

    def units(self, names: list[bytes]) -> list[bytes]:
        """The codes of distinct units."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        codes = list(map(self.young.get, names))
        if None not in codes:
            return codes
        miss = [i for i, c in enumerate(codes) if c is None]
        found = list(map(self.old.get, [names[i] for i in miss]))
        new = [i for i, c in zip(miss, found, strict=True) if c is None]
        spaced = [i for i in new if names[i].startswith(b" ") and names[i].count(b" ") == 1]
        other = [i for i in new if not (names[i].startswith(b" ") and names[i].count(b" ") == 1)]
        for some, how in ((spaced, self.fresh), (other, self.whole)):
            for i, c in zip(some, how([names[i].decode() for i in some]), strict=True):
                codes[i] = c
        for i, c in zip(miss, found, strict=True):
            if c is not None:
                codes[i] = c
            self.young[names[i]] = codes[i]
        return codes

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 16-bit) of all texts (large strings), one after another, and n + 1 offsets."""
        if not len(text):
            return np.empty(0, np.uint16), np.zeros(1, np.int64)
        rows = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]
        rows = rows - rows[0]
        cut = np.append(unit_starts(data), True)
        cut[rows] = True
        begin = np.flatnonzero(cut)
        if not len(data):
            return np.empty(0, np.uint16), np.zeros(len(rows), np.int64)
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data)])
        at, names = coded(values)
        codes = self.units(names.to_pylist())
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 2
        flat = np.frombuffer(b"".join(codes), "<u2")
        first, n = np.cumsum(size) - size, size[at]
        ids, offsets = flat[spans(first[at], n)], np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, rows)]
        whole = [np.flatnonzero(pc.match_substring(text, a).to_numpy(zero_copy_only=False)) for a in self.added]
        if whole := sorted({i for w in whole for i in w.tolist()}):
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for i, b in zip(whole, self.whole(text.take(pa.array(whole)).to_pylist()), strict=True):
                parts[i] = np.frombuffer(b, "<u2")
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in parts])])
        return ids, offsets


def ended(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to each row."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint16)
    new = offsets + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, as long as tasks that encode follow each other in it."""
    alone("encoding")
    if path not in _kept:
        _kept[path] = Encoder(path)
        on_leaving(_kept.clear)
    return _kept[path]
