"""Quality of texts: how much better a zstandard dictionary of good text compresses them than one of bad text.

Every whole text is cut into blocks of BLOCK bytes, and each block is compressed alone with either dictionary, so that a long text
leans on the dictionaries to its end and not on itself. The difference of the compressed sizes over the plain size is
the feature; a logistic curve, which also knows how short the text is, makes it the probability of label 1.

Learning reads at most ROWS labelled documents of each class (those with the smallest hashed doc_ids, so the
choice does not depend on order or partitions), and of each at most BLOCKS blocks, evenly spread over the whole text. It has two
halves: dictionaries of one half score the other, the curve is fitted to these scores, and the dictionaries that are used come from both.
So no text that the curve is fitted to stands in the dictionary that scored it. At most 2 * ROWS * BLOCKS * BLOCK bytes reach the driver; two dictionaries of DICTIONARY bytes are broadcast.

Defined results: a null text is empty; an empty text has the difference 0. Labels other than 0 and 1, of unknown documents, or repeated
ones with both values do not count. If a class has no learned text, all texts get its smoothed share; without labels 0.5.
Repeated rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import alone, bounded, column, pieces, saved, texts

BLOCK, DICTIONARY, LEVEL = 1024, 112 << 10, 6
ROWS, BLOCKS = 2000, 8
#: Bytes of a text whose shortness is one half.
SHORT = 64
#: Scores from which a text counts as good.
GOOD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def cut(text: bytes, most: int | None = None) -> list[bytes]:
    """The blocks of a text; most: only so many, evenly spread from its first to its last."""
    n = -(-len(text) // BLOCK)
    at = range(n) if most is None or n <= most else [i * (n - 1) // (most - 1) for i in range(most)]
    return [text[i * BLOCK : (i + 1) * BLOCK] for i in at]


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    if sum(map(len, blocks)) > 4 * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
        except zstandard.ZstdError:  # texts too much alike to train on
            pass
    return b"".join(blocks)[-DICTIONARY:]


class Sizes:
    """Compressed sizes by the dictionaries of bad (0) and good (1) text."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.by = []
        for d in dictionaries:
            made = zstandard.ZstdCompressionDict(d)
            made.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float]:
        """The share of the plain size by which good text's dictionary saves more (0 for an empty text), and the shortness, from 1 to 0."""
        bad, good = (sum(len(c.compress(b)) for b in cut(text)) for c in self.by)
        return (bad - good) / len(text) if text else 0.0, SHORT / (SHORT + len(text))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the logistic curve from rows of (difference, shortness) to labels, with an offset last, by Newton steps; ridge keeps them finite where the classes do not overlap."""
    middle, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w, hold = np.zeros(a.shape[1]), np.diag([ridge * len(x)] * x.shape[1] + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + hold, a.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return np.append(slopes, w[-1] - slopes @ middle)


def _blocks(batches):
    alone("quality")
    for batch in pieces(batches, limit=1 << 20):
        cuts = [cut(t.encode("utf-8", "surrogatepass"), BLOCKS) for t in texts(batch).to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "label"), column(batch, "half"), pa.array(cuts, pa.list_(pa.binary()))], ["doc_id", "label", "half", "blocks"])


def sample(documents: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """doc_id, label, half and blocks of the labelled documents to learn from; at most ROWS ids of each class are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(training & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    order = F.xxhash64("doc_id")
    chosen = None
    for c in (0, 1):
        one = known.filter(F.col("label") == c).orderBy(order, "doc_id").limit(ROWS)
        chosen = one if chosen is None else chosen.unionByName(one)
    chosen = saved(chosen.select("doc_id", "label", F.pmod(F.shiftright(order, 32), F.lit(2)).cast("int").alias("half")), "chosen")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return saved(rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.first("half").alias("half"), F.min("text").alias("text")).mapInArrow(_blocks, "doc_id long, label int, half int, blocks array<binary>"), "sample")


Model = tuple[tuple[bytes, bytes] | None, np.ndarray]


def fitted(rows: list[tuple[int, int, list[bytes]]]) -> Model:
    """Dictionaries and weights from (label, half, blocks); without texts of both classes no dictionaries, and the smoothed share of label 1 as offset."""
    of = {(c, h): [b for label, half, blocks in rows if label == c and half == h for b in blocks] for c in (0, 1) for h in (0, 1)}
    n = [sum(label == c for label, *_ in rows) for c in (0, 1)]
    if not all(of[c, 0] + of[c, 1] for c in (0, 1)):
        return None, np.array([0.0, 0.0, np.log((n[1] + 1) / (n[0] + 1))])
    x, y = [], []
    for h in (0, 1):
        sizes = Sizes(tuple(dictionary(of[c, 1 - h] or of[c, h]) for c in (0, 1)))  # a class with one half only lends it to both
        for label, half, blocks in rows:
            if half == h:
                x.append(sizes.features(b"".join(blocks)))
                y.append(label)
    return tuple(dictionary(of[c, 0] + of[c, 1]) for c in (0, 1)), curve(np.array(x), np.array(y, float))


def scores(text: list[bytes], sizes: Sizes | None, weights: np.ndarray) -> np.ndarray:
    x = np.array([sizes.features(t) if sizes else (0.0, 0.0) for t in text], float).reshape(-1, 2)
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -500, 500)))


def _score(model):
    def run(batches):
        alone("quality")
        dictionaries, weights = model.value
        sizes = Sizes(dictionaries) if dictionaries else None
        for batch in pieces(batches, limit=1 << 20):
            found = scores([t.encode("utf-8", "surrogatepass") for t in texts(batch).to_pylist()], sizes, weights)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found)], ["doc_id", "score"])

    return run


def learned(documents: DataFrame, labels: DataFrame, training: Column | None = None):
    """The model from the labelled documents of training, by default those not held out."""
    bounded(documents)
    got = sample(documents, labels, training if training is not None else ~held_out(F.col("doc_id"))).orderBy("doc_id").toArrow().to_pylist()
    return fitted([(r["label"], r["half"], r["blocks"]) for r in got])


def scored(documents: DataFrame, labels: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id and score (probability of label 1) for each row."""
    model = documents.sparkSession.sparkContext.broadcast(learned(documents, labels, training))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, score double")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from GOOD on)."""
    return scored(documents, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
