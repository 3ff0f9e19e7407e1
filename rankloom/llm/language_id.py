"""Language of texts: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased characters (a space at word boundaries) are summed per language over
all labelled training documents; the log-probability matrix (languages x BUCKETS, its size checked) is
broadcast, and batches are scored sparsely in numpy: each n-gram gathers its row of the matrix, on top of the
language's prior (its share of the training documents).

Defined results: text null or without a letter gives ``und`` with score 0; no labelled training text
gives ``und`` for all; ties go to the language that sorts first; repeated rows are scored each; an
empty table gives an empty result; further columns, and lang in a prediction, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import alone, bounded, column, pieces, texts

BUCKETS, ORDERS, SMOOTHING, MOST_LANGUAGES = 1 << 16, (1, 2, 3), 0.1, 256


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def grams(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Buckets of all n-grams of a batch, the row of each, and the lower-cased texts."""
    low = [" " + t.lower() + " " for t in batch.to_pylist()]
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    row = np.repeat(np.arange(len(low), dtype=np.int32), size)
    out, rows = [], []
    for n in ORDERS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        same = row[: len(h)] == row[n - 1 :]
        out.append((h % np.uint32(BUCKETS)).astype(np.int32)[same])
        rows.append(row[: len(h)][same])
    return np.concatenate(out) if out else np.empty(0, np.int32), np.concatenate(rows) if rows else np.empty(0, np.int32), low


def _counted(batches):
    alone("language")
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in pieces(batches, limit=1 << 20):
        lang = column(batch, "lang").to_pylist()
        names = sorted(set(lang))
        code = np.array([names.index(x) for x in lang])
        bucket, row, _ = grams(texts(batch))
        got = np.bincount(code[row].astype(np.int64) * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
        for i, name in enumerate(names):
            total[name] = total.get(name, 0) + got[i]
            docs[name] = docs.get(name, 0) + int((code == i).sum())
        if len(total) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    for name, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(c[at], docs[name]), pa.int64())], ["lang", "bucket", "n"])


def counts(documents: DataFrame, training: Column) -> DataFrame:
    """n-gram counts of the training rows: lang, bucket (-1: documents), n. Summed per task first."""
    rows = documents.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fitted(table: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the matrix of log probabilities (BUCKETS rows, float32) and the log priors. At most MOST_LANGUAGES x BUCKETS counts reach the driver."""
    got = table.toArrow()
    name = got["lang"].to_pylist()
    langs = sorted(set(name))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    n = np.zeros((len(langs), BUCKETS))
    place = {x: i for i, x in enumerate(langs)}
    code, bucket, c = np.array([place[x] for x in name], int), got["bucket"].to_numpy(), got["n"].to_numpy()
    real = bucket >= 0
    n[code[real], bucket[real]] = c[real]
    docs = np.zeros(len(langs))
    docs[code[~real]] = c[~real]
    return langs, np.log((n + SMOOTHING) / (n.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).T.astype(np.float32).copy(), np.log((docs + 1) / (docs.sum() + len(langs)))


def classified(text: pa.Array, langs: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior."""
    bucket, row, low = grams(text)
    n = len(low)
    letters = [bool(langs) and any(map(str.isalpha, t)) for t in low]
    if not langs:
        return ["und"] * n, np.zeros(n)
    score = np.stack([np.bincount(row, matrix[:, k][bucket], n) + prior[k] for k in range(len(langs))], 1)
    share = 1 / np.exp(np.clip(score - score.max(1, keepdims=True), -700, 0)).sum(1)
    pred = [langs[i] if f else "und" for i, f in zip(score.argmax(1).tolist(), letters, strict=True)]
    return pred, np.where(letters, share, 0.0)


def _predict(model):
    def run(batches):
        alone("language")
        for batch in pieces(batches, limit=1 << 20):
            pred, share = classified(texts(batch), *model.value)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(pred, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return run


def _known(model, least: float):
    def run(batches):
        alone("language")
        for batch in pieces(batches, limit=1 << 20):
            pred, share = classified(texts(batch), *model.value)
            good = np.array([x != "und" for x in pred]) & (share >= least)
            yield batch.filter(pa.array(good))

    return run


def _model(documents: DataFrame, training: Column | None = None):
    bounded(documents)
    learn = training if training is not None else ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return documents.sparkSession.sparkContext.broadcast(fitted(counts(documents, learn)))


def predicted(documents: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the prediction) for each row; learns from the rows of training, by default those not held out."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_predict(_model(documents, training)), "doc_id long, lang_pred string, score double")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predicted(documents).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known: those with ``und`` or a score below least go. Each row is judged by its own text, in one pass; columns stay as they are."""
    return documents.mapInArrow(_known(_model(documents), least), documents.schema)
