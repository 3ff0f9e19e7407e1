"""Exact duplicates by a 128-bit content hash, with the bytes themselves compared inside each group.

Built-in functions only. Texts are equal when identical after lower-casing A-Z; null counts as empty.
Grouping by hash *and* text makes the engine compare bytes wherever hashes agree, so two texts under
one hash stay apart; partial aggregation makes one row of a group in each task before anything is
shuffled, however many copies there are. Rows find their group again by light keys (hash, length and
SHA-256), in a join that adaptive execution can split.

Defined results: the row with the largest doc_id stays (a null doc_id loses against any other; repeated
rows of the same doc_id count in group_size; classes() marks each of them as kept, deduplicated() keeps one);
an empty table gives an empty result; further columns are ignored by classes() and kept by deduplicated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def _keyed(documents: DataFrame, hash_of) -> DataFrame:
    norm = documents.select(F.col("doc_id"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "norm", hash_of(F.col("norm")).alias("h"))


def groups(documents: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row for each distinct text: h, n_bytes, text_sha256, keep_id, group_size."""
    g = _keyed(documents, hash_of).groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return g.select("h", F.octet_length("norm").alias("n_bytes"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")


def classes(documents: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _keyed(documents, hash_of).select("doc_id", "h", F.octet_length("norm").alias("n_bytes"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    out = rows.join(groups(documents, hash_of), ["h", "n_bytes", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: of the rows with the largest doc_id any one (null is less than any).

    Rows find what stays by hash, length, SHA-256 and doc_id, so copies of one text spread over the tasks; of rows
    that agree in all four one is taken where they have met.
    """
    norm, key = normalised(F.col("text")), ["h", "n", "sha", "id"]
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # the caller's columns travel as one, so that no name of theirs meets one of these
    rows = documents.select(F.struct("*").alias("row"), content_hash(norm).alias("h"), F.octet_length(norm).alias("n"), F.sha2(norm.cast("binary"), 256).alias("sha"), ident.alias("id"))
    kept = groups(documents).select("h", F.col("n_bytes").alias("n"), F.col("text_sha256").alias("sha"), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("id"))
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")
