"""A lexical index of blocked posting lists: BM25 top-k that opens only the blocks that can change it.

Chunks are numbered in the order of their ids, and WIDTH neighbours make a range. A block holds the postings of one term within one range, so at most
WIDTH of them, with the highest impact among them; a frequent term's blocks lie over many files, and no task holds a whole term. A question's score
in a range is bounded by the sum of its terms' highest impacts there. The ranges with the highest bounds are scored first; ranges whose bound is below
the k-th score found there stay closed. What is opened is scored whole, so lists are those of a search through everything.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stemmer import stems
from ..functions.text import embed_text, unstopped
from ..operators.retrieve import PLACES, K1, B, ranked
from .files import written

#: Chunks of a range (a power of 2); ranges of a question that are scored first; folders that terms are dealt into by their hash.
WIDTH, FIRST, FOLDERS = 1024, 4, 32
#: Words, at most, whose stems are broadcast to the postings; a larger vocabulary is joined by a shuffle.
STEMS = 1 << 20


def _terms(rows: DataFrame, text: Column, cut, keep: list[str], known: DataFrame | None = None) -> DataFrame:
    """keep and term, one row for each word of a text. Without cut: English stems of all words but stop words; known: their table (word, stem), if there is one."""
    if cut is not None:
        return rows.select(*keep, F.explode(cut(text)).alias("term"))
    words = rows.select(*keep, F.explode(unstopped(text)).alias("word"))
    table = stems(words) if known is None else known
    return words.join(table, "word").select(*keep, F.col("stem").alias("term"))


class Bm25Table:
    """The index of (chunk_id, text) below a path: chunks (number, chunk_id, size), blocks (term, range, n, impact, entries), terms (term, df), and the collection's one row (n, mean, ranges). words: how a text is cut (a column function); without it English stems."""

    def __init__(self, spark: SparkSession, path: str, words=None):
        self.spark, self.path, self.words, self.name = spark, path.rstrip("/"), words, "bm25"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        w = df.write.mode("overwrite")
        (w.partitionBy(*folders) if folders else w).parquet(f"{self.path}/{name}")
        return self._read(name)

    def build(self, chunks: DataFrame) -> None:
        """Writes the index, of context and text where chunks have a context."""
        text = embed_text(F.col("context"), F.col("text")) if "context" in chunks.columns else F.col("text")
        rows = chunks.select("chunk_id", text.alias("text"))
        # numbers follow the ids: rows are dealt by ranges of ids and sorted, and an id's number is its task's and its place there
        cut = (self.words or unstopped)(F.col("text"))
        sizes = rows.select("chunk_id", F.size(cut).alias("size")).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
        numbered = self._write(sizes.select(F.monotonically_increasing_id().alias("number"), "chunk_id", F.coalesce("size", F.lit(0)).alias("size")), "chunks")
        whole = numbered.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), F.count_distinct(self._range()).alias("ranges"))
        found = whole.first()
        if not found["n"]:
            raise ValueError("an index over no chunks cannot be built")
        self._write(self.spark.createDataFrame([tuple(found)], "n long, mean double, ranges long").coalesce(1), "collection")
        known = None
        if self.words is None:
            known = self._write(stems(rows.select(F.explode(unstopped(F.col("text"))).alias("word"))), "stems")
            known = F.broadcast(known) if known.count() <= STEMS else known
        counted = _terms(rows, F.col("text"), self.words, ["chunk_id"], known).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / (found["mean"] or 1.0)))
        entry = F.struct("number", "tf", "size")
        blocks = counted.join(numbered, "chunk_id").groupBy("term", self._range().alias("range")).agg(F.count(F.lit(1)).alias("n"), F.max(part).alias("impact"), F.array_sort(F.collect_list(entry)).alias("entries"))
        dealt = blocks.withColumn("folder", _folder("term")).repartition("folder", F.pmod("range", F.lit(8))).sortWithinPartitions("folder", "term", "range")
        written_blocks = self._write(dealt, "blocks", "folder")
        self._write(written_blocks.groupBy("term").agg(F.sum("n").alias("df")), "terms")

    @staticmethod
    def _range() -> Column:
        return F.shiftright("number", WIDTH.bit_length() - 1)

    def load(self) -> bool:
        """Whether all tables are there and whole, by a row of each; if not, the index is to be built again."""
        try:
            n, ranges = self._read("collection").select("n", "ranges").first()
            for t, columns in (("chunks", {"number", "chunk_id", "size"}), ("terms", {"term", "df"}), ("blocks", {"term", "range", "n", "impact", "entries"})):
                rows = self._read(t)
                if not columns <= set(rows.columns):
                    return False
                rows.select(*sorted(columns)).first()
            return n == self._read("chunks").count() and ranges > 0
        except (PySparkException, Py4JJavaError, TypeError):
            return False

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, term, weight of the distinct terms of the questions that the index has."""
        n = self._read("collection").select("n")
        idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = _terms(queries.select("query_id", "query"), F.col("query"), self.words, ["query_id"]).distinct()
        return terms.join(self._read("terms"), "term").join(F.broadcast(n)).select("query_id", "term", idf.alias("weight"))

    def blocks(self, terms: DataFrame) -> DataFrame:
        """The blocks in the folders of the terms: at most FOLDERS numbers reach the driver."""
        got = terms.select(_folder("term").alias("f")).distinct().collect()
        return self._read("blocks").filter(F.col("folder").isin(sorted(r["f"] for r in got)))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """chunk_id, term, tf, size of all postings, or those of the terms."""
        rows = self._read("blocks") if terms is None else self.blocks(terms).join(terms.select("term").distinct(), "term", "left_semi")
        flat = rows.select("term", F.inline("entries"))
        return flat.drop("size").join(self._read("chunks"), "number").select("chunk_id", "term", "tf", "size")

    def _scored(self, wanted: DataFrame, blocks: DataFrame, among: DataFrame | None) -> DataFrame:
        """query_id, number, score of all chunks in the wanted blocks (query_id, term, range, weight)."""
        mean = self._read("collection").select("mean")
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        flat = wanted.join(blocks.select("term", "range", "entries"), ["term", "range"]).select("query_id", "weight", F.inline("entries"))
        if among is not None:
            flat = flat.join(self._read("chunks").join(among.select("chunk_id").distinct(), "chunk_id", "left_semi").select("number"), "number", "left_semi")
        return flat.join(F.broadcast(mean)).groupBy("query_id", "number").agg(F.sum(part).alias("score"))

    def bounds(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """query_id, range, bound: the most that a chunk of the range can score."""
        return asked.join(blocks.select("term", "range", "impact"), "term").groupBy("query_id", "range").agg(F.sum(F.col("weight") * F.col("impact")).alias("bound"))

    def opened(self, asked: DataFrame, blocks: DataFrame, k: int, among: DataFrame | None = None, first: int = FIRST) -> DataFrame:
        """query_id, range of the ranges that can hold one of a question's k: those whose bound is not below the k-th score in its first ranges. A list shorter than k opens all."""
        bounds = written(self.bounds(asked, blocks), "bounds")
        best = ranked(bounds.select("query_id", "range", F.col("bound").alias("score")), first, "range").select("query_id", "range")
        seen = ranked(self._scored(asked.join(blocks.select("term", "range"), "term").join(best, ["query_id", "range"], "left_semi"), blocks, among), k, "number")
        least = seen.filter(F.col("rank") == k).select("query_id", (F.round("score", PLACES) - 10.0**-PLACES).alias("least"))
        return bounds.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.round("bound", PLACES) >= F.col("least"))).select("query_id", "range")

    def search(self, queries: DataFrame, k: int = 5, among: DataFrame | None = None, first: int = FIRST) -> DataFrame:
        """Lists of k for (query_id, query); among: chunk_ids that alone are ranked (words weigh as in the whole index). first: ranges scored to find the threshold; an index of few more has none."""
        asked = written(self.asked(queries), "asked")
        blocks = self.blocks(asked)
        wanted = asked.join(blocks.select("term", "range"), "term")
        if self._read("collection").first()["ranges"] > 4 * first:
            wanted = wanted.join(self.opened(asked, blocks, k, among, first), ["query_id", "range"], "left_semi")
        top = ranked(self._scored(wanted, blocks, among), k, "number")
        return top.join(self._read("chunks").select("number", "chunk_id"), "number").select("query_id", "chunk_id", "score", "rank")

    def skipped(self, queries: DataFrame, k: int = 5, first: int = FIRST) -> DataFrame:
        """query_id, n_blocks of a question's terms, n_opened of them."""
        asked = written(self.asked(queries), "asked")
        blocks = self.blocks(asked)
        every = asked.join(blocks.select("term", "range"), "term").join(self.opened(asked, blocks, k, None, first).withColumn("open", F.lit(1)), ["query_id", "range"], "left")
        return every.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("open").alias("n_opened"))


def _folder(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")
