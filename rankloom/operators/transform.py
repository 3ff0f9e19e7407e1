"""Query transforms: a question becomes several (variant 0 is the question itself), and their lists are fused. Replies come through a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_lines, looks_lexical, strip
from ..providers import Generator
from ..session import RERANK_CANDIDATES, RRF_K, TOP_K
from ..sources.replies import ReplyLog, replied
from .retrieve import fuse_variants

#: A retriever answers a table of questions (query_id, query) with lists of k: query_id, chunk_id, score, rank.
Retriever = Callable[[DataFrame, int], DataFrame]
MAX_VARIANTS = 4

REWRITE = "Turn the question into a short search query: keep the words that carry meaning, leave out the rest, do not answer. Reply with the query only."
HYDE = "Write two or three sentences of a technical document that would answer the question, in its vocabulary. Reply with the passage only."
MULTI = "Write three short search queries for the question, each in other words, one in a line. Reply with the queries only."
BACK = "Write one more general question whose answer would give the background for this one. Reply with the question only."


def first_line(reply: Column) -> Column:
    """The first line of a reply without quotes; empty if there is none."""
    plain = F.regexp_replace(strip(F.coalesce(reply, F.lit(""))), r'^"+|"+$', "")
    return strip(F.element_at(F.split(plain, r"\r\n|\n|\r"), 1))


def _with(query: Column, more: Column) -> Column:
    return F.when(more != "", F.array(query, more)).otherwise(F.array(query))


def identity(queries: DataFrame, generator: Generator | None = None, log: ReplyLog | None = None) -> DataFrame:
    return queries.withColumn("variants", F.array("query"))


def rewrite(queries: DataFrame, generator: Generator, log: ReplyLog | None = None) -> DataFrame:
    """The question and its rewriting, if that differs but for case."""
    asked = replied(queries, REWRITE, F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nSearch query:")), generator, 64, log)
    line = first_line(F.col("reply.text"))
    return asked.withColumn("variants", _with(F.col("query"), F.when(F.lower(line) == F.lower("query"), "").otherwise(line))).drop("reply")


def hyde(queries: DataFrame, generator: Generator, log: ReplyLog | None = None) -> DataFrame:
    """The question and a passage that would answer it."""
    asked = replied(queries, HYDE, F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nPassage:")), generator, 200, log)
    return asked.withColumn("variants", _with(F.col("query"), strip(F.coalesce("reply.text", F.lit(""))))).drop("reply")


def multi_query(queries: DataFrame, generator: Generator, log: ReplyLog | None = None, variants: int = 3) -> DataFrame:
    """The question and up to MAX_VARIANTS others."""
    asked = replied(queries, MULTI, F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nQueries:")), generator, 200, log)
    lines = clean_lines(F.coalesce("reply.text", F.lit("")), min(variants, MAX_VARIANTS))
    return asked.withColumn("variants", F.concat(F.array("query"), lines)).drop("reply")


def step_back(queries: DataFrame, generator: Generator, log: ReplyLog | None = None) -> DataFrame:
    """The question and a more general one."""
    asked = replied(queries, BACK, F.concat(F.lit("Specific question: "), F.col("query"), F.lit("\n\nGeneral question:")), generator, 64, log)
    return asked.withColumn("variants", _with(F.col("query"), first_line(F.col("reply.text")))).drop("reply")


def routed_rewrite(queries: DataFrame, generator: Generator, log: ReplyLog | None = None) -> DataFrame:
    """Questions with identifiers stay as they are, the others are rewritten."""
    flag = queries.withColumn("lexical", looks_lexical(F.col("query")))
    return identity(flag.filter("lexical").drop("lexical")).unionByName(rewrite(flag.filter("not lexical").drop("lexical"), generator, log))


TRANSFORMS = {"identity": identity, "rewrite": rewrite, "hyde": hyde, "multiquery": multi_query, "stepback": step_back, "routed_rewrite": routed_rewrite}


def transform_named(name: str):
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; there are: {', '.join(sorted(TRANSFORMS))}")
    return TRANSFORMS[name]


def transformed(queries: DataFrame, retrieve: Retriever, transform, generator: Generator | None = None, k: int = TOP_K, candidates: int = RERANK_CANDIDATES, rrf_k: int = RRF_K, log: ReplyLog | None = None) -> DataFrame:
    """Lists of k, fused over the variants of each question (max(candidates, k) deep); a question with one variant keeps its list's own scores. n_variants: their number."""
    variants = F.filter("variants", lambda v: v.isNotNull() & (F.trim(v) != ""))
    each = transform(queries, generator, log).select("query_id", "query", variants.alias("variants"))
    each = each.withColumn("variants", F.when(F.size("variants") == 0, F.array("query")).otherwise(F.col("variants")))
    asked = each.select(F.col("query_id").alias("question"), F.posexplode("variants").alias("variant", "query")).withColumn("query_id", F.concat_ws("#", F.col("question").cast("string"), F.col("variant").cast("string")))
    lists = retrieve(asked.select("query_id", "query"), max(candidates, k)).join(asked.select("query_id", "question", "variant"), "query_id")
    return fuse_variants(lists.select(F.col("question").alias("query_id"), "variant", *(c for c in lists.columns if c in ("chunk_id", "score", "rank", "scores"))), k, rrf_k)
