"""Evaluation of several strategies at several depths and score floors, from lists that are retrieved once.

Each strategy answers the questions at the greatest depth, and its lists are written. Everything else reads these: a question's metrics at a depth
follow from the ranks of its relevant documents, and whether a floor refuses it from its best score. So the whole grid is one aggregation with
grouping sets for the kinds, and adding a depth or a floor costs no retrieval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.files import written
from . import context
from .metrics import validated
from .retrieve import to_documents

MEASURES = ("recall", "precision", "mrr", "ndcg", "hit")


def pool(strategies: dict, questions: DataFrame, depth: int, doc: Column | None = None) -> DataFrame:
    """run, query_id, doc, rank, best_score: each strategy's (name to retriever of (questions, k)) documents in the order of their best chunk, down to a depth, written. best_score: what the gate holds against a floor. doc: a list's document, by default its chunk."""
    out = None
    for name, retrieve in strategies.items():
        lists = written(retrieve(questions, depth), "lists")
        best = context.gate(lists, questions).select("query_id", "best_score")
        one = to_documents(lists, F.col("chunk_id") if doc is None else doc, depth).join(best, "query_id").select(F.lit(name).alias("run"), "query_id", "doc", "rank", "best_score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("an evaluation needs at least one strategy")
    return written(out, "pool")


def at_depths(found: DataFrame, golden: DataFrame, runs: list[str], depths: list[int]) -> DataFrame:
    """One row a run, question and depth, with all measures and the best score (null where nothing was found). golden: query_id, kind, relevant; without relevant documents there is nothing to miss, and every measure but the precision is 1."""
    relevant = golden.select("query_id", F.explode("relevant").alias("doc"))
    hits = found.join(relevant, ["query_id", "doc"]).groupBy("run", "query_id").agg(F.array_sort(F.collect_set("rank")).alias("at"))
    lists = found.groupBy("run", "query_id").agg(F.max("rank").alias("length"), F.max("best_score").alias("best_score"))
    each = golden.select("query_id", "kind", F.size("relevant").alias("n_relevant"), F.explode(F.array(*map(F.lit, runs))).alias("run"))
    each = each.join(lists, ["run", "query_id"], "left").join(hits, ["run", "query_id"], "left").withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    at = F.filter(F.coalesce("at", F.array().cast("array<int>")), lambda r: r <= F.col("depth"))
    got = F.size(at)

    def discounted(ranks: Column) -> Column:
        return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))

    def measure(value: Column) -> Column:
        return F.when(F.col("n_relevant") == 0, 1.0).otherwise(value)

    ideal = discounted(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_relevant", "depth"))))
    kept = F.least(F.coalesce("length", F.lit(0)), "depth")
    return each.select(
        "run",
        "query_id",
        "kind",
        "depth",
        "n_relevant",
        "best_score",
        measure(got / F.col("n_relevant")).alias("recall"),
        F.when((kept == 0) | (F.col("n_relevant") == 0), 0.0).otherwise(got / kept).alias("precision"),
        measure(F.coalesce(1 / F.array_min(at), F.lit(0.0))).alias("mrr"),
        measure(discounted(at) / ideal).alias("ndcg"),
        measure((got > 0).cast("double")).alias("hit"),
    )


def grid(rows: DataFrame, floors: list[float | None] = (None,)) -> DataFrame:
    """run, depth, floor, kind (and ALL) with the number of questions, how many a floor refuses, the rates of right and wrong refusals, and the means of the measures over the questions that it lets through. rows: as of at_depths(). A floor of None refuses nothing; another one also what found nothing."""
    each = rows.withColumn("floor", F.explode(F.array(*(F.lit(f).cast("double") for f in floors))))
    low = F.coalesce(F.col("floor").isNotNull() & (F.coalesce("best_score", F.lit(float("-inf"))) < F.col("floor")), F.lit(False))
    each = each.withColumn("refused", low)
    keys = ["run", "depth", "floor"]
    rate = lambda of: F.round(F.avg(F.when(of, F.col("refused").cast("double"))), 4)
    means = [F.round(F.avg(F.when(~F.col("refused"), F.col(m))), 4).alias(m) for m in MEASURES]
    sets = each.groupingSets([[*keys, "kind"], keys], *keys, "kind")
    out = sets.agg(F.grouping("kind").alias("_all"), F.count(F.lit(1)).alias("n"), F.count_if("refused").alias("n_refused"), rate(F.col("n_relevant") == 0).alias("correct_refusal"), rate(F.col("n_relevant") > 0).alias("false_refusal"), *means)
    return out.withColumn("kind", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("kind"))).drop("_all")


def report(cells: DataFrame, runs: list[str], value: str = "recall") -> DataFrame:
    """A grid as a table for readers: a row for each kind, depth and floor, a column for each run."""
    return cells.groupBy("kind", "depth", "floor").pivot("run", runs).agg(F.first(value)).orderBy("kind", "depth", "floor")


def evaluate(pipe, golden: DataFrame, documents: DataFrame, strategies: list[str], depths: list[int], floors: list[float | None] = (None,)) -> DataFrame:
    """The grid of a pipeline's strategies over a question set (id, question, relevant, kind) whose documents must exist; a set with problems is refused, naming them."""
    problems = validated(golden.select("id", "kind", "relevant"), documents).orderBy("id", "problem").limit(20).collect()
    if problems:
        raise ValueError("the question set is not valid: " + "; ".join(f"{r['id']}: {r['problem']}" for r in problems))
    questions = golden.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    of = pipe.table("chunks").select("chunk_id", "doc_id")

    def retriever(name: str):
        def run(asked: DataFrame, k: int) -> DataFrame:
            pipe.set_strategy(name)
            return pipe.retrieve(asked, k).join(of, "chunk_id")

        return run

    before = pipe.settings.strategy
    try:
        found = pool({name: retriever(name) for name in strategies}, questions, max(depths), F.col("doc_id"))
    finally:
        pipe.set_strategy(before)
    return grid(at_depths(found, golden.select(F.col("id").alias("query_id"), "kind", "relevant"), strategies, depths), floors)


def results_frame(passages: DataFrame, names: list[str], chars: int = 90) -> DataFrame:
    """Passages (query_id, rank, chunk_id, doc_id, score, scores, text) with a column for each named score and the first characters of the text, in a reader's order."""
    shown = F.regexp_replace(F.substring("text", 1, chars), r"\s+", " ").alias("text")
    return passages.select("query_id", "rank", "doc_id", "chunk_id", "score", *(F.col("scores")[n].alias(f"{n}_score") for n in names), shown).orderBy("query_id", "rank")
