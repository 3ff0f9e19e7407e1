"""What is done with retrieved chunks: windows, gates, prompts, citations, judging, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import judge_tokens, looks_like_refusal, snap, strip
from ..session import WINDOW


def windows(hits: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Hits (query_id, rank, score, doc_id, start_char, end_char) widened to breaks around them; hits without a document go."""
    j = hits.join(docs.select("doc_id", "text"), "doc_id")
    begin, end = F.col("start_char") - window, F.least(F.col("end_char"), F.length("text")) + window
    return j.withColumn("from_char", snap(F.col("text"), begin, False)).withColumn("to_char", snap(F.col("text"), end, True)).drop("text")


def merged_windows(wide: DataFrame, k: int = 5) -> DataFrame:
    """Folds each question's windows in rank order: a window goes into the first kept one of its document that it overlaps, which is widened and takes over its scores (not its score). At most a shortlist per question is held."""
    scores = ["scores"] if "scores" in wide.columns else []
    rows = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "from_char", "to_char", *scores)), lambda a, b: (a["rank"] - b["rank"]).cast("int"))
    more = ",scores:map<string,double>" if scores else ""
    empty = F.array().cast(f"array<struct<rank:int,doc_id:{wide.schema['doc_id'].dataType.simpleString()},score:double,a:int,b:int,merged:int{more}>>")

    def kept(e: Column, a: Column, b: Column, merged: Column, with_: Column | None = None) -> Column:
        both = [] if not scores else [(e["scores"] if with_ is None else F.map_zip_with(e["scores"], with_["scores"], lambda _, x, y: F.greatest(x, y))).alias("scores")]
        return F.struct(e["rank"].alias("rank"), e["doc_id"].alias("doc_id"), e["score"].alias("score"), a.alias("a"), b.alias("b"), merged.alias("merged"), *both)

    def step(acc: Column, x: Column) -> Column:
        def hit(e: Column) -> Column:
            return (e["doc_id"] == x["doc_id"]) & (x["from_char"] < e["b"]) & (x["to_char"] > e["a"])

        first = F.array_min(F.transform(F.filter(acc, hit), lambda e: e["rank"]))
        wider = F.transform(acc, lambda e: F.when(e["rank"] == first, kept(e, F.least(e["a"], x["from_char"]), F.greatest(e["b"], x["to_char"]), e["merged"] + 1, x)).otherwise(e))
        return F.when(first.isNotNull(), wider).otherwise(F.concat(acc, F.array(kept(x, x["from_char"], x["to_char"], F.lit(1)))))

    folded = wide.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.posexplode(F.slice(F.aggregate("rows", empty, step), 1, k)).alias("at", "w"))
    return folded.select("query_id", (F.col("at") + 1).alias("rank"), F.col("w.doc_id").alias("doc_id"), F.col("w.score").alias("score"), F.col("w.a").alias("from_char"), F.col("w.b").alias("to_char"), F.col("w.merged").alias("merged_windows"), *(F.col("w.scores").alias("scores") for _ in scores))


def window_islands(wide: DataFrame) -> DataFrame:
    """Windows of one question and document that overlap, also by way of others, as one: query_id, doc_id, from_char, to_char, merged_windows, best_rank, score.

    Gaps and islands: in the order of their starts, a window begins an island if it starts at or after the furthest end of all
    before it; the running sum of these beginnings numbers the islands. Unlike merged_windows() this does not depend on ranks, and windows that a
    third one joins are merged.
    """
    w = Window.partitionBy("query_id", "doc_id").orderBy("from_char", "to_char", "rank")
    furthest = F.max("to_char").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(furthest.isNull() | (F.col("from_char") >= furthest), 1).otherwise(0)
    numbered = wide.withColumn("begins", begins).withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by("score", "rank").alias("score")
    return numbered.groupBy("query_id", "doc_id", "island").agg(F.min("from_char").alias("from_char"), F.max("to_char").alias("to_char"), F.count(F.lit(1)).alias("merged_windows"), F.min("rank").alias("best_rank"), best).drop("island")


def gate(lists: DataFrame, questions: DataFrame, floor: float = 0.60) -> DataFrame:
    """Whether to abstain: nothing retrieved, or the best score below the floor; a score at the floor passes.

    Where a question's rows have a dense score (in the map scores, or a column dense), the best of these counts, as scores of other
    kinds have no fixed scale; else the best score.
    """
    own = [F.max(c) for c in ([F.col("scores")["dense"]] if "scores" in lists.columns else []) + ([F.col("dense")] if "dense" in lists.columns else [])]
    best = lists.groupBy("query_id").agg(F.coalesce(*own, F.max("score")).alias("best_score"))
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best_score", F.lit(0.0)).alias("best_score"), (F.col("best_score").isNull() | (F.col("best_score") < floor)).alias("abstain"))


def threshold_sweep(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """(best_score, answerable) against thresholds: how many unanswerable questions are caught, how many others refused. One pass: thresholds are columns of one aggregate."""
    aggs = [F.struct(F.lit(t).alias("threshold"), F.count_if((F.col("best_score") < t) & ~F.col("answerable")).alias("caught"), F.count_if((F.col("best_score") < t) & F.col("answerable")).alias("wrongly_refused")) for t in thresholds]
    return best.agg(F.array(*aggs).alias("all")).select(F.inline("all"))


def verdicts(best: DataFrame, low: float, high: float) -> DataFrame:
    """Three-way split of retrieval: correct, ambiguous (to be widened), incorrect (to be refused)."""
    return best.withColumn("verdict", F.when(F.col("best_score") >= high, "correct").when(F.col("best_score") >= low, "ambiguous").otherwise("incorrect"))


def blocks(passages: DataFrame) -> DataFrame:
    """(query_id, rank, title, doc_id, text, and maybe context) to numbered blocks; a chunk's context stands before its text."""
    body = F.col("text") if "context" not in passages.columns else F.when(F.coalesce("context", F.lit("")) != "", strip(F.concat("context", F.lit("\n"), "text"))).otherwise(F.col("text"))
    name = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("doc_id").cast("string")), F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")\n"), body)
    return passages.select("query_id", "rank", "doc_id", name.alias("block"))


def within_budget(numbered: DataFrame, most: int) -> DataFrame:
    """Whole blocks in rank order as long as their summed lengths fit."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("used", F.sum(F.length("block")).over(w)).filter(F.col("used") <= most)


def prompts(questions: DataFrame, numbered: DataFrame) -> DataFrame:
    """One prompt per question, with its passages before it; a fixed text where there are none."""
    ctx = numbered.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_blocks"))
    # fixed values: the prompt's wording
    full = F.concat(F.lit("Context passages:\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\n\nAnswer:"))
    none = F.concat(F.lit("No context passages were retrieved.\n\nQuestion: "), F.col("query"), F.lit("\n\nSay that the corpus contains nothing relevant to this question."))
    return questions.join(ctx, "query_id", "left").select("query_id", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.when(F.col("context").isNull(), none).otherwise(full).alias("prompt"))


def judged(answers: DataFrame) -> DataFrame:
    """(query_id, answer, context, expected array, answerable): groundedness, relevance and refusal without a model."""
    a, c = judge_tokens(F.col("answer")), judge_tokens(F.col("context"))
    refused = looks_like_refusal(F.col("answer")).cast("double")
    grounded = F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, c)) / F.size(a))
    hits = F.size(F.filter("expected", lambda x: F.contains(F.lower("answer"), F.lower(x))))
    relevant = F.when(F.size("expected") == 0, F.lit(0.0)).otherwise(hits / F.size("expected"))
    return answers.select("query_id", F.when(F.col("answerable"), F.round(grounded, 3)).otherwise(refused).alias("groundedness"), F.when(F.col("answerable"), F.round(relevant, 3)).otherwise(refused).alias("relevance"), F.when(~F.col("answerable"), refused).alias("correct_refusal"))


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """USD of (model, fresh, cache_write, cache_read, output) tokens; writes cost 1.25 and reads 0.1 of the input price."""
    c = (F.col("fresh") * F.col("price_in") + F.col("cache_write") * F.col("price_in") * 1.25 + F.col("cache_read") * F.col("price_in") * 0.1 + F.col("output") * F.col("price_out")) / 1e6
    return usage.join(prices, "model").withColumn("cost_usd", c)
