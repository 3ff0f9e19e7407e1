"""Evaluation of ranked documents against labels, all questions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KS = (1, 3, 5)


def ranked_arrays(doc_lists: DataFrame) -> DataFrame:
    """(query_id, doc, rank) to one array per question, in rank order; at most an evaluation depth each."""
    return doc_lists.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("retrieved"))


def _none(value: Column) -> Column:
    """Without relevant documents there is nothing to miss: 1."""
    return F.when(F.size("relevant") == 0, F.lit(1.0)).otherwise(value)


def recall(k: int) -> Column:
    return _none(F.size(F.array_intersect(F.slice("retrieved", 1, k), "relevant")) / F.size("relevant"))


def precision(k: int) -> Column:
    top = F.slice("retrieved", 1, k)
    hits = F.size(F.filter(top, lambda d: F.array_contains("relevant", d)))
    return F.when((F.size(top) == 0) | (F.size("relevant") == 0), F.lit(0.0)).otherwise(hits / F.size(top))


def first_rank() -> Column:
    """Rank of the first relevant document, or null."""
    at = F.transform("retrieved", lambda d, i: F.when(F.array_contains("relevant", d), i + 1))
    return F.array_min(F.filter(at, lambda x: x.isNotNull()))


def reciprocal_rank() -> Column:
    return _none(F.coalesce(1 / first_rank(), F.lit(0.0)))


def ndcg(k: int) -> Column:
    top = F.slice("retrieved", 1, k)
    gain = F.aggregate(F.transform(top, lambda d, i: F.when(F.array_contains("relevant", d), 1 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.size("relevant"), F.lit(k))), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    return _none(gain / ideal)


def hit(k: int) -> Column:
    return _none(F.arrays_overlap(F.slice("retrieved", 1, k), "relevant").cast("double"))


def per_question(labelled: DataFrame) -> DataFrame:
    """(query_id, kind, retrieved, relevant) with all metrics, rounded to 6 places."""
    cols = [F.round(f(k), 6).alias(f"{n}_at_{k}") for n, f in (("recall", recall), ("precision", precision), ("ndcg", ndcg), ("hit", hit)) for k in KS]
    return labelled.select("query_id", "kind", *cols, F.round(reciprocal_rank(), 6).alias("mrr"), first_rank().alias("first_rank"), F.size("relevant").alias("n_relevant"))


def summary(results: DataFrame) -> DataFrame:
    """Means by kind and over all (kind 'ALL') in one pass, to 4 places; NULL judgements are left out of means. The answerable-only means stand beside those that count questions without relevant documents as 1."""
    cols = [*(f"recall_at_{k}" for k in KS), "mrr", "ndcg_at_5"]
    # a kind and the total: two rows per result, aggregated before the shuffle
    rows = results.withColumn("kind", F.explode(F.array(F.col("kind"), F.lit("ALL"))))
    best = F.when(F.col("n_relevant") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 1 / F.col("n_relevant")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in cols), F.round(F.avg(F.when(F.col("n_relevant") > 0, F.col("recall_at_5"))), 4).alias("answerable_recall_at_5"), F.round(F.avg(best), 4).alias("max_recall_at_1"))


def ceiling(results: DataFrame, level: float = 0.95) -> DataFrame:
    """Whether the answerable mean recall reaches the level at every k: then the set cannot tell systems apart."""
    means = [F.round(F.avg(f"recall_at_{k}"), 4) for k in KS]
    flag = F.lit(True)
    for m in means:
        flag = flag & (m >= level)
    return results.filter("n_relevant > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(flag, F.lit(False)).alias("ceiling_reached"))


def validated(golden: DataFrame, docs: DataFrame) -> DataFrame:
    """Problems of a question set (id, kind, relevant): duplicate ids, missing documents, wrong kinds."""
    dup = golden.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    gone = golden.select("id", F.explode("relevant").alias("doc_id")).join(docs.select("doc_id"), "doc_id", "left_anti").select("id", F.lit("missing document").alias("problem")).distinct()
    kind = golden.filter((F.col("kind") == "unanswerable") != (F.size("relevant") == 0)).select("id", F.lit("wrong kind").alias("problem")).distinct()
    return dup.unionByName(gone).unionByName(kind)


def compared(runs: DataFrame) -> DataFrame:
    """(run, query_id, recall) side by side over the questions that all runs share: means, and questions that moved."""
    n = runs.agg(F.count_distinct("run").alias("runs"))
    shared = runs.groupBy("query_id").agg(F.count_distinct("run").alias("m")).join(F.broadcast(n)).filter("m = runs").select("query_id")
    return runs.join(shared, "query_id", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 4).alias("recall"))


def generation_means(results: DataFrame) -> DataFrame:
    """Means of groundedness, relevance and correct refusal (where it is not null), and n."""
    return results.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("groundedness", "relevance", "correct_refusal")))


def run_totals(results: DataFrame) -> DataFrame:
    """Mean latency (1 place) and total cost (6 places) of results with ms and cost_usd."""
    return results.agg(F.round(F.avg("ms"), 1).alias("ms"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def saturated(results: DataFrame, level: float = 0.95) -> DataFrame:
    """Kinds of answerable questions whose mean recall at 3 reaches the level."""
    return results.filter(F.col("kind") != "unanswerable").groupBy("kind").agg(F.round(F.avg("recall_at_3"), 4).alias("recall_at_3")).filter(F.col("recall_at_3") >= level)


def misses(results: DataFrame, beyond: int = 3) -> DataFrame:
    """Answerable questions whose first relevant document stands after a rank, or nowhere."""
    return results.filter((F.col("n_relevant") > 0) & (F.col("first_rank").isNull() | (F.col("first_rank") > beyond))).select("query_id", "first_rank", F.when(F.col("first_rank").isNull(), "absent").otherwise("near miss").alias("what"))


def crosstab(rows: DataFrame, by: str, flag: Column, names: tuple[str, str]) -> DataFrame:
    """Counts of rows by a column, with and without a flag."""
    return rows.groupBy(by).agg(F.count_if(flag).alias(names[0]), F.count_if(~flag).alias(names[1]))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How often two routers (query_id, route) say what: a_route, b_route, n."""
    return a.select("query_id", F.col("route").alias("a_route")).join(b.select("query_id", F.col("route").alias("b_route")), "query_id").groupBy("a_route", "b_route").agg(F.count(F.lit(1)).alias("n"))


def shortlist_crosstab(before: DataFrame, after: DataFrame, golden: DataFrame, top: int = 3) -> DataFrame:
    """Answerable questions by whether a relevant document is in the shortlist (query_id, doc) and among the first of the reranked list (query_id, doc, rank)."""
    rel = golden.select("query_id", F.explode("relevant").alias("doc"))
    inside = rel.join(before.select("query_id", "doc"), ["query_id", "doc"]).select("query_id").distinct().withColumn("in_shortlist", F.lit(True))
    first = rel.join(after.filter(F.col("rank") <= top).select("query_id", "doc"), ["query_id", "doc"]).select("query_id").distinct().withColumn("in_top", F.lit(True))
    each = rel.select("query_id").distinct().join(inside, "query_id", "left").join(first, "query_id", "left")
    return each.groupBy(F.coalesce("in_shortlist", F.lit(False)).alias("in_shortlist"), F.coalesce("in_top", F.lit(False)).alias("in_top")).agg(F.count(F.lit(1)).alias("n"))


def described(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, min, median (a value that occurs) and max by a column, and over all rows (by: null), in one pass."""
    v = F.col(value)
    out = rows.rollup(by).agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("least"), F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("most"), F.grouping(by).alias("total"))
    return out.withColumn("total", F.col("total") == 1)


def heads(rows: DataFrame, by: str, order: list, n: int = 2) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def matrix(summaries: DataFrame, names: list[str], value: str = "recall_at_5") -> DataFrame:
    """One row per kind, a column per run (run, kind, value)."""
    return summaries.groupBy("kind").pivot("run", names).agg(F.first(value))


def moved(a: DataFrame, b: DataFrame) -> DataFrame:
    """Questions whose first relevant rank differs between two runs: query_id, before, after."""
    both = a.select("query_id", F.col("first_rank").alias("before")).join(b.select("query_id", F.col("first_rank").alias("after")), "query_id", "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def spread(passages: DataFrame, top: int = 5) -> DataFrame:
    """Distinct documents and characters among the first passages (query_id, rank, doc_id, text) of each question."""
    return passages.filter(F.col("rank") <= top).groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum(F.length("text")).alias("chars"))


def refusals_by_config(answers: DataFrame) -> DataFrame:
    """(config, answerable, refused) to the rates of right and wrong refusals of each configuration."""
    rate = lambda c: F.round(F.avg(F.when(c, F.col("refused").cast("double"))), 4)
    return answers.groupBy("config").agg(F.count(F.lit(1)).alias("n"), rate(~F.col("answerable")).alias("correct_refusal"), rate(F.col("answerable")).alias("false_refusal"))
