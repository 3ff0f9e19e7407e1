"""Hand-computed cases for the retrieval engine, and its queries against their SQL."""

import math
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import chunk, context, graph, metrics, retrieve as R
from rankloom.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["doc_scan_filter", "chunk_fixed", "bm25_topk", "rrf_fusion", "dense_topk", "metrics_by_kind", "context_budget", "citations_extract", "hub_prune", "golden_validate", "threshold_sweep"]


def _list(spark, name, ids):
    return spark.createDataFrame([(1, c, 1.0, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, score double, rank int")


def _values(rows):
    return sorted((tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float, Decimal)) else str(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert _values(got.select(*cols).collect()) == _values(want.select(*cols).fetchall())


def test_fusion_anchors(spark):
    top = R.fuse({"a": _list(spark, "a", "ab"), "b": _list(spark, "b", "ac")}).first()
    assert top["chunk_id"] == "a" and math.isclose(top["score"], 2 / 61)
    dense, bm25 = _list(spark, "d", "awxyb"), _list(spark, "l", "pqrsb")
    assert R.fuse({"d": dense, "l": bm25}, rrf_k=1).first()["chunk_id"] == "a"
    assert R.fuse({"d": dense, "l": bm25}, rrf_k=60).first()["chunk_id"] == "b"
    with pytest.raises(ValueError):
        R.fuse({})


def test_metric_example(spark):
    df = spark.createDataFrame([(1, "x", list("CADBE"), list("AB")), (2, "x", ["A"], [])], "query_id int, kind string, retrieved array<string>, relevant array<string>")
    a, b = metrics.per_question(df).orderBy("query_id").collect()
    assert (a.recall_at_1, a.recall_at_3, a.recall_at_5, a.mrr, a.first_rank) == (0, 0.5, 1, 0.5, 2)
    assert round(a.ndcg_at_5, 3) == 0.651 and a.precision_at_3 == round(1 / 3, 6)
    assert b.recall_at_1 == b.mrr == b.ndcg_at_5 == 1 and b.first_rank is None and b.precision_at_1 == 0


def test_text_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first()["v"]

    assert value(X.citations(F.lit("a [2][4] b [2] c [1, 3]"))) == [2, 4, 1, 3]
    assert value(X.looks_lexical(F.lit("What is exit status 75?"))) and not value(X.looks_lexical(F.lit("Why am I charged twice?")))
    assert value(X.looks_like_refusal(F.lit("The context does not mention it."))) and not value(X.looks_like_refusal(F.lit("It is 42.")))
    assert value(X.clean_lines(F.lit('Here are some:\n1. how does it work?\n- "what is the default?"\nshort'))) == ["how does it work?", "what is the default?"]
    assert value(X.entities(F.lit("See `max_retries`, TX-4491 and The Thing; Vector Search works"))) == ["TX-4491", "max_retries", "Vector Search"]
    assert value(X.tolerant_json(F.lit('Sure {"a": 1} ok'), "a")) == "1" and value(X.tolerant_json(F.lit("no"), "a")) is None
    assert value(X.title(F.lit("x\n# Head \ny"), F.lit("s"))) == "Head" and value(X.title(F.lit("x"), F.lit("a-b_c"))) == "a b c"
    assert value(X.snap(F.lit("One. Two three"), F.lit(7), False)) == 5


def test_chunkers(spark):
    docs = spark.createDataFrame([(1, "a" * 1000), (2, "# H\n\nFirst part here. " + "word " * 60 + "\n\n## Next\n\nEnd."), (3, ""), (4, None)], "doc_id long, text string")
    assert [(r.start_char, r.end_char) for r in chunk.fixed(docs).filter("doc_id = 1").orderBy("chunk_index").collect()] == [(0, 512), (448, 960), (896, 1000)]
    rows = chunk.recursive(docs, 100, 20).filter("doc_id = 2").collect()
    assert rows and all(len(r.text) <= 100 + 21 for r in rows)
    # headings go with their section where the two fit; the one before a longer section stands alone
    sections = docs.sparkSession.createDataFrame([(1, "# H\n\nFirst part here, rather long.\n\n## Next\n\nEnd.\n\n## Last\n\nThird part.")], "doc_id long, text string")
    assert chunk.orphan_headings(chunk.recursive(sections, 40, 8)).count() == 0 and chunk.recursive(sections, 40, 8).count() == 2
    assert [r.text for r in chunk.orphan_headings(chunk.recursive(docs, 100, 0)).collect()] == ["# H"]
    with pytest.raises(ValueError):
        chunk.fixed(docs, 10, 10)


def test_windows_merge_and_gate(spark):
    wide = spark.createDataFrame([(1, 1, 7, 0.9, 0, 100), (1, 2, 7, 0.8, 50, 160), (1, 3, 8, 0.7, 0, 10)], "query_id int, rank int, doc_id long, score double, from_char int, to_char int")
    a, b = context.merged_windows(wide).orderBy("rank").collect()
    assert (a.from_char, a.to_char, a.merged_windows, a.score) == (0, 160, 2, 0.9) and b.doc_id == 8
    lists = spark.createDataFrame([(1, 0.6), (2, 0.599)], "query_id int, score double")
    got = {r.query_id: r.abstain for r in context.gate(lists, spark.createDataFrame([(1,), (2,), (3,)], "query_id int")).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_rerank_keeps_whole_shortlist(spark, tmp_path):
    n = 1_000_010  # the last ten, first by BM25, stand behind a million documents of the same overlap
    text = F.when(F.col("id") >= n - 10, "alpha alpha alpha").otherwise("alpha")
    spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.rank, r.chunk_id, r.score, r.rank_before, r.moved) for r in catalog.QUERIES["rerank_overlap"](spark, str(tmp_path)).collect())
    assert got == [(i, n - 11 + i, 1.0, i, 0) for i in range(1, 6)]
    assert [tuple(r) for r in catalog.QUERIES["rerank_movement"](spark, str(tmp_path)).collect()] == [(0, 5)]


def test_graph_walk(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (3, "c")], "chunk_id int, entity string")
    e = graph.edges(m)
    assert {(r.src, r.dst, r.weight) for r in e.collect()} == {("a", "b", 2), ("b", "a", 2)}
    got = graph.walk(spark.createDataFrame([(1, "a")], "query_id int, entity string"), e, m).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(1, 1.5), (2, 1.5), (3, 0.5)]


def test_plans_prune_and_push(spark):
    def plan(df):
        return df._jdf.queryExecution().toString()

    assert "WindowGroupLimit" in plan(catalog.QUERIES["dense_topk"](spark, SF))
    assert "EqualTo(label,3)" in plan(catalog.QUERIES["dense_topk_prefilter"](spark, SF))
