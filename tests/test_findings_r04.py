"""Cases of the findings of round 4: each failed before."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import graph, retrieve as R, scan
from rankloom.plans import catalog
from rankloom.sources import files, lexical


@pytest.fixture
def mentions(spark):
    """Chunks of up to nine entities, some in many chunks and some in one, with repeated rows and nulls."""
    rng = random.Random(4)
    rows = [(c, f"e{int(rng.paretovariate(0.6)) % 90:02d}") for c in range(400) for _ in range(rng.randint(1, 9))]
    return spark.createDataFrame(rows + rows[:50] + [(None, "e01"), (None, "e02"), (7, None), (401, "alone")], "chunk_id int, entity string").repartition(3)


def test_heaviest_neighbours(spark, mentions):
    """an entity's neighbours are counted where its chunks are, also over batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for some in (mentions, mentions.withColumn("entity", F.conv(F.hex("entity"), 16, 10).cast("long"))):
            for n, often in ((1, 2), (5, 2), (200, 30)):
                got = sorted(map(tuple, graph.heaviest(some, n, often).collect()))
                assert got == sorted(map(tuple, graph.pruned(graph.edges(some, often), n).collect())) and len(got) > 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_walk_is_whole(spark, mentions):
    """chunks that are left out before the sum are in no list; questions with few chunks keep them all. Neighbours are not found anew for each level."""
    edges, passes = graph.heaviest(mentions, 3).localCheckpoint(), spark.sparkContext.accumulator(0)
    seeds = mentions.filter("entity is not null").select(F.col("entity").alias("query_id"), "entity").distinct()
    for hops, k in ((1, 5), (2, 40), (3, 1), (4, 5)):
        near = graph.reached(seeds, edges, hops, 3)
        scored = near.join(mentions.distinct(), "entity").groupBy("query_id", "chunk_id").agg(F.sum(1 / (1 + F.col("distance"))).alias("score"))
        got, want = (sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in x.collect()) for x in (graph.walk(seeds, edges, mentions, hops, 3, k), R.ranked(scored, k)))
        assert got == want and ("alone", 1, 401, 1.0) in got

    def counted(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    seen = mentions.mapInArrow(counted, mentions.schema)
    assert graph.walk(seeds, graph.edges(seen), seen, 3).count() and passes.value <= 4 * mentions.count()


def test_cosines_by_batch(spark):
    """F2: cosines by batch are those by pair, with nulls, other lengths and lengths of 0; no pair is scored by an expression."""
    rows = [(f"v{i:02d}", [float(i % 7 - 3), float(i % 5), 1.0 / (i + 1)]) for i in range(40)] + [("z0", None), ("z1", [1.0]), ("z2", [None, 1.0, 2.0]), ("z3", [0.0, 0.0, 0.0]), ("z4", []), ("z5", [float("nan"), 1.0, 1.0]), ("z6", [4.0, 3.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows) if i % 9 == 0 or i > 38], "query_id int, query array<double>")
    norm = F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(R.dot(F.col("query"), F.col("query")))
    pairs = vectors.join(asked, F.lit(True)).select("query_id", "chunk_id", F.round(F.when(norm > 0, R.dot(F.col("embedding"), F.col("query")) / norm), 6).alias("cosine"))
    got = R.cosines(vectors, asked, 6)
    text = lambda df: sorted((r.query_id, r.chunk_id, str(r.cosine)) for r in df.collect())
    assert text(got) == text(pairs) and len({c for *_, c in text(got)} & {"None", "nan", "1.0"}) == 3
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "zip_with" not in got._jdf.queryExecution().toString()
    halves = [0.0078125, -0.0078125, 0.4e-6, -0.2e-6, 0.25]
    assert list(map(str, scan._rounded(np.array(halves), 6).tolist())) == ["0.007813", "-0.007813", "0.0", "0.0", "0.25"]
    assert R.cosines(vectors, asked.limit(0)).count() == 0 and R.cosines(vectors.limit(0), asked).count() == 0


def test_scanned_stems(spark, monkeypatch):
    """lists over stems are those of the index of stems, also where few stems are kept; stop words and words of one letter do not count. Nothing is written on the way."""
    rng = random.Random(8)
    words = ["run", "Running", "runs", "the", "was", "x", "Ñandúes", "walked", "walking", "a_1s", "skies", "sky", "will", "news"]
    texts = [(f"c{i:03d}", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)] + [("z1", ""), ("z2", "the of"), ("z3", "x y")]
    docs = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "Runner runs, running!"), (2, "the sky was news"), (3, "the of"), (4, None), (5, "ñandú walks"), (6, "x"), (7, "unknown")], "query_id long, query string")
    index = lexical.Bm25Table(spark, files.fresh(spark, "stems"))
    index.build(docs)
    want = {k: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in index.search(asked, k).collect()) for k in (3, 1000)}
    before = _bytes(files.workspace(spark))
    monkeypatch.setattr(scan, "STEMS", 3)
    for k, lists in want.items():
        assert sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in scan.bm25(asked, docs, k, stemmed=True).collect()) == lists and {q for q, *_ in lists} >= {1, 2, 5}
    assert _bytes(files.workspace(spark)) == before


def test_no_index_is_written(spark, tmp_path):
    """the query writes no postings."""
    text = F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), (F.col("id") * (i + 3) % 997).cast("string")) for i in range(40)))
    spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1x4 w2x5 w3x6"), (2, "w9x12")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = _bytes(files.workspace(spark))
    assert catalog.QUERIES["bm25_stemmed"](spark, str(tmp_path)).count() > 2
    assert _bytes(files.workspace(spark)) - before < 100_000


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
