"""Cases of the findings of round 3: each failed before."""

import pytest
from pyspark.sql import functions as F

from rankloom.plans import catalog


@pytest.fixture
def folder(tmp_path):
    def put(**tables):
        for name, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_turns_without_a_line(spark, folder):
    """of a user's turn no line may be left, as all are short, headers, empty or null."""
    said = [(1, 0, "user", "short"), (2, 0, "user", ""), (3, 0, "user", "a header only:"), (4, 0, "user", "- a proper line"), (5, 0, "user", None)]
    d = folder(conversations=spark.createDataFrame(said, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: (r.n_lines, r.first_line) for r in catalog.QUERIES["variant_clean"](spark, d).collect()}
    assert got == {1: (0, ""), 2: (0, ""), 3: (0, ""), 4: (1, "a proper line"), 5: (None, "")}


@pytest.fixture
def vectors(spark):
    """1,200 rows of label 3 and as many of label 1 on a circle, with two questions."""
    angle = F.col("id") * 0.37
    return spark.range(2400).select(F.col("id").alias("vec_id"), F.array(F.cos(angle), F.sin(angle)).cast("array<float>").alias("embedding"), F.when(F.col("id") % 2 == 0, 3).otherwise(1).alias("label")).filter("vec_id < 101 or vec_id % 100 > 0")


def test_whole_filtered_lists(spark, folder, vectors):
    """a filter may leave more than 1,000 rows to a question."""
    d = folder(embeddings=vectors)
    n = vectors.filter("label = 3").count()
    assert n > 1000
    assert {(r.query_id, r.n) for r in catalog.QUERIES["cells_filtered"](spark, d).collect()} == {(0, n), (100, n)}


def test_every_cosine(spark, folder, vectors):
    """a row for each question and vector."""
    d = folder(embeddings=vectors)
    got = catalog.QUERIES["cosine_matrix"](spark, d)
    assert got.columns == ["query_id", "chunk_id", "cosine"] and got.count() == 2 * vectors.count() == got.select("query_id", "chunk_id").distinct().count()
    assert got.filter("query_id = 100 and chunk_id = 100").first().cosine == 1.0


def test_scanned_lists(spark):
    """F1 to F10: scans give the lists of the plain operators; ties by id, in batches of few rows, with null and empty texts."""
    import random

    from rankloom.functions import text as X
    from rankloom.operators import retrieve as R, scan

    rng = random.Random(5)
    texts = [(f"c{i:04d}", " ".join(rng.choice(["the", "of", "Ñandú", "x", "a_1", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 12)))) for i in range(700)]
    docs = spark.createDataFrame(texts + [("z1", ""), ("z2", "!!")], "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, f"The w{i}, ñandú of w{i + 1}!") for i in range(20)] + [(50, "a_1"), (51, " "), (52, None), (53, "unknown x")], "query_id long, query string")
    for k in (1, 4, 1000):
        for one, other in ((scan.bm25, R.bm25), (scan.overlap, R.overlap)):
            got, want = (sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in f(asked, docs, k).collect()) for f in (one, other))
            assert got == want and {q for q, *_ in got} == {*range(20), 50}
    spaces = spark.createDataFrame([(" \t a  b　\n",), ("​\u0085x",), (" \r\n",), (None,)], "t string").select(X.strip(F.col("t")).alias("t"), F.regexp_replace("t", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("want"))
    assert all(r.t == r.want for r in spaces.collect())


@pytest.mark.parametrize("name", ["answers_cited", "answers_generated", "parent_merge", "question_events", "rrf_k_sweep", "serialised_results", "context_budget", "parent_window_expand", "passages_spread", "prompt_build"])
def test_no_shuffle_of_texts(spark, folder, name):
    """F1 to F10: what is written on the way is at most the lists, not the words of all texts."""
    text = F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), (F.col("id") * (i + 3) % 997).cast("string")) for i in range(60)))
    d = folder(documents=spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"), F.length(text).alias("n_chars"), F.lit("en").alias("lang")), benchmark=spark.createDataFrame([(1, "w1x4 w2x5 w3x6"), (2, "w9x12")], "item_id long, text string"))
    from rankloom.sources import files

    before = _bytes(files.workspace(spark))
    assert catalog.QUERIES[name](spark, d).count()
    assert _bytes(files.workspace(spark)) - before < 100_000


def _bytes(path):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_whole_questions_in_texts(spark):
    """by an inner word the same texts are found as by a search in all."""
    from rankloom.operators import scan

    texts = [(1, "so Big ñandú runs."), (2, "so big ñandú runs"), (3, "Big ñandúx runs"), (4, "xBig ñandú runsy"), (5, None), (6, ""), (7, "a-b"), (8, "Big ñandú")]
    docs = spark.createDataFrame(texts, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "Big ñandú runs"), (2, "ñandú"), (3, "-"), (4, None), (5, ""), (6, "big ñandú")], "query_id long, query string")
    want = sorted((r.query_id, r.chunk_id) for r in docs.join(asked, F.contains("text", "query")).collect())
    assert sorted((r.query_id, r.chunk_id) for r in scan.containing(asked, docs).collect()) == want and (1, 4) in want and (5, 6) in want


def test_vectors_by_batch(spark):
    """lists by batch are those by pair, with nulls, other lengths and ties."""
    from rankloom.operators import retrieve as R

    rows = [(i, [float(i % 3), float(i % 5)]) for i in range(40)] + [(90, None), (91, [1.0]), (92, [None, 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "query_id long, query array<double>")
    pairs = R.ranked(vectors.join(asked, F.lit(True)).select("query_id", "chunk_id", R.dot(F.col("embedding"), F.col("query")).alias("score")), None)
    for k in (4, 42):
        assert sorted(map(tuple, R.dense(asked, vectors, k).collect())) == sorted(map(tuple, pairs.filter(F.col("rank") <= k).collect()))
