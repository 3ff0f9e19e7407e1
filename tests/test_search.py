"""Stemmer, blocked index, windows as islands, walks over several levels and the evaluation grid."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.functions.stemmer import stem, stems
from rankloom.operators import context, evaluation, graph, metrics, retrieve as R
from rankloom.sources import store
from rankloom.sources.lexical import Bm25Table

#: Words of the published sample vocabulary and of the rules' own examples, each before its stem.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knot knot knots knot
generate generat generates generat generous generous generously generous general general communication communic community communiti arsenal arsenal ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoped hope hoping hope falling fall by by say say cry cri dying die relational relat conditional condit rational ration digitizer digit vietnamization vietnam operator oper feudalism feudal hopefulness hope decisiveness decis formaliti formal sensibiliti sensibl triplicate triplic formative format electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate cease ceas controll control roll roll youth youth boy boy syzygy syzygi news news innings inning succeed succeed agreed agre feed feed owe owe bee bee apology apolog fully fulli carelessly careless sky sky skies sky only onli yes yes flying fli x x be be"""


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_stemmer(spark):
    pairs = SAMPLE.split()
    want = dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert len(want) > 130 and {w: stem(w) for w in want} == want
    assert stem("") == "" and stem("a") == "a" and stem("caf\u00e9s") == "caf\u00e9" and stem("v2_9ing") == "v2_9ing" and stem("'tis") == "tis"
    got = stems(spark.createDataFrame([(w,) for w in [*want, *want, None]], "word string")).collect()
    assert len(got) == len(want) and {r.word: r.stem for r in got} == want
    docs = spark.createDataFrame([(1, "The indexing of queries: boxes worked quickly, boxes"), (2, None), (3, "the of")], "doc_id long, text string")
    assert {r.doc_id: r.terms for r in R.stemmed(docs).collect()} == {1: ["index", "queri", "box", "work", "quick", "box"], 2: [], 3: []}


@pytest.fixture(scope="module")
def corpus(spark):
    """Topics that lie together in the order of the ids, common words everywhere."""
    rng = random.Random(7)
    common, out = [f"w{i}" for i in range(12)], []
    for i in range(6000):
        own = [f"t{i // 200}x{j}" for j in range(15)]
        out.append((f"d{i:06d}", " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(own) for _ in range(rng.randint(1, 60)))))
    out += [("z1", ""), ("z2", None), ("z3", "!!")]
    return spark.createDataFrame(out, "chunk_id string, text string").repartition(5).persist()


def test_blocked_index(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr("rankloom.sources.lexical.WIDTH", 64)
    index = Bm25Table(spark, str(tmp_path / "i"), X.tokens)
    assert not index.load()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were much of it
    try:
        index.build(corpus)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.load()
    asked = spark.createDataFrame([(i, f"w{i % 12} w3 t{i}x1 t{i}x2 w5 unknown") for i in range(30)] + [(90, "w1 w2"), (91, " "), (92, "t3x1")], "query_id long, query string")
    want = rows(R.bm25(asked, corpus, 5), "query_id", "chunk_id", "rank")
    assert rows(index.search(asked, 5), "query_id", "chunk_id", "rank") == want and {q for q, *_ in want} == {*range(30), 90, 92}
    # blocks are short, no term lies whole in a task or file, and most of a question's blocks stay closed
    blocks = spark.read.parquet(f"{index.path}/blocks")
    assert blocks.agg(F.max(F.size("entries"))).first()[0] <= 64 and blocks.filter("term = 'w3'").count() > 80
    assert blocks.filter("term = 'w3'").select(F.input_file_name()).distinct().count() > 1
    skipped = {r.query_id: (r.n_blocks, r.n_opened) for r in index.skipped(asked, 5).collect()}
    assert all(opened < n / 4 for q, (n, opened) in skipped.items() if q < 30), skipped
    plan = index.search(asked.limit(1), 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan or "PartitionFilters: [isnotnull(folder" in plan
    # lists longer than a topic, ties by id, and a stated set of chunks
    assert rows(index.search(asked.limit(3), 500), "query_id", "chunk_id", "rank") == rows(R.bm25(asked.limit(3), corpus, 500), "query_id", "chunk_id", "rank")
    among = corpus.filter("chunk_id like '%7'")
    got = index.search(asked.limit(5), 4, among)
    every = R.bm25(asked.limit(5), corpus, 10_000).join(among.select("chunk_id"), "chunk_id", "left_semi")
    assert rows(got, "query_id", "chunk_id", "rank") == rows(R.ranked(every.drop("rank"), 4), "query_id", "chunk_id", "rank")
    some = index.postings(spark.createDataFrame([("w3",), ("w3",), ("none",)], "term string"))
    assert some.count() == blocks.filter("term = 'w3'").agg(F.sum("n")).first()[0] and some.columns == ["chunk_id", "term", "tf", "size"]
    spark.createDataFrame([(1,)], "other int").write.mode("overwrite").parquet(f"{index.path}/terms")
    assert not index.load()


def test_stemmed_index(spark, tmp_path):
    texts = spark.createDataFrame([(1, "running quickly"), (2, "the runs of a runner"), (3, "walked"), (4, "run run run")], "chunk_id long, text string")
    index = store.Bm25Table(spark, str(tmp_path / "i"))
    index.build(texts)
    got = index.search(spark.createDataFrame([(1, "Runs!"), (2, "walking"), (3, "the of")], "query_id long, query string"), 5)
    assert [(r.query_id, r.chunk_id) for r in got.orderBy("query_id", "rank").collect()] == [(1, 4), (1, 1), (1, 2), (2, 3)]


def test_islands_and_greedy_windows_differ(spark):
    """Ranked windows 0-10 and 20-30 do not overlap; the third, 8-22, joins them as one island, while the greedy fold puts it into the first alone."""
    shape = "query_id long, rank int, doc_id string, score double, from_char int, to_char int"
    wide = spark.createDataFrame([(1, 1, "a", 0.9, 0, 10), (1, 2, "a", 0.8, 20, 30), (1, 3, "a", 0.7, 8, 22), (1, 4, "a", 0.6, 30, 40), (1, 5, "b", 0.5, 5, 15), (2, 1, "a", 0.4, 5, 50), (2, 2, "a", 0.3, 10, 20), (2, 3, "a", 0.2, 30, 60)], shape)
    greedy = rows(context.merged_windows(wide), "query_id", "doc_id", "from_char", "to_char", "merged_windows")
    assert greedy == [(1, "a", 0, 22, 2), (1, "a", 20, 30, 1), (1, "a", 30, 40, 1), (1, "b", 5, 15, 1), (2, "a", 5, 60, 3)]
    islands = rows(context.window_islands(wide), "query_id", "doc_id", "from_char", "to_char", "merged_windows", "best_rank", "score")
    assert islands == [(1, "a", 0, 30, 3, 1, 0.9), (1, "a", 30, 40, 1, 4, 0.6), (1, "b", 5, 15, 1, 5, 0.5), (2, "a", 5, 60, 3, 1, 0.4)]
    kept = context.merged_windows(wide.withColumn("scores", F.create_map(F.lit("dense"), F.col("score"), F.concat(F.lit("r"), F.col("rank").cast("string")), F.lit(1.0))))
    assert kept.filter("query_id = 2").first().scores == {"dense": 0.4, "r1": 1.0, "r2": 1.0, "r3": 1.0}


def test_scores_are_carried(spark):
    shape = "query_id long, chunk_id string, score double, rank int"
    dense = R.with_origin(spark.createDataFrame([(1, "a", 0.7, 1), (1, "b", 0.5, 2)], shape), "dense")
    lexical = R.with_origin(spark.createDataFrame([(1, "b", 9.0, 1), (1, "c", 8.0, 2), (2, "c", 3.0, 1)], shape), "bm25")
    fused = R.fuse({"dense": dense, "bm25": lexical})
    got = {(r.query_id, r.chunk_id): r.scores for r in fused.collect()}
    assert got[1, "b"] == {"dense": 0.5, "bm25": 9.0, "rrf": 1 / 62 + 1 / 61} and set(got[1, "c"]) == {"bm25", "rrf"}
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id long, query string")
    again = R.rerank(fused, F.lit(0.1) * F.col("rank_before"), 3)
    assert all(r.scores["rerank"] == r.score and "rrf" in r.scores for r in again.collect())
    # the floor is for cosines: fused and reranked scores would refuse the first question, and let the second pass
    assert rows(context.gate(again, asked, 0.6), "query_id", "best_score", "abstain") == [(1, 0.7, False), (2, 0.1, True), (3, 0.0, True)]
    other = R.fuse({"dense": dense, "plain": lexical.drop("scores")})
    assert {frozenset(r.scores) for r in other.collect()} == {frozenset(("dense", "rrf")), frozenset(("rrf",))}


def test_walk_over_levels(spark):
    pairs = [("a", "b", 5), ("b", "c", 4), ("c", "d", 3), ("d", "e", 2), ("a", "f", 1), ("f", "a", 1)]
    edges = spark.createDataFrame(pairs + [(y, x, w) for x, y, w in pairs[:4]], "src string, dst string, weight long")
    seeds = spark.createDataFrame([(1, "a"), (1, "a"), (2, "d"), (3, "none")], "query_id long, entity string")
    of = lambda hops, n=10: rows(graph.reached(seeds.filter("query_id = 1"), edges, hops, n), "entity", "distance")
    assert of(0) == [("a", 0)] and of(1) == [("a", 0), ("b", 1), ("f", 1)] and of(3) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("f", 1)]
    assert of(9) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 1)] and of(1, 1) == [("a", 0), ("b", 1)]
    mentions = spark.createDataFrame([("m1", "b"), ("m1", "c"), ("m2", "d"), ("m3", "none")], "chunk_id string, entity string")
    got = rows(graph.walk(seeds, edges, mentions, 3), "query_id", "chunk_id", "score")
    assert [(q, c, round(s, 6)) for q, c, s in got] == [(1, "m1", 0.833333), (1, "m2", 0.25), (2, "m1", 0.833333), (2, "m2", 1.0), (3, "m3", 1.0)]
    alone = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (4, "c"), (5, "d")], "chunk_id int, entity string")
    assert tuple(graph.stats(graph.edges(alone), alone).first()) == (3, 1, 0.6667, 1) and graph.stats(graph.edges(alone)).first().entities == 2


def test_grid_reproduces_the_summary(spark):
    """At each depth without a floor, the grid says what the per-question metrics do; floors only take questions away."""
    rng = random.Random(1)
    golden = [(q, "multi" if q % 3 else "unanswerable", rng.sample(range(12), rng.randint(1, 4)) if q % 3 else []) for q in range(25)]
    lists = [(q, d, r + 1, 1.0 - r / 10 - q / 50) for q in range(24) for r, d in enumerate(rng.sample(range(12), 6))]
    golden_df = spark.createDataFrame(golden, "query_id long, kind string, relevant array<int>")
    lists_df = spark.createDataFrame(lists, "query_id long, chunk_id int, rank int, score double")
    asked = golden_df.select("query_id", F.lit("x").alias("query"))
    found = evaluation.pool({"one": lambda q, k: lists_df.filter(F.col("rank") <= k)}, asked, 5)
    cells = evaluation.grid(evaluation.at_depths(found, golden_df, ["one"], [1, 3, 5]), [None, 0.6])
    none = F.expr("cast(array() as array<int>)")
    arrays = metrics.ranked_arrays(lists_df.filter("rank <= 5").withColumnRenamed("chunk_id", "doc"))
    each = metrics.per_question(golden_df.join(arrays, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", none)))
    for kind in ("ALL", "multi", "unanswerable"):
        some = each if kind == "ALL" else each.filter(F.col("kind") == kind)
        for k in (1, 3, 5):
            want = some.agg(*(F.avg(f"{m}_at_{k}") for m in ("recall", "precision", "ndcg", "hit"))).first()
            got = cells.filter((F.col("kind") == kind) & (F.col("depth") == k) & F.col("floor").isNull()).first()
            assert [got.recall, got.precision, got.ndcg, got.hit] == pytest.approx(list(want), abs=2e-4) and got.n_refused == 0 and got.n == some.count()
    best = {q: max(s for p, _, _, s in lists if p == q) for q, *_ in lists}
    low = {q for q, *_ in golden if best.get(q, -1) < 0.6}
    cell = cells.filter("kind = 'ALL' and depth = 3 and floor = 0.6").first()
    assert cell.n_refused == len(low) and cell.false_refusal == pytest.approx(sum(q in low for q, _, r in golden if r) / sum(bool(r) for *_, r in golden), abs=1e-4)
    table = evaluation.report(cells, ["one"]).collect()
    assert len(table) == 3 * 3 * 2 and table[0].kind == "ALL"
    with pytest.raises(ValueError):
        evaluation.pool({}, asked, 5)
