"""Keyed tables under commits, the inverted file of vectors, and the log of replies."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankloom import providers as P
from rankloom.operators import answer, chunk, retrieve as R, transform
from rankloom.sources import files, replies
from rankloom.sources.delta import MergedTable
from rankloom.sources.replies import ReplyLog
from rankloom.sources.vectors import CellVectorTable, recall

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file


class Counting:
    """Another generator, with each call written down; for local sessions."""

    def __init__(self, path, inner, name="counting"):
        self.path, self.inner, self.name = str(path), inner, name
        open(self.path, "a").close()

    def generate(self, system, prompt, max_tokens=1024):
        with open(self.path, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        return self.inner.generate(system, prompt, max_tokens)

    def calls(self):
        with open(self.path) as f:
            return f.read().splitlines()


class Moody:
    """Another reply each time it is asked."""

    name = "moody"

    def __init__(self, *replies):
        self.replies = replies

    def generate(self, system, prompt, max_tokens=1024):
        return random.SystemRandom().choice(self.replies), 1, 1


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


# keyed tables


def test_upserts_deletes_and_versions(spark, tmp_path):
    t = MergedTable(spark, str(tmp_path / "t"), buckets=("doc_id", 8))
    of = lambda *r: spark.createDataFrame(r, "chunk_id string, doc_id string, v int")
    assert t.read() is None and t.version == 0
    t.upsert(of(("a1", "a", 1), ("a2", "a", 1), ("b1", "b", 1), ("b1", "b", 1)))
    t.upsert(of(("a1", "a", 2)), replacing="doc_id")
    assert rows(t.read(), "chunk_id", "v") == [("a1", 2), ("b1", 1)] and rows(t.read(1), "chunk_id", "v") == [("a1", 1), ("a2", 1), ("b1", 1)]
    t.delete(of(("b1", "", 0)))
    assert rows(t.read(), "chunk_id") == [("a1",)]
    t.upsert(of(("b1", "b", 7)))  # what was deleted can come again
    assert rows(t.read(), "chunk_id", "v") == [("a1", 2), ("b1", 7)]
    few = t.read(only=t.only(of(("", "b", 0))))
    assert rows(few, "chunk_id") in ([("b1",)], [("a1",), ("b1",)]) and "PartitionFilters: [isnotnull(_bucket" in few._jdf.queryExecution().toString()
    t.compact()
    assert len(t.commit()["parts"]) == 1 and rows(t.read(), "chunk_id", "v") == [("a1", 2), ("b1", 7)]
    assert len(t.vacuum()) == 5 and t.versions() == [5] and rows(t.read(), "chunk_id", "v") == [("a1", 2), ("b1", 7)]
    t.reset()
    assert t.read() is None
    with pytest.raises(Exception, match="null chunk_id"):
        t.upsert(of((None, "b", 7)))
    assert t.read() is None


def test_against_a_dictionary(spark, tmp_path):
    """Many random changes, each checked against a dictionary; the table compacts itself on the way."""
    rng, t, want = random.Random(4), MergedTable(spark, str(tmp_path / "t"), buckets=("doc_id", 3)), {}
    for step in range(14):
        ids = [(f"{d}{c}", d, step * 100 + c) for d in rng.sample("abcdef", 3) for c in rng.sample(range(5), 2)]
        kind = rng.choice(["upsert", "upsert", "replace", "delete", "drop"])
        df = spark.createDataFrame(ids, "chunk_id string, doc_id string, v int")
        if kind == "upsert" or (kind != "replace" and not want):
            t.upsert(df)
            want |= {k: (d, v) for k, d, v in ids}
        elif kind == "replace":
            t.upsert(df, replacing="doc_id")
            want = {k: x for k, x in want.items() if x[0] not in {d for _, d, _ in ids}} | {k: (d, v) for k, d, v in ids}
        elif kind == "delete":
            t.delete(df)
            want = {k: x for k, x in want.items() if k not in {k for k, *_ in ids}}
        else:
            t.delete(df, on="doc_id")
            want = {k: x for k, x in want.items() if x[0] not in {d for _, d, _ in ids}}
        if step == 8:
            t.compact()
    got = t.read()
    assert {r.chunk_id: (r.doc_id, r.v) for r in got.collect()} == want and got.count() == len(want)


def test_a_small_upsert_writes_little(spark, tmp_path):
    t = MergedTable(spark, str(tmp_path / "t"))
    base = spark.range(20000).select(F.format_string("c%d", "id").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    t.upsert(base)
    before = size_of(t.path)
    t.upsert(base.limit(200).withColumn("text", F.md5("text")))
    assert size_of(t.path) - before < 0.03 * before and t.read().count() == 20000


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    a, b = (MergedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one = spark.createDataFrame([("x", 1)], "chunk_id string, v int")
    a.upsert(one)
    now = a.commit()
    b.upsert(one.withColumn("v", F.lit(2)))
    with pytest.raises(FileExistsError):
        a._commit(now, [])
    assert rows(a.read(), "v") == [(2,)] and not [n for n, *_ in files.listed(spark, f"{a.path}/_commits") if n.endswith(".tmp")]


# inverted file


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(30, size=3000)] + 0.25 * rng.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:1000] = v[0]  # a third of the rows is one vector
    data = [(f"c{i:05d}", x.tolist(), i % 50) for i, x in enumerate(v)]
    return spark.createDataFrame(data, "chunk_id string, embedding array<double>, label int").repartition(4).persist()


def test_inverted_file(spark, clustered, tmp_path):
    t = CellVectorTable(spark, str(tmp_path / "v"), 16)
    t.add(clustered)
    asked = clustered.filter("chunk_id like '%00' or chunk_id like '%50'").select(F.substring("chunk_id", 2, 5).cast("long").alias("query_id"), F.col("embedding").alias("query"))
    exact = R.dense(asked, clustered, 10)
    found = t.search(asked, 10)
    cells, probes = t.notes["cells"], t.notes["probes"]
    assert 30 <= cells <= 55 and probes < cells / 4 and recall(found, exact) >= 0.95
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    few = t.search(asked.limit(1), 10)
    opened = few._jdf.queryExecution().toString().split("PartitionFilters: [cell")[1].split("]")[0]
    assert opened.count(",") < probes + 3
    assert rows(t.search(asked, 10, probes=cells), "query_id", "chunk_id", "rank") == rows(exact, "query_id", "chunk_id", "rank")
    # a filter that leaves fewer than k in the cells is answered from all
    rare = F.col("label") == 3
    assert rows(t.search(asked, 60, rare), "query_id", "chunk_id") == rows(R.dense(asked, clustered, 60, rare), "query_id", "chunk_id")
    among = clustered.filter("label = 7").select("chunk_id")
    assert {c for (c,) in rows(t.search(asked, 3, among=among), "chunk_id")} <= {c for (c,) in rows(among, "chunk_id")}


def test_inverted_file_is_kept_up(spark, clustered, tmp_path):
    """Rows that are added, moved to another cell or removed are found, or no longer found, at once; new centres find them too."""
    t = CellVectorTable(spark, str(tmp_path / "v"), 16)
    t.add(clustered)
    away = [0.0] * 15 + [1.0]
    ask = spark.createDataFrame([(1, away)], "query_id long, query array<double>")
    t.add(spark.createDataFrame([("c00005", away, 1), ("new", away, 2)], "chunk_id string, embedding array<double>, label int"))
    assert rows(t.search(ask, 2), "chunk_id") == [("c00005",), ("new",)] and t.count() == 3001
    t.remove(spark.createDataFrame([("new",)], "chunk_id string"))
    assert rows(t.search(ask, 1), "chunk_id") == [("c00005",)] and CellVectorTable(spark, t.path, 16).count() == 3000
    t.retrain()
    assert rows(t.search(ask, 1), "chunk_id") == [("c00005",)] and t.count() == 3000
    t.reset()
    assert t.search(ask, 1).count() == 0
    t.add(clustered.limit(3))
    assert t.search(ask, 5).count() == 3


# replies


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = ReplyLog(spark, str(tmp_path / "log"), part=3)
    made = Counting(tmp_path / "calls", P.RuleGenerator(("bad", ValueError("x")), default="yes"))
    asked = spark.createDataFrame([(i, f"p{i % 7}") for i in range(20)] + [(99, None), (98, "bad")], "id long, prompt string")
    out = log.replies(asked, "s", F.col("prompt"), made)
    assert out.count() == 22 and len(made.calls()) == 9 and len(log.parts()) >= 3  # counting it asks nothing
    assert {(r.reply.text, r.reply.error) for r in out.filter("id < 99 and id <> 98").collect()} == {("yes", None)}
    assert out.filter("id = 98").first().reply.error == "ValueError"
    log.replies(asked, "s", F.col("prompt"), made).count()
    assert len(made.calls()) == 9
    again = ReplyLog(spark, log.path)  # a new log object asks only what failed
    assert again.replies(asked, "s", F.col("prompt"), made).count() == 22 and made.calls()[9:] == ["bad"]
    again.replies(asked, "other system", F.col("prompt"), made)
    assert len(made.calls()) == 10 + 9


class Dying:
    """Ends the job with the fifth call: no error of the generator, but of its process."""

    name = "counting"

    def __init__(self, path):
        self.path = path

    def generate(self, system, prompt, max_tokens=1024):
        with open(self.path, "a") as f:
            f.write("x")
        if os.path.getsize(self.path) >= 5:
            raise SystemExit
        return "first run", 1, 1


def test_a_lost_job_is_taken_up(spark, tmp_path):
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "id long, prompt string")
    with pytest.raises(Exception):  # noqa: B017
        ReplyLog(spark, str(tmp_path / "log"), part=2).replies(asked, "s", F.col("prompt"), Dying(str(tmp_path / "n")))
    log = ReplyLog(spark, str(tmp_path / "log"), part=2)
    kept = log.read().count()
    assert 0 < kept < 5
    made = Counting(tmp_path / "calls", P.RuleGenerator(default="second run"))
    got = [r.reply.text for r in log.replies(asked, "s", F.col("prompt"), made).collect()]
    assert len(made.calls()) == 12 - kept and got.count("first run") == kept and got.count("second run") == 12 - kept


class Batches:
    """A service of batches: done at the second look; requests that name a fault fail, and those of a batch that holds "never" are never done."""

    name = "batches"

    def __init__(self):
        self.held, self.looks = {}, {}

    def submit(self, requests):
        self.held[len(self.held)] = requests
        return len(self.held) - 1

    def done(self, handle):
        self.looks[handle] = self.looks.get(handle, 0) + 1
        return self.looks[handle] > 1 and not any("never" in p for _, _, p, _ in self.held[handle])

    def results(self, handle):
        return {k: ValueError("x") if "fault" in p else (f"reply to {p}", 1, 2) for k, _, p, _ in reversed(self.held[handle]) if "lost" not in p}


def test_batches_are_polled_until_a_timeout(spark, tmp_path):
    asked = spark.createDataFrame([(str(i), f"p{i}") for i in range(5)] + [("f", "fault"), ("l", "lost"), ("1", "p1")], "custom_id string, prompt string")
    log = ReplyLog(spark, str(tmp_path / "log"))
    got = dict(rows(replies.batch_replies(asked, "s", Batches(), log=log, poll=0.01), "custom_id", "text"))
    assert got == {str(i): f"reply to p{i}" for i in range(5)} | {"f": "", "l": ""}
    assert {r.error for r in log.read().collect()} == {None, "ValueError", "LookupError"}
    late = log.replies(spark.createDataFrame([("n", "never")], "custom_id string, prompt string"), "s", F.col("prompt"), Batches(), poll=0.01, timeout=0.05)
    assert late.first().reply.error == "TimeoutError"


QUESTIONS = [(i, f"question {i}") for i in range(30)]


def test_multi_hop_asks_once_a_step(spark, tmp_path):
    texts = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "chunk_id string, text string")
    searches = tmp_path / "searches"
    searches.write_text("")
    retrieve = lambda q, k: q.select("query_id", F.lit("a").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    asked = spark.createDataFrame(QUESTIONS[:3], "query_id long, query string")
    made = Counting(tmp_path / "calls", P.RuleGenerator(default="ENOUGH"))
    lists, trace = answer.multi_hop(asked, retrieve, texts, made)
    assert lists.count() == trace.count() == 3 and len(made.calls()) == 3
    made = Counting(tmp_path / "more", P.RuleGenerator(("question 1", "SEARCH: beta"), default="ENOUGH"))
    lists, trace = answer.multi_hop(asked, retrieve, texts, made)
    assert lists.count() == trace.count() == 3 and len(made.calls()) == 4
    moody = Moody("ENOUGH", "SEARCH: beta", "SEARCH: gamma")
    _, trace = answer.multi_hop(spark.createDataFrame(QUESTIONS, "query_id long, query string"), retrieve, texts, moody)
    assert rows(trace, "query_id") == [(i,) for i, _ in QUESTIONS]


def test_graded_answers_of_a_moody_grader(spark, tmp_path):
    """One row a question, whose answer fits its verdict, and one call a step."""
    asked = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    retrieve = lambda q, k: q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")).select("query_id", F.concat(F.lit("c"), F.col("rank").cast("string")).alias("chunk_id"), (1 / F.col("rank")).alias("score"), "rank")
    passages = lambda x: x.withColumn("text", F.concat(F.lit("text "), F.col("query_id").cast("string"), F.lit(" "), F.col("chunk_id"))).withColumn("doc_id", F.col("chunk_id")).withColumn("title", F.lit(""))
    grader = Moody(*(f'{{"verdict": "{v}", "confidence": 0.5}}' for v in ("correct", "ambiguous", "incorrect")))
    counted = Counting(tmp_path / "grades", grader)
    made = Counting(tmp_path / "answers", P.RuleGenerator(default="said"))
    out = answer.corrected(asked, retrieve, passages, made, counted, 2)
    for _ in range(2):  # read twice, it says the same
        got = out.collect()
        assert sorted(r.query_id for r in got) == [i for i, _ in QUESTIONS] and len({r.verdict for r in got}) == 3
        for r in got:
            assert (r.answer == answer.REFUSAL) == (r.verdict == "incorrect") and r.widened == (r.verdict == "ambiguous")
            assert r.n_contexts == (6 if r.verdict == "ambiguous" else 2)
    assert len(counted.calls()) == 30 and len(made.calls()) == sum(r.verdict != "incorrect" for r in got)


def test_routes_variants_and_contexts_are_asked_once(spark, tmp_path):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    branch = lambda name: lambda q: q.select("query_id", F.lit(name).alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    made = Counting(tmp_path / "routes", Moody("LEXICAL", "no"))
    got = R.llm_routed(asked, branch("l"), branch("s"), made).collect()
    assert sorted(r.query_id for r in got) == [i for i, _ in QUESTIONS] and all((r.route == 1.0) == (r.chunk_id == "l") for r in got) and len(made.calls()) == 30
    made = Counting(tmp_path / "variants", Moody("other words", "more words"))
    lists = transform.transformed(asked, lambda q, k: q.select("query_id", F.col("query").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")), transform.rewrite, made)
    assert lists.count() == 60 and len(made.calls()) == 30
    docs = spark.createDataFrame([("a", "whole text")], "doc_id string, text string")
    chunks = spark.createDataFrame([(f"a::{i}", "a", f"part {i}") for i in range(5)], "chunk_id string, doc_id string, text string")
    made = Counting(tmp_path / "contexts", Moody("one", "two", "three"))
    out, new = chunk.contextualised(chunks, docs, spark.createDataFrame([], "key string, context string"), made)
    assert sorted(c for (c,) in rows(out, "context")) == sorted(c for (c,) in rows(new, "context")) and len(made.calls()) == 5
