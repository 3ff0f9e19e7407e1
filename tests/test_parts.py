"""Chunker rules, stores, providers, answers, streams and the pipeline against hand-made or brute-force values."""

import json
import os
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankloom import cli, providers as P
from rankloom.functions import text as X
from rankloom.operators import answer, chunk, context, evaluation, graph, metrics, retrieve as R, transform
from rankloom.pipeline import Options, Pipeline, pipeline_at
from rankloom.session import Settings, check_request
from rankloom.sources import store
from rankloom.streaming import ingest as stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file

DOCS = [
    ("a.md", "# Alpha\n\nThe alpha service reads MAX_RETRIES from its settings. It fails with status 75 when locked.\n\n## Limits\n\nAt most ten workers run."),
    ("b.md", "# Beta\n\nThe beta index holds vectors. `max_retries` is not used here.\n\nVector Search finds neighbours of a question."),
    ("c.md", "# Gamma\n\nNothing else matters in gamma. Vector Search and MAX_RETRIES meet here."),
]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in [*DOCS, ("README.md", "skip me"), ("empty.md", "  "), ("x.csv", "no")]:
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def pipe(spark, corpus, tmp_path_factory):
    p = Pipeline(spark, str(tmp_path_factory.mktemp("tables")), Settings(chunk_size=80, overlap=10))
    p.stats = p.ingest(store.load_documents(spark, corpus))
    return p


class Counting:
    """Another generator, with each call written down; for local sessions."""

    def __init__(self, path, inner):
        self.path, self.inner, self.name = path, inner, "counting"

    def generate(self, system, prompt, max_tokens=1024):
        with open(self.path, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        return self.inner.generate(system, prompt, max_tokens)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_load_documents(spark, corpus, tmp_path):
    got = {r.doc_id: r for r in store.load_documents(spark, corpus).collect()}
    assert sorted(got) == ["a.md", "b.md", "c.md"] and got["a.md"].title == "Alpha" and len(got["a.md"].content_sha) == 16
    for name in ("my docs", "c++", "a%20b", "x{y}[z]*", "docs/in docs"):  # names that are patterns, or need encoding
        folder = tmp_path / "odd" / name / "sub dir"
        folder.mkdir(parents=True)
        (folder / "é 100%+1.txt").write_text("y")
        (folder.parent / "one two.md").write_text("# T")
        assert rows(store.load_documents(spark, str(tmp_path / "odd" / name)), "doc_id", "title") == [("one two.md", "T"), ("sub dir/é 100%+1.txt", "é 100%+1")]
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "only.md").write_text(" ")
    for gone in ("blank", "nowhere"):
        with pytest.raises(FileNotFoundError):
            store.load_documents(spark, str(tmp_path / gone))


CUT_DOCS = [t for _, t in DOCS] + ["aaaa bbbbbbbbbbbbbb\n\ncc", "x" * 100, "one. two. three! four? five; six, seven eight", "# A\n# B\n\ntext\n\n## end", "", "  \n\n ", "\n\nlead and more words here to split\n\n" + "word " * 60, "é ü 😀 " * 30]


def separated(text, a, b, size):
    """Whether nothing but separators lies between two places."""
    return all(text[i : i + 2] in (". ", "? ", "! ", "; ", ", ") or text[i - 1 : i + 1] in (". ", "? ", "! ", "; ", ", ") or text[i].isspace() for i in range(a, b))


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (40, 8), (90, 20), (512, 64)])
def test_recursive_chunker_keeps_its_rules(spark, size, overlap):
    """The rules one by one, on the offsets: bodies are whole, in order, short enough and as long as they can be; only separators lie between; tails are the last words before."""
    texts = CUT_DOCS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string")
    got = {}
    for r in chunk.recursive(docs, size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
        assert r.chunk_id == f"{r.doc_id}::{r.chunk_index:04d}" and r.end_char == r.start_char + len(r.text)
    assert set(got) == {i for i, t in enumerate(texts) if t.strip()}
    for i, found in got.items():
        text, at, before = texts[i], 0, None
        bodies = []
        for r, (a, b) in zip(found, chunk.spans(text, size, X.SEPARATORS), strict=True):
            body = text[a:b].strip()
            tail = ""
            if before is not None and overlap:
                tail = before[-overlap:] if len(before) <= overlap else (before[-overlap:].split(" ", 1)[1] if " " in before[-overlap:] else before[-overlap:])
                tail = tail.strip()
            start = text.index(body, a)
            assert r.text == (f"{tail} {body}" if tail else body) and r.start_char == (max(0, start - len(tail) - 1) if tail else start)
            assert b - a <= size and separated(text, at, a, size)
            at, before = b, body
            bodies.append((a, b))
        assert separated(text, at, len(text), size)
        if len(text) <= size:
            assert bodies == [(0, len(text))]
        for (a, b), (c, d) in zip(bodies, bodies[1:]):  # two neighbours do not fit into one, unless a longer unit parts them
            if d - a <= size:
                assert any(len(u) > size for sep in X.SEPARATORS[:-1] for u in text.split(sep) if text[a:b].strip() in u or text[c:d].strip() in u)


def test_recursive_chunker_by_hand(spark):
    """Worked examples: what is written here is what a reader of the rules expects."""
    cases = {
        ("aaaa bbbbbbbbbbbbbb\n\ncc", 10, 0): [("aaaa", 0), ("bbbbbbbbbb", 5), ("bbbb", 15), ("cc", 21)],
        ("# A\n# B\n\ntext that goes on\n\n## end", 20, 0): [("# A\n# B", 0), ("text that goes on", 9), ("## end", 28)],
        ("## Head\n\nbody one\n\nbody two", 20, 0): [("## Head\n\nbody one", 0), ("body two", 19)],
        ("one two. three four. five six", 21, 6): [("one two. three four", 0), ("four five six", 16)],
        ("short\n\nshort too", 30, 5): [("short\n\nshort too", 0)],
        ("a\n\n\n\nb b b b b", 9, 0): [("a", 0), ("b b b b b", 5)],
    }
    for (text, size, overlap), want in cases.items():
        got = chunk.recursive(spark.createDataFrame([(1, text)], "doc_id long, text string"), size, overlap).orderBy("chunk_index").collect()
        assert [(r.text, r.start_char) for r in got] == want, (text, [(r.text, r.start_char) for r in got])


def test_chunker_helpers(spark):
    assert chunk.tail_words("hello big world", 8) == "world" and chunk.tail_words("short", 9) == "short" and chunk.tail_words("unbroken", 3) == "ken" and chunk.tail_words("x", 0) == ""
    assert chunk.is_heading(" ## Two ") and not chunk.is_heading("plain") and not chunk.is_heading("# a\nb")
    assert chunk.plan_name("recursive") == "recursive(512/64)"
    with pytest.raises(ValueError):
        chunk.plan_name("fixed", 5, 5)
    docs = spark.createDataFrame([(1, "a" * 300 + "\n\n" + "b" * 200 + "\n\n" + "c" * 300 + "\n\n" + "d" * 700)], "doc_id long, text string")
    assert [len(r.text) for r in chunk.merged_paragraphs(docs).orderBy("chunk_index").collect()] == [502, 300, 700]
    even = spark.createDataFrame([(1, "a" * 300 + "\n\n" + "b" * 300 + "\n\n\n\nc")], "doc_id long, text string")
    assert [len(r.text) for r in chunk.merged_paragraphs(even).orderBy("chunk_index").collect()] == [602, 1] and chunk.merged_paragraphs(even.filter("false")).count() == 0  # the blank line does not count
    assert rows(chunk.paragraphs(docs, 250), "paragraph") == [(0,), (2,), (3,)]
    assert chunk.outside(spark.createDataFrame([("a",), ("z",)], "doc_id string"), spark.createDataFrame([("a",)], "doc_id string")).collect()[0][0] == "z"


def test_text_functions(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    assert value(X.tolerant_json(F.lit('no {bad} but {"a": "x"} then {"a": "y"}'), "a")) == "x"
    assert value(X.tolerant_json(F.lit('```json\n{"a": 2}\n```'), "a")) == "2" and value(X.tolerant_json(F.lit("[1]"), "a")) is None
    assert value(X.tolerant_list(F.lit('so: ["One", "Two"] end'))) == ["One", "Two"] and value(X.tolerant_list(F.lit("none"))) is None
    assert value(X.common_prefix(F.lit("abcdef"), F.lit("abcxyz"))) == "abc" and value(X.common_prefix(F.lit("a"), F.lit("b"))) == ""
    assert value(X.unstopped(F.lit("The indexing of queries"))) == ["indexing", "queries"]
    assert value(answer.follow_up(F.lit('x\nsearch: "the missing part"\nthanks'))) == "the missing part" and value(answer.follow_up(F.lit("ENOUGH"))) is None


def test_entities_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat("text", F.lit(" See `max_retries`, MAX_RETRIES, TX-12, The End, The Name and The Name; BM25 Vector Search the End")).alias("text"))

    def one(text):
        out = []
        for p, g in X.ENTITIES:
            for m in re.finditer(p, text):
                e = " ".join(re.sub(r"^[`.,;:()\[\]]+|[`.,;:()\[\]]+$", "", m[g].strip()).split())
                w = e.lower().split(" ")
                if 3 <= len(e) <= 60 and w[0] not in X.STOP_ENTITIES and w[-1] not in X.STOP_ENTITIES and not (len(w) == 2 and w[0] == w[1]) and e.lower() not in [x.lower() for x in out]:
                    out.append(e)
        return out[:12]

    got = docs.select("text", X.entities(F.col("text")).alias("e")).collect()
    assert all(r.e == one(r.text) for r in got)


def test_windows_against_brute_force(spark):
    def snap(text, at, forward, reach=200):
        if at <= 0:
            return 0
        if at >= len(text):
            return len(text)
        for m in ("\n\n", ". ", "\n"):
            i = text.find(m, at, at + reach) if forward else text.rfind(m, max(0, at - reach), at)
            if i >= 0:
                return i + len(m)
        return at

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 300").select("doc_id", "text")
    hits = docs.select((F.col("doc_id") % 7).alias("query_id"), F.row_number().over(R.Window.partitionBy(F.col("doc_id") % 7).orderBy("doc_id")).alias("rank"), F.lit(1.0).alias("score"), "doc_id", (F.col("doc_id") % 200).cast("int").alias("start_char"), (F.col("doc_id") % 200 + 80).cast("int").alias("end_char"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = context.windows(hits, docs, 50).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert (r.from_char, r.to_char) == (snap(t, r.start_char - 50, False), snap(t, min(r.end_char, len(t)) + 50, True))


def test_vector_tables(spark, tmp_path):
    path = str(tmp_path / "v")
    t = store.get_store(spark, "plain", path, 2)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    assert t.count() == 0 and t.get(asked.select(F.lit("x").alias("chunk_id"))) is None and t.search(asked).count() == 0
    t.add(spark.createDataFrame([("1", [1.0, 0.0], "d"), ("2", [0.0, 1.0], "e"), ("1", [1.0, 0.0], "d")], "chunk_id string, embedding array<double>, doc_id string"))
    t.add(spark.createDataFrame([("2", [0.6, 0.8], "f")], "chunk_id string, embedding array<double>, doc_id string"))
    again = store.VectorTable(spark, path)
    assert again.count() == 2 and rows(again.search(asked), "chunk_id", "rank") == [("1", 1), ("2", 2)] and rows(again.search(asked, 5, F.col("doc_id") == "f"), "chunk_id") == [("2",)]
    assert rows(again.get(spark.createDataFrame([("2",), ("2",), ("9",)], "chunk_id string")), "doc_id") == [("f",)]
    t.reset()
    assert again.count() == 0
    t.add(spark.createDataFrame([("3", [0.0, 1.0], "d")], "chunk_id string, embedding array<double>, doc_id string"))
    assert again.count() == 1
    (tmp_path / "v" / "rows" / "lost").mkdir()  # a write that failed
    assert again.count() == 1
    with pytest.raises(Exception, match="wrong dimension"):
        t.add(spark.createDataFrame([("4", [1.0], "d")], "chunk_id string, embedding array<double>, doc_id string"))
    with pytest.raises(ValueError, match="plain"):
        store.get_store(spark, "other", path)
    with pytest.raises(ValueError):
        store.get_store(spark, "partitioned", path)
    p = store.get_store(spark, "partitioned", str(tmp_path / "p"), 2)
    p.add(spark.createDataFrame([("1", [1.0, 0.0], "d"), ("2", [0.0, 1.0], "e"), ("3", [0.6, 0.8], "f")], "chunk_id string, embedding array<double>, doc_id string"))
    found = p.search_within(asked, spark.createDataFrame([("e",)], "doc_id string"))
    assert rows(found, "chunk_id") == [("2",)] and "PartitionFilters: [isnotnull(_bucket" in found._jdf.queryExecution().toString()
    t.remove(spark.createDataFrame([("d",)], "doc_id string"))
    assert again.count() == 0


def test_lexical_index(spark, tmp_path):
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(DOCS)] + [(9, "")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "vector search"), (2, "max_retries"), (3, " ")], "query_id long, query string")
    index = store.Bm25Table(spark, str(tmp_path / "i"))
    assert not index.load()
    index.build(texts)
    assert store.Bm25Table(spark, index.path).load() and index.name == "bm25"
    plain = store.Bm25Table(spark, str(tmp_path / "p"), X.unstopped)
    plain.build(texts)
    assert rows(plain.search(asked, 3), "query_id", "chunk_id", "rank") == rows(R.bm25(asked, texts, 3, words=X.unstopped), "query_id", "chunk_id", "rank")
    got = rows(index.search(asked, 3), "query_id", "chunk_id", "rank")
    assert {q for q, *_ in got} == {1, 2} and {c for q, c, _ in got if q == 2} == {0, 1, 2}
    spark.createDataFrame([(1,)], "other int").write.mode("overwrite").parquet(f"{index.path}/terms")
    assert not index.load()
    with pytest.raises(ValueError):
        index.build(texts.limit(0))


def test_sinks(spark, tmp_path):
    md = tmp_path / "r.md"
    md.write_text("# Results\n| a |\n|-|\n| no runs yet |\nend")
    store.append_row(str(md), store.report_row("x", {"recall_at_1": 0.5, "mrr": float("nan"), "cost_usd": 0.01}, True), "|-|")
    assert md.read_text().split("\n")[3] == "| x | 0.500 | - | - | - | - | $0.0100 | ⚠️ ceiling |" and "no runs yet" not in md.read_text()
    with pytest.raises(ValueError):
        store.append_row(str(md), "r", "no such marker")
    name = store.write_run(spark.createDataFrame([(1, 0.5)], "query_id long, mrr double"), str(tmp_path / "runs"), "Hybrid + Rerank (n=10)!", {"k": 5}, 0)
    assert name == "19700101-000000-hybrid-rerank-n-10" and spark.read.json(str(tmp_path / "runs")).first()["config"] == '{"k": 5}'
    cache = store.PrefixCache(spark, str(tmp_path / "cache"))
    cache.append(spark.createDataFrame([("k", "c")], "key string, context string"))
    os.makedirs(tmp_path / "cache" / "broken")
    (tmp_path / "cache" / "broken" / "part-0.parquet").write_text("not parquet")
    assert rows(cache.read(), "key") == [("k",)]
    one = spark.createDataFrame([(1, 0.1234567)], "q int, s double").select(store.response(F.create_map(F.lit("dense"), F.col("s"))).alias("j")).first()["j"]
    assert json.loads(one) == {"dense": 0.123457}


def test_providers(spark):
    e = P.SignedHashEmbedder(5)
    df = spark.createDataFrame([(1, "Some Text, some more"), (2, None), (3, "some TEXT some more"), (4, "\u00e9t\u00e9 9")], "id long, text string")
    got = {r.id: r for r in P.embedded(df, F.col("text"), e).withColumn("same", P.hash_vector(F.coalesce("text", F.lit("")), 5)).collect()}
    assert got[1].embedding == e.embed_query("some text some more") == got[3].embedding and all(abs(a - b) < 1e-12 for r in got.values() for a, b in zip(r.embedding, r.same, strict=True))
    assert got[2].embedding == [0.0] * 5 and abs(sum(x * x for x in got[4].embedding) - 1) < 1e-12
    wide = P.SignedHashEmbedder(256)
    near = lambda a, b: sum(x * y for x, y in zip(wide.embed_query(a), wide.embed_query(b), strict=True))
    assert near("cache settings of the server", "server cache settings") > 0.7 > 0.3 > abs(near("cache settings of the server", "mountain light in winter"))
    assert isinstance(e, P.Embedder) and isinstance(P.RareWordReranker(), P.Reranker) and isinstance(P.QuotingGenerator(), P.Generator)
    quoted = P.QuotingGenerator().generate("s", "Context passages:\n\n[1] A (a)\nnothing here\n\n[2] B (b)\nfirst line\nthe limit is ten\n\nQuestion: What is the limit?\n\nAnswer:")
    assert quoted[0] == "the limit is ten [2]" and P.QuotingGenerator().generate("s", "Question: x")[0].startswith("Nothing")
    replies = P.generated(df, "s", F.col("text"), P.RuleGenerator(("Some", "yes"), ("some", ValueError("x")))).select("id", "reply.*").collect()
    assert {r.id: (r.text, r.error) for r in replies} == {1: ("yes", None), 2: ("", None), 3: (None, "ValueError"), 4: ("", None)}
    short = spark.createDataFrame([(1, "a b", "a x"), (2, "a b", "b a"), (3, "", "z")], "id long, q string, t string")
    assert rows(P.rescored(short, F.col("q"), F.col("t"), P.RareWordReranker()), "id", "other") == [(1, 0.5), (2, 1.0), (3, 0.0)]
    assert P.RareWordReranker({"rare": 3.0, "the": 1.0}).scores("the rare", ["rare", "the", ""]) == [0.75, 0.25, 0.0]
    scripted = P.ScriptedGenerator("one", "two")
    assert [scripted.generate("s", "p")[0] for _ in range(3)] == ["one", "two", "two"] and len(scripted.calls) == 3
    with pytest.raises(ValueError, match="test embedder"):
        P.provider("nowhere", "embedder")
    P.register("mine", "generator", lambda: P.RuleGenerator(default="hi"))
    assert P.provider("mine", "cheap").generate("", "")[0] == "hi"
    with pytest.raises(ValueError, match="A_KEY, B_KEY"):
        P.require_keys("A_KEY", "B_KEY", env={"C": "1"})


def test_contexts_are_made_once(spark):
    docs = spark.createDataFrame([("a", "whole text")], "doc_id string, text string")
    chunks = spark.createDataFrame([("a::0", "a", "whole"), ("z::0", "z", "lost")], "chunk_id string, doc_id string, text string")
    cache = spark.createDataFrame([], "key string, context string")
    out, new = chunk.contextualised(chunks, docs, cache, P.RuleGenerator(default="  It\nstands  first. "))
    assert rows(out, "chunk_id", "context") == [("a::0", "It stands first.")]
    again, none = chunk.contextualised(chunks, docs, new, P.RuleGenerator(("", ValueError("not asked"))))
    assert none.count() == 0 and rows(again, "context") == [("It stands first.",)]
    failed, _ = chunk.contextualised(chunks, docs, cache, P.RuleGenerator(("Passage", ValueError("down"))))
    assert rows(failed, "context") == [(None,)]


def test_transforms(spark):
    asked = spark.createDataFrame([(1, "why is it slow"), (2, "what is MAX_RETRIES")], "query_id long, query string")
    made = P.RuleGenerator((transform.REWRITE, '"WHY IS IT SLOW"'), (transform.MULTI, "Queries:\n1. first variant here\n- second variant here\nshort\n3) third variant here\n4. fourth variant here"), (transform.HYDE, " A passage. "), (transform.BACK, ""))
    get = lambda name: {r.query_id: r.variants for r in transform.transform_named(name)(asked, made).collect()}
    assert get("identity")[1] == ["why is it slow"] and get("rewrite")[1] == ["why is it slow"] and len(get("rewrite")[2]) == 2
    assert get("multiquery")[1] == ["why is it slow", "first variant here", "second variant here", "third variant here"]
    assert get("hyde")[1] == ["why is it slow", "A passage."] and get("stepback")[2] == ["what is MAX_RETRIES"]
    assert get("routed_rewrite")[2] == ["what is MAX_RETRIES"]
    with pytest.raises(ValueError, match="identity"):
        transform.transform_named("none")


def test_routers(spark):
    asked = spark.createDataFrame([(1, "status 75"), (2, "why so slow")], "query_id long, query string")
    branch = lambda score: lambda q: q.select("query_id", F.lit("c").alias("chunk_id"), F.lit(score).alias("score"), F.lit(1).alias("rank"))
    assert rows(R.routed(asked, branch(1.0), branch(2.0)), "query_id", "route", "score") == [(1, 1.0, 1.0), (2, 0.0, 2.0)]
    model = P.RuleGenerator(("slow", "lexical, I think"), ("75", ValueError("down")))
    assert rows(R.llm_routed(asked, branch(1.0), branch(2.0), model), "query_id", "route") == [(1, 0.0), (2, 1.0)]


def test_grader_and_judge_fail_open(spark):
    asked = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "query_id long, query string")
    passages = spark.createDataFrame([(1, 1, "p"), (2, 1, "p"), (3, 1, "p")], "query_id long, rank int, text string")
    model = P.RuleGenerator(("one", 'ok {"verdict": " Ambiguous ", "confidence": 7}'), ("two", "none"), ("three", OSError("x")))
    got = {r.query_id: tuple(r)[1:] for r in answer.graded(asked, passages, model).select("query_id", "verdict", "confidence", "reason").collect()}
    assert got == {1: ("ambiguous", 1.0, ""), 2: ("correct", 0.0, "grader returned unparseable output"), 3: ("correct", 0.0, "grader unavailable: OSError"), 4: ("incorrect", 1.0, "nothing retrieved")}
    judged = spark.createDataFrame([(1, "q", "a", "c"), (2, "q", "b", "c")], "query_id long, query string, answer string, context string")
    model = P.RuleGenerator(("Answer:\na", '{"groundedness": 1.5, "relevance": "x"}'))
    assert rows(answer.model_judged(judged, model).filter("query_id = 1"), "groundedness", "relevance") == [(1.0, None)]
    assert rows(answer.model_judged(judged, model).filter("query_id = 2"), "groundedness") == [(None,)]


def test_entities_by_a_model(spark):
    chunks = spark.createDataFrame([("1", "uses `max_retries`"), ("2", "uses `max_retries`"), ("3", "plain")], "chunk_id string, text string")
    chunks = chunks.withColumn("text", F.concat("text", F.lit(" in "), "chunk_id"))
    model = P.RuleGenerator(("in 1", '["Vector  Search", "the end", "ab", "Cache Key"]'), ("in 2", ValueError("x")), default="nothing")
    assert {r.chunk_id: r.entities for r in answer.extracted(chunks, model).collect()} == {"1": ["Vector Search", "Cache Key"], "2": ["max_retries"], "3": []}


def test_multi_hop_stops(spark):
    texts = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("g", "gamma")], "chunk_id string, text string")
    retrieve = lambda q, k: q.join(texts, F.contains(F.col("query"), F.col("text"))).select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "query_id long, query string")
    model = P.RuleGenerator(("Question: alpha\n\nSo far:\n- alpha\n\n", "SEARCH: beta"), ("Question: alpha", "SEARCH: gamma"), ("Question: beta", "search: BETA"), default="ENOUGH")
    lists, trace = answer.multi_hop(asked, retrieve, texts, model)
    assert rows(lists, "query_id", "chunk_id") == [(1, "a"), (1, "b"), (1, "g"), (2, "b"), (3, "g")]
    assert rows(trace, "query_id", "hops", "stopped_because") == [(1, 3, "hop limit reached"), (2, 1, "follow-up repeated an earlier query"), (3, 1, "model said enough")]


def test_gate_and_prompt(spark):
    asked = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "query_id long, query string")
    lists = spark.createDataFrame([(1, -4.0, 0.7), (1, 9.0, None), (2, 9.0, 0.5)], "query_id long, score double, dense double")
    assert rows(context.gate(lists, asked), "query_id", "best_score", "abstain") == [(1, 0.7, False), (2, 0.5, True), (3, 0.0, True)]
    p = spark.createDataFrame([(1, 1, "", "d", "text", "ctx"), (1, 2, "T", "e", "more", "")], "query_id long, rank int, title string, doc_id string, text string, context string")
    got = {r.query_id: r.prompt for r in context.prompts(asked, context.blocks(p)).collect()}
    assert got[1] == "Context passages:\n\n[1] d (d)\nctx\ntext\n\n[2] T (e)\nmore\n\nQuestion: q1\n\nAnswer:" and got[2].startswith("No context passages were retrieved.\n\nQuestion: q2")


def test_dense_keeps_equal_ids_and_string_ids(spark):
    v = spark.createDataFrame([("1", [1.0, 0.0]), ("x::0001", [0.9999999, 0.0]), ("y", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    assert [r.chunk_id for r in R.dense(q, v).orderBy("rank").collect()] == ["1", "y", "x::0001"]  # closer than 1e-6, and still by score
    assert len(R.blocks_of(q)) == 1 and len(R.blocks_of(q, 10)) > 1 and sum(b.count() for b in R.blocks_of(q, 10)) == 1


def test_more_metrics(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "query_id string, first_rank int")
    other = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "query_id string, first_rank int")
    assert rows(metrics.moved(runs, other), "query_id") == [("b",), ("c",)]
    means = metrics.generation_means(spark.createDataFrame([(1.0, 0.5, None), (0.0, 0.5, 1.0)], "groundedness double, relevance double, correct_refusal double")).first()
    assert tuple(means) == (2, 0.5, 0.5, 1.0)
    g = graph.seeds(spark.createDataFrame([(1, "How does Vector Search work?"), (2, "no")], "query_id long, query string"), spark.createDataFrame([("vector search",), ("Other",)], "entity string"))
    assert rows(g, "query_id", "entity") == [(1, "vector search")]
    assert rows(graph.frequencies(spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "chunk_id int, entity string"), 1), "entity", "n") == [("a", 2)]


def test_pipeline_end_to_end(spark, pipe):
    assert pipe.stats["documents"] == 3 and pipe.stats["chunks"] == pipe.count() > 3 and pipe.stats["chunker"] == "recursive(80/10)"
    asked = spark.createDataFrame([(1, "MAX_RETRIES settings"), (2, "vector search neighbours")], "query_id long, query string")
    for name in ("dense", "bm25", "hybrid", "rerank", "router", "parent", "graph"):
        pipe.set_strategy(name)
        lists = pipe.retrieve(asked, 3)
        assert lists.columns == ["query_id", "chunk_id", "score", "rank", "scores"] and lists.count() > 0
        passages = pipe.passages(lists)
        docs = {d: t for d, t in DOCS}
        assert passages.count() > 0
        if name == "parent":
            assert all(docs[r.doc_id][r.start_char : r.end_char] == r.text for r in passages.collect())
    pipe.set_strategy("bm25")
    assert pipe.retrieve(asked, 1).filter("query_id = 1").join(pipe.table("chunks"), "chunk_id").first()["doc_id"] in ("a.md", "c.md")
    answers = {r.query_id: r for r in pipe.ask(asked).collect()}
    assert answers[1].answer.endswith("]") and not answers[1].refused
    assert pipe.health()["chunks"] == pipe.count() and json.loads(pipe.retrieve_response(asked, 2).first()["results"])[0]["rank"] == 1
    gated = Pipeline(spark, pipe.path, Settings(strategy="dense", score_floor=1.5))
    assert {(r.abstained, r.refused, r.output_tokens, r.n_contexts) for r in gated.ask(asked).collect()} == {(True, True, 0, 5)}
    fused = Pipeline(spark, pipe.path, Settings(strategy="bm25"), Options(transform="stepback")).retrieve(asked, 3)
    assert fused.columns == ["query_id", "chunk_id", "score", "rank", "scores"] and fused.count() > 0
    assert pipeline_at(pipe.path) is pipeline_at(pipe.path)
    with pytest.raises(ValueError, match="hybrid"):
        pipe.set_strategy("none")


def test_pipeline_filters_scores_and_gate(spark, pipe):
    """A condition on the chunks holds for every strategy before anything is ranked; lists say where their scores come from; a floor for cosines works on fused and reranked lists."""
    asked = spark.createDataFrame([(1, "MAX_RETRIES settings of the alpha service"), (2, "?!")], "query_id long, query string")
    of = pipe.table("chunks").select("chunk_id", "doc_id")
    want = {"dense": {"dense"}, "bm25": {"bm25"}, "hybrid": {"dense", "bm25", "rrf"}, "rerank": {"dense", "bm25", "rrf", "rerank"}, "router": {"bm25", "rerank"}, "parent": {"dense", "bm25", "rrf"}, "graph": {"graph"}}
    for name, origins in want.items():
        pipe.set_strategy(name)
        got = pipe.retrieve(asked, 3, F.col("doc_id") != "a.md").join(of, "chunk_id").collect()
        assert got and {r.doc_id for r in got} <= {"b.md", "c.md"}, name
        for r in pipe.retrieve(asked.filter("query_id = 1"), 3).collect():
            assert set(r.scores) <= origins | {"dense", "bm25"} and any(abs(r.score - v) < 1e-12 for v in r.scores.values()), name
    for name in ("hybrid", "rerank", "parent"):
        gated = Pipeline(spark, pipe.path, Settings(strategy=name, score_floor=0.3))
        assert rows(gated.ask(asked), "query_id", "abstained") == [(1, False), (2, True)], name
    pipe.set_strategy("hybrid")
    shown = json.loads(pipe.retrieve_response(asked.filter("query_id = 1"), 2).first()["results"])
    assert set(shown[0]["scores"]) >= {"rrf"} and [x["rank"] for x in shown] == [1, 2]


def test_contextual_pipeline(spark, corpus, tmp_path):
    """Chunks get their contexts when they are ingested, each is asked for once, also over two ingests, and searches find words of the contexts only."""
    calls = str(tmp_path / "calls")
    open(calls, "w").close()
    P.register("situated", "embedder", P.SignedHashEmbedder)
    P.register("situated", "reranker", P.RareWordReranker)
    P.register("situated", "generator", lambda: Counting(calls, P.RuleGenerator(("Passage:\n# Beta", "Situated in the zebra handbook."), default="Elsewhere.")))
    p = Pipeline(spark, str(tmp_path / "t"), Settings(chunk_size=80, overlap=10, strategy="bm25"), Options(profile="situated", contextual=True))
    docs = store.load_documents(spark, corpus)
    first = p.ingest(docs)
    asked = spark.createDataFrame([(1, "zebra handbook")], "query_id long, query string")
    found = p.passages(p.retrieve(asked, 3)).collect()
    assert [r.doc_id for r in found] == ["b.md"] and found[0].context == "Situated in the zebra handbook." and "zebra" not in found[0].text
    with open(calls) as f:
        n = len(f.read().splitlines())
    assert n == first["chunks"]
    p.ingest(docs)
    with open(calls) as f:
        assert len(f.read().splitlines()) == n
    p.set_strategy("rerank")
    assert p.retrieve(asked, 1).join(p.table("chunks"), "chunk_id").first()["doc_id"] == "b.md"  # the reranker reads contexts too


def test_evaluation_of_a_pipeline(spark, pipe):
    golden = spark.createDataFrame([("q1", "alpha service settings", ["a.md"], "lookup"), ("q2", "vector search", ["b.md", "c.md"], "multi"), ("q3", "quarterly taxes", [], "unanswerable")], "id string, question string, relevant array<string>, kind string")
    docs = pipe.table("documents")
    cells = evaluation.evaluate(pipe, golden, docs, ["bm25", "hybrid"], [1, 3], [None, 0.3])
    at = {(r.run, r.depth, r.floor, r.kind): r for r in cells.collect()}
    assert len(at) == 2 * 2 * 2 * 4 and at["bm25", 3, None, "lookup"].recall == 1.0 and at["bm25", 1, None, "multi"].recall == 0.5 and at["bm25", 1, None, "ALL"].n == 3
    assert at["hybrid", 1, None, "ALL"].n_refused == 0 and at["bm25", 1, 0.3, "unanswerable"].correct_refusal == 1.0
    with pytest.raises(ValueError, match="q1: missing document"):
        evaluation.evaluate(pipe, golden.withColumn("relevant", F.when(F.col("id") == "q1", F.array(F.lit("gone.md"))).otherwise(F.col("relevant"))), docs, ["bm25"], [1])
    pipe.set_strategy("hybrid")
    asked = golden.select(F.expr("cast(substring(id, 2) as long)").alias("query_id"), F.col("question").alias("query"))
    frame = evaluation.results_frame(pipe.passages(pipe.retrieve(asked, 2)), ["dense", "bm25"], 20)
    assert frame.columns == ["query_id", "rank", "doc_id", "chunk_id", "score", "dense_score", "bm25_score", "text"] and max(len(r.text) for r in frame.collect()) <= 20


def test_commands(spark, corpus, tmp_path, capsys):
    path = ["--path", str(tmp_path / "t"), "--strategy", "bm25"]
    assert cli.main([*path, "ingest", corpus], spark)["documents"] == 3
    assert cli.main([*path, "search", "beta vectors", "-k", "2"], spark)[0]["doc_id"] == "b.md"
    assert cli.main([*path, "ask", "beta vectors"], spark)["answer"].endswith("]")
    assert cli.main([*path, "status"], spark)["status"] == "ok" and '"status": "ok"' in capsys.readouterr().out
    for question, k in (("", 5), ("x", 26), ("x" * 2001, 5)):
        with pytest.raises(ValueError):
            check_request(question, k)


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "a" * 600, 1, False), (2, "b", 1, False), (3, "c" * 600, 1, False), (None, "x", 1, False)], "doc_id long, text string, at int, deleted boolean")
    docs.write.parquet(source)
    read = spark.readStream.schema(docs.schema).parquet(source)
    run = lambda: stream.ingest(read, out, str(tmp_path / "check"), newest="at", folders=4).awaitTermination()
    run()
    hashes, chunks = stream.tables(spark, out, 4)
    assert rows(chunks.read(), "doc_id", "chunk_index") == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    docs.union(spark.createDataFrame([(1, "short now", 3, False), (1, "older", 2, False), (3, None, 2, True)], docs.schema)).write.mode("append").parquet(source)
    run()
    # the changed document's old chunks are gone, and the deleted document's; what did not change was not written again
    assert rows(chunks.read(), "doc_id", "text") == [(1, "short now"), (2, "b")] and rows(hashes.read(), "doc_id") == [(1,), (2,)]
    new = [p for p in chunks.commit()["parts"] if p["seq"] == chunks.version and p["kind"] == "rows"]
    assert spark.read.parquet(f"{out}/chunks/{new[0]['path']}").count() == 1
    before = (chunks.version, hashes.version)
    stream.write_batch(docs, 1, out, newest="at", folders=4)  # a batch that was committed does nothing when it is run again
    assert (chunks.version, hashes.version) == before
    more = spark.createDataFrame([(9, "z", 1, False)], docs.schema)
    stream.write_batch(more, 2, out, folders=4)
    hashes.reset()  # as if the last batch had been lost between the commits of chunks and hashes
    stream.write_batch(more, 3, out, folders=4)
    assert rows(chunks.read().filter("doc_id = 9"), "text") == [("z",)]


def test_question_stream(spark, pipe, tmp_path):
    """Contexts, tokens, done in order; a failing generator gives an error after the contexts; a batch that is run again asks nothing and writes the same."""
    calls = tmp_path / "calls"
    P.register("counting", "embedder", P.SignedHashEmbedder)
    P.register("counting", "generator", lambda: Counting(str(calls), P.RuleGenerator(("Question: vector", ValueError("down")), default="It is so [1].")))
    asked = spark.createDataFrame([(1, "MAX_RETRIES settings"), (2, "vector search"), (3, "?? !!")], "query_id long, query string")
    served = Pipeline(spark, pipe.path, Settings(strategy="hybrid", score_floor=0.2), Options(profile="counting"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    asked.write.parquet(source)
    read = spark.readStream.schema(asked.schema).parquet(source)
    stream.answering(read, served, out, str(tmp_path / "check")).awaitTermination()
    by = {}
    for r in stream.replay(spark, out).orderBy("query_id", "seq").collect():
        by.setdefault(r.query_id, []).append((r.seq, r.event, json.loads(r.data)))
    assert [e for _, e, _ in by[1]] == ["contexts", "token", "token", "token", "token", "done"] and "".join(d["text"] for _, e, d in by[1] if e == "token") == "It is so [1]."
    assert by[1][0][2][0]["rank"] == 1 and set(by[1][0][2][0]["scores"]) >= {"rrf"}
    assert [(e, d.get("detail")) for _, e, d in by[2][1:]] == [("error", "ValueError")] and [s for s, *_ in by[1]] == list(range(6))
    assert by[3][-1][1:] == ("done", {"abstained": True}) and "".join(d["text"] for _, e, d in by[3] if e == "token") == answer.REFUSAL
    once = calls.read_text().count("\n")
    assert once == 2  # the gate kept the third from the generator
    stream.answer_batch(asked.filter("query_id = 1"), 0, served, out)
    assert calls.read_text().count("\n") == once and rows(stream.replay(spark, out), "seq", "event")[0] == (0, "contexts")
    assert rows(stream.replay(spark, out, spark.createDataFrame([(1, 3)], "query_id long, seq int")), "seq") == [(4,), (5,)]


def test_event_windows_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = stream.event_windows(spark.readStream.schema(schema).parquet(src), late="1 hour").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = stream.event_windows(spark.read.parquet(src))
    shown = F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("w")
    assert rows(spark.table("win"), shown, "event_type", "n") == rows(want, shown, "event_type", "n")
