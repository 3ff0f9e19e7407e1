"""The engine as one object: documents are chunked once, written, and answered from tables.

ingest() writes the chunks, and the vectors and the lexical index are made from what was written; retrieve() and
ask() work on tables of questions and read these tables only.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.text import content_sha, embed_text, entities, looks_like_refusal
from .operators import answer, chunk, context, graph, retrieve as R, transform
from .providers import embedded, provider, rescored
from .session import Settings
from .sources.files import written
from .sources.replies import ReplyLog
from .sources.store import Bm25Table, PrefixCache, get_store, serialised

LIST = ("query_id", "chunk_id", "score", "rank", "scores")
STRATEGIES = ("dense", "bm25", "hybrid", "rerank", "router", "parent", "graph")


@dataclass(frozen=True)
class Options:
    """What a pipeline is made with, apart from its settings. contextual: chunks get a context from the cheap generator when they are ingested; replies are logged below the path, so that an ingest that was lost goes on where it ended. keep_replies: replies are kept below the path, and the same prompt is not asked again by later calls."""

    profile: str = "test"
    store: str = "plain"
    transform: str = "identity"
    strict: bool = False
    contextual: bool = False
    keep_replies: bool = False


class Pipeline:
    """Chunks, vectors, a lexical index and an entity graph below one path."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, options: Options | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings, self.options = settings or Settings(), options or Options()
        self.set_strategy(self.settings.strategy)
        self._made: dict[str, object] = {}

    def provider(self, kind: str):
        """A provider of the profile, made when first asked for."""
        if kind not in self._made:
            self._made[kind] = provider(self.options.profile, kind)
        return self._made[kind]

    def set_strategy(self, name: str) -> None:
        if name not in STRATEGIES:
            raise ValueError(f"unknown strategy {name!r}; there are: {', '.join(STRATEGIES)}")
        self.settings = replace(self.settings, strategy=name)

    @property
    def vectors(self):
        return get_store(self.spark, self.options.store, f"{self.path}/vectors", self.provider("embedder").dimension)

    @property
    def lexical(self) -> Bm25Table:
        return Bm25Table(self.spark, f"{self.path}/bm25")

    @property
    def log(self) -> ReplyLog | None:
        return ReplyLog(self.spark, f"{self.path}/replies") if self.options.keep_replies else None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def ingest(self, docs: DataFrame, recursive: bool = True, reset: bool = True) -> dict:
        """Documents (doc_id, text, maybe title) into chunks, vectors, lexical index and graph, all made from the written chunks. Returns counts."""
        cut = chunk.recursive if recursive else chunk.fixed
        have = docs if "title" in docs.columns else docs.withColumn("title", F.col("doc_id").cast("string"))
        have = have.select(F.col("doc_id").cast("string"), "text", "title").withColumn("content_sha", content_sha(F.col("text")))
        have.write.mode("overwrite").parquet(f"{self.path}/documents")
        rows = cut(self.table("documents").select("doc_id", "text"), self.settings.chunk_size, self.settings.overlap)
        rows = rows.join(self.table("documents").select("doc_id", "title"), "doc_id")
        if self.options.contextual:
            cache, made = PrefixCache(self.spark, f"{self.path}/contexts"), self.provider("cheap")
            rows, new = chunk.contextualised(rows, self.table("documents").select("doc_id", "text"), cache.read(), made, made.name, ReplyLog(self.spark, f"{self.path}/replies"))
            cache.append(new)
            rows = rows.withColumn("context", F.coalesce("context", F.lit("")))
        else:
            rows = rows.withColumn("context", F.lit(""))
        rows.write.mode("overwrite").parquet(f"{self.path}/chunks")
        chunks = self.table("chunks")
        if reset:
            self.vectors.reset()
        self.vectors.add(embedded(chunks, embed_text(F.col("context"), F.col("text")), self.provider("embedder")).select("chunk_id", "doc_id", "embedding"))
        self.lexical.build(chunks)
        mentions = chunks.select("chunk_id", F.explode(entities(F.col("text"))).alias("entity")).select("chunk_id", F.lower("entity").alias("entity"))
        mentions.write.mode("overwrite").parquet(f"{self.path}/mentions")
        graph.edges(self.table("mentions")).write.mode("overwrite").parquet(f"{self.path}/edges")
        return {"documents": self.table("documents").count(), "chunks": chunks.count(), "chunker": chunk.plan_name("recursive" if recursive else "fixed", self.settings.chunk_size, self.settings.overlap)}

    def count(self) -> int:
        return self.vectors.count()

    def _allowed(self, where: Column | None) -> DataFrame | None:
        """The chunks that a condition on the chunks' columns (chunk_id, doc_id, title, text, ...) leaves."""
        return None if where is None else self.table("chunks").filter(where).select("chunk_id")

    def _dense(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        asked = embedded(questions, F.col("query"), self.provider("embedder"), "query", query=True).select("query_id", "query")
        found = self.vectors.search(asked, k, among=self._allowed(where)).select("query_id", "chunk_id", "score", "rank")
        return R.with_origin(found, "dense")

    def _bm25(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        return R.with_origin(self.lexical.search(questions, k, self._allowed(where)).select("query_id", "chunk_id", "score", "rank"), "bm25")

    def _reranked(self, questions: DataFrame, short: DataFrame, k: int) -> DataFrame:
        """By the reranker's score of the question with what was embedded of a chunk, its context before its text."""
        body = self.table("chunks").select("chunk_id", embed_text(F.col("context"), F.col("text")).alias("body"))
        pairs = short.join(questions.select("query_id", "query"), "query_id").join(body, "chunk_id")
        scored = rescored(pairs, F.col("query"), F.col("body"), self.provider("reranker")).select("query_id", "chunk_id", "score", "rank", "scores", "other")
        return R.rerank(scored, F.col("other"), k).select(*LIST)

    def _lists(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        s = self.settings
        deep = max(s.candidates, k)
        if s.strategy == "dense":
            return self._dense(questions, k, where)
        if s.strategy == "bm25":
            return self._bm25(questions, k, where)
        if s.strategy == "graph":
            mentions, allowed = self.table("mentions"), self._allowed(where)
            mentions = mentions if allowed is None else mentions.join(allowed, "chunk_id", "left_semi")
            found = graph.retrieve(questions, self.table("edges"), mentions, k=k, named=self.table("mentions"))
            return R.with_origin(found.select("query_id", "chunk_id", "score", "rank"), "graph")
        both = lambda q, n: R.fuse({"dense": self._dense(q, deep, where), "bm25": self._bm25(q, deep, where)}, n, s.rrf_k).select(*LIST)
        if s.strategy in ("hybrid", "parent"):
            return both(questions, k if s.strategy == "hybrid" else 3 * k)
        if s.strategy == "rerank":
            return self._reranked(questions, both(questions, deep), k)
        return R.routed(questions, lambda q: self._reranked(q, self._bm25(q, deep, where), k), lambda q: self._reranked(q, both(q, deep), k)).select(*LIST)

    def retrieve(self, questions: DataFrame, k: int | None = None, where: Column | None = None) -> DataFrame:
        """Lists of k (query_id, chunk_id, score, rank, scores) for (query_id, query), by the strategy, over the transform's variants. where: a condition on the chunks' columns, applied before anything is ranked. scores: a map of all scores that a chunk got on its way (dense, bm25, rrf, rerank, graph)."""
        k = k or self.settings.top_k
        how = transform.transform_named(self.options.transform)
        if how is transform.identity:
            return self._lists(questions, k, where)
        return transform.transformed(questions, lambda q, n: self._lists(q, n, where), how, self.provider("cheap"), k, self.settings.candidates, self.settings.rrf_k, self.log).drop("n_variants")

    def passages(self, lists: DataFrame) -> DataFrame:
        """Lists with their texts; by the parent strategy windows of the documents around them, merged where they overlap."""
        chunks = self.table("chunks").select("chunk_id", "doc_id", "title", "context", "text", "start_char", "end_char")
        rows = lists.join(chunks, "chunk_id")
        if self.settings.strategy != "parent":
            return rows
        docs = self.table("documents").select("doc_id", "text", "title")
        wide = context.merged_windows(context.windows(rows.drop("text", "title", "context"), docs, self.settings.window), self.settings.top_k)
        body = F.substring(F.col("text"), F.col("from_char") + 1, F.col("to_char") - F.col("from_char"))
        return wide.join(docs, "doc_id").select("query_id", "rank", "score", "scores", F.concat_ws("::", "doc_id", "from_char").alias("chunk_id"), "doc_id", "title", F.lit("").alias("context"), body.alias("text"), F.col("from_char").alias("start_char"), F.col("to_char").alias("end_char"))

    def answer(self, questions: DataFrame, lists: DataFrame, passages: DataFrame, log: ReplyLog | None = None) -> DataFrame:
        """answered() from passages that were retrieved, behind the gate where a floor is set; abstained: whether it refused."""
        made, strict = self.provider("generator"), self.options.strict
        if self.settings.score_floor is None:
            return answer.answered(questions, passages, made, strict=strict, log=log).withColumn("abstained", F.lit(False))
        return answer.gated_answers(questions, passages, lists, made, self.settings.score_floor, strict=strict, log=log)

    def ask(self, questions: DataFrame, k: int | None = None, where: Column | None = None) -> DataFrame:
        """answered() for each question, behind the gate where a floor is set; refused: whether the answer is a refusal."""
        lists = written(self.retrieve(questions, k, where), "lists")
        out = self.answer(questions, lists, self.passages(lists), self.log)
        return out.withColumn("refused", F.col("abstained") | looks_like_refusal(F.col("answer")))

    def health(self) -> dict:
        return {"status": "ok", "chunks": self.count(), "strategy": self.settings.strategy, "profile": self.options.profile}

    def retrieve_response(self, questions: DataFrame, k: int | None = None, where: Column | None = None) -> DataFrame:
        """query_id, results: the JSON that a service would return."""
        return serialised(self.passages(self.retrieve(questions, k, where)))

    def config(self) -> dict:
        return asdict(self.settings) | asdict(self.options)


@lru_cache(16)
def pipeline_at(path: str, settings: Settings | None = None, options: Options | None = None) -> Pipeline:
    """One pipeline for each path, settings and options in a process."""
    return Pipeline(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), path, settings, options)
