"""Answers: prompts through a generator, citations resolved to what was retrieved, refusals, graded retrieval and follow-up searches.

All work on whole tables of questions. Replies come through a log (sources.replies), so that each prompt is asked once, when the function is
called, whatever reads the result. Where a loop is needed (follow-up searches) it runs over the questions that are still open, a
fixed number of times, and ends when none is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import citations, clamp, collapse, entities, first_plausible, strip, tolerant_list, tolerant_object
from ..providers import Generator
from ..session import TOP_K
from ..sources.files import written
from ..sources.replies import ReplyLog, replied
from . import context
from .retrieve import ranked

#: Fixed value: the answer where nothing is generated.
REFUSAL = "The retrieved passages do not contain the information needed to answer this question. The corpus does not appear to cover it."
ANSWER = "Answer from the passages only and cite them as [1] or [2][4]. If they do not contain the answer, say so."
STRICT = "Answer from the passages only and cite them as [1] or [2][4]. Where they do not state the answer, say that the context does not contain it, and nothing else. Do not guess, not even from passages on the same topic."
#: The reply's keys and verdicts, which graded() reads.
GRADE = 'Do the passages answer the question? Being on the same topic is not enough. Reply with JSON only: {"verdict": "correct" | "ambiguous" | "incorrect", "confidence": 0.0-1.0, "reason": "<8 words>"}'
FOLLOW_UP = "Say whether the passages suffice to answer the question. Reply ENOUGH, or SEARCH: and a short query for what is missing."
ENTITIES = "List the key entities that the passage discusses, at most eight. Reply with a JSON array of strings only."
JUDGE = 'Judge the answer by the context. Reply with JSON only: {"groundedness": 0.0-1.0, "relevance": 0.0-1.0}'
GRADE_CHARS = 3000


def cited(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, answer) and (query_id, rank, chunk_id, ...) to one row per citation in the order of its first mark: numbers outside the passages are left out."""
    marks = answers.select("query_id", F.posexplode(citations(F.col("answer"))).alias("place", "rank"))
    return marks.join(passages, ["query_id", "rank"])


def answered(questions: DataFrame, passages: DataFrame, generator: Generator, max_chars: int | None = None, strict: bool = False, max_tokens: int = 1024, log: ReplyLog | None = None) -> DataFrame:
    """query_id, answer, input_tokens, output_tokens, prompt_chars, n_contexts, error of one generation per question. passages: query_id, rank, title, doc_id, text (and context)."""
    blocks = context.blocks(passages)
    asked = context.prompts(questions, blocks if max_chars is None else context.within_budget(blocks, max_chars))
    out = replied(asked, STRICT if strict else ANSWER, F.col("prompt"), generator, max_tokens, log)
    n = passages.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_contexts"))
    return out.join(n, "query_id", "left").select("query_id", F.coalesce("reply.text", F.lit("")).alias("answer"), "reply.input_tokens", "reply.output_tokens", F.length("prompt").alias("prompt_chars"), F.coalesce("n_contexts", F.lit(0)).alias("n_contexts"), "reply.error")


def refused(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """As answered(), without a generation: the fixed refusal, no tokens; the passages stay counted."""
    n = passages.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_contexts"))
    zero = F.lit(0).cast("long")
    return questions.select("query_id").join(n, "query_id", "left").select("query_id", F.lit(REFUSAL).alias("answer"), zero.alias("input_tokens"), zero.alias("output_tokens"), F.lit(0).alias("prompt_chars"), F.coalesce("n_contexts", F.lit(0)).alias("n_contexts"), F.lit(None).cast("string").alias("error"))


def gated_answers(questions: DataFrame, passages: DataFrame, lists: DataFrame, generator: Generator, floor: float = 0.60, **how) -> DataFrame:
    """answered(), but for questions that the gate refuses: these cost no generation. abstained: which they are."""
    flag = questions.join(context.gate(lists, questions, floor).select("query_id", "abstain"), "query_id")
    no, yes = flag.filter("abstain").drop("abstain"), flag.filter("not abstain").drop("abstain")
    mine = passages.join(yes.select("query_id"), "query_id", "left_semi")
    return answered(yes, mine, generator, **how).withColumn("abstained", F.lit(False)).unionByName(refused(no, passages).withColumn("abstained", F.lit(True)))


def graded(questions: DataFrame, passages: DataFrame, generator: Generator, log: ReplyLog | None = None) -> DataFrame:
    """query_id, verdict, confidence, reason. Nothing retrieved is incorrect; a failed or unreadable grade is correct with confidence 0, so that a broken grader lets answers through."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    blocks = context.within_budget(passages.select("query_id", "rank", block.alias("block")), GRADE_CHARS)
    text = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n").alias("text"))
    some = passages.select("query_id").distinct().withColumn("some", F.lit(True))
    asked = questions.join(some, "query_id", "left").join(text, "query_id", "left")
    prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nRetrieved passages:\n"), F.coalesce("text", F.lit("")), F.lit("\n\nJSON verdict:"))
    replies = replied(asked.filter("some"), GRADE, prompt, generator, 150, log)
    found = tolerant_object(F.col("reply.text"))
    word = F.lower(F.trim(F.get_json_object(found, "$.verdict")))
    sure = F.expr("try_cast(c as double)")
    one = replies.select("query_id", "reply.error", found.alias("o"), word.alias("w"), F.get_json_object(found, "$.confidence").alias("c"), F.get_json_object(found, "$.reason").alias("r"))
    read = one.select(
        "query_id",
        F.when(F.col("w").isin("correct", "ambiguous", "incorrect"), F.col("w")).otherwise("correct").alias("verdict"),
        F.when(F.col("o").isNull(), 0.0).otherwise(F.coalesce(clamp(sure), F.lit(0.5))).alias("confidence"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("grader unavailable: "), F.col("error"))).when(F.col("o").isNull(), "grader returned unparseable output").otherwise(F.substring(F.coalesce("r", F.lit("")), 1, 120)).alias("reason"),
    )
    return read.unionByName(asked.filter("some is null").select("query_id", F.lit("incorrect").alias("verdict"), F.lit(1.0).alias("confidence"), F.lit("nothing retrieved").alias("reason")))


def corrected(questions: DataFrame, retrieve, passages_of, generator: Generator, grader: Generator, k: int = TOP_K, widen: int = 3, log: ReplyLog | None = None) -> DataFrame:
    """Graded retrieval: correct is answered, ambiguous is retrieved once more, widen times as deep, and answered, incorrect is refused without a generation. passages_of: lists to passages with texts. verdict, confidence and widened stand beside the answer; one row a question."""
    lists = written(retrieve(questions, k), "lists")
    by = written(questions.join(graded(questions, passages_of(lists), grader, log), "query_id"), "grades")
    bad, half, good = (by.filter(F.col("verdict") == v).select(*questions.columns) for v in ("incorrect", "ambiguous", "correct"))
    more = written(retrieve(half, k * widen), "wider")
    deeper = more.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).select("query_id", F.lit(True).alias("widened"))
    used = lists.join(good.select("query_id"), "query_id", "left_semi").unionByName(more)
    out = answered(good.unionByName(half), passages_of(used), generator, strict=True, log=log).unionByName(refused(bad, passages_of(lists)))
    return out.join(by.select("query_id", "verdict", "confidence", "reason"), "query_id").join(deeper, "query_id", "left").withColumn("widened", F.coalesce("widened", F.lit(False)))


def follow_up(reply: Column) -> Column:
    """The query after SEARCH: in a reply, its first line without quotes; null if there is none."""
    after = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?is)search:(.*)$", 1)
    line = F.regexp_replace(strip(F.element_at(F.split(strip(after), r"\r\n|\n|\r"), 1)), r'^"+|"+$', "")
    return F.nullif(line, F.lit(""))


def multi_hop(questions: DataFrame, retrieve, texts: DataFrame, generator: Generator, k: int = TOP_K, max_hops: int = 2, log: ReplyLog | None = None) -> tuple[DataFrame, DataFrame]:
    """Lists of k over up to max_hops further searches, and a trace (query_id, hops, queries, stopped_because).

    A chunk keeps the best score of all hops, so a later one never takes anything away. A question is done when the
    generator asks for nothing more, repeats a query, or the limit is reached. Each hop's lists are written, so that no search is done twice. texts: chunk_id, text.
    """
    lists = written(retrieve(questions, k).select("query_id", "chunk_id", "score"), "hop")
    open_ = questions.select("query_id", "query", F.array(F.lower("query")).alias("asked"), F.array("query").alias("queries"))
    traces = None

    def done(rows: DataFrame, why: str) -> DataFrame:
        return rows.select("query_id", F.size("queries").alias("hops"), "queries", F.lit(why).alias("stopped_because"))

    for _ in range(max_hops):
        top = ranked(lists.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), 5).join(texts, "chunk_id")
        said = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, 220).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("so_far"))
        prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nSo far:\n"), F.coalesce("so_far", F.lit("")), F.lit("\n\nReply:"))
        replies = replied(open_.join(said, "query_id", "left"), FOLLOW_UP, prompt, generator, 64, log).withColumn("next", follow_up(F.col("reply.text")))
        again = F.array_contains("asked", F.lower("next"))
        ended = done(replies.filter("next is null"), "model said enough").unionByName(done(replies.filter(F.col("next").isNotNull() & again), "follow-up repeated an earlier query"))
        traces = ended if traces is None else traces.unionByName(ended)
        more = replies.filter(F.col("next").isNotNull() & ~again)
        open_ = written(more.select("query_id", "query", F.concat("asked", F.array(F.lower("next"))).alias("asked"), F.concat("queries", F.array("next")).alias("queries"), "next"), "open")
        if open_.isEmpty():
            break
        lists = lists.unionByName(written(retrieve(open_.select("query_id", F.col("next").alias("query")), k).select("query_id", "chunk_id", "score"), "hop"))
        open_ = open_.drop("next")
    limit = done(open_, "hop limit reached")
    traces = limit if traces is None else traces.unionByName(limit)
    return ranked(lists.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k), traces


def extracted(chunks: DataFrame, generator: Generator, limit: int = 8, log: ReplyLog | None = None) -> DataFrame:
    """chunk_id, entities: a generator's list of plausible entities; the typographic ones where it fails or gives no list."""
    asked = replied(chunks, ENTITIES, F.concat(F.lit("Passage:\n"), F.col("text"), F.lit("\n\nJSON array:")), generator, 150, log)
    listed = tolerant_list(F.col("reply.text"))
    return asked.select("chunk_id", F.when(F.col("reply.error").isNotNull() | listed.isNull(), entities(F.col("text"), limit)).otherwise(first_plausible(F.transform(listed, collapse), limit)).alias("entities"))


def model_judged(answers: DataFrame, generator: Generator, log: ReplyLog | None = None) -> DataFrame:
    """(query_id, query, answer, context) to groundedness and relevance by a generator, in 0 to 1; null where its reply cannot be read."""
    prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nContext:\n"), F.col("context"), F.lit("\n\nAnswer:\n"), F.col("answer"), F.lit("\n\nJSON:"))
    found = replied(answers, JUDGE, prompt, generator, 100, log).select("query_id", tolerant_object(F.col("reply.text")).alias("o"))
    one = found.select("query_id", F.get_json_object("o", "$.groundedness").alias("g"), F.get_json_object("o", "$.relevance").alias("r"))
    return one.select("query_id", clamp(F.expr("try_cast(g as double)")).alias("groundedness"), clamp(F.expr("try_cast(r as double)")).alias("relevance"))
