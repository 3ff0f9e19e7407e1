"""Streams: incremental ingest by content hash, answers to a stream of questions, and windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import content_sha
from ..operators import chunk
from ..operators.answer import REFUSAL
from ..sources import files
from ..sources.delta import MergedTable
from ..sources.replies import ReplyLog
from ..sources.store import serialised

#: Folders that documents and their chunks are dealt into by the hash of doc_id: a batch reads those of its documents.
FOLDERS = 256


def tables(spark: SparkSession, path: str, folders: int = FOLDERS) -> tuple[MergedTable, MergedTable]:
    """The hashes of the documents (doc_id, content_sha) and their chunks."""
    return MergedTable(spark, f"{path}/documents", "doc_id", ("doc_id", folders)), MergedTable(spark, f"{path}/chunks", "chunk_id", ("doc_id", folders))


def write_batch(df: DataFrame, number: int, path: str, size: int = 512, overlap: int = 64, newest: str | None = None, folders: int = FOLDERS) -> None:
    """Chunks the documents (doc_id, text) of a batch whose text is new. A changed document's chunks take the place of all its old ones; a document of which a column deleted is true goes, with its chunks.

    newest: the column by whose largest value one of several rows of a document counts; else any does. Documents are committed last, with the batch's number:
    a batch that is run again does nothing if they were, and else writes the same once more.
    """
    docs, chunks = tables(df.sparkSession, path, folders)
    if docs.commit()["seen"].get("ingest", -1) >= number:
        return
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in df.columns else F.lit(False)
    rows = df.filter("doc_id is not null").withColumn("gone", gone).withColumn("content_sha", content_sha(F.coalesce("text", F.lit(""))))
    if newest:
        rows = rows.groupBy("doc_id").agg(F.max_by(F.struct("text", "gone", "content_sha"), newest).alias("r")).select("doc_id", "r.*")
    rows = files.written(rows.select("doc_id", "text", "gone", "content_sha").dropDuplicates(["doc_id"]), "batch")
    known = docs.read(only=docs.only(rows.select("doc_id")))
    new = rows.filter("not gone")
    if known is not None:
        new = new.join(known.select("doc_id", "content_sha"), ["doc_id", "content_sha"], "left_anti")
    new, mark = files.written(new, "changed"), {"ingest": number}
    left = new.select("doc_id").unionByName(rows.filter("gone").select("doc_id"))
    if left.isEmpty():
        docs.change(None, None, mark)
        return
    chunks.change(chunk.fixed(new, size, overlap), left, mark)
    docs.change(new.select("doc_id", "content_sha"), rows.filter("gone").select("doc_id"), mark)


def ingest(stream: DataFrame, path: str, checkpoint: str, size: int = 512, overlap: int = 64, newest: str | None = None, folders: int = FOLDERS):
    """Chunks documents as they come; texts of which the hash is known already are skipped."""
    return stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path, size, overlap, newest, folders)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENTS = "query_id long, seq int, event string, data string"


def events(questions: DataFrame, results: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, seq, event, data: what is said to each question, in order: its contexts, the answer's words as tokens, and done; or an error where the generation failed.

    results: query_id, results (JSON); answers: query_id, answer, error, abstained. A question without results has empty contexts.
    """
    said = questions.select("query_id").join(results.select("query_id", "results"), "query_id", "left").join(answers.select("query_id", "answer", "error", "abstained"), "query_id", "left")

    def event(name: str, data: Column) -> Column:
        return F.struct(F.lit(name).alias("event"), data.alias("data"))

    words = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\s*\S+"), F.lit(0))
    tokens = F.transform(words, lambda w: event("token", F.to_json(F.struct(w.alias("text")))))
    good = F.concat(tokens, F.array(event("done", F.to_json(F.struct("abstained")))))
    bad = F.array(event("error", F.to_json(F.struct(F.col("error").alias("detail")))))
    every = F.concat(F.array(event("contexts", F.coalesce("results", F.lit("[]")))), F.when(F.col("error").isNotNull(), bad).otherwise(good))
    return said.select("query_id", F.posexplode(every).alias("seq", "e")).select(F.col("query_id").cast("long"), "seq", "e.event", "e.data")


def answer_batch(df: DataFrame, number: int, pipe, path: str) -> None:
    """Answers the questions (query_id, query) of a batch from a pipeline's tables and writes their events under the batch's number. Replies are kept in a log below the path: a batch that is run again asks nothing again and writes the same events. Questions behind the gate cost no generation."""
    questions = files.written(df.select("query_id", "query").filter("query_id is not null").dropDuplicates(["query_id"]), "questions")
    lists = files.written(pipe.retrieve(questions), "lists")
    passages = pipe.passages(lists)
    answers = pipe.answer(questions, lists, passages, ReplyLog(df.sparkSession, f"{path}/replies"))
    out = events(questions, serialised(passages), answers.withColumn("answer", F.when(F.col("abstained"), F.lit(REFUSAL)).otherwise(F.col("answer"))))
    out.write.mode("overwrite").parquet(f"{path}/events/batch={number}")


def answering(stream: DataFrame, pipe, path: str, checkpoint: str):
    """Answers questions as they come."""
    return stream.writeStream.foreachBatch(lambda df, n: answer_batch(df, n, pipe, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str, after: DataFrame | None = None) -> DataFrame:
    """The events written so far; after: (query_id, seq) up to which a reader has them already."""
    rows = spark.read.schema(EVENTS).parquet(f"{path}/events")
    if after is None:
        return rows
    return rows.join(after.select("query_id", F.col("seq").alias("_had")), "query_id", "left").filter(F.col("_had").isNull() | (F.col("seq") > F.col("_had"))).drop("_had")


def event_windows(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Tumbling windows by type; with a watermark on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
