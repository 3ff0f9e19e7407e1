"""A written log of generators' replies: each prompt is asked once, whatever branches of a plan read the reply.

A call is dear and may give another reply the next time, so a plan must not evaluate it again for each branch, count or write. Here the rows that ask
are written, prompts that the log does not know are sent in numbered parts, each part is written as it is done, and all branches
read the log. What is in the log when a job is lost stays: the same call again asks only the rest.
"""

from __future__ import annotations

import time
import uuid
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..providers import BATCH, REPLY, Generator, generated
from . import files

#: Prompts in one part, at most about: what a lost job has to ask again.
PART = 10_000
LOGGED = f"key string, {REPLY}"


@runtime_checkable
class BatchClient(Protocol):
    """A service that takes many requests at once: submit() gives a handle, done() says whether its results can be fetched, results() gives (text, input tokens, output tokens) or an exception for each id."""

    name: str

    def submit(self, requests: list[tuple[str, str, str, int]]) -> str: ...

    def done(self, handle: str) -> bool: ...

    def results(self, handle: str) -> dict[str, object]: ...


class ReplyLog:
    """Replies by the hash of model, system text, prompt and length, below a path; parts count once they are written whole.

    Errors are kept too, as all branches must see the same; another log object over the same path asks them again.
    """

    def __init__(self, spark: SparkSession, path: str, part: int = PART):
        self.spark, self.path, self.part, self.run = spark, path.rstrip("/"), part, uuid.uuid4().hex

    def parts(self) -> list[str]:
        names = [n for n, *_ in files.listed(self.spark, f"{self.path}/parts")]
        return [n for n in names if files.exists(self.spark, f"{self.path}/parts/{n}/_SUCCESS")]

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], LOGGED)
        return self.spark.read.schema(LOGGED).parquet(*(f"{self.path}/parts/{n}" for n in parts))

    def read(self) -> DataFrame:
        """One row a key: a reply before an error."""
        one = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "error", "text", "input_tokens", "output_tokens")).alias("r")
        return self._rows(self.parts()).groupBy("key").agg(one).select("key", "r.text", "r.input_tokens", "r.output_tokens", "r.error")

    def _known(self) -> DataFrame:
        parts = self.parts()
        mine = [n for n in parts if n.startswith(self.run)]
        return self._rows([n for n in parts if n not in mine]).filter("error is null").select("key").unionByName(self._rows(mine).select("key"))

    def replies(self, rows: DataFrame, system: str, prompt: Column, model: Generator | BatchClient, max_tokens: int = 1024, out: str = "reply", poll: float = 5.0, timeout: float = 24 * 3600.0) -> DataFrame:
        """rows with the reply (text, input_tokens, output_tokens, error) to each prompt. model: a generator, or a client of batches, which is polled until the timeout."""
        parts = F.concat_ws("\u001f", F.lit(model.name), F.lit(str(max_tokens)), F.lit(system), F.coalesce(prompt, F.lit("")))
        asked = files.written(rows.withColumn("_prompt", F.coalesce(prompt, F.lit(""))).withColumn("_key", F.sha2(parts, 256)), "asked")
        misses = files.written(asked.select(F.col("_key").alias("key"), F.col("_prompt").alias("prompt")).dropDuplicates(["key"]).join(self._known(), "key", "left_anti"), "misses")
        n = misses.count()
        numbers = -(-n // self.part)
        for i in range(numbers):
            some = misses.filter(F.pmod(F.xxhash64("key"), F.lit(numbers)) == i)
            tasks = max(1, min(self.spark.sparkContext.defaultParallelism, -(-min(n, self.part) // BATCH)))
            some = some.repartition(tasks)
            if isinstance(model, BatchClient):
                said = some.mapInPandas(_submitted(model, system, max_tokens, poll, timeout), LOGGED)
            else:
                said = generated(some, system, F.col("prompt"), model, max_tokens).select("key", "reply.*")
            said.write.parquet(f"{self.path}/parts/{self.run}-{len(self.parts()):06d}")
        reply = F.struct("text", "input_tokens", "output_tokens", "error").alias(out)
        return asked.join(self.read().select(F.col("key").alias("_key"), reply), "_key", "left").select(*rows.columns, out)


def _submitted(client: BatchClient, system: str, max_tokens: int, poll: float, timeout: float):
    def run(frames):
        for frame in frames:
            until = time.monotonic() + timeout
            try:
                handle = client.submit([(k, system, p, max_tokens) for k, p in zip(frame["key"], frame["prompt"], strict=True)])
                while not client.done(handle):
                    if time.monotonic() >= until:
                        raise TimeoutError
                    time.sleep(poll)
                got = client.results(handle)
            except Exception as e:  # none of these was answered; the others go on
                got = dict.fromkeys(frame["key"], e)
            found = [(k, None, 0, 0, type(r).__name__) if isinstance(r, Exception) else (k, *r, None) for k in frame["key"] for r in [got.get(k, LookupError())]]
            yield pd.DataFrame(found, columns=["key", "text", "input_tokens", "output_tokens", "error"])

    return run


def replied(rows: DataFrame, system: str, prompt: Column, model: Generator | BatchClient, max_tokens: int = 1024, log: ReplyLog | None = None) -> DataFrame:
    """rows with replies through a log; without one, through a new one, so that at least no branch asks again."""
    return (log or ReplyLog(rows.sparkSession, files.fresh(rows.sparkSession, "replies"))).replies(rows, system, prompt, model, max_tokens)


def batch_replies(requests: DataFrame, system: str, model: Generator | BatchClient, max_tokens: int = 200, log: ReplyLog | None = None, **how) -> DataFrame:
    """(custom_id, prompt) to one text for each id, joined by id and never by place; a failed request gives an empty text. An id that comes twice is asked once."""
    asked = requests.select("custom_id", "prompt").dropDuplicates(["custom_id"])
    log = log or ReplyLog(requests.sparkSession, files.fresh(requests.sparkSession, "replies"))
    return log.replies(asked, system, F.col("prompt"), model, max_tokens, **how).select("custom_id", F.coalesce("reply.text", F.lit("")).alias("text"))
