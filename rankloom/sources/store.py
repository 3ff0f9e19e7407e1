"""Tables as sources and sinks: text folders, vector tables, golden sets, run reports."""

from __future__ import annotations

import json
import math
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import content_sha, strip, title
from . import files
from .files import workspace
from .lexical import Bm25Table
from .vectors import CellVectorTable, PartitionedVectorTable, VectorTable, get_store

__all__ = ["Bm25Table", "CellVectorTable", "PartitionedVectorTable", "VectorTable", "get_store", "workspace"]

GOLDEN = "id string, question string, relevant array<string>, answer_contains array<string>, kind string"


def load_documents(spark: SparkSession, root: str) -> DataFrame:
    """Text files below a folder of any name (.md, .txt, .rst; no readme.md): doc_id is the path from root. An error if none has text."""
    p, fs = files.hadoop(spark, root)
    if not fs.exists(p):
        raise FileNotFoundError(root)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    plain = re.sub(r"([\[\]{}*?\\])", r"\\\1", root)  # a path, no pattern
    rows = spark.read.text(plain, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "").alias("path"))
    whole = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # files are named by encoded paths, in which a plus is a plus
    rows = rows.select(F.substring(whole, len(base) + 1, 1 << 30).alias("doc_id"), strip(F.col("text")).alias("text"))
    rows = rows.filter(F.lower("doc_id").rlike(r"\.(md|txt|rst)$") & ~F.lower("doc_id").rlike(r"(^|/)readme\.md$") & (F.col("text") != ""))
    if rows.isEmpty():
        raise FileNotFoundError(f"no documents in {root}")
    stem = F.regexp_extract("doc_id", r"([^/]*)\.[^.]*$", 1)
    return rows.withColumn("title", title(F.col("text"), stem)).withColumn("content_sha", content_sha(F.col("text")))


def payload(chunks: DataFrame, *own: str) -> DataFrame:
    """Columns other than own as one map of strings, meta; nulls are left out."""
    rest = [c for c in chunks.columns if c not in own]
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rest))
    return chunks.select(*own, F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())).alias("meta"))


def from_payload(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The columns of kinds (name and type) back from meta; null where a key is missing."""
    return rows.select(*[c for c in rows.columns if c != "meta"], *(F.expr(f"try_cast(meta['{c}'] AS {kind})").alias(c) for c, kind in kinds.items()))


class PrefixCache:
    """Contexts by key (key, context) as Parquet, each batch of new rows in a folder of its own; a folder that cannot be read counts as empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], "key string, context string")
        out = empty
        for name, *_ in files.listed(self.spark, self.path):
            try:
                one = self.spark.read.parquet(f"{self.path}/{name}")
                out = out.unionByName(one.select("key", "context"))
            except (PySparkException, Py4JJavaError):
                continue
        return out.dropDuplicates(["key"])

    def append(self, rows: DataFrame) -> None:
        rows.select("key", "context").write.parquet(f"{self.path}/{uuid.uuid4().hex}")


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with the rows of new in place of those with the same key; of new rows with one key any one stays."""
    new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def missing(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of questions; white space is collapsed, the default kind is conceptual."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = [(str(q["id"]), " ".join(q["question"].split()), q.get("relevant") or [], q.get("answer_contains") or [], q.get("kind", "conceptual")) for q in yaml.safe_load(f)]
    return spark.createDataFrame(rows, GOLDEN)


def shown(value: float | None) -> str:
    return "-" if value is None or math.isnan(value) else f"{value:.3f}"


def report_row(label: str, summary: dict, at_ceiling: bool = False) -> str:
    """A Markdown row; the cost stands in it only where the summary has one."""
    cost = [f"${summary['cost_usd']:.4f}"] if summary.get("cost_usd") is not None else []
    return "| " + " | ".join([label, *(shown(summary.get(k)) for k in ("recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_5")), *cost, "⚠️ ceiling" if at_ceiling else ""]) + " |"


def append_row(path: str, row: str, marker: str, placeholder: str = "no runs yet") -> None:
    """Puts a row under the marker line of a Markdown file, and drops the placeholder row."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().split("\n")
    at = next((i for i, x in enumerate(lines) if marker in x), None)
    if at is None:
        raise ValueError(f"no {marker} in {path}")
    lines.insert(at + 1, row)
    lines = [x for x in lines if not (x.startswith("|") and placeholder in x)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def run_name(label: str, at: float | None = None) -> str:
    """A stamp and 48 characters of the label that fit a file name."""
    slug = re.sub(r"[^a-z0-9]+", "-", label.lower()).strip("-")[:48]
    return f"{time.strftime('%Y%m%d-%H%M%S', time.gmtime(at))}-{slug}"


def write_run(results: DataFrame, path: str, label: str, config: dict, at: float | None = None) -> str:
    """Per-question results as JSON lines, by run; returns the run's name."""
    name = run_name(label, at)
    results.withColumn("run_id", F.lit(name)).withColumn("config", F.lit(json.dumps(config))).write.mode("append").partitionBy("run_id").json(path)
    return name


def response(scores: Column) -> Column:
    """A scores map as JSON with 6 places."""
    return F.to_json(F.transform_values(scores, lambda _, v: F.round(v, 6)))


def serialised(passages: DataFrame) -> DataFrame:
    """One JSON list per question: rank, chunk_id, doc_id, title, text, score and, where there is one, the map of scores (6 places) of each passage."""
    scores = [F.transform_values("scores", lambda _, v: F.round(v, 6)).alias("scores")] if "scores" in passages.columns else []
    each = F.struct("rank", "chunk_id", "doc_id", "title", "text", F.round("score", 6).alias("score"), *scores)
    return passages.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(each), lambda a, b: (a["rank"] - b["rank"]).cast("int"))).alias("results"))
