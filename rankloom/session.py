"""Sessions and tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: How each setting is bounded: chunk sizes, top-k and shortlist depth of the retrieval pipeline.
CHUNK_SIZE, OVERLAP, TOP_K, RERANK_CANDIDATES, EVAL_DEPTH, RRF_K, WINDOW = 512, 64, 5, 10, 20, 60, 600


@dataclass(frozen=True)
class Settings:
    """Pipeline settings; checked when made."""

    chunk_size: int = CHUNK_SIZE
    overlap: int = OVERLAP
    top_k: int = TOP_K
    candidates: int = RERANK_CANDIDATES
    rrf_k: int = RRF_K
    window: int = WINDOW
    score_floor: float | None = None
    strategy: str = "hybrid"

    def __post_init__(self):
        if not 0 <= self.overlap < self.chunk_size:
            raise ValueError("overlap must be smaller than chunk_size")
        if not 1 <= self.top_k <= 25:
            raise ValueError("top_k must be between 1 and 25")


def check_request(question: str, k: int) -> None:
    """What a service asks of a request: 1 to 2000 characters, 1 to 25 results."""
    if not 1 <= len(question.strip()) <= 2000:
        raise ValueError("a question has 1 to 2000 characters")
    if not 1 <= k <= 25:
        raise ValueError("k must be between 1 and 25")


def session(cores: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the one that is there."""
    b = SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]").appName("rankloom")
    for k, v in ({"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
