"""Vector tables: rows (chunk_id, embedding, further columns) that are upserted, deleted and searched by cosine of unit vectors.

VectorTable scans all rows for a search and is exact. PartitionedVectorTable deals rows into folders by the hash of a column and opens
those that a search asks for. CellVectorTable is an inverted file: rows lie in folders by their nearest of the centres of a
k-means, and a question opens the folders of its nearest centres only; what is found there is scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import files
from .delta import MergedTable

LIST = "query_id long, chunk_id string, score double, rank int"
#: Cells of an inverted file, at most; vectors of a cell from which its centre is learned, about.
MOST_CELLS, LEARN = 4096, 64
#: Questions by which the number of probes is set, and the recall that they are to reach.
TRIALS, RECALL = 256, 0.96


def within(rows: DataFrame, among: DataFrame | None) -> DataFrame:
    return rows if among is None else rows.join(among.select("chunk_id").distinct(), "chunk_id", "left_semi")


class VectorTable:
    """An exact table; opening a path again finds the newest version."""

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, **how):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension
        self.rows = MergedTable(spark, self.path, **how)

    @property
    def version(self) -> int:
        return self.rows.version

    def read(self) -> DataFrame | None:
        return self.rows.read()

    def _checked(self, rows: DataFrame) -> DataFrame:
        if not self.dimension:
            return rows
        return rows.withColumn("embedding", F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(F.raise_error(F.lit("wrong dimension"))))

    def add(self, rows: DataFrame, replacing: str | None = None) -> None:
        """Adds rows, replacing those of the same chunk_id; of new rows with one id any one stays. replacing: a column (doc_id) of which all older rows with the new values go."""
        self.rows.upsert(self._checked(rows), replacing)

    def remove(self, keys: DataFrame) -> None:
        """Rows with the values of keys' one column (chunk_id, doc_id) go."""
        self.rows.delete(keys, keys.columns[0])

    def search(self, queries: DataFrame, k: int = 5, where: Column | None = None, among: DataFrame | None = None) -> DataFrame:
        """Lists of k for (query_id, query vector); where (a condition on the table's columns) and among (chunk_ids) are applied before the ranking. An empty table gives none."""
        from ..operators.retrieve import dense

        rows = self.read()
        return self.spark.createDataFrame([], LIST) if rows is None else dense(queries, within(rows, among), k, where)

    def get(self, ids: DataFrame) -> DataFrame | None:
        """The rows of these chunk_ids; None from an empty table."""
        rows = self.read()
        return None if rows is None else rows.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def count(self) -> int:
        rows = self.read()
        return 0 if rows is None else rows.count()

    def reset(self) -> None:
        """Empties the table; what is added later starts anew."""
        self.rows.reset()


class PartitionedVectorTable(VectorTable):
    """As VectorTable, dealt into folders by the hash of a column (a document's rows lie together), so that a search within some of its values opens their folders only; the dimension must be given."""

    def __init__(self, spark: SparkSession, path: str, dimension: int | None, by: str = "doc_id", folders: int = 64):
        if not dimension:
            raise ValueError("a partitioned table needs its dimension")
        super().__init__(spark, path, dimension, buckets=(by, folders))
        self.by = by

    def search_within(self, queries: DataFrame, values: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
        """As search(), among the rows whose value of the column stands in values."""
        from ..operators.retrieve import dense

        rows = self.rows.read(only=self.rows.only(values.select(self.by)))
        if rows is None:
            return self.spark.createDataFrame([], LIST)
        return dense(queries, rows.join(values.select(self.by).distinct(), self.by, "left_semi"), k, where)


def nearest(centres: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each vector, nearest first; ties go to the lower number."""
    far = (centres * centres).sum(1) - 2.0 * vectors @ centres.T
    return far.argsort(axis=1, kind="stable")[:, :n]


class CellVectorTable(VectorTable):
    """An inverted file of cells.

    Centres are learned from a bounded sample (LEARN rows a cell, by the hash of their ids) when rows are first added, as many as the root of their
    number, and stay until retrain(); every row is indexed. A question probes so many cells that, for TRIALS rows of the table as questions, on
    average RECALL of the exact first ten are found; the number is kept with the commit. A question that finds fewer than k rows in its cells (as a filter leaves few) is answered from all
    cells. Rows of one cell are dealt over several files, as copies may all lie in one.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, recall: float = RECALL):
        super().__init__(spark, path, dimension, by="cell")
        self.recall = recall

    @property
    def notes(self) -> dict:
        return self.rows.commit()["notes"]

    def centres(self) -> np.ndarray:
        """At most MOST_CELLS rows reach the driver."""
        got = self.spark.read.parquet(f"{self.path}/{self.notes['centres']}").orderBy("cell").toArrow()
        return np.array(got["centre"].to_pylist(), float)

    def _learned(self, rows: DataFrame) -> str:
        """Writes the centres of rows; returns where."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = rows.count()
        cells = int(min(MOST_CELLS, max(1, round(n**0.5))))
        sample = rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < max(1, min(1 << 20, (cells * LEARN << 20) // max(n, 1))))
        learn = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
        name = files.fresh(self.spark, "centres").rsplit("/", 1)[1]
        try:
            if learn.limit(cells + 1).count() > cells > 1:
                found = [c.tolist() for c in KMeans(k=cells, seed=7, maxIter=10, initMode="random").fit(learn).clusterCenters()]
            else:
                found = [r["features"].toArray().tolist() for r in learn.limit(cells).collect()] or [[0.0] * (self.dimension or 1)]
        finally:
            learn.unpersist()
        self.spark.createDataFrame(list(enumerate(found)), "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/{name}")
        return name

    def _celled(self, rows: DataFrame, centres: np.ndarray, n: int | None = None, out: str = "cell", vector: str = "embedding") -> DataFrame:
        """rows with the number of the nearest centre, or an array of the n nearest."""
        shared = self.spark.sparkContext.broadcast(centres)

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            found = nearest(shared.value, np.stack(v.to_numpy()).astype(float), n or 1) if len(v) else np.empty((0, 1), int)
            return pd.Series(list(found.astype(np.int32)), index=v.index)

        got = rows.withColumn(out, cells(F.col(vector).cast("array<double>")))
        return got if n else got.withColumn(out, F.get(F.col(out), F.lit(0)))

    def add(self, rows: DataFrame, replacing: str | None = None) -> None:
        rows = self._checked(rows)
        notes = self.notes if self.notes.get("centres") else self.notes | {"centres": self._learned(rows)}
        centres = np.array(self.spark.read.parquet(f"{self.path}/{notes['centres']}").orderBy("cell").toArrow()["centre"].to_pylist(), float)
        self.rows.upsert(self._celled(rows, centres), replacing, notes=notes | {"cells": len(centres)})
        if "probes" not in self.notes:
            self.tune()

    def retrain(self) -> None:
        """Learns new centres from all rows and deals these anew."""
        rows = self.read()
        if rows is not None:
            notes = {"centres": self._learned(rows)}
            now = self.rows.commit()
            centres = np.array(self.spark.read.parquet(f"{self.path}/{notes['centres']}").orderBy("cell").toArrow()["centre"].to_pylist(), float)
            part = self.rows._put(self._celled(rows.drop("cell"), centres), "rows", "chunk_id", now["version"] + 1)
            self.rows._commit(now, [part], notes=notes | {"cells": len(centres)})
            self.tune()

    def tune(self) -> list[float]:
        """Sets the number of probes: the least that reaches the recall on TRIALS rows as questions. Returns the recall of 1, 2, ... probes.

        One exact search: a neighbour is found by as many probes as its cell's place among the cells nearest to the question.
        """
        rows, n = self.read(), self.notes["cells"]
        asked = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(TRIALS).select("chunk_id", F.col("embedding").alias("query"))
        asked = self.spark.createDataFrame([(i, list(map(float, r["query"]))) for i, r in enumerate(asked.collect())], "query_id long, query array<double>")
        order = self._celled(asked, self.centres(), n, "cells", "query").select("query_id", "cells")
        hits = super().search(asked, 10).join(rows.select("chunk_id", "cell"), "chunk_id").join(F.broadcast(order), "query_id")
        places = hits.groupBy(F.array_position("cells", F.col("cell")).alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a cell at most
        found = np.cumsum(np.bincount([r["place"] - 1 for r in places], [r["n"] for r in places], n)) if places else np.ones(n)
        share = found / found[-1]
        now = self.rows.commit()
        self.rows._commit(now, now["parts"], notes={"probes": int(np.argmax(share >= self.recall)) + 1})
        return share.tolist()

    def search(self, queries: DataFrame, k: int | None = 5, where: Column | None = None, among: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """Lists of k from the probed cells' rows, scored exactly. probes: their number; the table's own by default, all cells make the search exact. k None: whole lists, which only all cells hold."""
        from ..operators.retrieve import BROADCAST_BYTES, blocks_of, dense, dot, ranked

        rows = self.read()
        if rows is None:
            return self.spark.createDataFrame([], LIST)
        rows = within(rows, among)
        n = min(probes or self.notes["probes"], self.notes["cells"])
        if k is None or n >= self.notes["cells"]:
            return dense(queries, rows, k, where)
        some, out = rows.filter(where) if where is not None else rows, None
        centres = self.centres()
        for q in blocks_of(queries, BROADCAST_BYTES // n):
            asked = self._celled(q.select("query_id", "query"), centres, n, "cells", "query")
            opened = sorted(r["c"] for r in asked.select(F.explode("cells").alias("c")).distinct().collect())  # at most MOST_CELLS
            one = asked.select("query_id", "query", F.explode("cells").alias("_cell"))
            near = some.filter(F.col("cell").isin(opened)).join(F.broadcast(one), F.col("cell") == F.col("_cell"))
            # k rows a question, kept on disk: what comes of them reads them more than once
            top = ranked(near.select("query_id", "chunk_id", dot(F.col("embedding"), F.col("query")).alias("score")), k).persist(StorageLevel.DISK_ONLY)
            full = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            few = q.join(full.select("query_id"), "query_id", "left_anti")
            whole = top.join(full.select("query_id"), "query_id", "left_semi").unionByName(dense(few.select("query_id", "query"), rows, k, where))
            out = whole if out is None else out.unionByName(whole)
        return out


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The mean share of each question's exact list that was found."""
    hit = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    got = hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("share")).agg(F.avg("share").alias("recall")).first()
    return 1.0 if got["recall"] is None else got["recall"]


STORES = {"plain": VectorTable, "partitioned": PartitionedVectorTable, "cells": CellVectorTable}


def get_store(spark: SparkSession, kind: str, path: str, dimension: int | None = None) -> VectorTable:
    """A store by name; an unknown name is told which there are."""
    if kind not in STORES:
        raise ValueError(f"unknown store {kind!r}; there are: {', '.join(sorted(STORES))}")
    return STORES[kind](spark, path, dimension)
