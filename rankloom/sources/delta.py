"""Keyed tables of Parquet parts under commits: upserts and deletions write only what changes, reading merges, compaction rewrites.

A commit is a small JSON file that lists the parts of a version: parts of rows, and parts of keys that are gone, each with the
number of the commit that wrote it. A row counts unless its key stands in a later part, of rows or of gone keys. So an upsert of
1 % of the table writes 1 % of it, a failed write leaves files that no commit names, and older versions can still be read. Keys of later
parts are joined against the rest; Spark broadcasts them as long as they are small, and compaction keeps them so.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import files

#: Parts from which on a commit is followed by a compaction.
MOST_PARTS = 24
BUCKET = "_bucket"


class MergedTable:
    """Rows with a unique key below one path. buckets: a column and the number of folders that its hash deals rows into, so that reading a few of its values opens a few folders; by: a column of which each value has its folder."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", buckets: tuple[str, int] | None = None, by: str | None = None):
        self.spark, self.path, self.key, self.buckets, self.by = spark, path.rstrip("/"), key, buckets, by

    # commits

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n, *_ in files.listed(self.spark, f"{self.path}/_commits") if n.endswith(".json")]

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    def commit(self, version: int | None = None) -> dict:
        """What a version (the newest) is made of."""
        v = self.version if version is None else version
        return json.loads(files.read_text(self.spark, f"{self.path}/_commits/{v:08d}.json")) if v else {"version": 0, "parts": [], "seen": {}, "notes": {}}

    def _commit(self, before: dict, parts: list[dict], seen: dict | None = None, notes: dict | None = None) -> None:
        """Fails if another writer has committed since `before` was read; what was written then stays unnamed."""
        after = {"version": before["version"] + 1, "parts": parts, "seen": before["seen"] | (seen or {}), "notes": before["notes"] | (notes or {})}
        files.write_new(self.spark, f"{self.path}/_commits/{after['version']:08d}.json", json.dumps(after))

    def _put(self, rows: DataFrame, kind: str, on: str, seq: int) -> dict:
        name = f"{kind}/{uuid.uuid4().hex}"
        folders = [self.by] if self.by and kind == "rows" else []
        if self.buckets and self.buckets[0] in rows.columns:
            rows = rows.withColumn(BUCKET, self._bucket(F.col(self.buckets[0])))
            folders.append(BUCKET)
        if folders:  # a folder's rows in a few tasks; one that holds much of the table in many
            rows = rows.repartition(*folders, F.pmod(F.xxhash64(on), F.lit(4)))
        w = rows.write
        (w.partitionBy(*folders) if folders else w).parquet(f"{self.path}/{name}")
        return {"kind": kind, "on": on, "path": name, "seq": seq, "folders": folders}

    def _bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("string")), F.lit(self.buckets[1])).cast("int")

    # writing

    def upsert(self, rows: DataFrame, replacing: str | None = None, seen: dict[str, int] | None = None, notes: dict | None = None) -> None:
        """Adds rows in place of those with their keys; of new rows with one key any one stays. replacing: a column (a chunk's document, say) of which all older rows with the new rows' values go too. A null key is an error."""
        self.change(rows, rows.select(replacing).distinct() if replacing else None, seen, notes)

    def change(self, rows: DataFrame | None, gone: DataFrame | None = None, seen: dict[str, int] | None = None, notes: dict | None = None) -> None:
        """One commit: rows before it with a value of gone's one column go, rows are added. seen: numbers that a stream has reached, kept with the commit."""
        now = self.commit()
        seq, parts = now["version"] + 1, list(now["parts"])
        if gone is not None and parts:
            parts.append(self._put(gone.distinct(), "gone", gone.columns[0], seq))
        if rows is not None:
            checked = rows.withColumn(self.key, F.coalesce(F.col(self.key), F.raise_error(F.lit(f"null {self.key}")).cast(rows.schema[self.key].dataType)))
            parts.append(self._put(checked.dropDuplicates([self.key]), "rows", self.key, seq))
        self._commit(now, parts, seen, notes)
        if len(parts) > MOST_PARTS:
            self.compact()

    def delete(self, keys: DataFrame, on: str | None = None) -> None:
        """Rows whose key (or column on) stands in keys go."""
        self.change(None, keys.select(on or self.key))

    def reset(self, notes: dict | None = None) -> None:
        self._commit(self.commit(), [], notes=notes)

    def compact(self) -> None:
        """One part of what can be read now."""
        now, rows = self.commit(), self.read()
        self._commit(now, [] if rows is None else [self._put(rows, "rows", self.key, now["version"] + 1)])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes the files of all but the newest versions, and those that no commit names; returns the parts that went. Not while another writer is at work."""
        kept = self.versions()[-keep:]
        named = {p["path"] for v in kept for p in self.commit(v)["parts"]}
        out = [f"{kind}/{n}" for kind in ("rows", "gone") for n, *_ in files.listed(self.spark, f"{self.path}/{kind}") if f"{kind}/{n}" not in named]
        for p in out:
            files.removed(self.spark, f"{self.path}/{p}")
        for v in set(self.versions()) - set(kept):
            files.removed(self.spark, f"{self.path}/_commits/{v:08d}.json")
        return out

    # reading

    def _part(self, p: dict, only: Column | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{p['path']}")
        return rows.filter(only) if only is not None and BUCKET in p["folders"] else rows

    def only(self, values: DataFrame) -> Column:
        """A condition on folders that leaves those with the values of the bucketed column: at most as many numbers as there are buckets reach the driver."""
        got = values.select(self._bucket(F.col(self.buckets[0])).alias("b")).distinct().collect()
        return F.col(BUCKET).isin(sorted(r["b"] for r in got))

    def read(self, version: int | None = None, only: Column | None = None) -> DataFrame | None:
        """The rows of a version (the newest); None if it holds no part. only: as from only(), reads these folders."""
        parts = self.commit(version)["parts"]
        rows = [p for p in parts if p["kind"] == "rows"]
        if not rows:
            return None
        first = min(p["seq"] for p in rows)
        later: dict[str, list[DataFrame]] = {}
        for p in parts:
            if p["seq"] > first:
                later.setdefault(p["on"], []).append(self._part(p, only).select(F.col(p["on"]).alias("_on"), F.lit(p["seq"]).alias("_last")))
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self._part(p, only).withColumn("_seq", F.lit(p["seq"])) for p in rows))
        for on, marks in later.items():
            last = reduce(DataFrame.unionByName, marks).groupBy("_on").agg(F.max("_last").alias("_last"))
            out = out.join(last, F.col(on) == F.col("_on"), "left").filter(F.col("_last").isNull() | (F.col("_last") <= F.col("_seq"))).drop("_on", "_last")
        return out.drop("_seq", BUCKET)
