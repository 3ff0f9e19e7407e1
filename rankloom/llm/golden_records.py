"""Golden records: one record a cluster of client rows, by rules of survivorship, with map-side dominance pruning.

Each task keeps, of the rows of a cluster that it holds, only those that can still win a slot: the newest row; the newest with
a segment; for each source the newest with an e-mail, and with the longest name; for each segment the newest with a
balance; the best address. Newest is RECENT: latest updated_at (null last), higher trust, smaller client_id. Within one
source the newest row is fresh if any is, so which rows are stale need not be known yet. Tasks also send, for each cluster, the number of rows, of rows that are stale beside the task's own latest, and the times of the others with their
counts. Only these survivors are shuffled; pandas then takes many clusters at a time, dealt by a hash of the cluster.

A cluster of more than HOT survivors and times (at most 1/SHARE of all, so at most SHARE such clusters) goes another way: its
survivors are pruned again in a tree of FAN tasks' rows a node, and its times are counted by time first and then held against its
latest, which is broadcast (SHARE rows at most). Nothing that grows with a cluster meets in one task.

Defined results: a row without master_id and client_id belongs to the cluster null; an unknown or null source has the least
trust; a null updated_at is stale and last. Rows that tie in all of RECENT are taken in the order of the values of name, email, segment,
city, nation_id, balance (nulls last), so repeated rows and ties give the same record always. A balance that is not finite, or
beyond 9e16, counts as null. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import TimestampType

from .common import alone, bounded, saved

#: Sources by falling trust; any other comes after these.
SOURCES = ("store", "crm", "partner", "web")
STALE_AFTER = 10 * 24 * 3600 * 1_000_000
#: Rows that a task holds before it prunes them; the rows of one group of pandas, about.
HELD, GROUP = 1 << 16, 50_000
HOT, SHARE, FAN = 1024, 100_000, 16
LAST = np.iinfo(np.int64).max
#: What tells rows apart that tie in RECENT.
VALUES = ("name", "email", "segment", "city", "nation_id", "cents")
SURVIVOR = "cluster_id long, client_id long, at long, trust long, name string, email string, segment string, city string, nation_id long, cents long, n long, stale long, part long, times array<struct<at:long,n:long>>"
RECORD = "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id long, balance_cents long, name_from long, email_from long, segment_from long, balance_from long, address_from long"


def prepared(clients: DataFrame) -> DataFrame:
    """The columns that records need: blank strings as null, times in microseconds, balances in cents, sources as places in SOURCES."""

    def filled(name: str):
        c = F.col(name).cast("string")
        return F.when(~c.rlike(r"^[\x20\x09-\x0D]*$"), c)

    stamp = isinstance(clients.schema["updated_at"].dataType, TimestampType)
    at = F.unix_micros("updated_at") if stamp else F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(updated_at AS TIMESTAMP_NTZ))")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCES)), filled("source")), F.lit(0))
    money = F.col("balance").cast("double")
    return clients.select(
        F.coalesce(F.col("master_id").cast("long"), F.col("client_id").cast("long")).alias("cluster_id"),
        F.col("client_id").cast("long").alias("client_id"),
        at.cast("long").alias("at"),
        F.when(place > 0, place - 1).otherwise(len(SOURCES)).cast("long").alias("trust"),
        *(filled(c).alias(c) for c in ("name", "email", "segment", "city")),
        F.col("nation_id").cast("long").alias("nation_id"),
        F.when(F.abs(money) < 9e16, F.floor(100 * money + 0.5)).cast("long").alias("cents"),
    )


def _whole(s: pd.Series, null: int = LAST) -> np.ndarray:
    return s.fillna(null).to_numpy(np.int64)


class Ordered:
    """Rows of clusters in the order RECENT, and picks from them."""

    def __init__(self, rows: pd.DataFrame):
        code = pd.factorize(rows["cluster_id"], use_na_sentinel=False)[0]
        at = _whole(rows["at"], -LAST)
        keys = [_whole(rows["client_id"]), _whole(rows["trust"]), -at, code]
        order = np.lexsort(keys)
        same = np.ones(max(len(order) - 1, 0), bool)
        for k in keys:
            same &= np.diff(k[order]) == 0
        if same.any():
            ties = [np.where(rows[v].isna(), LAST, pd.factorize(rows[v], sort=True)[0]) for v in reversed(VALUES)]
            order = np.lexsort([*ties, *keys])
        self.rows, self.code, self.at = rows.take(order).reset_index(drop=True), code[order], at[order]
        self.first = np.flatnonzero(np.diff(self.code, prepend=-1))
        self.latest = self.at[self.first][self.code_rank()]

    def code_rank(self) -> np.ndarray:
        """The number of each row's cluster, from 0 in this order."""
        return np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.code))))

    def old(self, at: np.ndarray, latest: np.ndarray) -> np.ndarray:
        """Whether times (-LAST: none) are stale beside their cluster's latest."""
        return (at == -LAST) | (at < np.maximum(latest, STALE_AFTER - LAST) - STALE_AFTER)

    def picks(self, holds: np.ndarray, *before: np.ndarray, split: np.ndarray | None = None) -> np.ndarray:
        """Of the rows that hold something, the first of each cluster (and split) by the keys in before, then in the order RECENT."""
        at = np.flatnonzero(holds)
        group = [self.code[at]] if split is None else [split[at], self.code[at]]
        at = at[np.lexsort([*(k[at] for k in reversed(before)), *group])]
        new = np.zeros(len(at), bool)
        new[:1] = True
        for k in (self.code,) if split is None else (self.code, split):
            new[1:] |= np.diff(k[at]) != 0
        return at[new]

    def lengths(self) -> np.ndarray:
        return _whole(self.rows["name"].str.len(), 0)

    def filled(self) -> np.ndarray:
        return self.rows["city"].notna().to_numpy().astype(np.int64) + self.rows["nation_id"].notna().to_numpy()

    def winners(self) -> np.ndarray:
        """Which rows can win a slot of their cluster, whatever rows other tasks hold."""
        r, won = self.rows, np.zeros(len(self.code), bool)
        trust, has = _whole(r["trust"]), {c: r[c].notna().to_numpy() for c in ("name", "email", "segment", "cents")}
        segment = pd.factorize(r["segment"], use_na_sentinel=False)[0]
        won[self.first] = True
        won[self.picks(has["segment"])] = True
        won[self.picks(has["email"], split=trust)] = True
        won[self.picks(has["name"], -self.lengths(), split=trust)] = True
        won[self.picks(has["cents"], split=segment)] = True
        won[self.picks(np.ones(len(won), bool), -self.filled())] = True
        return won

    def column(self, name: str, at: np.ndarray, holds: np.ndarray | None = None) -> pd.Series:
        """A column of one row a cluster: of the picked rows (where they hold something), else null."""
        out = pd.Series(np.full(len(self.first), -1), dtype=np.int64)
        at = at if holds is None else at[holds[at]]
        out.iloc[self.code_rank()[at]] = at
        return self.rows[name].reindex(out).reset_index(drop=True)

    def records(self) -> pd.DataFrame:
        """One record a cluster."""
        r, trust = self.rows, _whole(self.rows["trust"])
        old = self.old(self.at, self.latest).astype(np.int64)
        has = {c: r[c].notna().to_numpy() for c in ("name", "email", "segment", "cents")}
        segment = self.picks(has["segment"])
        name, email = self.picks(has["name"], -self.lengths(), old, trust), self.picks(has["email"], old, trust)
        chosen = pd.factorize(pd.concat([r["segment"], self.column("segment", segment)]), use_na_sentinel=False)[0]
        other = (chosen[: len(r)] != chosen[len(r) :][self.code_rank()]).astype(np.int64)
        cents, address = self.picks(has["cents"], other), self.picks(np.ones(len(r), bool), -self.filled())
        n, stale = (pd.Series(np.add.reduceat(_whole(r[c], 0), self.first)) for c in ("n", "stale"))
        return pd.DataFrame({
            "cluster_id": r["cluster_id"].take(self.first).reset_index(drop=True), "n_records": n, "n_stale": stale + self._late(),
            "name": self.column("name", name), "email": self.column("email", email), "segment": self.column("segment", segment),
            "city": self.column("city", address), "nation_id": self.column("nation_id", address), "balance_cents": self.column("cents", cents),
            "name_from": self.column("client_id", name), "email_from": self.column("client_id", email), "segment_from": self.column("client_id", segment),
            "balance_from": self.column("client_id", cents), "address_from": self.column("client_id", address, self.filled() > 0),
        })

    def _late(self) -> np.ndarray:
        """How many rows behind the times that came with the survivors are stale beside the latest of all."""
        times = self.rows["times"]
        size = times.map(lambda t: 0 if t is None else len(t)).to_numpy(np.int64)
        if not size.sum():
            return np.zeros(len(self.first), np.int64)
        pairs = [(e["at"], e["n"]) for t in times[size > 0] for e in t]
        at, n = np.array(pairs, np.int64).T
        rank = np.repeat(self.code_rank(), size)
        return np.bincount(rank, n * self.old(at, self.latest[self.first][rank]), len(self.first)).astype(np.int64)


def _frame(table: pa.Table | pa.RecordBatch) -> pd.DataFrame:
    """Whole numbers stay so where some are null."""
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def _sent(rows: pd.DataFrame, shape: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split(" ") for f in shape.split(", ")]
    pair = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
    return pa.table({n: pa.array(rows[n], kinds.get(k, pair), from_pandas=True) for n, k in fields})


def summary(rows: pd.DataFrame, part: int) -> pa.Table:
    """Survivors of a task's rows; on the first of each cluster the number of rows, of stale ones, and the times of the others."""
    o = Ordered(rows)
    old, rank, won = o.old(o.at, o.latest), o.code_rank(), o.winners()
    fresh = np.flatnonzero(~old)  # by cluster and falling time
    start = np.flatnonzero((np.diff(rank[fresh], prepend=-1) != 0) | (np.diff(o.at[fresh], prepend=LAST) != 0))
    count, at, of = np.diff(np.append(start, len(fresh))), o.at[fresh[start]], rank[fresh[start]]
    numbers = np.zeros((3, len(rank)), np.int64)
    numbers[:, o.first] = np.bincount(rank), np.bincount(rank, old), np.bincount(of, minlength=len(o.first))
    n, stale, size = numbers[:, won]
    pairs = pa.StructArray.from_arrays([pa.array(at), pa.array(count)], ["at", "n"])
    out = _sent(o.rows[won].assign(n=n, stale=stale, part=part, times=None), SURVIVOR)
    return out.set_column(out.schema.get_field_index("times"), "times", pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pairs))


def _survivors(batches):
    alone("golden")
    part, held, n = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield from summary(_frame(pa.Table.from_batches(held)), part).to_batches()
            held, n = [], 0
    if n:
        yield from summary(_frame(pa.Table.from_batches(held)), part).to_batches()


def _pruned(table: pa.Table) -> pa.Table:
    """Survivors of survivors; their numbers are summed on the first of each cluster."""
    o = Ordered(_frame(table))
    sums = np.zeros((2, len(o.code)), np.int64)
    sums[:, o.first] = [np.add.reduceat(_whole(o.rows[c], 0), o.first) for c in ("n", "stale")]
    return _sent(o.rows.assign(n=sums[0], stale=sums[1], times=None)[o.winners()], SURVIVOR)


def _records(table: pa.Table) -> pa.Table:
    return _sent(Ordered(_frame(table)).records(), RECORD)


def golden(clients: DataFrame) -> DataFrame:
    """One record a cluster of (client_id, master_id, source, updated_at, name, email, city, nation_id, segment, balance); client_id is any whole number."""
    bounded(clients)
    found = saved(prepared(clients).mapInArrow(_survivors, SURVIVOR), "survivors")
    size = 1 + F.coalesce(F.size("times"), F.lit(0))
    total = found.agg(F.sum(size).alias("n")).first()["n"] or 0
    groups = max(1, -(-total // GROUP))
    of = F.pmod(F.xxhash64("cluster_id"), F.lit(groups)).alias("group")
    hot = found.groupBy("cluster_id").agg(F.sum(size).alias("size")).filter(F.col("size") > max(HOT, total // SHARE)).select(F.col("cluster_id").alias("hot_id"))
    hot = saved(hot, "hot")
    if hot.isEmpty():
        return found.groupBy(of).applyInArrow(_records, RECORD)
    match = F.col("cluster_id").eqNullSafe(F.col("hot_id"))
    cold = found.join(F.broadcast(hot), match, "left_anti")
    rows = found.join(F.broadcast(hot), match, "left_semi")
    latest = rows.groupBy("cluster_id").agg(F.max("at").alias("latest")).withColumnRenamed("cluster_id", "hot_id")
    times = rows.select("cluster_id", F.explode("times").alias("t")).groupBy("cluster_id", "t.at").agg(F.sum("t.n").alias("n"))
    stale = F.when(F.col("at") < F.col("latest") - STALE_AFTER, F.col("n")).otherwise(0)
    late = times.join(F.broadcast(latest), match).groupBy("cluster_id").agg(F.sum(stale).alias("late"))
    tasks = found.agg(F.max("part").alias("n")).first()["n"] + 1
    while tasks > 1:
        tasks = -(-tasks // FAN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        rows = rows.groupBy(of, "part").applyInArrow(_pruned, SURVIVOR)
    late = late.withColumnRenamed("cluster_id", "hot_id")
    first = rows.groupBy(of).applyInArrow(_records, RECORD)
    done = first.join(F.broadcast(late), match, "left").withColumn("n_stale", F.col("n_stale") + F.coalesce("late", F.lit(0))).drop("late", "hot_id")
    return cold.groupBy(of).applyInArrow(_records, RECORD).unionByName(done)


#: The same in SQL, with the clusters' latest as a window.
ORACLE = r"""
WITH a AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at AS upd, nation_id, balance,
  CASE WHEN regexp_full_match(name, '[\x20\x09-\x0D]*') THEN NULL ELSE name END AS name, CASE WHEN regexp_full_match(email, '[\x20\x09-\x0D]*') THEN NULL ELSE email END AS email,
  CASE WHEN regexp_full_match(segment, '[\x20\x09-\x0D]*') THEN NULL ELSE segment END AS segment, CASE WHEN regexp_full_match(city, '[\x20\x09-\x0D]*') THEN NULL ELSE city END AS city,
  coalesce(list_position(['store', 'crm', 'partner', 'web'], source), 5) AS trust FROM clients),
b AS (SELECT *, upd IS NULL OR upd < max(upd) OVER (PARTITION BY cluster_id) - INTERVAL 240 HOUR AS stale, row_number() OVER (PARTITION BY cluster_id ORDER BY upd DESC NULLS LAST, trust, client_id) AS recent FROM a),
s AS (SELECT cluster_id, arg_min(segment, recent) AS segment, arg_min(client_id, recent) AS segment_from FROM b WHERE segment IS NOT NULL GROUP BY cluster_id),
n AS (SELECT cluster_id, name, client_id AS name_from FROM b WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY length(name) DESC, stale, trust, recent) = 1),
e AS (SELECT cluster_id, email, client_id AS email_from FROM b WHERE email IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, recent) = 1),
m AS (SELECT b.cluster_id, CAST(floor(100 * balance + 0.5) AS BIGINT) AS balance_cents, client_id AS balance_from FROM b LEFT JOIN s ON b.cluster_id = s.cluster_id WHERE balance IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY b.cluster_id ORDER BY b.segment IS DISTINCT FROM s.segment, recent) = 1),
p AS (SELECT cluster_id, city, nation_id, CASE WHEN city IS NOT NULL OR nation_id IS NOT NULL THEN client_id END AS address_from FROM b
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT DESC, recent) = 1),
c AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (WHERE stale) AS n_stale FROM b GROUP BY cluster_id)
SELECT c.cluster_id, n_records, n_stale, name, email, segment, city, CAST(nation_id AS BIGINT) AS nation_id, balance_cents, name_from, email_from, segment_from, balance_from, address_from
FROM c LEFT JOIN s USING (cluster_id) LEFT JOIN n USING (cluster_id) LEFT JOIN e USING (cluster_id) LEFT JOIN m USING (cluster_id) LEFT JOIN p USING (cluster_id)
"""
