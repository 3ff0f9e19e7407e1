"""Vector code compression: product codes whose nearest entries are found through segment-mean lower bounds.

Components become integers floor(SCALE * x); vectors are cut into PARTS equal parts, each coded by the nearest of
at most ENTRIES codebook entries of its position. Codebooks are learned in ROUNDS rounds of integer k-means: each round
is one pass over the vectors, in which tasks send sums of each entry's parts (PARTS * ENTRIES rows of fixed size a
task) and never vectors; the driver holds the codebooks only, and broadcasts these.

Nearest entries: a part and an entry are cut into 1, 2, 4, ... blocks. For a block of n components,
n * (difference of means)^2 + (difference of residual norms)^2 never exceeds its squared distance, where the residual is
what stays once the mean is taken off. From coarse to fine, an entry goes once its bound, less a margin for rounding,
is above the exact distance of the entry that the coarsest bound puts first. What is left gets exact integer distances.

Defined results: a null vector, and one with a null or non-finite component, is dropped. A vector that cannot be cut
(no components, their number no multiple of PARTS or not that of the smallest kept vec_id's vector) or that has
a component beyond LARGEST takes no part in learning and comes back with null code and error; so do all if that first vector
cannot be cut. Null vec_ids sort last; equal vec_ids by their vectors. Fewer vectors than ENTRIES
give fewer entries. Repeated rows are coded each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import alone, bounded, column, saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components up to this keep the distances of vectors of up to 512 components within 64 bits.
LARGEST = 1 << 26
#: Vectors in one step of a task.
STEP = 4096
#: Labels, at most, whose sums are broadcast; more are joined by a shuffle in which each label is dealt over SALTS tasks.
LABELS, SALTS = 1 << 18, 16

Book = np.ndarray  # PARTS x entries x components of a part, int64


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (components as doubles), without null vectors and such with null or non-finite components."""
    bad: Column = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & ~bad)


def codable(v: Column, dimension: int) -> Column:
    """Whether a vector can be coded by codebooks of that dimension."""
    return (F.size(v) == dimension) & F.forall(v, lambda x: F.abs(F.floor(x * SCALE)) <= LARGEST)


def integers(v: pa.ListArray) -> np.ndarray:
    """Rows of scaled integers of a batch of vectors of one length."""
    return np.floor(v.flatten().to_numpy(zero_copy_only=False) * float(SCALE)).astype(np.int64).reshape(len(v), -1)


def blocks(size: int) -> list[np.ndarray]:
    """Starts of the blocks at each level, coarse to fine, for parts of that many components; whole parts first, blocks of at least two components last."""
    out, n = [], 1
    while size // n >= 2 or n == 1:
        out.append(np.unique(np.arange(n) * size // n))
        n *= 2
    return out


def summaries(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of the block's length, and residual norms, of each block along the last axis."""
    n = np.diff(np.append(starts, x.shape[-1]))
    total, square = np.add.reduceat(x, starts, axis=-1), np.add.reduceat(x * x, starts, axis=-1)
    if not fits(x):
        total, square = total.astype(np.float64), square.astype(np.float64)
    return total / np.sqrt(n), np.sqrt(np.maximum((n * square - total * total) / n, 0.0))


def fits(x: np.ndarray) -> bool:
    """Whether sums of squares times a block's length stay within 62 bits, so that residuals have no error but the root's."""
    return x.shape[-1] * float(np.abs(x).max(initial=0)) < 2.0**31


class Codebooks:
    """Codebooks with the block summaries of their entries."""

    def __init__(self, entries: Book):
        self.entries, self.exact = entries, fits(entries)
        self.levels = [(s, *summaries(entries, s)) for s in blocks(entries.shape[2])] if entries.size else []

    def assigned(self, x: np.ndarray, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry and the squared distance of each part of x (rows x PARTS x components); ties go to the lower index. seen: counts pairs, and those measured exactly."""
        n, parts, size = x.shape
        k = self.entries.shape[1]
        found = np.full((n * parts, k), np.iinfo(np.int64).max)
        flat, at = x.reshape(n * parts, size), np.tile(np.arange(parts), n)
        top = float(np.abs(x).max(initial=0)) + float(np.abs(self.entries).max(initial=0))
        margin = size * top * top * (1e-12 if fits(flat) and self.exact else 1e-6) + 1.0  # more than rounding can add to a bound
        bound = None
        for level, (starts, means, norms) in enumerate(self.levels):
            mine, rest = summaries(flat, starts)
            if level == 0:
                bound = ((mine[:, None, :] - means[at]) ** 2 + (rest[:, None, :] - norms[at]) ** 2).sum(2)
                first = bound.argmin(1)
                row = np.arange(n * parts)
                best = self._exact(flat, row, at, first)
                found[row, first] = best
                alive = bound - margin <= best[:, None]
                alive[row, first] = False
                row, entry = np.nonzero(alive)
            else:
                finer = ((mine[row] - means[at[row], entry]) ** 2 + (rest[row] - norms[at[row], entry]) ** 2).sum(1)
                keep = finer - margin <= best[row]
                row, entry = row[keep], entry[keep]
        found[row, entry] = self._exact(flat, row, at, entry)
        if seen is not None:
            seen["pairs"] = seen.get("pairs", 0) + n * parts * k
            seen["exact"] = seen.get("exact", 0) + n * parts + len(row)
        code = found.argmin(1)
        return code.reshape(n, parts), found[np.arange(n * parts), code].reshape(n, parts)

    def _exact(self, flat: np.ndarray, row: np.ndarray, at: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = flat[row] - self.entries[at[row], entry]
        return (d * d).sum(1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _steps(batches, name: str = "v"):
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            yield batch.slice(i, STEP)


def _sums(books):
    def run(batches):
        alone("codes")
        b: Codebooks = books.value
        parts, k, size = b.entries.shape
        total, count = np.zeros((parts * k, size), np.int64), np.zeros(parts * k, np.int64)
        for batch in _steps(batches):
            x = integers(column(batch, "v")).reshape(-1, parts, size)
            code = (b.assigned(x)[0] + np.arange(parts) * k).ravel()
            order = code.argsort(kind="stable")
            used, starts = np.unique(code[order], return_index=True)
            total[used] += np.add.reduceat(x.reshape(-1, size)[order], starts, axis=0)
            count += np.bincount(code, minlength=parts * k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, size)), pa.array(np.tile(np.arange(size), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], size))],
            ["entry", "place", "total", "n"],
        )

    return run


def _coded(books):
    def run(batches):
        alone("codes")
        b: Codebooks = books.value
        parts, _, size = b.entries.shape
        for batch in _steps(batches):
            code, error = b.assigned(integers(column(batch, "v")).reshape(-1, parts, size))
            text = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "label"), pa.array(text, pa.string()), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return run


def first_entries(rows: DataFrame) -> tuple[int, Book]:
    """The dimension and the entries that learning begins with; the dimension is 0 if the first vector cannot be cut. ENTRIES rows reach the driver."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").first()
    dimension = len(first["v"]) if first else 0
    if not dimension or dimension % PARTS:
        return 0, np.empty((PARTS, 0, 0), np.int64)
    got = rows.filter(codable(F.col("v"), dimension)).orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").toArrow()["v"].combine_chunks()
    if not len(got):
        return 0, np.empty((PARTS, 0, 0), np.int64)
    return dimension, integers(got).reshape(len(got), PARTS, -1).transpose(1, 0, 2).copy()


def fitted(rows: DataFrame, entries: Book, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after rounds of k-means over rows (v of one length) from entries; an entry that no part chose stays."""
    sc = rows.sparkSession.sparkContext
    parts, k, size = entries.shape
    for _ in range(rounds):
        books = sc.broadcast(Codebooks(entries))
        sums = rows.select("v").mapInArrow(_sums(books), "entry long, place long, total long, n long").groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        entry, place, total, n = (sums[c].to_numpy() for c in ("entry", "place", "total", "n"))
        entries = entries.copy()
        entries.reshape(parts * k, size)[entry, place] = total // n  # floors, also below 0
        books.unpersist()
    return Codebooks(entries)


def with_totals(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows (written) with the sum of value over equal keys, nulls together; sums of few keys are broadcast, those of many joined on a salted key, as one key may hold much of the table."""
    sums = saved(rows.groupBy(key).agg(F.sum(value).alias(out)), "totals").withColumnRenamed(key, "_key")
    if sums.count() <= LABELS:
        return rows.join(F.broadcast(sums), rows[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    spread = sums.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, salted[key].eqNullSafe(spread["_key"]) & (salted["_salt"] == spread["_at"]), "left").drop("_key", "_at", "_salt")


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of (vec_id, embedding, label)."""
    rows = kept(bounded(vectors))
    spark, kind = vectors.sparkSession, rows.schema["label"].dataType.simpleString()
    dimension, entries = first_entries(rows)
    if dimension:
        good = rows.filter(codable(F.col("v"), dimension))
        books = fitted(good, entries)
        digest = books.digest()
        out = good.mapInArrow(_coded(spark.sparkContext.broadcast(books)), f"vec_id long, label {kind}, code string, error long")
        bad = rows.filter(~codable(F.col("v"), dimension))
    else:
        digest, out, bad = hashlib.sha256(b"").hexdigest(), None, rows
    rest = bad.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = saved(rest if out is None else out.unionByName(rest), "codes")
    return with_totals(out, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same in SQL, with one step for each round; for vectors of one length only."""
    distance = "list_sum(list_transform(range(1, len(p.xs) + 1), lambda i: (p.xs[i] - c.xs[i]) * (p.xs[i] - c.xs[i])))"
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT r, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS xs FROM k, range(8) t(part))",
        "c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, xs FROM p WHERE r <= 16)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT p.r, p.part, min(struct_pack(d := {distance}, entry := c.entry)) AS best FROM p JOIN c{i} c ON p.part = c.part GROUP BY p.r, p.part)")
        if i < ROUNDS:
            steps.append(f"s{i} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY i) AS xs FROM (SELECT p.part, d.best.entry AS entry, u.i, CAST((sum(p.xs[u.i]) - ((sum(p.xs[u.i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM p JOIN d{i} d ON p.r = d.r AND p.part = d.part, LATERAL (SELECT unnest(range(1, len(p.xs) + 1)) AS i) u GROUP BY p.part, d.best.entry, u.i) GROUP BY part, entry)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(s.xs, c.xs) AS xs FROM c{i} c LEFT JOIN s{i} s ON c.part = s.part AND c.entry = s.entry)")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM d{ROUNDS} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN o ON k.r = o.r, h"
