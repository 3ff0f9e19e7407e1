"""What the operators of this subpackage share: saved tables, Arrow mapping and word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, object] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one is set only where none is, and only for a local session: on a cluster its machines would not see each other's files."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="rankloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be over; the cluster empties the folder then
        return


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and returns a reader: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/rankloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if path not in _made:
        _made[path] = atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that ended in a saved table; it acts when the driver collects garbage, else only every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_saved(df: DataFrame) -> None:
    """Deletes the files of a table that saved() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/rankloom-" in path:
            _forget(df.sparkSession, path)


_at_work: list = [None, []]


def alone(what: str) -> None:
    """Called as a task's Python part begins: if this worker's last task did other work, what that kept is dropped and its memory given back."""
    if _at_work[0] != what:
        for drop in _at_work[1]:
            drop()
        _at_work[:] = [what, []]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)


def on_leaving(drop) -> None:
    """What drops the things that the worker keeps from task to task, for when other work begins."""
    _at_work[1].append(drop)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold while the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Bytes of an Arrow batch that goes to Python, at most: rows may be whole documents, and by default their number alone is bounded closely.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches of the session that will run df; a smaller bound stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batches, name: str = "text", limit: int = 8 << 20):
    """Cuts record batches so that each holds about limit bytes of the named column at most; a longer single row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts as large strings, null as empty, in buffers of their own: some kernels misread strings that do not begin at their buffer's start."""
    return pc.fill_null(column(batch, name).take(pa.array(np.arange(batch.num_rows))).cast(pa.large_string()), "")


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cases A-Z and splits at [\\x20\\x09-\\x0D]: the words of all rows as one array, and each row's first and last place in it (n + 1 offsets)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    values, ends = split.values, split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(values), 0)
    keep = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return values.filter(full), keep[ends]


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Distinct values, and for each value its place among them."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain constants of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
