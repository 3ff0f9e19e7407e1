"""Paths in whichever store they lie: the shared working folder, listing, whole small files, removal."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, whichever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change of what lies in a folder, by name; nothing where there is no folder."""
    p, fs = hadoop(spark, path)
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)) if fs.exists(p) else []


def removed(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    p, fs = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file as a whole, under a name that nothing has yet: it is written aside and moved, so no reader sees a part of it. FileExistsError if another writer was first."""
    jvm = spark.sparkContext._jvm
    target, fs = hadoop(spark, path)
    aside, _ = hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(aside, False)
        raise FileExistsError(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(aside, target, how)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(target):
            raise FileExistsError(path) from e
        raise


_workspaces: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A folder of this application below the shared one of spark.checkpoint.dir, removed when the process ends. Where none is set a temporary one serves a local session; on a cluster that is an error, as its machines would not see each other's files."""
    sc = spark.sparkContext
    if sc.applicationId not in _workspaces:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = tempfile.mkdtemp(prefix="rankloom-")
        path = f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"
        _workspaces[sc.applicationId] = path
        atexit.register(_forget, spark, path)
    return _workspaces[sc.applicationId]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        removed(spark, path)
    except Exception:  # the session may be over
        return


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the workspace that nothing has yet."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """df as a written table of the workspace: its lineage ends there, and branches that read it do not compute it again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
