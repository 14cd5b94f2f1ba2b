"""Tables written once into the folder that the whole cluster shares, so that a plan can be cut there.

A written table survives lost executors (unlike a local checkpoint), is columnar, and carries true sizes for the
planner: a small one is broadcast because its size is known, a large one never is.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a lookup that may be broadcast, at 24 a row and 8 a column more (24 for strings).
LOOKUP_BYTES = 16 << 20
_own: dict[str, str] = {}
#: Of each thread, what its open scopes hold.
_local = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and the master is local (tests), a temporary folder
    of this machine. A cluster that names none fails, as its machines would not see each other's folders."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lodegauge-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared root, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/lodegauge/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to a fresh shared folder and return it as read from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for held in getattr(_local, "scopes", []):
        held.append(out)
    return out


def lookup(df: DataFrame) -> DataFrame:
    """A narrow written table to be joined to wide rows: marked for broadcast if it is counted to have at most
    LOOKUP_BYTES, and left to the planner (an exchange of both sides) beyond that. Strings should be short names."""
    row = 24 + sum(24 if kind == "string" else 8 for _, kind in df.dtypes)
    return F.broadcast(df) if df.count() * row <= LOOKUP_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """A table as it is scanned, or, where the scan has fewer partitions than the cluster has cores (a small table in one
    file would keep one of them busy), its rows dealt to as many. Large tables are never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


@contextlib.contextmanager
def settings(spark: SparkSession, given: dict[str, str]):
    """The session's settings while a job is planned and run; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def released(spark: SparkSession):
    """Jobs that run inside leave no shuffle files when they are done: else these stay until the driver happens to collect its garbage, and
    steps that write what the next ones read add theirs up."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


@contextlib.contextmanager
def scope():
    """Delete the tables that this thread writes inside, at the end, but for those passed to what this yields:
    keep(*frames)."""
    held: list[DataFrame] = []
    kept: list[DataFrame] = []
    scopes = _local.scopes = getattr(_local, "scopes", [])
    scopes.append(held)
    try:
        yield lambda *frames: kept.extend(frames)
    finally:
        scopes.pop()
        paths = {df.__dict__.get("_scratch_path") for df in kept}
        drop(*(df for df in held if df.__dict__.get("_scratch_path") not in paths))


def drop(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more. Frames that written() did not return are left alone."""
    for df in frames:
        path = df.__dict__.pop("_scratch_path", None)
        if path:
            context = df.sparkSession.sparkContext
            hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
