"""Session settings, and written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dir: tempfile.TemporaryDirectory | None = None
_staged: list[str] = []
_scopes = threading.local()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are this process gets a temporary
    folder; a cluster is refused.
    """
    global _local_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_dir is None:
        _local_dir = tempfile.TemporaryDirectory(prefix="textloom-")
    return _local_dir.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, dropped with the staged tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    for scope in getattr(_scopes, "open", []):
        scope.append(path)
    return path


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that this thread stages inside, once the block is left.

    What is returned from the block must have been written elsewhere by then.
    """
    own: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), own]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
        _delete(spark, [p for p in own if p in _staged])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that its name belongs to."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a table feeds several later passes, so that its inputs are
    scanned once, and where a loop must cut its lineage. Lost executors only
    cost a re-read of the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    _delete(spark, [t.staged_path for t in tables])


def drop_staged(spark: SparkSession) -> int:
    """Delete all tables staged by this process, once nothing reads them any more."""
    return _delete(spark, list(_staged))


def _delete(spark: SparkSession, paths: list[str]) -> int:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _staged.remove(name)
    return len(paths)
