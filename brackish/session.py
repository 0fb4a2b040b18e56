"""Session settings and the shared scratch area."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Settings every query relies on. The method limit is the size up to which the JVM compiles a
# method: wider generated code would run interpreted, so Spark should split it instead.
QUERY_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session made elsewhere."""
    for key, value in QUERY_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "brackish", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` wins over the defaults."""
    settings = {
        **QUERY_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (tests, a laptop) that names none gets a fresh folder. On a
    cluster each executor would write such a folder to its own disk, so that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and context.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="brackish-"))
    return root or context.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's derived tables, under the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/brackish-{spark.sparkContext.applicationId}"


#: Paths that `recording` blocks have seen made, the innermost block last.
_RECORDS: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one derived table."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    return path


@contextmanager
def recording() -> Iterator[list[str]]:
    """Collects the paths of the derived tables that are made inside of the block."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def remove_unread(spark: SparkSession, paths: Sequence[str], *readers: DataFrame) -> list[str]:
    """Remove those of the derived tables that none of the `readers` reads; the others come back."""
    read = {part for df in readers for f in df.inputFiles() for part in f.split("/")}
    left = []
    for name in paths:
        if name.rsplit("/", 1)[-1] in read:  # the name ends in an identifier of its own
            left.append(name)
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return left


def release(spark: SparkSession) -> None:
    """Remove the derived tables this application has written.

    Call it when the results that were built from them have been written: a DataFrame that
    still reads one of them fails afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder so that later passes read stable rows."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write a derived table to the shared scratch area and read it back.

    The planner then knows its real size: a small one is broadcast by the session's own
    threshold, so the large side of the join is not shuffled; a large one is sorted. The
    table is also computed once, however often it is used.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
