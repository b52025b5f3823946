"""Shared storage: where tables that cut lineage, archives and checkpoints go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only a local-mode session, where one
    machine runs everything, may fall back on a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders of the scratch scopes that are open, the innermost last.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the innermost scratch scope, or with ``keep`` in the one around it; without a scope in the shared folder."""
    open_scopes = _scopes.get()[:-1] if keep else _scopes.get()
    return f"{open_scopes[-1] if open_scopes else shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch paths inside is deleted at the end, but for what is kept.

    A plan that reads such tables must have been written or collected by then.
    """
    path = scratch_path(spark, "scope")
    token = _scopes.set((*_scopes.get(), path))
    try:
        yield
    finally:
        _scopes.reset(token)
        remove(spark, path)


#: Spark's setting that shuffle files go at the end of the statement that made them.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, so a lost executor costs a reread.

    Inside a scratch scope the table goes with it, unless it is to be kept.  What was shuffled on the way goes as soon as the table is
    written, not when the driver happens to collect its garbage: nothing reads it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)
