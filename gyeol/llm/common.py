"""Plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by the cluster.

    Only a session that runs in one process, as in tests, may go without the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gyeol-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder; what follows doesn't depend on any executor's disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_made: contextvars.ContextVar[list[str]] = contextvars.ContextVar("tables", default=[])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end, when what reads them must be done."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            remove(spark, path)
        _made.reset(token)


def stored(df: DataFrame, *by: str) -> str:
    """The path of the rows as a Parquet table in the shared folder, with a folder for each value of ``by``."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _made.get().append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and the planner knows its size."""
    path = stored(df)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def give_back() -> None:
    """Return freed memory to the system: a worker waits beside the others for its next task, and keeps what it has."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, of rows that have a doc_id and a text."""
    return docs.select("doc_id", *columns).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
