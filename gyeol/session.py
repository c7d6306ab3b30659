"""A session with the settings the engine is designed for, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """AQE on (coalescing and skew joins), Arrow on, UTC; other settings by keyword, dots as double underscores."""
    b = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: Where the tables of ``cut`` lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the folder that spark.checkpoint.dir names: lineage ends there.

    Compressed columns take a fraction of a checkpoint's serialised rows.  Only a one-process session may go without the setting.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gyeol-")
        context.setCheckpointDir(named)
    path = f"{named}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing reads any more."""
    if path := _PATHS.pop(df, None):
        context = df.sparkSession.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
