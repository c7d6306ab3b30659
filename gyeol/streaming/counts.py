"""Additive training on a stream: token counts as a complete-mode aggregation.

Counts add up, so this is the part of training that streams; scores are batch queries
over the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import split_words


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 100) -> DataFrame:
    """Documents from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """tok, n; on a stream and on a table alike."""
    return docs.select(F.explode(split_words(text)).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each trigger writes a version of the table at path, so a failed one leaves the version before it; state lives at checkpoint, which executors must share."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that was written whole (Parquet marks it when it ends)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        raise ValueError(f"no version at {path}")
    newest = max(int(f.getPath().getParent().getName().split("=")[1]) for f in found)
    return spark.read.parquet(f"{path}/version={newest}")
