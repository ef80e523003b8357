"""Incremental ingest: files as they arrive, filtered, each text once, appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import digest
from ..operators.filters import Transform


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder; files_per_batch bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def once(df: DataFrame, event_time: str | None = None, late: str = "7 days") -> DataFrame:
    """Each normalised text once; with an event time the state forgets what is older than ``late``."""
    x = df.withColumn("_d", digest())
    x = x.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["_d"]) if event_time else x.dropDuplicates(["_d"])
    return x.drop("_d")


def per_window(df: DataFrame, event_time: str, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """Records and characters per window and source, late rows within ``late`` counted."""
    x = df.withWatermark(event_time, late).groupBy(F.window(event_time, size), F.coalesce("source", F.lit("unknown")).alias("source"))
    return x.agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))


def ingest(df: DataFrame, steps: Transform, out: str, checkpoint: str, event_time: str | None = None) -> StreamingQuery:
    """Runs what has arrived through the steps and dedup, appends Parquet, and stops; state and offsets stay in checkpoint."""
    return once(steps(df), event_time).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
