"""Incremental runs: files and responses as streams (an extension of the batch engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_table_stream(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 64) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def usage_windows(attempts: DataFrame, *, late: str = "7 days", width: str = "1 hour") -> DataFrame:
    """Tries, tokens and errors by provider and hour of attempt; rows later than ``late`` are left out, state is bounded by it."""
    return (
        attempts.withColumn("attempted_at", F.col("attempted_at").cast("timestamp"))
        .withWatermark("attempted_at", late)
        .groupBy(F.window("attempted_at", width).alias("w"), "provider")
        .agg(F.count("*").alias("attempts"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.count_if(~F.col("ok")).alias("errors"))
        .select(F.col("w.start").alias("hour"), "provider", "attempts", "tokens", "errors")
    )


def dedup_stream(rows: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Repeats of a key dropped, with state kept only for the lateness allowed."""
    return rows.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def incremental(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch step over what is new and appends it, each batch once under its number."""

    def write(batch: DataFrame, n: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
