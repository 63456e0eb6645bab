"""Streaming forms of the cohort: sources, first triggers, sessions and windowed counts with late events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of a folder as they arrive; the batch size bounds a trigger's work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_triggers(events: DataFrame, relation: Column, key: str = "pr_id", time: str = "interaction_dt", tie: str = "event_id") -> DataFrame:
    """The least qualifying event of each item so far: one row of state per item, for update or complete mode."""
    first = F.min(F.struct(F.col(time).alias("trigger_dt"), F.col(tie).alias("trigger_event_id")))
    return events.filter(relation).groupBy(key).agg(first.alias("f")).select(key, "f.*")


def sessions(events: DataFrame, gap: str, late: str, key: str = "pr_id", time: str = "interaction_dt") -> DataFrame:
    """Sessions that close once the watermark passes them; events later than ``late`` are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("start_dt"), F.col("w.end").alias("end_dt"), "n_events")


def windowed_counts(events: DataFrame, length: str, late: str, *keys: str, slide: str | None = None, time: str = "interaction_dt") -> DataFrame:
    """Events per tumbling or sliding window and keys."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, length, slide or length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("start_dt"), F.col("w.end").alias("end_dt"), *keys, "n_events")


def once_each(events: DataFrame, late: str, keys: list[str], time: str = "interaction_dt") -> DataFrame:
    """Events without repeats that arrive within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work through what has arrived, write it to Parquet and stop; the checkpoint lets the next call go on from there.

    Append mode adds files. In complete and update mode each batch overwrites a
    folder of its own number, so that a batch that is run again leaves no rows twice.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that complete mode has written last."""
    every = spark.read.parquet(path)
    return every.filter(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")
