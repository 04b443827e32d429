"""Structured Streaming: case state and owed work over a file stream of events, equal to the batch folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(query) -> None:  # noqa: ANN001
    """Starts a writer with the trigger for what is there, and waits."""
    query.trigger(availableNow=True).start().awaitTermination()


def stream_state(events: DataFrame, case: str, order: Column, value: Column, path: str) -> DataFrame:
    """Latest value and number of events of each case, kept by a stateful aggregation; returns the final table.

    In update mode each micro-batch gives the cases that changed, which are written under their batch number, so that a
    repeated batch replaces itself; the state of a case is that of its last batch.  No state reaches the driver.
    """
    state = events.groupBy(case).agg(F.max_by(value, order).alias("latest"), F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    run_available(state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint"))
    kept = events.sparkSession.read.schema(state.schema.add("batch", "long")).option("basePath", f"{path}/state").parquet(f"{path}/state")
    return kept.groupBy(case).agg(F.max_by("latest", "batch").alias("latest"), F.max_by("n", "batch").alias("n"))


def stream_append(events: DataFrame, append: Callable[[DataFrame], object], checkpoint: str) -> None:
    """Each micro-batch through an idempotent append, so that a repeated batch changes nothing."""
    run_available(events.writeStream.foreachBatch(lambda batch, _id: append(batch)).option("checkpointLocation", checkpoint))


def live_sessions(events: DataFrame, key: str, at: str, ttl: str, late: str = "0 seconds") -> DataFrame:
    """State that expires: events of a key belong together while no gap is longer than ``ttl``; closed groups come out
    with start, end and count, and their state goes once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, ttl).alias("live")).agg(F.count("*").alias("n")).select(key, F.col("live.start").alias("first_at"), F.col("live.end").alias("expires_at"), "n")
