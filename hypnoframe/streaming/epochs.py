"""Structured Streaming counterparts: event-time epochs, gap sessions and a stateful running baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def epoch_stats(events: DataFrame, length: str = "1 hour", step: str | None = None, late: str = "2 hours") -> DataFrame:
    """Tumbling or sliding epochs per channel; epochs close ``late`` after their end."""
    w = F.window("ts", length, step) if step else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("ch")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Contiguous segments per recording: a session ends after ``gap`` without a sample."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("seg"), F.col("user_id").alias("id")).agg(F.count("*").alias("n"))


def running_baseline(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Per channel and batch, the running mean and variance so far: state is three numbers a key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, parts, state):
        n, s, q = state.get if state.exists else (0, 0.0, 0.0)
        for p in parts:
            n, s, q = n + len(p), s + float(p["value"].sum()), q + float((p["value"] ** 2).sum())
        state.update((n, s, q))
        yield pd.DataFrame({"ch": [key[0]], "n": [n], "mean": [s / n], "var": [max(q / n - (s / n) ** 2, 0.0)]})

    return events.groupBy(F.col("event_type").alias("ch")).applyInPandasWithState(update, "ch string, n long, mean double, var double", "n long, s double, q double", "update", GroupStateTimeout.NoTimeout)
