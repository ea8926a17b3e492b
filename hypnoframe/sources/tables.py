"""Views of the driver's tables as recordings: events as samples and annotations, orders as intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts: Column) -> Column:
    """Nanoseconds from 1970-01-01 of a timestamp's wall clock, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (days * 86_400_000_000 + (F.hour(ts).cast("long") * 3600 + F.minute(ts).cast("long") * 60) * 1_000_000 + micros) * 1000


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ch, t_ns, x, ix: a row per event; ix orders ties."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_type").alias("ch"), nanos(F.col("ts")).alias("t_ns"), F.col("value").alias("x"), F.col("event_id").alias("ix"))


def annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, class, start_ns, stop_ns: each event lasts as many minutes as its value."""
    s = samples(spark, sf_dir)
    return s.select("id", F.col("ch").alias("class"), F.col("t_ns").alias("start_ns"), (F.col("t_ns") + F.round(F.col("x") * 100).cast("long") * 600_000_000).alias("stop_ns"))


def hours(spark: SparkSession, sf_dir: str, t0: int) -> tuple[int, int]:
    """First hour (counted from ``t0``) and number of hours of the whole days that hold all events."""
    t = nanos(F.col("ts"))
    r = load(spark, sf_dir, "events").agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    if r["a"] is None:
        return 0, 24
    day = 86_400_000_000_000
    first, last = (r["a"] - t0) // day, (r["b"] - t0) // day
    return 24 * first, 24 * (last - first + 1)
