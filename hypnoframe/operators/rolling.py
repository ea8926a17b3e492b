"""Per-row window operators over ordered time, with the engine's edge rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, out: str = "ma") -> DataFrame:
    """Centred mean over an odd window; the first and last (size-1)/2 rows copy the nearest full window's mean."""
    if size % 2 == 0:
        raise ValueError("an odd window is needed")
    h = size // 2
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumns({"_rn": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys)), "_m": F.avg(value).over(w.rowsBetween(-h, h))})
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.nth_value("_m", h + 1).over(full)
    last = F.max(F.when(F.col("_rn") == F.col("_n") - h, F.col("_m"))).over(Window.partitionBy(*keys))
    ma = F.when(F.col("_n") < size, F.avg(value).over(Window.partitionBy(*keys))).when(F.col("_rn") <= h, first).when(F.col("_rn") > F.col("_n") - h, last).otherwise(F.col("_m"))
    return d.withColumn(out, ma).drop("_rn", "_n", "_m")


def median_filter(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, out: str = "md") -> DataFrame:
    """Running lower median; even sizes reach from -n/2 to n/2-1; frames are cut at the edges."""
    lo, hi = (-(size // 2), size // 2) if size % 2 else (-(size // 2), size // 2 - 1)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(lo, hi)
    v = F.sort_array(F.collect_list(value).over(w))
    return df.withColumn(out, F.element_at(v, F.floor((F.size(v) + 1) / 2).cast("int")))


def rolling_norm(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, out: str = "z") -> DataFrame:
    """Centred z-score in windows that are whole at the ends too.

    Before the first value stand once more the (size-1)/2 values that follow it, and
    after the last those that precede it, both in their order.  A group of fewer
    than (size+1)/2 values has no such window: null.
    """
    h = size // 2
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    # the places at which a row stands: its own, and one before or after all others
    before = F.when((F.col("_rn") > 1) & (F.col("_rn") <= h + 1), F.col("_rn") - 1 - h)
    after = F.when((F.col("_rn") >= F.col("_n") - h) & (F.col("_rn") < F.col("_n")), F.col("_rn") + h + 1)
    placed = d.withColumn("_at", F.explode(F.array_compact(F.array(F.col("_rn"), before, after))))
    win = w.orderBy("_at").rowsBetween(-h, h)
    z = F.try_divide(F.col(value) - F.avg(value).over(win), F.stddev_samp(value).over(win))
    return placed.withColumn(out, F.when(F.col("_n") > h, z)).where("_at = _rn").drop("_rn", "_n", "_at")


def difference(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "diff") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.col(value) - F.lag(value).over(w))


def shift(df: DataFrame, keys: list[str], order: list[str], value: str, by: int, wrap: bool = True, out: str = "shifted") -> DataFrame:
    """Values ``by`` rows earlier; with ``wrap`` the ends meet, by an equi-join on the row number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if not wrap:
        return df.withColumn(out, F.lag(value, by).over(w))
    d = df.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    src = d.select(*keys, F.pmod(F.col("_rn") + by, F.col("_n")).alias("_rn"), F.col(value).alias(out))
    return d.join(src, [*keys, "_rn"]).drop("_rn", "_n")


def accumulate(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "acc") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def quantile_dynamics(df: DataFrame, keys: list[str], order: list[str], value: str, nq: int = 10) -> DataFrame:
    """Means by ordered quantile of epochs, and the slope over epochs."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("q", F.ntile(nq).over(w)).groupBy(*keys, "q").agg(F.avg(value).alias("ss"), F.count("*").alias("n"))


def local_ratio(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 15, th: float = 2.0) -> DataFrame:
    """Ratio of a value to its moving average, flagged above ``th``."""
    d = moving_average(df, keys, order, value, size, "local")
    return d.withColumn("fac", F.try_divide(F.col(value), F.col("local"))).withColumn("flag", F.when(F.col("fac") > th, 1).otherwise(0))


def peaks(df: DataFrame, keys: list[str], order: list[str], value: str, w: int = 2) -> DataFrame:
    """Rows strictly above all others within ``w`` rows on each side."""
    o = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.max(value).over(o.rowsBetween(-w, -1)), F.max(value).over(o.rowsBetween(1, w))
    return df.withColumn("_pk", (F.col(value) > before) & (F.col(value) > after)).where("_pk").drop("_pk")


def threshold_runs(df: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """Runs of consecutive rows where ``hit`` holds: keys, run, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_h", F.coalesce(hit, F.lit(False)))
    d = d.withColumn("run", F.sum(F.when(F.col("_h") & ~F.coalesce(F.lag("_h").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    return d.where("_h").groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
