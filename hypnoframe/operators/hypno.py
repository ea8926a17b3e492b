"""Stages and hypnogram statistics over an epoch table (id, e, stage)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypnoframe.operators import intervals as iv

STAGES = ["W", "N1", "N2", "N3", "R", "?", "L"]
SLEEP, NREM = ["N1", "N2", "N3", "R"], ["N1", "N2", "N3"]


def staged(eps: DataFrame, annots: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """Stage of each epoch from annotations: `?` if none, or if several differ (conflict = 1)."""
    a = annots.where(F.col("class").isin(stages)).select("id", F.col("class").alias("s"), F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
    hit = iv.range_join(eps.select("id", "e", "start_ns", "stop_ns"), a, ["id"]).groupBy("id", "e").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    j = eps.join(iv.shuffled(hit), ["id", "e"], "left")
    return j.select(*eps.columns, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("?").alias("stage"), F.coalesce((F.col("lo") != F.col("hi")).cast("int"), F.lit(0)).alias("conflict"))


def bouts(h: DataFrame, keys: list[str], order: str = "e", state: str = "stage") -> DataFrame:
    """Maximal runs of one state: keys, run, state, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    return h.withColumn("_n", new).withColumn("run", F.sum("_n").over(w)).groupBy(*keys, "run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def bout_summary(h: DataFrame, keys: list[str], order: str = "e", state: str = "stage", unit_min: float = 0.5) -> DataFrame:
    """Number, mean, lower median and longest bout per state, and minutes in bouts of at least 5 and 10 minutes."""
    b = bouts(h, keys, order, state).withColumn("mins", F.col("n") * unit_min)
    return b.groupBy(*keys, state).agg(
        F.count("*").alias("BOUT_N"),
        F.avg("mins").alias("BOUT_MN"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY mins)").alias("BOUT_MD"),
        F.max("mins").alias("BOUT_MX"),
        F.sum(F.when(F.col("mins") >= 5, F.col("mins")).otherwise(0.0)).alias("BOUT_05"),
        F.sum(F.when(F.col("mins") >= 10, F.col("mins")).otherwise(0.0)).alias("BOUT_10"),
    )


def transitions(h: DataFrame, keys: list[str], order: str = "e", state: str = "stage") -> DataFrame:
    """Counts of consecutive state pairs."""
    w = Window.partitionBy(*keys).orderBy(order)
    return h.select(*keys, F.col(state).alias("pre"), F.lead(state).over(w).alias("post")).where("post is not null").groupBy("pre", "post").agg(F.count("*").alias("n"))


def flanking(h: DataFrame, keys: list[str], order: str = "e", state: str = "stage") -> DataFrame:
    """Per epoch, how many like it come directly before and after, and the smaller of the two."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = bouts(h, keys, order, state)
    d = h.withColumn("_n", F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)).withColumn("run", F.sum("_n").over(w)).drop("_n")
    rn = F.row_number().over(Window.partitionBy(*keys, "run").orderBy(order))
    d = d.withColumn("_k", rn).join(runs.select(*keys, "run", "n"), [*keys, "run"])
    return d.withColumns({"flank_left": F.col("_k") - 1, "flank_right": F.col("n") - F.col("_k")}).withColumn("flank_min", F.least("flank_left", "flank_right")).drop("_k", "n", "run")


def summary(h: DataFrame, epoch_min: float = 0.5) -> DataFrame:
    """TIB, TRT, TST, SOL, WASO, SE, SPT, FWT, REM latencies and minutes per stage, per id.

    Lights are on during L epochs.  Times are minutes; latencies are null without sleep or REM.
    """
    m = epoch_min
    sleep, dark = F.col("stage").isin(SLEEP), F.col("stage") != "L"

    def mins(cond):
        return F.sum(F.when(cond, m).otherwise(0.0))

    base = h.groupBy("id").agg(
        (F.count("*") * m).alias("TIB"),
        F.min(F.when(dark, F.col("e"))).alias("lo"),
        (F.max(F.when(dark, F.col("e"))) + 1).alias("hi"),
        F.min(F.when(sleep, F.col("e"))).alias("fs"),
        (F.max(F.when(sleep, F.col("e"))) + 1).alias("fw"),
        F.min(F.when(F.col("stage") == "R", F.col("e"))).alias("fr"),
        mins(F.col("stage") == "W").alias("TWT"),
        mins(F.col("stage") == "?").alias("OTHR"),
        mins(sleep).alias("sleep"),
        *(mins(F.col("stage") == s).alias(f"MINS_{s}") for s in ("N1", "N2", "N3", "R")),
    )
    inner = h.join(base.select("id", "fs", "fw", "fr"), "id").groupBy("id").agg(
        F.sum(F.when((F.col("stage") == "W") & (F.col("e") >= F.col("fs")) & (F.col("e") < F.col("fw")), m).otherwise(0.0)).alias("WASO"),
        F.sum(F.when(F.col("stage").isin(NREM) & (F.col("e") >= F.col("fs")) & (F.col("e") < F.col("fr")), m).otherwise(0.0)).alias("rem2"),
    )
    j = base.join(inner, "id")
    trt = F.coalesce((F.col("hi") - F.col("lo")) * m, F.lit(0.0))
    return j.select(
        "id",
        "TIB",
        trt.alias("TRT"),
        "TWT",
        F.col("sleep").alias("TST"),
        ((F.col("fs") - F.col("lo")) * m).alias("SOL"),
        F.when(F.col("fs").isNotNull(), F.col("WASO")).alias("WASO"),
        ((F.col("hi") - F.col("fw")) * m).alias("FWT"),
        (trt - (F.col("fs") - F.col("lo")) * m).alias("SPT"),
        F.when(trt > 0, 100 * F.col("sleep") / trt).alias("SE"),
        ((F.col("fr") - F.col("fs")) * m).alias("REM_LAT"),
        F.when(F.col("fr").isNotNull(), F.col("rem2")).alias("REM_LAT2"),
        "OTHR",
        *(F.col(f"MINS_{s}") for s in ("N1", "N2", "N3", "R")),
    )


def n2_direction(h: DataFrame, th: float = 0.25) -> DataFrame:
    """Up/down score of N2 epochs from the nearest other stages on each side; class A, D or F."""
    w = Window.partitionBy("id").orderBy("e")
    other = F.when(F.col("stage") != "N2", F.col("stage"))
    left = F.last(other, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # what follows is what came before in the reverse order: a frame that runs to the end is read anew for each row
    right = F.last(other, True).over(Window.partitionBy("id").orderBy(F.desc("e")).rowsBetween(Window.unboundedPreceding, -1))
    up = lambda s, sign: F.when(s == "N3", float(sign)).when(s.isin("N1", "W", "R"), float(-sign))
    a, b = up(left, 1), up(right, -1)
    score = (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / F.greatest(F.lit(1), a.isNotNull().cast("int") + b.isNotNull().cast("int"))
    d = h.withColumns({"_s": score}).where("stage = 'N2'")
    return d.select("id", "e", F.col("_s").alias("score"), F.when(F.col("_s") > th, "A").when(F.col("_s") < -th, "D").otherwise("F").alias("n2"))


def cycles(h: DataFrame, epoch_min: float = 0.5, nrem_min: float = 15, rem_min: float = 5, gap_min: float = 15) -> DataFrame:
    """NREM/REM cycles by a modified Feinberg-Floyd rule: sequential per night, so a grouped pandas function.

    A cycle starts with at least ``nrem_min`` of NREM, holds REM whose pieces are at
    most ``gap_min`` apart and, from the second on, last ``rem_min``.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("e").reset_index(drop=True)
        s, out, k, i, n = p["stage"].to_numpy(), [0] * len(p), 0, 0, len(p)
        while i < n:
            if s[i] not in NREM:
                i += 1
                continue
            j = nrem = 0
            start, rem, last, j = i, 0, None, i
            while j < n:
                if s[j] in NREM:
                    if last is not None and (j - last - 1) * epoch_min <= gap_min and not any(x == "R" for x in s[j : j + round(gap_min / epoch_min)]) and rem:
                        break
                    if last is not None and (j - last) * epoch_min > gap_min:
                        break
                    nrem += rem == 0
                elif s[j] == "R":
                    rem, last = rem + 1, j
                j += 1
            end = (last + 1) if last is not None else j
            if nrem * epoch_min >= nrem_min and (k == 0 or rem * epoch_min >= rem_min or last is None):
                k += 1
                out[start:end] = [k] * (end - start)
            i = max(end, start + 1)
        return pd.DataFrame({"id": p["id"], "e": p["e"], "cycle": out})

    kind = h.schema["id"].dataType.simpleString()
    return h.select("id", "e", "stage").groupBy("id").applyInPandas(one, f"id {kind}, e long, cycle int")
