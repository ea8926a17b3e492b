"""Interval algebra: range joins, merges, set operations, coverage and nearest neighbours.

Intervals are columns (id, class, start_ns, stop_ns) with ``stop_ns`` one past the
end; a zero-length interval is a point.  Two overlap predicates coexist, as in the
engine this follows: :func:`overlaps` (value semantics) and :func:`found` (index
semantics, in which a point matches only windows that contain it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000_000
HOUR = 3600 * SECOND


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Half-open overlap, or equal starts (so coinciding points overlap)."""
    return ((a_start < b_stop) & (a_stop > b_start)) | (a_start == b_start)


def found(start: Column, stop: Column, q_start: Column, q_stop: Column) -> Column:
    """What an index query for [q_start, q_stop) finds: overlapping intervals, and points p with q_start <= p < q_stop."""
    return F.when(start == stop, (q_start <= start) & (start < q_stop)).otherwise((start < q_stop) & (stop > q_start))


def spanned(start: Column, stop: Column, q_start: Column, q_stop: Column) -> Column:
    """Whether the interval spans the whole window."""
    return (start <= q_start) & (stop >= q_stop)


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that is never broadcast: Spark takes rows exploded from few (epochs, bins) for few."""
    return df.hint("merge")


def _binned(df: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    first = F.floor(F.col(start) / width).cast("long")
    last = F.floor((F.greatest(F.col(stop), F.col(start) + 1) - 1) / width).cast("long")
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width_ns: int = HOUR, how: str = "inner", predicate=found, left_cols: tuple[str, str] = ("start_ns", "stop_ns"), right_cols: tuple[str, str] = ("r_start", "r_stop")) -> DataFrame:
    """Overlap join as an equi-join on time bins, so it shuffles by (keys, bin) and never nests loops.

    Both sides are spread over the bins they touch; a pair is kept only in the
    later of the two first bins, so none is made twice.  A long interval costs a
    row per bin: ``width_ns`` should be near the typical length.  The predicate
    gets the right side's interval as the indexed one and the left as the window.
    ``how`` is inner, left_semi or left_anti.
    """
    a, b = shuffled(_binned(left, *left_cols, width_ns)), _binned(right, *right_cols, width_ns)
    b = b.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in right.columns if c not in keys), F.col("_first").alias("_rfirst"), F.col("_bin").alias("_rbin"))
    b = shuffled(b)
    same = F.col("_bin") == F.col("_rbin")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    hit = same & predicate(F.col(right_cols[0]), F.col(right_cols[1]), F.col(left_cols[0]), F.col(left_cols[1]))
    if how == "inner":
        once = F.col("_bin") == F.greatest("_first", "_rfirst")
        return a.join(b, hit & once).drop("_first", "_bin", "_rfirst", "_rbin", *(f"_k_{k}" for k in keys))
    if how not in ("left_semi", "left_anti"):
        raise ValueError(how)
    touched = a.join(b, hit, "left_semi").select(*left.columns).distinct()
    if how == "left_semi":
        return touched
    on = [left[c].eqNullSafe(touched[c]) for c in left.columns]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return left.join(shuffled(touched), cond, "left_anti")


def islands(df: DataFrame, keys: list[str], join_neighbours: bool = True, gap_ns: int = 0) -> DataFrame:
    """Merges overlapping (and, by default, touching) intervals: keys, start_ns, stop_ns, n.

    Merging is done within time bins of a day first, which shrinks what a hot key
    has to order in one task.
    """

    def merge(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start_ns", "stop_ns")
        before = F.max("stop_ns").over(w.rowsBetween(Window.unboundedPreceding, -1))
        apart = (F.col("start_ns") > before + gap_ns) if join_neighbours else (F.col("start_ns") >= before + gap_ns)
        new = F.when(before.isNull() | apart, 1).otherwise(0)
        return d.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(*by, "_run").agg(F.min("start_ns").alias("start_ns"), F.max("stop_ns").alias("stop_ns"), F.sum("n").alias("n")).drop("_run")

    day = df.select(*keys, "start_ns", "stop_ns", F.lit(1).cast("long").alias("n")).withColumn("_day", F.floor(F.col("start_ns") / (24 * HOUR)))
    return merge(merge(day, [*keys, "_day"]).drop("_day"), keys)


def intersection(a: DataFrame, b: DataFrame, keys: list[str], width_ns: int = HOUR) -> DataFrame:
    """Intersection of two interval sets, each flattened first; a point strictly inside the other set's interval stays one."""
    x = islands(a, keys).drop("n")
    y = islands(b, keys).select(*keys, F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
    both = range_join(x, y, keys, width_ns, predicate=lambda a, b, c, d: (a < d) & (b > c))
    return both.select(*keys, F.greatest("start_ns", "r_start").alias("start_ns"), F.least("stop_ns", "r_stop").alias("stop_ns"))


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*keys, "start_ns", "stop_ns"]
    return islands(a.select(*cols).unionByName(b.select(*cols)), keys).drop("n")


def complement(df: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """Gaps of the flattened set within ``bounds`` (keys, lo, hi)."""
    flat = islands(df, keys).drop("n")
    w = Window.partitionBy(*keys).orderBy("start_ns")
    b = flat.join(bounds, keys)
    gaps = b.select(*keys, F.coalesce(F.lag("stop_ns").over(w), F.col("lo")).alias("g0"), F.col("start_ns").alias("g1"))
    tail = b.groupBy(*keys, "hi").agg(F.max("stop_ns").alias("g0")).select(*keys, "g0", F.col("hi").alias("g1"))
    empty = bounds.join(flat.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("lo").alias("g0"), F.col("hi").alias("g1"))
    return gaps.unionByName(tail).unionByName(empty).where("g0 < g1").select(*keys, F.col("g0").alias("start_ns"), F.col("g1").alias("stop_ns"))


def excise(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Time of the flattened ``a`` that ``b`` doesn't cover, as fragments: a sweep over starts and stops."""

    def edges(d: DataFrame, c: str) -> DataFrame:
        f = islands(d, keys)
        z = F.lit(0)
        s = f.select(*keys, F.col("start_ns").alias("t"), F.lit(1).alias(c)).unionByName(f.select(*keys, F.col("stop_ns").alias("t"), F.lit(-1).alias(c)))
        return s.withColumn("db" if c == "da" else "da", z).select(*keys, "t", "da", "db")

    e = edges(a, "da").unionByName(edges(b, "db")).groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*keys).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*keys, F.col("t").alias("start_ns"), F.lead("t").over(w).alias("stop_ns"), F.sum("da").over(run).alias("ia"), F.sum("db").over(run).alias("ib"))
    return islands(e.where("ia > 0 and ib = 0 and stop_ns is not null"), keys).drop("n")


def extend(df: DataFrame, left_ns: int, right_ns: int) -> DataFrame:
    """Widens intervals; a start doesn't go below 0."""
    return df.withColumns({"start_ns": F.greatest(F.lit(0), F.col("start_ns") - left_ns), "stop_ns": F.col("stop_ns") + right_ns})


def reduce_to(df: DataFrame, what: str) -> DataFrame:
    """Points at the start, stop or midpoint of intervals (points stay)."""
    at = {"start": F.col("start_ns"), "stop": F.col("stop_ns"), "midpoint": F.expr("start_ns + (stop_ns - start_ns) div 2")}[what]
    return df.withColumn("_p", at).withColumns({"start_ns": F.col("_p"), "stop_ns": F.col("_p")}).drop("_p")


def nearest(seeds: DataFrame, others: DataFrame, keys: list[str], at: str = "t_ns") -> DataFrame:
    """Distance of each seed point to the points of ``others`` before (or at) and after it.

    One union ordered by time with running last/first values: no pairs are made.
    Columns of ``seeds`` plus prev_t, next_t and nearest_s (signed seconds to the
    nearest other; ties go to the earlier one).
    """
    cols = seeds.columns
    s = seeds.withColumn("_o", F.lit(None).cast("long")).withColumn("_k", F.lit(1))
    o = others.select(*(F.col(c) if c in keys else F.col(at).alias(c) if c == at else F.lit(None).cast(seeds.schema[c].dataType).alias(c) for c in cols), F.col(at).alias("_o"), F.lit(0).alias("_k"))
    w = Window.partitionBy(*keys).orderBy(at, "_k")
    u = s.unionByName(o)
    u = u.withColumn("prev_t", F.last("_o", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # what follows is what came before in the reverse order: a frame that runs to the end is read anew for each row
    back = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_k"))
    u = u.withColumn("next_t", F.last("_o", True).over(back.rowsBetween(Window.unboundedPreceding, 0))).where("_k = 1")
    back, ahead = F.col(at) - F.col("prev_t"), F.col("next_t") - F.col(at)
    near = F.when(ahead.isNull() | (back <= ahead), -back / SECOND).otherwise(ahead / SECOND)
    return u.select(*cols, "prev_t", "next_t", near.alias("nearest_s"))


def coverage(windows: DataFrame, annots: DataFrame, keys: list[str], width_ns: int = HOUR, how_flat: bool = True) -> DataFrame:
    """Seconds, share and count of flattened annotations within each window row (start_ns, stop_ns).

    Windows without any keep a row: sec 0, cnt 0, has 0.
    """
    other = islands(annots, keys) if how_flat else annots
    other = other.select(*keys, F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
    cols = windows.columns
    hits = range_join(windows, other, keys, width_ns)
    part = (F.least("stop_ns", "r_stop") - F.greatest("start_ns", "r_start")) / SECOND
    agg = hits.groupBy(*cols).agg(F.sum(part).alias("sec"), F.count("*").alias("cnt"))
    out = windows.join(shuffled(agg), cols, "left")
    dur = (F.col("stop_ns") - F.col("start_ns")) / SECOND
    return out.select(*cols, F.coalesce("sec", F.lit(0.0)).alias("sec"), F.coalesce(F.col("sec") / dur * 100, F.lit(0.0)).alias("pct"), F.coalesce("cnt", F.lit(0)).alias("cnt"), F.when(F.col("cnt") > 0, 1).otherwise(0).alias("has"))


def segments(points: DataFrame, keys: list[str], at: str, gap_ns: int) -> DataFrame:
    """Contiguous runs of points whose steps are at most ``gap_ns``: keys, seg, start, stop, n."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.lag(at).over(w).isNull() | (F.col(at) - F.lag(at).over(w) > gap_ns), 1).otherwise(0)
    p = points.withColumn("_n", new).withColumn("seg", F.sum("_n").over(w))
    return p.groupBy(*keys, "seg").agg(F.min(at).alias("start_ns"), F.max(at).alias("stop_ns"), F.count("*").alias("n"))


def class_summary(annots: DataFrame) -> DataFrame:
    """Instances and seconds per class."""
    return annots.groupBy("class").agg(F.count("*").alias("count"), F.sum((F.col("stop_ns") - F.col("start_ns")) / SECOND).alias("dur"))


def axa(seeds: DataFrame, others: DataFrame, keys: list[str], width_ns: int = HOUR) -> DataFrame:
    """Cross-tabulation of seed intervals with flattened others, per seed class and other class.

    P, T, N: means over seeds of the share, seconds and number of overlapping
    others; A: share of seeds with any; TOT_N, TOT_T: sums.  Zero-length seeds
    don't count.
    """
    s = seeds.where("stop_ns > start_ns").withColumnRenamed("class", "seed")
    flat = islands(others, [*keys, "class"]).select(*keys, F.col("class").alias("annot"), F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
    hit = range_join(s, flat, keys, width_ns).where("seed != annot")
    t = (F.least("stop_ns", "r_stop") - F.greatest("start_ns", "r_start")) / SECOND
    per = hit.groupBy(*s.columns, "annot").agg(F.sum(t).alias("t"), F.count("*").alias("n"), F.count("*").alias("_any"))
    per = per.withColumn("p", F.col("t") / ((F.col("stop_ns") - F.col("start_ns")) / SECOND))
    sums = per.groupBy("seed", "annot").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("a"))
    total = s.groupBy("seed").agg(F.count("*").alias("seeds"))
    return sums.join(total, "seed").select("seed", "annot", (F.col("p") / F.col("seeds")).alias("P"), (F.col("t") / F.col("seeds")).alias("T"), (F.col("n") / F.col("seeds")).alias("N"), (F.col("a") / F.col("seeds")).alias("A"), F.col("n").alias("TOT_N"), F.col("t").alias("TOT_T"))
