"""Epoch grids, mask algebra and restructuring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypnoframe.operators import intervals as iv

S = iv.SECOND


def epochs(recordings: DataFrame, len_s: float = 30.0, inc_s: float | None = None, offset_s: float = 0.0) -> DataFrame:
    """Grid over ``recordings`` (id, dur_ns): id, e (from 1), start_ns, stop_ns, masked (false).

    A trailing partial epoch is dropped: an epoch stays if start + len - 1 < duration.
    """
    n, i, o = (round(x * S) for x in (len_s, inc_s or len_s, offset_s))
    if n < i:
        raise ValueError("epoch length is under its increment")
    count = F.greatest(F.lit(0), F.floor((F.col("dur_ns") - o - n) / i) + 1)
    starts = F.when(count > 0, F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).otherwise(F.array().cast("array<long>"))
    # dealt by number: recordings are few rows that become many, so they mustn't be coalesced by size into one task
    e = recordings.select("id", "dur_ns").repartition(int(recordings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").select("id", F.explode(starts).alias("k"))
    return e.select("id", (F.col("k") + 1).alias("e"), (F.col("k") * i + o).alias("start_ns"), (F.col("k") * i + o + n).alias("stop_ns"), F.lit(False).alias("masked"))


def epochs_in_segments(segs: DataFrame, len_s: float = 30.0, inc_s: float | None = None) -> DataFrame:
    """Discontinuous recordings: the grid restarts in each contiguous segment (id, seg, start_ns, stop_ns)."""
    n, i = round(len_s * S), round((inc_s or len_s) * S)
    count = F.floor((F.col("stop_ns") - F.col("start_ns") - n) / i) + 1
    e = segs.where(count > 0).select("id", "seg", F.col("start_ns").alias("s0"), F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).alias("k"))
    w = Window.partitionBy("id").orderBy("seg", "k")
    return e.select("id", F.row_number().over(w).cast("long").alias("e"), (F.col("s0") + F.col("k") * i).alias("start_ns"), (F.col("s0") + F.col("k") * i + n).alias("stop_ns"), F.lit(False).alias("masked"))


def epochs_spliced(segs: DataFrame, len_s: float) -> DataFrame:
    """splice-gaps: epochs of ``len_s`` of recorded time, gaps skipped; an epoch's interval may span gaps."""
    n = round(len_s * S)
    w = Window.partitionBy("id").orderBy("start_ns")
    c = segs.withColumn("c1", F.sum(F.col("stop_ns") - F.col("start_ns")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("c0", F.col("c1") - (F.col("stop_ns") - F.col("start_ns")))
    first, last = F.ceil(F.col("c0") / n), F.ceil(F.col("c1") / n) - 1
    starts = c.where(last >= first).select("id", F.explode(F.sequence(first, last)).alias("k"), "c0", "start_ns").select("id", "k", (F.col("start_ns") + F.col("k") * n - F.col("c0")).alias("start_ns"))
    first, last = F.floor(F.col("c0") / n), F.floor(F.col("c1") / n) - 1
    stops = c.where(last >= first).select("id", F.explode(F.sequence(first, last)).alias("k"), "c0", F.col("start_ns").alias("s")).select("id", "k", (F.col("s") + (F.col("k") + 1) * n - F.col("c0")).alias("stop_ns"))
    return starts.join(stops, ["id", "k"]).select("id", (F.col("k") + 1).alias("e"), "start_ns", "stop_ns", F.lit(False).alias("masked"))


def epochs_from(annots: DataFrame, w_s: float = 0.0, shift_s: float = 0.0, trunc_s: float = 0.0) -> DataFrame:
    """Generic epochs, one per annotation, widened, shifted or cut at the end."""
    w, s, t = (round(x * S) for x in (w_s, shift_s, trunc_s))
    a = annots.select("id", (F.col("start_ns") - w + s).alias("start_ns"), (F.col("stop_ns") + w + s - t).alias("stop_ns")).where("start_ns >= 0 and stop_ns > start_ns")
    return a.withColumn("e", F.row_number().over(Window.partitionBy("id").orderBy("start_ns", "stop_ns")).cast("long")).select("id", "e", "start_ns", "stop_ns", F.lit(False).alias("masked"))


# ---- masks --------------------------------------------------------------

#: update modes: 0 only masks, 1 only unmasks, 2 does both
MASK, UNMASK, FORCE = 0, 1, 2


def updated(masked: Column, match: Column, mode: int, negate: bool = False) -> Column:
    """The mask after a match under a mode; ``negate`` is the ifnot form.  A null match changes nothing."""
    candidate = ~match if (negate != (mode == UNMASK)) else match
    if mode == MASK:
        new = masked | candidate
    elif mode == UNMASK:
        new = masked & candidate
    else:
        new = candidate
    return F.coalesce(new, masked)


def annotated(eps: DataFrame, annots: DataFrame, classes: list[str], every: bool = False, width_ns: int = iv.HOUR) -> DataFrame:
    """``eps`` with ``m``: whether any (or every) class overlaps the epoch; ``+class`` must span it."""
    full = {c[1:] for c in classes if c.startswith("+")}
    names = [c.lstrip("+") for c in classes]
    a = annots.where(F.col("class").isin(names)).select("id", F.col("class").alias("_c"), F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
    hits = iv.range_join(eps.select("id", "e", "start_ns", "stop_ns"), a, ["id"], width_ns)
    if full:
        hits = hits.where(~F.col("_c").isin(list(full)) | iv.spanned(F.col("r_start"), F.col("r_stop"), F.col("start_ns"), F.col("stop_ns")))
    seen = hits.groupBy("id", "e").agg(F.countDistinct("_c").alias("_n"))
    return eps.join(iv.shuffled(seen), ["id", "e"], "left").withColumn("m", F.coalesce(F.col("_n") >= (len(set(names)) if every else 1), F.lit(False))).drop("_n")


def mask_annots(eps: DataFrame, annots: DataFrame, classes: list[str], mode: int = FORCE, negate: bool = False, every: bool = False) -> DataFrame:
    e = annotated(eps, annots, classes, every)
    return e.withColumn("masked", updated(F.col("masked"), F.col("m"), mode, negate)).drop("m")


def mask_expr(eps: DataFrame, match: Column, mode: int = FORCE, negate: bool = False) -> DataFrame:
    """Epochs for which the expression is true are masked (or, negated, kept)."""
    return eps.withColumn("masked", updated(F.col("masked"), match, mode, negate))


def _by_id(order: str = "e") -> Window:
    return Window.partitionBy("id").orderBy(order)


def mask_range(eps: DataFrame, ranges: list[tuple[int, int]], include: bool = True) -> DataFrame:
    """epoch=1-10,12: keep (or mask) the listed epochs."""
    m = F.lit(False)
    for a, b in ranges:
        m = m | F.col("e").between(a, b)
    return eps.withColumn("masked", F.col("masked") | (~m if include else m))


def mask_first(eps: DataFrame, n: int) -> DataFrame:
    """Keeps the first n unmasked epochs."""
    k = F.sum(F.when(F.col("masked"), 0).otherwise(1)).over(_by_id().rowsBetween(Window.unboundedPreceding, 0))
    return eps.withColumn("masked", F.col("masked") | (k > n))


def mask_random(eps: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Keeps n unmasked epochs chosen by a seeded hash."""
    w = Window.partitionBy("id", "masked").orderBy(F.xxhash64(F.lit(seed), "id", "e"), "e")
    return eps.withColumn("_r", F.row_number().over(w)).withColumn("masked", F.col("masked") | (F.col("_r") > n)).drop("_r")


def mask_flip(eps: DataFrame) -> DataFrame:
    """Negates the mask, unless nothing of a recording is masked."""
    some = F.max(F.col("masked").cast("int")).over(Window.partitionBy("id")) == 1
    return eps.withColumn("masked", F.when(some, ~F.col("masked")).otherwise(F.col("masked")))


def mask_all(eps: DataFrame, masked: bool = True) -> DataFrame:
    return eps.withColumn("masked", F.lit(masked))


def unmask_interior(eps: DataFrame) -> DataFrame:
    """Unmasks everything between the first and the last unmasked epoch."""
    w = Window.partitionBy("id")
    k = F.when(~F.col("masked"), F.col("e"))
    inside = F.col("e").between(F.min(k).over(w), F.max(k).over(w))
    return eps.withColumn("masked", F.col("masked") & ~F.coalesce(inside, F.lit(False)))


def mask_edges(eps: DataFrame, n: int, leading: bool = True, trailing: bool = True) -> DataFrame:
    """Masks the first and the last n epochs."""
    w = Window.partitionBy("id")
    first, last = F.min("e").over(w), F.max("e").over(w)
    m = F.lit(False)
    if leading:
        m = m | (F.col("e") < first + n)
    if trailing:
        m = m | (F.col("e") > last - n)
    return eps.withColumn("masked", F.col("masked") | m)


def mask_trim(eps: DataFrame, label: str, n: int = 0, col: str = "label") -> DataFrame:
    """Of the leading and trailing runs with ``label``, keeps n epochs next to the rest."""
    w = Window.partitionBy("id")
    other = F.when(~F.coalesce(F.col(col) == label, F.lit(False)), F.col("e"))
    first, last = F.min(other).over(w), F.max(other).over(w)
    return eps.withColumn("masked", F.col("masked") | F.coalesce((F.col("e") < first - n) | (F.col("e") > last + n), F.lit(False)))


def mask_flanked(eps: DataFrame, label: str, n: int, col: str = "label") -> DataFrame:
    """Keeps an epoch only if it and all n on each side have ``label``; near the edges it is masked."""
    hit = F.coalesce((F.col(col) == label).cast("int"), F.lit(0))
    around = F.sum(hit).over(_by_id().rowsBetween(-n, n))
    return eps.withColumn("masked", F.col("masked") | (around < 2 * n + 1))


def mask_stable(eps: DataFrame, labels: list[str], n: int, unique: bool = True, col: str = "label") -> DataFrame:
    """Keeps an epoch of one of ``labels`` whose n neighbours on each side have the same one (or, not unique, any of them)."""
    ok = F.col(col).isin(labels)
    w = _by_id().rowsBetween(-n, n)
    inside = F.sum(F.coalesce(ok.cast("int"), F.lit(0))).over(w) == 2 * n + 1
    same = F.min(col).over(w) == F.max(col).over(w)
    return eps.withColumn("masked", F.col("masked") | ~F.coalesce(inside & (same if unique else F.lit(True)), F.lit(False)))


def mask_regional(eps: DataFrame, x: int, y: int) -> DataFrame:
    """Masks an unmasked epoch unless x of the y before and x of the y after are unmasked (beyond the edges: bad);
    then any left whose two neighbours are both masked."""
    good = (~F.col("masked")).cast("int")
    back = F.coalesce(F.sum(good).over(_by_id().rowsBetween(-y, -1)), F.lit(0))
    ahead = F.coalesce(F.sum(good).over(_by_id().rowsBetween(1, y)), F.lit(0))
    one = eps.withColumn("_m", F.col("masked") | ((back < x) & (ahead < x)))
    left = F.coalesce(F.lag("_m").over(_by_id()), F.lit(True))
    right = F.coalesce(F.lead("_m").over(_by_id()), F.lit(True))
    return one.withColumn("masked", F.col("_m") | (left & right)).drop("_m")


def restructure(eps: DataFrame) -> DataFrame:
    """Drops masked epochs and renumbers; e_orig keeps the number before."""
    w = Window.partitionBy("id").orderBy("e")
    return eps.where("not masked").withColumn("e_orig", F.col("e")).withColumn("e", F.row_number().over(w).cast("long"))


def retained(points: DataFrame, eps: DataFrame, width_ns: int = iv.HOUR, at: str = "t_ns") -> DataFrame:
    """Samples or records (id, t) that an unmasked epoch contains: a left semi range join.  An epoch without length contains none."""
    p = points.withColumns({"start_ns": F.col(at), "stop_ns": F.col(at) + 1})
    keep = eps.where("not masked and start_ns < stop_ns").select("id", F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
    return iv.range_join(p, keep, ["id"], width_ns, "left_semi").drop("start_ns", "stop_ns")


def chep_summary(chep: DataFrame, n_epochs: int, n_channels: int, bad_channels: float = 0.5, bad_epochs: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Bad channels and bad epochs by their share of masked (id, e, ch) entries."""
    ch = chep.groupBy("id", "ch").agg((F.countDistinct("e") / n_epochs).alias("share")).where(F.col("share") > bad_channels)
    ep = chep.groupBy("id", "e").agg((F.countDistinct("ch") / n_channels).alias("share")).where(F.col("share") > bad_epochs)
    return ch, ep


def chep_outliers(stats: DataFrame, value: str, ep_th: list[float] = (3.0,), ch_th: list[float] = ()) -> DataFrame:
    """Channel x epoch mask by repeated z-scores: within a channel across epochs, then within an epoch across channels."""
    d = stats.withColumn("masked", F.lit(False))
    for by, ths in (("ch", ep_th), ("e", ch_th)):
        for th in ths:
            w = Window.partitionBy("id", by)
            live = F.when(~F.col("masked"), F.col(value))
            z = F.try_divide(F.abs(F.col(value) - F.avg(live).over(w)), F.stddev_samp(live).over(w))
            d = d.withColumn("masked", F.col("masked") | F.coalesce(z > th, F.lit(False)))
    return d
