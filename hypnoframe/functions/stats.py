"""Exact aggregate semantics as Column expressions (all within whole-stage aggregation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def skew(x: Column) -> Column:
    """Third central moment over the cube of the sample SD."""
    n = F.count(x)
    return F.skewness(x) * F.pow((n - 1) / n, 1.5)


def kurt(x: Column, plus3: bool = False) -> Column:
    """Population excess kurtosis."""
    return F.kurtosis(x) + (3.0 if plus3 else 0.0)


def lower_median(name: str) -> Column:
    """The lower of the two middle values for an even count."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name})")


def quantile(x: Column, p: float) -> Column:
    """Interpolating quantile."""
    return F.percentile(x, F.lit(p))


def iqr(x: Column) -> Column:
    return quantile(x, 0.75) - quantile(x, 0.25)


def robust_sd(x: Column) -> Column:
    return 0.7413 * iqr(x)


def trunc_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Percentile without interpolation: the value at 0-based rank trunc(n p), the last at p = 1.

    No group is ordered in one task: values are counted in narrow parts of the line,
    and of the part that holds the rank the distinct values are.
    """
    x = F.col(value).cast("double")
    # parts a thousandth apart in log1p(|x|), which never falls as |x| grows; NaN is above all others
    part = F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x)) * 1000).cast("long"))
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), part.alias("_b"))
    w = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = d.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).withColumns({"_to": F.sum("_c").over(w("_b")), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))) + 1
    b = b.where((at <= F.col("_to")) & (at > F.col("_to") - F.col("_c"))).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_b").alias("_part"), (at - F.col("_to") + F.col("_c")).alias("_at"))
    same = F.col("_b") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    v = d.join(b, same).groupBy(*keys, "_v", "_at").agg(F.count("*").alias("_c")).withColumn("_to", F.sum("_c").over(w("_v")))
    return v.where((F.col("_at") <= F.col("_to")) & (F.col("_at") > F.col("_to") - F.col("_c"))).select(*keys, F.col("_v").alias("pctl"))


def winsorized(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Clamps at the truncated percentiles p and 1 - p of each group."""
    lo = trunc_percentile(df, keys, value, p).withColumnRenamed("pctl", "_lo")
    hi = trunc_percentile(df, keys, value, 1 - p).withColumnRenamed("pctl", "_hi")
    return df.join(lo, keys).join(hi, keys).withColumn(value, F.greatest(F.least(F.col(value), F.col("_hi")), F.col("_lo"))).drop("_lo", "_hi")


def hjorth(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Activity, mobility and complexity in variance mode (population variances); fewer than 3 values: 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    d = d.withColumn("_dd", F.col("_d") - F.lag("_d").over(w))
    a = d.groupBy(*keys).agg(F.var_pop(value).alias("v0"), F.var_pop("_d").alias("v1"), F.var_pop("_dd").alias("v2"), F.count(value).alias("n"))
    mob = F.sqrt(F.try_divide("v1", "v0"))
    ok = F.col("n") >= 3
    return a.select(*keys, F.when(ok, F.col("v0")).otherwise(0.0).alias("H1"), F.when(ok, mob).otherwise(0.0).alias("H2"), F.when(ok, F.try_divide(F.sqrt(F.try_divide("v2", "v1")), mob)).otherwise(0.0).alias("H3"))


def petrosian(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Petrosian fractal dimension from sign changes of first differences."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_up", F.col(value) - F.lag(value).over(w) > 0)
    d = d.withColumn("_turn", (F.col("_up") != F.lag("_up").over(w)).cast("int"))
    a = d.groupBy(*keys).agg(F.count(value).cast("double").alias("n"), F.sum("_turn").alias("k"))
    return a.select(*keys, F.when(F.col("n") < 3, 0.0).otherwise(F.log10("n") / (F.log10("n") + F.log10(F.col("n") / (F.col("n") + 0.4 * F.col("k"))))).alias("PFD"))


def turning_rate(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Share of inner values that are local extremes."""
    w = Window.partitionBy(*keys).orderBy(order)
    a, b = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    return df.withColumn("_t", F.when(a * b < 0, 1.0).when(a.isNotNull() & b.isNotNull(), 0.0)).groupBy(*keys).agg(F.avg("_t").alias("turning_rate"))


def tabulated(df: DataFrame, keys: list[str], value: str, bin_width: float | None = None, req: int = 0) -> DataFrame:
    """Value or bin counts with at least ``req`` observations."""
    v = F.floor(F.col(value) / bin_width) * bin_width if bin_width else F.col(value)
    return df.groupBy(*keys, v.alias("bin")).agg(F.count("*").alias("n")).where(F.col("n") >= req)


def otsu(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Otsu's threshold from one histogram pass: threshold with the largest between-class variance."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    h = df.join(F.broadcast(r)).select(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int").alias("b"), "lo", "hi").groupBy("b", "lo", "hi").agg(F.count("*").alias("n"))
    w = Window.orderBy("b")  # at most ``bins`` rows
    run, full = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = h.withColumns({"n0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("b")).over(run), "n1": F.sum("n").over(full), "s1": F.sum(F.col("n") * F.col("b")).over(full)})
    p = F.col("n0") / F.col("n1")
    mu, mt = F.col("s0") / F.col("n1"), F.col("s1") / F.col("n1")
    c = c.withColumn("sigma_b", F.when((p > 0) & (p < 1), F.pow(mt * p - mu, 2) / (p * (1 - p))).otherwise(0.0))
    return c.orderBy(F.desc("sigma_b"), "b").limit(1).select((F.col("lo") + (F.col("b") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"), "sigma_b")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two label columns: n, accuracy, kappa (chance-corrected)."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).count()
    rows = pairs.groupBy("a").agg(F.sum("count").alias("ra")).withColumnRenamed("a", "k")
    cols = pairs.groupBy("b").agg(F.sum("count").alias("cb")).withColumnRenamed("b", "k")
    total = pairs.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("agree"))
    chance = rows.join(cols, "k").agg(F.sum(F.col("ra") * F.col("cb")).alias("e"))
    t = total.join(F.broadcast(chance))
    po, pe = F.col("agree") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    return t.select("n", po.alias("acc"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def correlations(wide: DataFrame, channels: list[str]) -> DataFrame:
    """Pearson r of every channel pair in one aggregation."""
    pairs = [(x, y) for i, x in enumerate(channels) for y in channels[i + 1 :]]
    agg = wide.agg(*(F.corr(x, y).alias(f"{i}") for i, (x, y) in enumerate(pairs)), *(F.covar_samp(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)))
    return agg.select(F.explode(F.array(*(F.struct(F.lit(x).alias("ch1"), F.lit(y).alias("ch2"), F.col(f"{i}").alias("r"), F.col(f"c{i}").alias("cov")) for i, (x, y) in enumerate(pairs)))).alias("p")).select("p.*")


def acf(df: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """Autocorrelation as the correlation of a series with its own lags."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, F.col(value), *(F.lag(value, k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    a = d.groupBy(*keys).agg(*(F.corr(value, f"l{k}").alias(f"l{k}") for k in range(1, lags + 1)))
    return a.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("acf")) for k in range(1, lags + 1)))).alias("x")).select(*keys, "x.*")


def mutual_information(binned: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies (bits) of two binned columns and what they share."""
    joint = binned.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count()

    def h(d: DataFrame, name: str) -> DataFrame:
        n = F.sum("count")
        return d.agg((F.log2(n) - F.sum(F.col("count") * F.log2("count")) / n).alias(name))

    ha = h(joint.groupBy(a).agg(F.sum("count").alias("count")), "ha")
    hb = h(joint.groupBy(b).agg(F.sum("count").alias("count")), "hb")
    hj = h(joint, "hj")
    return ha.join(F.broadcast(hb)).join(F.broadcast(hj)).select((F.col("ha") + F.col("hb") - F.col("hj")).alias("mi"), F.col("hj").alias("jinf"), F.col("ha").alias("infa"), F.col("hb").alias("infb"))


def circular(df: DataFrame, keys: list[str], phase: Column) -> DataFrame:
    """Mean angle (degrees) and resultant length of phases in radians."""
    a = df.groupBy(*keys).agg(F.avg(F.cos(phase)).alias("c"), F.avg(F.sin(phase)).alias("s"), F.count("*").alias("n"))
    return a.select(*keys, "n", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("itpc"), F.pmod(F.degrees(F.atan2("s", "c")) + 360, F.lit(360.0)).alias("angle"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between and within variance components and F of one-way groups."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return s.select("k", "n", between.alias("ss_between"), F.col("within").alias("ss_within"), F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k"))).alias("f"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's chi-square of a table of two label columns, and its degrees of freedom; no pair of labels is made that doesn't occur."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("o"))
    row, col = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    n = cells.agg(F.sum("o").alias("n")).withColumn("_k", F.lit(1))
    # sum (o - e)^2 / e = n (sum o^2 / (ra cb) - 1), to which cells that are empty add nothing
    s = cells.join(row, "a").join(col, "b").agg(F.sum(F.col("o") * F.col("o") / F.col("ra") / F.col("cb")).alias("s")).withColumn("_k", F.lit(1))
    d = row.agg(F.count("*").alias("r")).withColumn("_k", F.lit(1)).join(col.agg(F.count("*").alias("c")).withColumn("_k", F.lit(1)), "_k")
    return s.join(n, "_k").join(d, "_k").select((F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"))


def runs_test(df: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """Number of runs of a two-valued series and its z-score under random order (Wald and Wolfowitz)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.select(*keys, *order, hit.alias("_h")).withColumn("_new", F.when(F.lag("_h").over(w).eqNullSafe(F.col("_h")), 0).otherwise(1))
    g = d.groupBy(*keys).agg(F.sum("_new").alias("runs"), F.sum(F.col("_h").cast("int")).cast("double").alias("n1"), F.sum((~F.col("_h")).cast("int")).cast("double").alias("n0"))
    n, both = F.col("n1") + F.col("n0"), 2 * F.col("n1") * F.col("n0")
    mean, var = both / n + 1, both * (both - n) / (n * n * (n - 1))
    return g.select(*keys, "runs", F.when((F.col("n1") > 0) & (F.col("n0") > 0) & (n > 1) & (both != n), (F.col("runs") - mean) / F.sqrt(var)).alias("z"))


def matthews(df: DataFrame, a: str, b: str) -> DataFrame:
    """Matthews' correlation of two label columns (any number of labels) and the mean F1 over the labels of ``a``."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("o"))
    long = cells.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("o").alias("t"), F.lit(0.0).alias("p")), F.struct(F.col("b").alias("k"), F.lit(0.0).alias("t"), F.col("o").alias("p")))).alias("x"), (F.col("a") == F.col("b")).alias("same"))
    per = long.groupBy("x.k").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum(F.when(F.col("same"), F.col("x.t")).otherwise(0.0)).alias("c"))
    f1 = F.when(F.col("t") > 0, 2 * F.col("c") / (F.col("t") + F.col("p")))
    g = per.agg(F.sum("c").alias("c"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.avg(f1).alias("f1"))
    s2 = F.col("s") * F.col("s")
    return g.select(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))).alias("mcc"), "f1")


def percentile_scaled(df: DataFrame, keys: list[str], order: list[str], value: str, p: float = 0.95, segments: int = 4, out: str = "scaled") -> DataFrame:
    """sign(r) ln(|r| / q + 1) of the centred value r, q the lower median of the segments' truncated percentiles (q = 0: r itself).

    The first segments * (n div segments) values of a group make the segments.
    """
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_rn": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w), "_centred": F.col(value) - F.avg(value).over(w)})
    size = F.floor(F.col("_n") / segments)
    d = d.withColumn("_s", F.when(size > 0, F.floor(F.col("_rn") / size)))
    cut = trunc_percentile(d.where(F.col("_s") < segments), [*keys, "_s"], "_centred", p).groupBy(*keys).agg(lower_median("pctl").alias("_q"))
    r, q = F.col("_centred"), F.col("_q")
    return d.join(cut, keys, "left").withColumn(out, F.when(F.coalesce(q, F.lit(0.0)) == 0, r).otherwise(F.signum(r) * F.log(F.abs(r) / q + 1))).drop("_rn", "_n", "_centred", "_s", "_q")
