"""Registered queries over the driver's tables that DuckDB can check, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hypnoframe.functions import stats
from hypnoframe.operators import epochs as ep
from hypnoframe.operators import hypno, rolling
from hypnoframe.operators import intervals as iv
from hypnoframe.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}

#: 2024-01-01, from which epochs count
T0 = 1_704_067_200_000_000_000
DAY, HOUR, MIN = 24 * iv.HOUR, iv.HOUR, 60 * iv.SECOND
CTE = """WITH s AS (SELECT user_id AS id, event_type AS ch, epoch_us(ts) * 1000 AS t_ns, value AS x, event_id AS ix FROM events),
a AS (SELECT id, ch AS class, t_ns AS start_ns, t_ns + CAST(round(x * 100) AS BIGINT) * 600000000 AS stop_ns FROM s),
flat0 AS (SELECT *, max(stop_ns) OVER (PARTITION BY id, class ORDER BY start_ns, stop_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a),
flat1 AS (SELECT *, sum(CASE WHEN b IS NULL OR start_ns > b THEN 1 ELSE 0 END) OVER (PARTITION BY id, class ORDER BY start_ns, stop_ns ROWS UNBOUNDED PRECEDING) AS run FROM flat0),
flat AS (SELECT id, class, min(start_ns) AS start_ns, max(stop_ns) AS stop_ns, count(*) AS n FROM flat1 GROUP BY id, class, run),
days AS (SELECT min((t_ns - 1704067200000000000) // 86400000000000) AS d0, max((t_ns - 1704067200000000000) // 86400000000000) + 1 AS d1 FROM s),
e AS (SELECT id, k - 24 * d0 + 1 AS e, 1704067200000000000 + k * 3600000000000 AS start_ns, 1704067200000000000 + (k + 1) * 3600000000000 AS stop_ns FROM (SELECT DISTINCT id FROM s), (SELECT d0, unnest(range(24 * d0, 24 * d1)) AS k FROM days))
"""


def query(sql: str | None = None, cte: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = CTE + sql if cte else sql
        return f

    return add


def hourly(spark, d):
    """Hourly epochs per user over the days that hold all events."""
    first, n = tables.hours(spark, d, T0)
    ids = tables.samples(spark, d).select("id").distinct().withColumn("dur_ns", F.lit(n * HOUR))
    at = T0 + first * HOUR
    return ep.epochs(ids, 3600.0).withColumns({"start_ns": F.col("start_ns") + at, "stop_ns": F.col("stop_ns") + at})


def of(spark, d, *classes):
    return tables.annots(spark, d).where(F.col("class").isin(list(classes)))


# ---- flagship -----------------------------------------------------------


@query(
    """, m AS (SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM a WHERE a.id = e.id AND a.class = 'error' AND CASE WHEN a.start_ns = a.stop_ns THEN e.start_ns <= a.start_ns AND a.start_ns < e.stop_ns ELSE a.start_ns < e.stop_ns AND a.stop_ns > e.start_ns END)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY e) AS e2 FROM m)
SELECT s.id, s.ch, r.e2 AS e, r.e AS e_orig, count(*) AS n, avg(x) AS mean, min(x) AS min, max(x) AS max, sqrt(avg(x * x)) AS rms
FROM s JOIN r ON s.id = r.id AND s.t_ns >= r.start_ns AND s.t_ns < r.stop_ns GROUP BY ALL"""
)
def flagship_epoch_mask_stats(spark, d):
    """EPOCH, MASK ifnot=error, RE, STATS epoch."""
    eps = ep.restructure(ep.mask_annots(hourly(spark, d), of(spark, d, "error"), ["error"], ep.FORCE, negate=True))
    s = tables.samples(spark, d).withColumn("_h", F.floor((F.col("t_ns") - T0) / HOUR) + 1 - tables.hours(spark, d, T0)[0])
    # the grid is regular, so samples meet epochs by an equi-join on the epoch's number
    j = s.join(iv.shuffled(eps.select("id", F.col("e_orig").alias("_h"), "e")), ["id", "_h"])
    x = F.col("x")
    return j.groupBy("id", "ch", "e", F.col("_h").alias("e_orig")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), stats.rms(x).alias("rms"))


# ---- descriptive statistics ---------------------------------------------


@query(
    """SELECT id, ch, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, sqrt(avg(x * x)) AS rms, min(x) AS min, max(x) AS max,
quantile_disc(x, 0.5) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, round(0.7413 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 9) AS robust_sd,
CASE WHEN count(*) > 1 THEN (sum(pow(x - m, 3)) / count(*)) / pow(stddev_samp(x), 3) END AS skew, CASE WHEN count(*) > 1 THEN (sum(pow(x - m, 4)) / count(*)) / pow(var_pop(x), 2) - 3 END AS kurt
FROM (SELECT *, avg(x) OVER (PARTITION BY id, ch) AS m FROM s) GROUP BY id, ch HAVING count(*) > 2"""
)
def stats_by_channel(spark, d):
    x = F.col("x")
    out = tables.samples(spark, d).groupBy("id", "ch").agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), stats.rms(x).alias("rms"), F.min(x).alias("min"), F.max(x).alias("max"), stats.lower_median("x").alias("median"),
        stats.iqr(x).alias("iqr"), F.round(stats.robust_sd(x), 9).alias("robust_sd"), stats.skew(x).alias("skew"), stats.kurt(x).alias("kurt"),
    )
    return out.where("n > 2")


@query(
    """, ep1 AS (SELECT id, ch, (t_ns - 1704067200000000000) // 3600000000000 AS e, avg(x) AS m, sqrt(avg(x * x)) AS r FROM s GROUP BY ALL)
SELECT id, ch, count(*) AS ne, avg(m) AS mean_mn, quantile_disc(m, 0.5) AS mean_md, avg(r) AS rms_mn, quantile_disc(r, 0.5) AS rms_md FROM ep1 GROUP BY id, ch"""
)
def stats_two_level(spark, d):
    """Epoch statistics, then their means and lower medians."""
    e = tables.samples(spark, d).groupBy("id", "ch", F.floor((F.col("t_ns") - T0) / HOUR).alias("e")).agg(F.avg("x").alias("m"), stats.rms(F.col("x")).alias("r"))
    return e.groupBy("id", "ch").agg(F.count("*").alias("ne"), F.avg("m").alias("mean_mn"), stats.lower_median("m").alias("mean_md"), F.avg("r").alias("rms_mn"), stats.lower_median("r").alias("rms_md"))


@query(
    """, r AS (SELECT l_returnflag AS flag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT flag, v AS pctl FROM r WHERE k = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1"""
)
def pctl_trunc(spark, d):
    li = tables.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    return stats.trunc_percentile(li, ["flag"], "v", 0.95)


@query(
    """, o AS (SELECT *, x - lag(x) OVER w AS dx FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns, ix)), o2 AS (SELECT *, dx - lag(dx) OVER (PARTITION BY id ORDER BY t_ns, ix) AS ddx FROM o),
g AS (SELECT id, var_pop(x) AS v0, var_pop(dx) AS v1, var_pop(ddx) AS v2, count(*) AS n FROM o2 GROUP BY id)
SELECT id, CASE WHEN n < 3 THEN 0 ELSE v0 END AS "H1", CASE WHEN n < 3 THEN 0 ELSE sqrt(v1 / v0) END AS "H2", CASE WHEN n < 3 THEN 0 ELSE sqrt(v2 / v1) / sqrt(v1 / v0) END AS "H3" FROM g"""
)
def hjorth(spark, d):
    s = tables.samples(spark, d).withColumn("o", F.struct("t_ns", "ix"))
    return stats.hjorth(s, ["id"], "o", "x")


@query(
    """, o AS (SELECT *, x - lag(x) OVER (PARTITION BY id ORDER BY t_ns, ix) > 0 AS up FROM s), o2 AS (SELECT *, CAST(up <> lag(up) OVER (PARTITION BY id ORDER BY t_ns, ix) AS INT) AS turn FROM o)
SELECT id, CASE WHEN count(*) < 3 THEN 0.0 ELSE log10(count(*)) / (log10(count(*)) + log10(count(*) / (count(*) + 0.4 * sum(turn)))) END AS "PFD" FROM o2 GROUP BY id"""
)
def petrosian_fd(spark, d):
    return stats.petrosian(tables.samples(spark, d).withColumn("o", F.struct("t_ns", "ix")), ["id"], "o", "x")


@query("""SELECT ch, floor(x / 10.0) * 10.0 AS bin, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 3""")
def tabulate(spark, d):
    return stats.tabulated(tables.samples(spark, d), ["ch"], "x", 10.0, 3)


@query(
    """, r AS (SELECT min(x) AS lo, max(x) AS hi FROM s), h AS (SELECT least(99, CAST(floor((x - lo) / (hi - lo) * 100) AS INT)) AS b, lo, hi, count(*) AS n FROM s, r GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (ORDER BY b) AS n0, sum(n * b) OVER (ORDER BY b) AS s0, sum(n) OVER () AS n1, sum(n * b) OVER () AS s1 FROM h),
v AS (SELECT *, CASE WHEN n0 < n1 THEN pow(s1 / n1 * (n0 / n1) - s0 / n1, 2) / (n0 / n1 * (1 - n0 / n1)) ELSE 0.0 END AS sigma_b FROM c)
SELECT lo + (b + 1) * (hi - lo) / 100 AS threshold, sigma_b FROM v ORDER BY sigma_b DESC, b LIMIT 1"""
)
def otsu_threshold(spark, d):
    return stats.otsu(tables.samples(spark, d), "x", 100)


@query(
    """WITH p AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
ra AS (SELECT a AS k, sum(c) AS ra FROM p GROUP BY a), cb AS (SELECT b AS k, sum(c) AS cb FROM p GROUP BY b), t AS (SELECT sum(c) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS g FROM p),
e AS (SELECT coalesce(sum(ra * cb), 0) AS e FROM ra JOIN cb USING (k))
SELECT CAST(n AS BIGINT) AS n, g / n AS acc, (g / n - e / (n * n)) / (1 - e / (n * n)) AS kappa FROM t, e""",
    cte=False,
)
def stage_kappa(spark, d):
    return stats.kappa(tables.load(spark, d, "labels"), "quality", "toxic")


@query("""SELECT event_type AS ch, count(DISTINCT user_id) AS ids, count(*) AS n FROM events GROUP BY event_type""", cte=False)
def contains_counts(spark, d):
    return tables.samples(spark, d).groupBy("ch").agg(F.countDistinct("id").alias("ids"), F.count("*").alias("n"))


# ---- epochs, masks, restructuring ----------------------------------------


@query("""SELECT id, ch, (t_ns - 1704067200000000000) // 1800000000000 + 1 AS e, count(*) AS n, sum(x) AS total FROM s GROUP BY ALL""")
def epoch_fixed(spark, d):
    s = tables.samples(spark, d)
    return s.groupBy("id", "ch", (F.floor((F.col("t_ns") - T0) / (HOUR // 2)) + 1).alias("e")).agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query("""SELECT id, k + 1 AS e, count(*) AS n, max(x) AS top FROM (SELECT *, unnest(range(greatest(0, (t_ns - 1704067200000000000) // 3600000000000 - 1), (t_ns - 1704067200000000000) // 3600000000000 + 1)) AS k FROM s) GROUP BY id, k""")
def epoch_sliding(spark, d):
    """Two-hour epochs every hour."""
    at = F.col("t_ns") - T0
    first, last = F.greatest(F.lit(0), F.floor((at - 2 * HOUR) / HOUR) + 1), F.floor(at / HOUR)
    s = tables.samples(spark, d).select("id", "x", F.explode(F.sequence(first, last)).alias("k"))
    return s.groupBy("id", (F.col("k") + 1).alias("e")).agg(F.count("*").alias("n"), F.max("x").alias("top"))


def _mask_sql(test: str) -> str:
    return f""", hit AS (SELECT e.id, e.e, count(DISTINCT a.class) AS k, count(DISTINCT CASE WHEN a.start_ns <= e.start_ns AND a.stop_ns >= e.stop_ns THEN a.class END) AS spans FROM e JOIN a ON a.id = e.id AND a.class IN ('error', 'view')
AND CASE WHEN a.start_ns = a.stop_ns THEN e.start_ns <= a.start_ns AND a.start_ns < e.stop_ns ELSE a.start_ns < e.stop_ns AND a.stop_ns > e.start_ns END GROUP BY ALL)
SELECT e.id, e.e, {test} AS masked FROM e LEFT JOIN hit USING (id, e)"""


@query(_mask_sql("coalesce(k >= 1, false)"))
def mask_if(spark, d):
    return ep.mask_annots(hourly(spark, d), tables.annots(spark, d), ["error", "view"]).select("id", "e", "masked")


@query(_mask_sql("NOT coalesce(k >= 1, false)"))
def mask_ifnot(spark, d):
    return ep.mask_annots(hourly(spark, d), tables.annots(spark, d), ["error", "view"], negate=True).select("id", "e", "masked")


@query(_mask_sql("coalesce(k >= 2, false)"))
def mask_if_all(spark, d):
    return ep.mask_annots(hourly(spark, d), tables.annots(spark, d), ["error", "view"], every=True).select("id", "e", "masked")


@query(_mask_sql("coalesce(spans >= 1, false)"))
def mask_if_spanned(spark, d):
    return ep.mask_annots(hourly(spark, d), tables.annots(spark, d), ["+error", "+view"]).select("id", "e", "masked")


@query(_mask_sql("NOT coalesce(k >= 1, false)"))
def mask_all_then_unmask_if(spark, d):
    """MASK all, then unmask-if: only unmasks matching epochs."""
    return ep.mask_annots(ep.mask_all(hourly(spark, d)), tables.annots(spark, d), ["error", "view"], ep.UNMASK).select("id", "e", "masked")


_LABELLED = """, lab AS (SELECT id, e.e, coalesce(min(s.ch), '?') AS label FROM e LEFT JOIN s USING (id) WHERE s.t_ns >= e.start_ns AND s.t_ns < e.stop_ns GROUP BY ALL),
le AS (SELECT e.id, e.e, coalesce(lab.label, '?') AS label FROM e LEFT JOIN lab USING (id, e))"""


def labelled(spark, d):
    """Hourly epochs labelled with the first event type in them, `?` without one."""
    s = tables.samples(spark, d).groupBy("id", (F.floor((F.col("t_ns") - T0) / HOUR) + 1).alias("e")).agg(F.min("ch").alias("label"))
    return hourly(spark, d).join(iv.shuffled(s), ["id", "e"], "left").withColumn("label", F.coalesce("label", F.lit("?")))


@query(_LABELLED + " SELECT id, e, coalesce(sum(CAST(label = '?' AS INT)) OVER (PARTITION BY id ORDER BY e ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) < 5 AS masked FROM le")
def mask_flanked(spark, d):
    return ep.mask_flanked(labelled(spark, d), "?", 2).select("id", "e", "masked")


@query(_LABELLED + ", f AS (SELECT id, min(e) FILTER (label <> '?') AS f, max(e) FILTER (label <> '?') AS l FROM le GROUP BY id) SELECT le.id, e, coalesce(e < f - 2 OR e > l + 2, false) AS masked FROM le JOIN f USING (id)")
def mask_trim(spark, d):
    return ep.mask_trim(labelled(spark, d), "?", 2).select("id", "e", "masked")


@query(_LABELLED + ", g AS (SELECT *, CAST(label = '?' AS INT) AS good FROM le), b AS (SELECT *, coalesce(sum(good) OVER (PARTITION BY id ORDER BY e ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS back, coalesce(sum(good) OVER (PARTITION BY id ORDER BY e ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS ahead FROM g), m AS (SELECT id, e, good = 0 OR (back < 3 AND ahead < 3) AS m FROM b) SELECT id, e, m OR (coalesce(lag(m) OVER (PARTITION BY id ORDER BY e), true) AND coalesce(lead(m) OVER (PARTITION BY id ORDER BY e), true)) AS masked FROM m")
def mask_regional(spark, d):
    eps = ep.mask_expr(labelled(spark, d), F.col("label") != "?")
    return ep.mask_regional(eps, 3, 4).select("id", "e", "masked")


@query(_LABELLED + ", k AS (SELECT *, sum(CAST(label <> '?' AS INT)) OVER (PARTITION BY id ORDER BY e ROWS UNBOUNDED PRECEDING) AS k FROM le) SELECT id, e AS e_orig, row_number() OVER (PARTITION BY id ORDER BY e) AS e FROM k WHERE label <> '?' AND k <= 5")
def mask_first_restructure(spark, d):
    eps = ep.mask_first(ep.mask_expr(labelled(spark, d), F.col("label") == "?"), 5)
    return ep.restructure(eps).select("id", "e", "e_orig")


@query(""", k AS (SELECT DISTINCT s.id, s.ch, s.ix FROM s JOIN a ON a.id = s.id AND a.class = 'purchase' AND a.start_ns <= s.t_ns AND s.t_ns < a.stop_ns) SELECT ch, count(*) AS n FROM k GROUP BY ch""")
def restructure_samples(spark, d):
    """Samples within purchase intervals: a left semi range join."""
    keep = of(spark, d, "purchase").withColumn("masked", F.lit(False))
    return ep.retained(tables.samples(spark, d), keep).groupBy("ch").agg(F.count("*").alias("n"))


@query(""", q AS (SELECT id, ch, (t_ns - 1704067200000000000) // 86400000000000 AS e, max(x) AS v FROM s GROUP BY ALL), z AS (SELECT *, abs(v - avg(v) OVER w) / stddev_samp(v) OVER w > 2 AS m FROM q WINDOW w AS (PARTITION BY id, ch)) SELECT id, ch, e, coalesce(m, false) AS masked FROM z""")
def chep_mask(spark, d):
    v = tables.samples(spark, d).groupBy("id", "ch", F.floor((F.col("t_ns") - T0) / DAY).alias("e")).agg(F.max("x").alias("v"))
    return ep.chep_outliers(v, "v", [2.0]).select("id", "ch", "e", "masked")


# ---- interval algebra ----------------------------------------------------


@query("SELECT id, class, start_ns, stop_ns, n FROM flat")
def iv_flatten(spark, d):
    return iv.islands(tables.annots(spark, d), ["id", "class"])


@query("SELECT x.id, greatest(x.start_ns, y.start_ns) AS start_ns, least(x.stop_ns, y.stop_ns) AS stop_ns FROM flat x JOIN flat y ON x.id = y.id AND x.class = 'error' AND y.class = 'view' AND x.start_ns < y.stop_ns AND x.stop_ns > y.start_ns")
def iv_intersect(spark, d):
    return iv.intersection(of(spark, d, "error"), of(spark, d, "view"), ["id"])


@query(""", u AS (SELECT id, start_ns, stop_ns, max(stop_ns) OVER (PARTITION BY id ORDER BY start_ns, stop_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b2 FROM a WHERE class IN ('error', 'view')), v AS (SELECT *, sum(CASE WHEN b2 IS NULL OR start_ns > b2 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY start_ns, stop_ns ROWS UNBOUNDED PRECEDING) AS run FROM u) SELECT id, min(start_ns) AS start_ns, max(stop_ns) AS stop_ns FROM v GROUP BY id, run""")
def iv_union(spark, d):
    return iv.union(of(spark, d, "error"), of(spark, d, "view"), ["id"])


_EXISTS = "EXISTS (SELECT 1 FROM a b WHERE b.id = a.id AND b.class = 'view' AND CASE WHEN b.start_ns = b.stop_ns THEN a.start_ns <= b.start_ns AND b.start_ns < a.stop_ns ELSE b.start_ns < a.stop_ns AND b.stop_ns > a.start_ns END)"


def _view(spark, d):
    return of(spark, d, "view").select("id", F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))


@query(f"SELECT DISTINCT id, start_ns, stop_ns FROM a WHERE class = 'error' AND {_EXISTS}")
def iv_keep(spark, d):
    return iv.range_join(of(spark, d, "error").drop("class"), _view(spark, d), ["id"], how="left_semi")


@query(f"SELECT id, start_ns, stop_ns FROM a WHERE class = 'error' AND NOT {_EXISTS}")
def iv_drop(spark, d):
    return iv.range_join(of(spark, d, "error").drop("class"), _view(spark, d), ["id"], how="left_anti")


@query("SELECT a.id, a.start_ns, a.stop_ns, b.start_ns AS r_start, b.stop_ns AS r_stop FROM a JOIN a b ON a.id = b.id AND a.class = 'error' AND b.class = 'view' AND CASE WHEN b.start_ns = b.stop_ns THEN a.start_ns <= b.start_ns AND b.start_ns < a.stop_ns ELSE b.start_ns < a.stop_ns AND b.stop_ns > a.start_ns END")
def iv_range_join(spark, d):
    return iv.range_join(of(spark, d, "error").drop("class"), _view(spark, d), ["id"])


@query(""", b AS (SELECT DISTINCT id, 1704067200000000000 AS lo, 1704067200000000000 + 31 * 86400000000000 AS hi FROM s), f AS (SELECT * FROM flat WHERE class = 'error'), g AS (SELECT b.id, coalesce(lag(stop_ns) OVER (PARTITION BY b.id ORDER BY start_ns), lo) AS start_ns, start_ns AS stop_ns FROM f JOIN b USING (id)
UNION ALL SELECT id, max(stop_ns), any_value(hi) FROM f JOIN b USING (id) GROUP BY id UNION ALL SELECT id, lo, hi FROM b WHERE id NOT IN (SELECT id FROM f)) SELECT id, start_ns, stop_ns FROM g WHERE start_ns < stop_ns""")
def iv_complement(spark, d):
    bounds = tables.samples(spark, d).select("id").distinct().select("id", F.lit(T0).alias("lo"), F.lit(T0 + 31 * DAY).alias("hi"))
    return iv.complement(of(spark, d, "error"), ["id"], bounds)


@query(""", ed AS (SELECT id, t, sum(da) AS da, sum(db) AS db FROM (SELECT id, start_ns AS t, 1 AS da, 0 AS db FROM flat WHERE class = 'error' UNION ALL SELECT id, stop_ns, -1, 0 FROM flat WHERE class = 'error' UNION ALL SELECT id, start_ns, 0, 1 FROM flat WHERE class = 'view' UNION ALL SELECT id, stop_ns, 0, -1 FROM flat WHERE class = 'view') GROUP BY id, t),
r AS (SELECT id, t AS start_ns, lead(t) OVER w AS stop_ns, sum(da) OVER (w ROWS UNBOUNDED PRECEDING) AS ia, sum(db) OVER (w ROWS UNBOUNDED PRECEDING) AS ib FROM ed WINDOW w AS (PARTITION BY id ORDER BY t)), k AS (SELECT * FROM r WHERE ia > 0 AND ib = 0 AND stop_ns IS NOT NULL),
n AS (SELECT *, CASE WHEN lag(stop_ns) OVER (PARTITION BY id ORDER BY start_ns) = start_ns THEN 0 ELSE 1 END AS new FROM k), g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY start_ns ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT id, min(start_ns) AS start_ns, max(stop_ns) AS stop_ns FROM g GROUP BY id, run""")
def iv_excise(spark, d):
    return iv.excise(of(spark, d, "error"), of(spark, d, "view"), ["id"])


@query("""SELECT e.id, e.e, coalesce(sum(CASE WHEN f.id IS NOT NULL THEN (least(e.stop_ns, f.stop_ns) - greatest(e.start_ns, f.start_ns)) / 1e9 END), 0) AS sec, count(f.id) AS cnt, CAST(count(f.id) > 0 AS INT) AS has FROM e LEFT JOIN (SELECT * FROM flat WHERE class = 'error') f ON f.id = e.id AND f.start_ns < e.stop_ns AND f.stop_ns > e.start_ns GROUP BY e.id, e.e""")
def espan(spark, d):
    return iv.coverage(hourly(spark, d).select("id", "e", "start_ns", "stop_ns"), of(spark, d, "error"), ["id"]).select("id", "e", "sec", "cnt", "has")


@query(""", p AS (SELECT a.id, a.class, a.start_ns, a.stop_ns, f.class AS annot, sum((least(a.stop_ns, f.stop_ns) - greatest(a.start_ns, f.start_ns)) / 1e9) AS t, count(*) AS n FROM a JOIN flat f ON a.id = f.id AND a.class <> f.class AND a.stop_ns > a.start_ns AND CASE WHEN f.start_ns = f.stop_ns THEN a.start_ns <= f.start_ns AND f.start_ns < a.stop_ns ELSE f.start_ns < a.stop_ns AND f.stop_ns > a.start_ns END GROUP BY ALL),
c AS (SELECT class, count(*) AS seeds FROM a WHERE stop_ns > start_ns GROUP BY class)
SELECT class AS seed, annot, sum(t / ((stop_ns - start_ns) / 1e9)) / any_value(seeds) AS "P", sum(t) / any_value(seeds) AS "T", sum(n) / any_value(seeds) AS "N", count(*) / any_value(seeds) AS "A", CAST(sum(n) AS BIGINT) AS "TOT_N", sum(t) AS "TOT_T" FROM p JOIN c USING (class) GROUP BY class, annot""")
def axa(spark, d):
    a = tables.annots(spark, d)
    return iv.axa(a, a, ["id"])


@query(""", f AS (SELECT id, sum(stop_ns - start_ns) / 1e9 AS s FROM flat WHERE class = 'error' GROUP BY id) SELECT id, s AS spanned_sec, 100 * s / (31 * 86400) AS spanned_pct FROM f""")
def spanning(spark, d):
    f = iv.islands(of(spark, d, "error"), ["id"]).groupBy("id").agg((F.sum(F.col("stop_ns") - F.col("start_ns")) / iv.SECOND).alias("spanned_sec"))
    return f.withColumn("spanned_pct", 100 * F.col("spanned_sec") / (31 * 86400))


@query("""SELECT class, count(*) AS count, sum((stop_ns - start_ns) / 1e9) AS dur FROM a GROUP BY class""")
def annots_summary(spark, d):
    return iv.class_summary(tables.annots(spark, d))


@query("""SELECT x.id, x.ix, x.t_ns, p.t_ns AS prev_t FROM (SELECT * FROM s WHERE ch = 'error') x ASOF LEFT JOIN (SELECT id, t_ns FROM s WHERE ch = 'purchase') p ON x.id = p.id AND x.t_ns >= p.t_ns""")
def asof_nearest(spark, d):
    s = tables.samples(spark, d)
    near = iv.nearest(s.where("ch = 'error'").select("id", "ix", "t_ns"), s.where("ch = 'purchase'").select("id", "t_ns"), ["id"])
    return near.select("id", "ix", "t_ns", "prev_t")


@query(""", g AS (SELECT *, CASE WHEN lag(t_ns) OVER w IS NULL OR t_ns - lag(t_ns) OVER w > 21600000000000 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns)), h AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY t_ns) AS seg FROM g) SELECT id, CAST(seg AS BIGINT) AS seg, min(t_ns) AS start_ns, max(t_ns) AS stop_ns, count(*) AS n FROM h GROUP BY id, seg""")
def segments(spark, d):
    return iv.segments(tables.samples(spark, d), ["id"], "t_ns", 6 * HOUR)


@query("""SELECT f.class, s.ch, count(*) AS n, avg(s.x) AS m FROM flat f JOIN s ON s.id = f.id AND s.t_ns >= f.start_ns AND s.t_ns < f.stop_ns GROUP BY ALL""")
def means_by_annot(spark, d):
    f = iv.islands(tables.annots(spark, d), ["id", "class"]).drop("n")
    s = tables.samples(spark, d).select("id", "ch", "x", F.col("t_ns").alias("r_start"), F.col("t_ns").alias("r_stop"))
    return iv.range_join(f, s, ["id"]).groupBy("class", "ch").agg(F.count("*").alias("n"), F.avg("x").alias("m"))


@query("""SELECT CAST(CASE WHEN x < 20 THEN 0 WHEN x < 60 THEN 1 ELSE 2 END AS INT) AS level, count(*) AS runs, sum(c) AS n FROM (SELECT id, lvl AS x0, run, any_value(x) AS x, count(*) AS c FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY t_ns, ix ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(lvl) OVER (PARTITION BY id ORDER BY t_ns, ix) = lvl THEN 0 ELSE 1 END AS new FROM (SELECT *, CASE WHEN x < 20 THEN 0 WHEN x < 60 THEN 1 ELSE 2 END AS lvl FROM s))) GROUP BY id, lvl, run) GROUP BY level""")
def s2a_levels(spark, d):
    """Signal to annotation: runs of a value level."""
    s = tables.samples(spark, d).withColumn("o", F.struct("t_ns", "ix")).withColumn("level", F.when(F.col("x") < 20, 0).when(F.col("x") < 60, 1).otherwise(2))
    return hypno.bouts(s, ["id"], "o", "level").groupBy("level").agg(F.count("*").alias("runs"), F.sum("n").alias("n"))


# ---- windows over time ---------------------------------------------------


@query(""", o AS (SELECT id, ix, x, t_ns, row_number() OVER w AS rn, count(*) OVER (PARTITION BY id) AS c, avg(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns, ix)),
k AS (SELECT id, max(m) FILTER (rn = 3) AS lo, max(m) FILTER (rn = c - 2) AS hi FROM o GROUP BY id) SELECT o.id, o.ix, CASE WHEN c < 5 THEN avg(x) OVER (PARTITION BY o.id) WHEN rn <= 2 THEN lo WHEN rn > c - 2 THEN hi ELSE m END AS ma FROM o JOIN k USING (id)""")
def moving_average(spark, d):
    return rolling.moving_average(tables.samples(spark, d), ["id"], ["t_ns", "ix"], "x", 5).select("id", "ix", "ma")


@query("""SELECT id, ix, quantile_disc(x, 0.5) OVER (PARTITION BY id ORDER BY t_ns, ix ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS md FROM s""")
def median_filter(spark, d):
    return rolling.median_filter(tables.samples(spark, d), ["id"], ["t_ns", "ix"], "x", 7).select("id", "ix", "md")


@query("""SELECT id, ix, x - lag(x) OVER w AS diff, lag(x, 3) OVER w AS shifted, sum(x) OVER (w ROWS UNBOUNDED PRECEDING) AS acc FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns, ix)""")
def difference_shift_accumulate(spark, d):
    o = ["t_ns", "ix"]
    s = rolling.difference(tables.samples(spark, d), ["id"], o, "x")
    s = rolling.accumulate(rolling.shift(s, ["id"], o, "x", 3, wrap=False), ["id"], o, "x")
    return s.select("id", "ix", "diff", "shifted", "acc")


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t_ns, ix) - 1 AS rn, count(*) OVER (PARTITION BY id) AS c FROM s) SELECT o.id, o.ix, p.x AS shifted FROM o JOIN o p ON o.id = p.id AND (p.rn + 3) % o.c = o.rn""")
def shift_wrap(spark, d):
    return rolling.shift(tables.samples(spark, d), ["id"], ["t_ns", "ix"], "x", 3).select("id", "ix", "shifted")


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t_ns, ix) AS rn, count(*) OVER (PARTITION BY id) AS n FROM s),
p AS (SELECT id, ix, x, n, rn AS pos, true AS own FROM r UNION ALL SELECT id, ix, x, n, rn - 6, false FROM r WHERE rn BETWEEN 2 AND 6 UNION ALL SELECT id, ix, x, n, rn + 6, false FROM r WHERE rn BETWEEN n - 5 AND n - 1)
SELECT id, ix, z FROM (SELECT id, ix, own, CASE WHEN n > 5 THEN (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END AS z FROM p WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE own"""
)
def rolling_norm(spark, d):
    return rolling.rolling_norm(tables.samples(spark, d), ["id"], ["t_ns", "ix"], "x", 11).select("id", "ix", "z")


@query("""SELECT id, ix, x FROM (SELECT *, max(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, max(x) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS c FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns, ix)) WHERE x > b AND x > c""")
def peaks(spark, d):
    return rolling.peaks(tables.samples(spark, d), ["id"], ["t_ns", "ix"], "x").select("id", "ix", "x")


@query("""SELECT id, q, avg(x) AS ss, count(*) AS n FROM (SELECT *, ntile(10) OVER (PARTITION BY id ORDER BY t_ns, ix) AS q FROM s) GROUP BY id, q""")
def quantile_dynamics(spark, d):
    return rolling.quantile_dynamics(tables.samples(spark, d), ["id"], ["t_ns", "ix"], "x")


@query(""", o AS (SELECT id, ix, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns, ix)) SELECT id, CAST(k AS INT) AS lag, CASE k WHEN 1 THEN corr(x, l1) WHEN 2 THEN corr(x, l2) ELSE corr(x, l3) END AS acf FROM o, (SELECT unnest([1, 2, 3]) AS k) GROUP BY id, k""")
def acf_lag(spark, d):
    s = tables.samples(spark, d).withColumn("o", F.struct("t_ns", "ix"))
    return stats.acf(s, ["id"], "o", "x", 3)


# ---- pairs, information, sequences ---------------------------------------

_CH = ["click", "error", "purchase", "signup", "view"]
_WIDE = ", w AS (SELECT (t_ns - 1704067200000000000) // 86400000000000 AS day, id % 10 AS g, " + ", ".join(f"avg(x) FILTER (ch = '{c}') AS {c}" for c in _CH) + " FROM s GROUP BY ALL)"


def _wide(spark, d):
    s = tables.samples(spark, d)
    return s.groupBy(F.floor((F.col("t_ns") - T0) / DAY).alias("day"), (F.col("id") % 10).alias("g")).pivot("ch", _CH).agg(F.avg("x"))


@query(_WIDE + " " + " UNION ALL ".join(f"SELECT '{x}' AS ch1, '{y}' AS ch2, corr({x}, {y}) AS r, covar_samp({x}, {y}) AS cov FROM w" for i, x in enumerate(_CH) for y in _CH[i + 1 :]))
def corr_pairs(spark, d):
    return stats.correlations(_wide(spark, d), _CH)


@query(_WIDE + """, b AS (SELECT floor(click / 10) AS a, floor(error / 10) AS b, count(*) AS c FROM w WHERE click IS NOT NULL AND error IS NOT NULL GROUP BY ALL),
ja AS (SELECT sum(c) AS c FROM b GROUP BY a), jb AS (SELECT sum(c) AS c FROM b GROUP BY b), h AS (SELECT (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) FROM ja) AS ha, (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) FROM jb) AS hb, (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) FROM b) AS hj)
SELECT ha + hb - hj AS mi, hj AS jinf, ha AS infa, hb AS infb FROM h""")
def mutual_info(spark, d):
    w = _wide(spark, d).select(F.floor(F.col("click") / 10).alias("a"), F.floor(F.col("error") / 10).alias("b"))
    return stats.mutual_information(w, "a", "b")


@query(""", o AS (SELECT id, ch AS pre, lead(ch) OVER (PARTITION BY id ORDER BY t_ns, ix) AS post FROM s) SELECT pre, post, count(*) AS n FROM o WHERE post IS NOT NULL GROUP BY ALL""")
def transitions(spark, d):
    return hypno.transitions(tables.samples(spark, d).withColumn("o", F.struct("t_ns", "ix")), ["id"], "o", "ch")


@query(""", r0 AS (SELECT *, CASE WHEN lag(ch) OVER w = ch THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns, ix)), r1 AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY t_ns, ix ROWS UNBOUNDED PRECEDING) AS run FROM r0), r AS (SELECT id, run, ch, count(*) * 0.5 AS mins FROM r1 GROUP BY ALL)
SELECT ch, count(*) AS "BOUT_N", avg(mins) AS "BOUT_MN", quantile_disc(mins, 0.5) AS "BOUT_MD", max(mins) AS "BOUT_MX" FROM r GROUP BY ch""")
def bouts(spark, d):
    b = hypno.bouts(tables.samples(spark, d).withColumn("o", F.struct("t_ns", "ix")), ["id"], "o", "ch").withColumn("mins", F.col("n") * 0.5)
    return b.groupBy("ch").agg(F.count("*").alias("BOUT_N"), F.avg("mins").alias("BOUT_MN"), stats.lower_median("mins").alias("BOUT_MD"), F.max("mins").alias("BOUT_MX"))


_STAGED = _LABELLED + ", st AS (SELECT id, e, CASE label WHEN 'click' THEN 'N1' WHEN 'error' THEN 'N2' WHEN 'purchase' THEN 'N3' WHEN 'signup' THEN 'R' WHEN 'view' THEN 'W' ELSE 'W' END AS stage FROM le)"


def staged(spark, d):
    m = F.create_map(*(F.lit(x) for kv in (("click", "N1"), ("error", "N2"), ("purchase", "N3"), ("signup", "R"), ("view", "W"), ("?", "W")) for x in kv))
    return labelled(spark, d).select("id", "e", m[F.col("label")].alias("stage"))


@query(_STAGED + """, b AS (SELECT id, count(*) * 0.5 AS "TIB", min(e) FILTER (stage <> 'L') AS lo, max(e) FILTER (stage <> 'L') + 1 AS hi, min(e) FILTER (stage NOT IN ('W', '?', 'L')) AS fs, max(e) FILTER (stage NOT IN ('W', '?', 'L')) + 1 AS fw, min(e) FILTER (stage = 'R') AS fr, count(*) FILTER (stage = 'W') * 0.5 AS "TWT", count(*) FILTER (stage NOT IN ('W', '?', 'L')) * 0.5 AS "TST" FROM st GROUP BY id)
SELECT b.id, any_value("TIB") AS "TIB", any_value("TWT") AS "TWT", any_value("TST") AS "TST", any_value((fs - lo) * 0.5) AS "SOL", count(*) FILTER (stage = 'W' AND e >= fs AND e < fw) * 0.5 AS "WASO", any_value((hi - fw) * 0.5) AS "FWT", any_value(100 * "TST" / ((hi - lo) * 0.5)) AS "SE", any_value((fr - fs) * 0.5) AS "REM_LAT", CASE WHEN any_value(fr) IS NOT NULL THEN count(*) FILTER (stage IN ('N1', 'N2', 'N3') AND e >= fs AND e < fr) * 0.5 END AS "REM_LAT2" FROM b JOIN st USING (id) GROUP BY b.id""")
def hypno_summary(spark, d):
    return hypno.summary(staged(spark, d)).select("id", "TIB", "TWT", "TST", "SOL", "WASO", "FWT", "SE", "REM_LAT", "REM_LAT2")


@query(_STAGED + """, r0 AS (SELECT *, CASE WHEN lag(stage) OVER (PARTITION BY id ORDER BY e) = stage THEN 0 ELSE 1 END AS new FROM st), r1 AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY e ROWS UNBOUNDED PRECEDING) AS run FROM r0) SELECT id, e, row_number() OVER (PARTITION BY id, run ORDER BY e) - 1 AS flank_left, count(*) OVER (PARTITION BY id, run) - row_number() OVER (PARTITION BY id, run ORDER BY e) AS flank_right FROM r1""")
def hypno_flanking(spark, d):
    return hypno.flanking(staged(spark, d), ["id"]).select("id", "e", F.col("flank_left").cast("long").alias("flank_left"), "flank_right")


@query(_STAGED + """, o AS (SELECT id, e, stage, last_value(CASE WHEN stage <> 'N2' THEN stage END IGNORE NULLS) OVER (PARTITION BY id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(CASE WHEN stage <> 'N2' THEN stage END IGNORE NULLS) OVER (PARTITION BY id ORDER BY e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM st),
v AS (SELECT id, e, CASE WHEN l = 'N3' THEN 1.0 WHEN l IN ('N1', 'W', 'R') THEN -1.0 END AS p, CASE WHEN r = 'N3' THEN -1.0 WHEN r IN ('N1', 'W', 'R') THEN 1.0 END AS q FROM o WHERE stage = 'N2'), z AS (SELECT id, e, (coalesce(p, 0) + coalesce(q, 0)) / greatest(1, CAST(p IS NOT NULL AS INT) + CAST(q IS NOT NULL AS INT)) AS sc FROM v)
SELECT id, e, CAST(sc AS DOUBLE) AS score, CASE WHEN sc > 0.25 THEN 'A' WHEN sc < -0.25 THEN 'D' ELSE 'F' END AS n2 FROM z""")
def hypno_n2_direction(spark, d):
    return hypno.n2_direction(staged(spark, d))


@query("""SELECT ch, count(*) AS n, sqrt(pow(avg(cos(x)), 2) + pow(avg(sin(x)), 2)) AS itpc FROM s GROUP BY ch""")
def circular_itpc(spark, d):
    return stats.circular(tables.samples(spark, d), ["ch"], F.col("x")).select("ch", "n", "itpc")


@query(""", g AS (SELECT ch, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM s GROUP BY ch) SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ss_between, sum((n - 1) * v) AS ss_within, ((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM g""")
def anova(spark, d):
    return stats.anova(tables.samples(spark, d), "ch", "x")


@query(""", p AS (SELECT id, ch, count(*) AS n, avg(x) AS m FROM s GROUP BY ALL) SELECT id, """ + ", ".join(f"max(m) FILTER (ch = '{c}') AS \"MEAN.CH_{c}\"" for c in _CH) + " FROM p GROUP BY id")
def pivot_rows_cols(spark, d):
    """Result extractor: long results pivoted to VAR.FAC_LVL columns."""
    from hypnoframe.plans import results

    s = tables.samples(spark, d).groupBy("id", "ch").agg(F.avg("x").alias("MEAN"))
    long = results.long(s, "STATS", ["ch"], ["MEAN"])
    return results.pivot(long, rows=[], cols={"CH": _CH}, variables=["MEAN"])


@query("""SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n FROM (SELECT md5(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""", cte=False)
def dupes(spark, d):
    g = tables.load(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("h")).count().where("count > 1")
    return g.agg(F.count("*").alias("groups"), F.sum("count").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN sqrt(o_totalprice) > 300 AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag, CASE WHEN o_totalprice > 100000 THEN ln(o_totalprice) ELSE o_totalprice / 2 END AS y FROM orders""", cte=False)
def expr_eval(spark, d):
    """The expression language over table rows."""
    from hypnoframe.functions.expr import compiled

    o = tables.load(spark, d, "orders")
    return o.select("o_orderkey", compiled('ifelse( sqrt(o_totalprice) > 300 && o_orderstatus == "F" , 1 , 0 )', o.columns).alias("flag"), compiled("ifelse( o_totalprice > 100000 , log(o_totalprice) , o_totalprice / 2 )", o.columns).alias("y"))


# ---- further statistics ---------------------------------------------------


@query("""SELECT sum(o) * (sum(o * o / ra / cb) - 1) AS chi2, (any_value(r) - 1) * (any_value(c) - 1) AS df FROM (SELECT l_linestatus AS a, l_returnflag AS b, CAST(count(*) AS DOUBLE) AS o, sum(count(*)) OVER (PARTITION BY l_linestatus) AS ra, sum(count(*)) OVER (PARTITION BY l_returnflag) AS cb FROM lineitem GROUP BY l_linestatus, l_returnflag),
(SELECT count(DISTINCT l_linestatus) AS r, count(DISTINCT l_returnflag) AS c FROM lineitem)""", False)
def chi_square(spark, d):
    return stats.chi_square(tables.load(spark, d, "lineitem"), "l_linestatus", "l_returnflag")


@query("""SELECT id, runs, CASE WHEN n1 > 0 AND n0 > 0 AND 2 * n1 * n0 != n1 + n0 THEN (runs - (2 * n1 * n0 / (n1 + n0) + 1)) / sqrt(2 * n1 * n0 * (2 * n1 * n0 - n1 - n0) / ((n1 + n0) * (n1 + n0) * (n1 + n0 - 1))) END AS z
FROM (SELECT id, sum(new) AS runs, CAST(count(*) FILTER (h) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT h) AS DOUBLE) AS n0 FROM (SELECT id, x > 50 AS h, CASE WHEN (x > 50) IS NOT DISTINCT FROM lag(x > 50) OVER (PARTITION BY id ORDER BY t_ns, ix) THEN 0 ELSE 1 END AS new FROM s) GROUP BY id)""")
def runs_test(spark, d):
    return stats.runs_test(tables.samples(spark, d), ["id"], ["t_ns", "ix"], F.col("x") > 50).withColumn("runs", F.col("runs").cast("decimal(38,0)").cast("long"))


@query(""", q AS (SELECT ch AS a, lead(ch) OVER (PARTITION BY id ORDER BY t_ns, ix) AS b FROM s), t AS (SELECT a AS k, CAST(count(*) AS DOUBLE) AS t, CAST(count(*) FILTER (a = b) AS DOUBLE) AS c FROM q WHERE b IS NOT NULL GROUP BY a), p AS (SELECT b AS k, CAST(count(*) AS DOUBLE) AS p FROM q WHERE b IS NOT NULL GROUP BY b),
j AS (SELECT coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(c, 0) AS c FROM t FULL JOIN p USING (k)) SELECT (sum(c) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) AS mcc, avg(CASE WHEN t > 0 THEN 2 * c / (t + p) END) AS f1 FROM j""")
def matthews_f1(spark, d):
    s = tables.samples(spark, d)
    return stats.matthews(s.withColumn("b", F.lead("ch").over(Window.partitionBy("id").orderBy("t_ns", "ix"))), "ch", "b")


@query(""", r AS (SELECT id, ix, row_number() OVER (PARTITION BY id ORDER BY t_ns, ix) - 1 AS rn, count(*) OVER (PARTITION BY id) AS n, x - avg(x) OVER (PARTITION BY id) AS r FROM s), g AS (SELECT *, rn // nullif(n // 4, 0) AS seg FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY id, seg ORDER BY r) AS o, count(*) OVER (PARTITION BY id, seg) AS m FROM g WHERE seg < 4),
c AS (SELECT id, quantile_disc(r, 0.5) AS q FROM (SELECT id, seg, r FROM k WHERE o = least(m - 1, CAST(floor(m * CAST(0.95 AS DOUBLE)) AS BIGINT)) + 1) GROUP BY id) SELECT g.id, ix, CASE WHEN coalesce(q, 0) = 0 THEN r ELSE sign(r) * ln(abs(r) / q + 1) END AS scaled FROM g LEFT JOIN c ON c.id = g.id""")
def percentile_scaled(spark, d):
    return stats.percentile_scaled(tables.samples(spark, d), ["id"], ["t_ns", "ix"], "x").select("id", "ix", "scaled")


@query("""SELECT id, avg(CASE WHEN a * b < 0 THEN 1.0 ELSE 0.0 END) AS turning_rate FROM (SELECT id, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns, ix)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY id""")
def turning_rate(spark, d):
    s = tables.samples(spark, d).withColumn("o", F.struct("t_ns", "ix"))
    return stats.turning_rate(s, ["id"], "o", "x").where("turning_rate is not null")


@query(""", r AS (SELECT id, ix, x, row_number() OVER w AS rn, count(*) OVER (PARTITION BY id) AS n, avg(x) OVER (w ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m, avg(x) OVER (PARTITION BY id) AS whole FROM s WINDOW w AS (PARTITION BY id ORDER BY t_ns, ix))
SELECT r.id, r.ix, CASE WHEN r.n < 15 THEN r.whole ELSE q.m END AS local, r.x / nullif(CASE WHEN r.n < 15 THEN r.whole ELSE q.m END, 0) AS fac, CASE WHEN r.x / nullif(CASE WHEN r.n < 15 THEN r.whole ELSE q.m END, 0) > 2 THEN 1 ELSE 0 END AS flag FROM r LEFT JOIN r q ON q.id = r.id AND q.rn = least(greatest(r.rn, 8), r.n - 7)""")
def local_ratio(spark, d):
    return rolling.local_ratio(tables.samples(spark, d), ["id"], ["t_ns", "ix"], "x").select("id", "ix", "local", "fac", "flag")


@query("""SELECT DISTINCT p.id, p.start_ns, p.stop_ns, q.start_ns AS r_start, q.stop_ns AS r_stop, CAST(least(p.stop_ns, q.stop_ns) - greatest(p.start_ns, q.start_ns) AS DOUBLE) / (greatest(p.stop_ns, q.stop_ns) - least(p.start_ns, q.start_ns)) AS jaccard FROM a p JOIN a q ON p.id = q.id AND p.class = 'error' AND q.class = 'view'
WHERE p.start_ns < q.stop_ns AND q.start_ns < p.stop_ns AND CAST(least(p.stop_ns, q.stop_ns) - greatest(p.start_ns, q.start_ns) AS DOUBLE) / (greatest(p.stop_ns, q.stop_ns) - least(p.start_ns, q.start_ns)) >= 0.2""")
def listed_overlap(spark, d):
    from hypnoframe.plans import procs

    return procs.listed_overlap(of(spark, d, "error"), of(spark, d, "view"), 0.2).select("id", "start_ns", "stop_ns", "r_start", "r_stop", "jaccard").distinct()
