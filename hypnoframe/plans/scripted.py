"""Registered queries that run command scripts over the whole events table.

Each user is a recording of the whole days that hold all events, each event type a
channel whose sample k is the sum of its values in hour k; the channel's nominal rate is 24 per "second", so a
30-"second" epoch is a month and a 1-"second" epoch a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypnoframe.plans import procs
from hypnoframe.plans.session import NS, Session
from hypnoframe.sources import tables

QUERIES: dict = {}
ORACLE: dict = {}
RATE, T0 = 24, 1_704_067_200_000_000_000


def session(spark: SparkSession, d: str) -> Session:
    """Traces by one aggregation: the hour sums in order, with zeros between."""
    # each worker holds a batch of traces several times over
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    first, n = tables.hours(spark, d, T0)
    t0 = T0 + first * 3600 * NS
    e = tables.samples(spark, d).groupBy("id", "ch", F.floor((F.col("t_ns") - t0) / (3600 * NS)).cast("int").alias("h")).agg(F.sum("x").alias("s"))
    m = e.groupBy(F.col("id").cast("string").alias("id"), "ch").agg(F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", F.coalesce("s", F.lit(0.0)).alias("s"))))).alias("m"))
    # dealt by number: traces are small but costly to work on, so they mustn't be coalesced by size into one task
    m = m.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    upto = F.flatten(F.transform("m", lambda r, i: F.concat(zeros(r["h"] - F.when(i > 0, F.element_at("m", i)["h"]).otherwise(-1) - 1), F.array(r["s"]))))
    v = F.concat(upto, zeros(n - 1 - F.when(F.size("m") > 0, F.element_at("m", -1)["h"]).otherwise(-1)))
    samples = m.select("id", "ch", F.lit(float(RATE)).alias("sr"), F.lit("uV").alias("unit"), v.alias("v"))
    recs = m.select("id").distinct().select("id", F.lit("2024-01-01 00:00:00").alias("start"), F.lit(n // RATE * NS).cast("long").alias("dur_ns"), F.lit(NS).cast("long").alias("rec_ns"))
    a = tables.annots(spark, d)
    scale = lambda c: (F.round((F.col(c) - t0) / (3600 * RATE))).cast("long")
    notes = a.select(F.col("id").cast("string").alias("id"), "class", F.col("class").alias("inst"), F.lit(".").alias("ch"), scale("start_ns").alias("start_ns"), scale("stop_ns").alias("stop_ns"), F.create_map().cast("map<string,string>").alias("meta"))
    return Session(spark, samples, notes, recs)


#: query -> (script, command, factors of the table it returns)
SCRIPTS = {
    "psd": ("PSD spectrum min=0.5 max=12", "PSD", ("CH", "B")), "psd_epoch": ("EPOCH len=5 & PSD epoch", "PSD", ("CH", "B", "E")), "psd_ratio": ("PSD ratio ratio1", "PSD-RATIO", ("CH",)), "fft": ("FFT sig=error", "FFT", ("CH", "F")),
    "mtm": ("MTM segment-sec=10", "MTM", ("CH", "F")), "irasa": ("IRASA sig=error,view", "IRASA", ("CH", "F")), "acf": ("ACF lag=5", "ACF", ("CH", "LAG")), "dfa": ("DFA sig=error", "DFA", ("CH", "SEC")), "fip": ("FIP f-lwr=2 f-upr=6 sig=error", "FIP", ("CH", "F", "T")),
    "coh": ("COH", "COH", ("CH1", "CH2", "B")), "xcorr": ("XCORR w=1", "XCORR", ("CH1", "CH2")), "tsync": ("TSYNC w=1", "TSYNC", ("CH1", "CH2")), "psi": ("PSI", "PSI", ("CH1", "CH2", "F")), "ipc": ("IPC", "IPC", ("CH1", "CH2")), "cc": ("CC lwr=2 upr=4 sig1=error sig2=view", "CC", ("CH1", "CH2")),
    "mi": ("MI nbins=8", "MI", ("CH1", "CH2")), "gp": ("GP order=3", "GP", ("CH1", "CH2")), "ed": ("ED", "ED", ("CH1", "CH2")), "insert_lag": ("INSERT w=2 sig1=error sig2=view", "INSERT", ("CH1", "CH2")), "sync": ("SYNC f-lwr=2 f-upr=6", "SYNC", ("F",)),
    "pac": ("PAC ph=1,3 amp=5,9", "PAC", ("CH",)), "cfc": ("CFC a=1,3 b=5,9", "CFC", ("CH",)), "psc": ("PSC nc=2", "PSC", ("CH",)), "svd": ("SVD no-new-channels", "SVD", ("C",)), "microstates": ("MS k=3", "MS", ("K",)), "l1out": ("L1OUT", "L1OUT", ("CH",)), "asymm": ("ASYMM left=error right=view", "ASYMM", ("B",)),
    "sigstats": ("EPOCH len=5 & SIGSTATS epoch", "SIGSTATS", ("CH", "E")), "lzw": ("EPOCH len=5 & LZW", "LZW", ("CH", "E")), "mse": ("EPOCH len=15 & MSE s=1,3,1 sig=error", "MSE", ("CH", "SCALE")), "rai": ("RAI sig=error", "RAI", ("CH",)), "otsu": ("OTSU", "OTSU", ("CH",)), "artifacts": ("EPOCH len=2 & ARTIFACTS no-mask", "ARTIFACTS", ("CH", "E")),
    "edger": ("EPOCH len=1 & EDGER", "EDGER", ("CH",)), "qc": ("QC win=5 inc=5", "QC", ("CH",)), "zr": ("EPOCH len=5 & ZR", "ZR", ("CH", "E")), "spindles": ("SPINDLES fc=4 cycles=5 min=0.2 min0=0.1", "SPINDLES", ("CH",)), "so": ("SO", "SO", ("CH",)), "ripples": ("RIPPLES f-lwr=6 f-upr=11 msec=10", "RIPPLES", ("CH",)),
    "desat": ("DESAT drop=50", "DESAT", ("CH",)), "respbreath": ("RESPBREATH", "RESPBREATH", ("CH",)), "z_peaks": ("Z-PEAKS w=2 th=3", "Z-PEAKS", ("CH", "N")), "peaks_signal": ("PEAKS", "PEAKS", ("CH", "N")), "hrv": ("HRV sig=error", "HRV", ("CH",)), "hb": ("HB oxygen=view events=error", "HB", ()), "tlock": ("TLOCK annot=error w=0.5", "TLOCK", ("CH", "SEC")),
    "peri": ("PERI annot=error w=0.25", "PERI", ("CH", "SEC")), "tclst": ("TCLST annot=error sig=view w=0.25", "TCLST", ("CH", "N")), "coupl": ("PCOUPL events=error sig=view lwr=1 upr=3", "PCOUPL", ("CH",)), "exe": ("EXE win=5 sig=error", "EXE", ("CH", "E")), "days": ("DAYS", "DAYS", ("DAY",)),
    "overlap_permuted": ("OVERLAP seed=error other=view", "OVERLAP", ("SEED",)), "headers": ("HEADERS", "HEADERS", ("CH",)), "ctypes": ("CTYPES", "CTYPES", ("CH",)), "dupes_channels": ("DUPES", "DUPES", ("CH",)), "s2c": ("S2C sig=error", "S2C", ("CH", "N")), "sig_cycles": ("SIG-CYCLES sig=error epoch-sec=1", "SIG-CYCLES", ("CH", "E")), "arousal_features": ("AROUSALS sig=error", "AROUSALS", ("CH", "T")), "polarity": ("POL", "POL", ("CH",)),
    "nmf": ("NMF sig=error", "NMF", ("CH", "F")), "chep_mask_signal": ("EPOCH len=1 & CHEP-MASK ep-th=3", "CHEP-MASK", ("CH",)), "annot_means": ("MEANS annot=error", "MEANS", ("CH", "ANNOT")), "espan_command": ("EPOCH len=1 & ESPAN annot=error", "ESPAN", ("E",)), "eval_command": ('EPOCH len=1 & EVAL expr="error.n > 1 && view.sec > 0" annot=busy', "EVAL", ("E",)),
    "derive_command": ('DERIVE expr="sum(error) / length(error)" var=M', "DERIVE", ()), "cwt_stats": ("CWT sig=error fc=4 & STATS", "STATS", ("CH",)), "hilbert_stats": ("HILBERT sig=error f=2,5 & STATS", "STATS", ("CH",)), "filter_stats": ("FILTER bandpass=2,5 tw=1 & STATS", "STATS", ("CH",)), "butterworth_stats": ("FILTER lowpass=4 butterworth=4 & STATS", "STATS", ("CH",)),
    "resample_stats": ("RESAMPLE sr=12 & STATS", "STATS", ("CH",)), "bands_stats": ("BANDS sig=error bands=DELTA,THETA & STATS", "STATS", ("CH",)), "median_filter_stats": ("MEDIAN-FILTER hwin=0.25 & STATS", "STATS", ("CH",)), "tv_stats": ("TV lambda=20 & STATS", "STATS", ("CH",)), "line_denoise_stats": ("LINE-DENOISE f=6 & STATS", "STATS", ("CH",)), "robust_norm_stats": ("ROBUST-NORM & STATS", "STATS", ("CH",)),
    "rolling_norm_stats": ("ROLLING-NORM w=2 & STATS", "STATS", ("CH",)), "ssa_stats": ("SSA sig=error L=24 nc=2 & STATS", "STATS", ("CH",)), "emd_stats": ("EMD sig=error imf=3 & STATS", "STATS", ("CH",)), "ica_stats": ("ICA nc=3 & STATS", "STATS", ("CH",)), "ged_stats": ("GED f1=4 & STATS", "STATS", ("CH",)), "sl_stats": ("SL & STATS", "STATS", ("CH",)), "interpolate_stats": ("INTERPOLATE bad=error & STATS", "STATS", ("CH",)),
    "adjust_stats": ("ADJUST sig=error adj=view & STATS", "STATS", ("CH",)), "combine_stats": ("COMBINE mean=M & STATS", "STATS", ("CH",)), "suppress_ecg_stats": ("SUPPRESS-ECG ecg=error & STATS", "STATS", ("CH",)), "filter_design": ("FILTER-DESIGN fs=100 bandpass=8,12", "FILTER-DESIGN", ("F",)), "cwt_design": ("CWT-DESIGN fc=13 fs=100", "CWT-DESIGN", ()), "moving_average_stats": ("MOVING-AVERAGE hw=0.25 & STATS", "STATS", ("CH",)),
}


def _script(name: str, text: str, cmd: str, factors: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return session(spark, d).eval(text).table(cmd, *factors)

    run.__name__, run.__doc__ = name, f"Script: {text}"
    QUERIES[name] = run


for _name, (_text, _cmd, _factors) in SCRIPTS.items():
    _script("cmd_" + _name, _text, _cmd, _factors)


# ---- native commands that SQL can check ----------------------------------

_TRACE = """WITH s0 AS (SELECT user_id AS id, event_type AS ch, epoch_us(ts) * 1000 AS t_ns, (epoch_us(ts) * 1000 - 1704067200000000000) // 3600000000000 AS h, value AS x FROM events), lim AS (SELECT min(h) // 24 * 24 AS h0, (max(h) // 24 - min(h) // 24 + 1) * 24 AS n FROM s0),
s AS (SELECT id, ch, h - h0 AS h, x FROM s0, lim), u AS (SELECT DISTINCT id, ch FROM s), v AS (SELECT CAST(u.id AS VARCHAR) AS id, u.ch, k, coalesce(sum(x), 0.0) AS x FROM u CROSS JOIN (SELECT unnest(range(0, n)) AS k FROM lim) LEFT JOIN s ON s.id = u.id AND s.ch = u.ch AND s.h = k GROUP BY ALL),
a AS (SELECT CAST(id AS VARCHAR) AS id, ch AS class, CAST(round((t_ns - h0 * 3600000000000 - 1704067200000000000) / 86400.0) AS BIGINT) AS start_ns, CAST(round((t_ns + CAST(round(x * 100) AS BIGINT) * 600000000 - h0 * 3600000000000 - 1704067200000000000) / 86400.0) AS BIGINT) AS stop_ns FROM s0, lim),
rec AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id, n // 24 AS dur FROM s0, lim) """
_DAY = "SELECT id, ch, CAST(k // 24 AS BIGINT) AS day, sum(x) AS total, min(x) AS low, max(x) AS high FROM ({}) GROUP BY ALL"


def _daily(s: Session) -> DataFrame:
    # not the inner kind: from that Spark infers a filter on the array, for which it makes the array a second time
    d = s.samples.select("id", "ch", F.posexplode_outer("v").alias("k", "x")).where("k is not null")
    return d.groupBy("id", "ch", F.floor(F.col("k") / RATE).alias("day")).agg(F.sum("x").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"))


def _checked(name: str, text: str, sql: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _daily(session(spark, d).eval(text))

    run.__name__, run.__doc__ = name, f"Script: {text}; daily sums and limits of the traces"
    QUERIES[name], ORACLE[name] = run, _TRACE + _DAY.format(sql)


_checked("sig_flip", "FLIP", "SELECT id, ch, k, -x AS x FROM v")
_checked("sig_rectify", "FLIP & RECTIFY", "SELECT id, ch, k, abs(-x) AS x FROM v")
_checked("sig_reverse", "REVERSE", "SELECT id, ch, n - 1 - k AS k, x FROM v, lim")
_checked("sig_clip", "CLIP upr=50", "SELECT id, ch, k, least(50.0, x) AS x FROM v")
_checked("sig_log", "LOG offset=1", "SELECT id, ch, k, ln(x + 1) AS x FROM v")
_checked("sig_scale", "SCALE min-max=0,1", "SELECT id, ch, k, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS x FROM v WINDOW w AS (PARTITION BY id, ch)")
_checked("sig_shift_wrap", "SHIFT sp=7", "SELECT id, ch, (k + 7) % n AS k, x FROM v, lim")
_checked("sig_shift", "SHIFT sp=7 no-wrap", "SELECT id, ch, k, coalesce(lag(x, 7) OVER (PARTITION BY id, ch ORDER BY k), 0.0) AS x FROM v")
_checked("sig_1fnorm", "1FNORM", "SELECT id, ch, k, coalesce(x - lag(x) OVER (PARTITION BY id, ch ORDER BY k), 0.0) AS x FROM v")
_checked("sig_minmax", "MINMAX max=80", "SELECT id, ch, k, least(80.0, x) AS x FROM v")
_checked("sig_millivolts", "mV", "SELECT id, ch, k, x * 0.001 AS x FROM v")
_checked("sig_signals_keep", "SIGNALS keep=error,view", "SELECT id, ch, k, x FROM v WHERE ch IN ('error', 'view')")
_checked("sig_rename_copy", "COPY sig=error tag=B & RENAME sig=view new=seen", "SELECT id, CASE ch WHEN 'view' THEN 'seen' ELSE ch END AS ch, k, x FROM v UNION ALL SELECT id, 'error_B', k, x FROM v WHERE ch = 'error'")
_checked("sig_reference", "SIGNALS keep=error,view & REFERENCE sig=error ref=view", "SELECT v.id, v.ch, v.k, CASE WHEN v.ch = 'error' THEN v.x - coalesce(r.x, 0) ELSE v.x END AS x FROM v LEFT JOIN v r ON r.id = v.id AND r.k = v.k AND r.ch = 'view' WHERE v.ch IN ('error', 'view')")
_checked("sig_dereference", "SIGNALS keep=error,view & DEREFERENCE sig=error ref=view", "SELECT v.id, v.ch, v.k, CASE WHEN v.ch = 'error' THEN v.x + coalesce(r.x, 0) ELSE v.x END AS x FROM v LEFT JOIN v r ON r.id = v.id AND r.k = v.k AND r.ch = 'view' WHERE v.ch IN ('error', 'view')")
_checked("sig_spike", "SIGNALS keep=error,view & SPIKE from=view to=error wgt=2", "SELECT v.id, v.ch, v.k, CASE WHEN v.ch = 'error' THEN v.x + 2 * coalesce(r.x, 0) ELSE v.x END AS x FROM v LEFT JOIN v r ON r.id = v.id AND r.k = v.k AND r.ch = 'view' WHERE v.ch IN ('error', 'view')")
_checked("sig_empty", "SIGNALS keep=error & EMPTY sig=Z sr=24", "SELECT id, ch, k, x FROM v WHERE ch = 'error' UNION ALL SELECT DISTINCT id, 'Z', k, 0.0 FROM v")
_checked("sig_trans", 'TRANS sig=D expr="a = error * 2 ; a - view" & SIGNALS keep=D', "SELECT e.id, 'D' AS ch, e.k, e.x * 2 - w.x AS x FROM v e JOIN v w ON e.id = w.id AND e.k = w.k WHERE e.ch = 'error' AND w.ch = 'view'")
_checked("sig_freeze_thaw", "FREEZE tag=a & FLIP & THAW tag=a", "SELECT id, ch, k, x FROM v")
_checked("script_loop_if", "LOOP index=i vals=1,2,3\nFLIP\nEND-LOOP\nx=0\nIF x\nRECTIFY\nFI", "SELECT id, ch, k, -x AS x FROM v")
_checked("mask_re_signal", "EPOCH len=1 & MASK epoch=3-5,8 & RE", "SELECT id, ch, CASE WHEN k // 24 = 7 THEN 72 + k % 24 ELSE k - 48 END AS k, x FROM v WHERE k // 24 IN (2, 3, 4, 7)")


def _oracle(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, _TRACE + sql
        return f

    return add


@_oracle("SELECT id, ch, count(*) AS \"N\", avg(x) AS \"MEAN\", stddev_samp(x) AS \"SD\", sqrt(avg(x * x)) AS \"RMS\", min(x) AS \"MIN\", max(x) AS \"MAX\" FROM v GROUP BY id, ch")
def stats_command(spark, d):
    return session(spark, d).eval("STATS").table("STATS", "CH").select("id", "ch", "N", "MEAN", "SD", "RMS", "MIN", "MAX")


@_oracle("SELECT id, ch, k // 24 + 1 AS e, avg(x) AS \"MEAN\", stddev_samp(x) AS \"SD\", quantile_disc(x, 0.5) AS \"MEDIAN\", sqrt(avg(x * x)) AS \"RMS\" FROM v GROUP BY ALL")
def stats_epoch_command(spark, d):
    return session(spark, d).eval("EPOCH len=1 & STATS epoch").table("STATS", "CH", "E").select("id", "ch", "e", "MEAN", "SD", "MEDIAN", "RMS")


@_oracle("SELECT a.id, a.ch AS ch1, b.ch AS ch2, corr(a.x, b.x) AS \"R\" FROM v a JOIN v b ON a.id = b.id AND a.k = b.k AND a.ch < b.ch GROUP BY ALL")
def correl_command(spark, d):
    return session(spark, d).eval("CORREL").table("CORREL", "CH1", "CH2")


@_oracle("SELECT a.id, a.ch AS ch1, b.ch AS ch2, covar_samp(a.x, b.x) AS \"COV\" FROM v a JOIN v b ON a.id = b.id AND a.k = b.k AND a.ch < b.ch GROUP BY ALL")
def covar_command(spark, d):
    return session(spark, d).eval("COVAR").table("COVAR", "CH1", "CH2")


@_oracle("SELECT id, ch, floor(x / 20.0) * 20.0 AS \"VALUE\", count(*) AS \"N\" FROM v GROUP BY ALL")
def tabulate_command(spark, d):
    return session(spark, d).eval("TABULATE bin=20").table("TABULATE", "CH", "VALUE")


@_oracle("SELECT id, ch, CAST(floor(k / ceil(n / 12.0)) AS BIGINT) AS bucket, min(x) AS lo, max(x) AS hi, min(k) / 24.0 AS t FROM v, lim GROUP BY ALL")
def window_view(spark, d):
    return procs.window_view(session(spark, d).samples, 0.0, tables.hours(spark, d, T0)[1] / RATE, 12)


@_oracle("SELECT id, ch, count(*) AS n, sum(x) AS total FROM (SELECT id, ch, x FROM v UNION ALL SELECT id, ch, x FROM v) GROUP BY ALL")
def merge_recordings(spark, d):
    s = session(spark, d).samples
    m = procs.merge([s, s])
    return m.select("id", "ch", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@_oracle(", q AS (SELECT user_id AS id, substr(event_type, 1, 1) AS c, lead(substr(event_type, 1, 1), 1) OVER w AS c2, lead(substr(event_type, 1, 1), 2) OVER w AS c3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), m AS (SELECT c || c2 || c3 AS kmer, count(*) AS obs FROM q WHERE c3 IS NOT NULL GROUP BY 1) SELECT kmer, obs, obs / sum(obs) OVER () AS freq FROM m")
def kmer_counts(spark, d):
    s = tables.samples(spark, d)
    seq = s.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_ns", "ix", F.col("ch").substr(1, 1).alias("c")))), lambda r: r["c"]), "").alias("seq"))
    return procs.kmers(seq, 3)


def cmd_actig(spark, d):
    """Rest-activity numbers in real time: a sample an hour."""
    s = session(spark, d)
    return s.with_samples(s.samples.withColumn("sr", F.lit(1.0 / 3600))).eval("ACTIG bin=60").table("ACTIG", "CH")


def gpa_association(spark, d):
    """Daily totals of each channel against the total of all, with permutations and FDR."""
    s = tables.samples(spark, d)
    chs = ["click", "error", "purchase", "signup", "view"]
    w = s.groupBy("id").pivot("ch", chs).agg(F.sum("x")).na.fill(0.0).withColumn("y", F.col("click") + F.col("view"))
    return procs.association(w, chs, "y", 100)


def cpt_clusters(spark, d):
    """Cluster permutation over hours of the day: hourly means of each user against the user's total."""
    s = tables.samples(spark, d)
    h = s.groupBy(F.col("id").alias("unit"), F.pmod(F.floor(F.col("t_ns") / (3600 * NS)), F.lit(24)).cast("double").alias("pos")).agg(F.avg("x").alias("x"))
    t = s.groupBy(F.col("id").alias("unit")).agg(F.sum("x").alias("y"))
    return procs.cluster_permutation(h.join(t, "unit"), 1.5, 100)


QUERIES |= {"cmd_actig": cmd_actig, "gpa_association": gpa_association, "cpt_clusters": cpt_clusters}
