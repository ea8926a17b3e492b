"""Commands over the whole events table, each with the DuckDB SQL that gives the same rows.

The recordings are those of ``scripted``: a trace per user and event type, a sample
an hour, 24 samples a "second"; annotations are the events' intervals.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.plans.scripted import _DAY, _TRACE, RATE, _daily, session
from hypnoframe.plans.session import Session

QUERIES: dict = {}
ORACLE: dict = {}
STAGES = "REMAP map=click:W,error:N1,purchase:N2,signup:N3,view:R"
#: what REMAP makes of the annotations
_STAGED = ", st AS (SELECT id, CASE class WHEN 'click' THEN 'W' WHEN 'error' THEN 'N1' WHEN 'purchase' THEN 'N2' WHEN 'signup' THEN 'N3' WHEN 'view' THEN 'R' ELSE class END AS class, start_ns, stop_ns FROM a)"
#: merged intervals of each class, epochs of one second, and what an epoch finds
_FLAT = """, f0 AS (SELECT *, max(stop_ns) OVER (PARTITION BY id, class ORDER BY start_ns, stop_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a),
f1 AS (SELECT *, sum(CASE WHEN b IS NULL OR start_ns > b THEN 1 ELSE 0 END) OVER (PARTITION BY id, class ORDER BY start_ns, stop_ns ROWS UNBOUNDED PRECEDING) AS run FROM f0),
flat AS (SELECT id, class, min(start_ns) AS start_ns, max(stop_ns) AS stop_ns FROM f1 GROUP BY id, class, run)"""
_EPOCH = ", ep AS (SELECT id, e, (e - 1) * 1000000000 AS start_ns, e * 1000000000 AS stop_ns FROM (SELECT id, unnest(range(1, dur + 1)) AS e FROM rec))"
_FOUND = "CASE WHEN {0}.start_ns = {0}.stop_ns THEN {1}.start_ns <= {0}.start_ns AND {0}.start_ns < {1}.stop_ns ELSE {0}.start_ns < {1}.stop_ns AND {0}.stop_ns > {1}.start_ns END"
_DBL = lambda x: f"CAST({x} AS DOUBLE)"
_STATS = (
    """SELECT id, ch, n AS "N", m AS "MEAN", sd AS "SD", rms AS "RMS", lo AS "MIN", hi AS "MAX", CASE WHEN sd > 0 THEN m3 / pow(sd, 3) ELSE 0.0 END AS "SKEW", CASE WHEN sd > 0 THEN m4 / (m2 * m2) - 3 ELSE 0.0 END AS "KURT", """
    + ", ".join(f'q[CAST(least(n - 1, floor(n * {_DBL(p / 100)})) AS BIGINT) + 1] AS "P{p:02}"' for p in (1, 5, 25, 75, 95, 99))
    + """ FROM (SELECT id, ch, count(*) AS n, any_value(m) AS m, stddev_samp(x) AS sd, sqrt(avg(x * x)) AS rms, min(x) AS lo, max(x) AS hi, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4, list(x ORDER BY x) AS q
FROM (SELECT *, avg(x) OVER (PARTITION BY id, ch) AS m FROM ({}) y) GROUP BY id, ch)"""
)


def _add(name: str, run, sql: str, doc: str) -> None:
    run.__name__, run.__doc__ = name, doc
    QUERIES[name], ORACLE[name] = run, _TRACE + sql


def _table(name: str, text: str, cmd: str, factors: tuple[str, ...], sql: str, shape=None) -> None:
    """A result table of a script; ``shape``: what is made of it."""

    def run(spark, d: str) -> DataFrame:
        out = session(spark, d).eval(text).table(cmd, *factors)
        return shape(out) if shape else out

    _add(name, run, sql, f"Script: {text}")


def _stats(name: str, text: str, sql: str) -> None:
    """STATS of the traces that a script leaves; ``sql``: rows id, ch, k, x."""
    _table(name, f"{text} & STATS", "STATS", ("CH",), _STATS.format(sql))


def _traces(name: str, text: str, sql: str) -> None:
    def run(spark, d: str) -> DataFrame:
        return _daily(session(spark, d).eval(text))

    _add(name, run, _DAY.format(sql), f"Script: {text}; daily sums and limits of the traces")


def _notes(name: str, text: str, sql: str) -> None:
    """The annotations that a script leaves, repeats counted; ``sql``: rows id, class, start_ns, stop_ns."""

    def run(spark, d: str) -> DataFrame:
        return session(spark, d).eval(text).annots.groupBy("id", "class", "start_ns", "stop_ns").agg(F.count("*").alias("n"))

    _add(name, run, f"SELECT id, class, start_ns, stop_ns, count(*) AS n FROM ({sql}) y GROUP BY ALL" if not sql.startswith(",") else sql, f"Script: {text}; the annotations left")


def _counted(ctes: str, sql: str) -> str:
    return f"{ctes} SELECT id, class, start_ns, stop_ns, count(*) AS n FROM ({sql}) y GROUP BY ALL"


def _mask(name: str, text: str, masked: str, ctes: str = "") -> None:
    """The mask that a script leaves over epochs of one second; ``masked``: SQL of it over ep."""
    _table(name, f"EPOCH len=1 & {text} & DUMP-MASK", "DUMP-MASK", ("E",), f'{_EPOCH}{ctes} SELECT id, e, CAST({masked} AS INTEGER) AS "EMASK" FROM ep')


# ---- headers, tables and session state -----------------------------------

_table("cmd_headers", "HEADERS", "HEADERS", ("CH",), """SELECT id, ch, 24.0 AS "SR", 'uV' AS "PDIM", min(x) AS "PMIN", max(x) AS "PMAX" FROM v GROUP BY id, ch""")
_table("cmd_headers_recording", "RECORD-SIZE dur=2 & SET-HEADERS start-time=X & HEADERS", "HEADERS", (), """SELECT rec.id, count(*) AS "NS", any_value(dur) // 2 AS "NR", 2.0 AS "REC_DUR", CAST(any_value(dur) AS DOUBLE) AS "TOT_DUR_SEC", 'X' AS "START_TIME" FROM rec JOIN u ON rec.id = CAST(u.id AS VARCHAR) GROUP BY rec.id""")
for _name in ("SUMMARY", "DESC"):
    _table(f"cmd_{_name.lower()}", _name, _name, (), """SELECT id, count(*) AS "NS", string_agg(ch, ',' ORDER BY ch) AS "SIGNALS" FROM (SELECT DISTINCT id, ch FROM v) GROUP BY id""", lambda t: t.withColumn("SIGNALS", F.array_join("SIGNALS", ",")))
_table("cmd_set_var_vars", "SET-VAR alpha=1 beta=two & VARS", "VARS", ("VAR",), """SELECT * FROM (VALUES ('alpha', '1'), ('beta', 'two')) y("VAR", "VAL")""")
_table("cmd_tag", "TAG tag=A/GRP & CONTAINS sig=error", "CONTAINS", (), """SELECT rec.id, 1 AS "NS_REQ", CAST(count(u.ch) AS BIGINT) AS "NS_OBS", 'GRP' AS "A" FROM rec LEFT JOIN u ON rec.id = CAST(u.id AS VARCHAR) AND u.ch = 'error' GROUP BY rec.id""")
_table("cmd_contains", "CONTAINS sig=error,nope annots=error,view,none", "CONTAINS", (), """SELECT rec.id, 2 AS "NS_REQ", count(DISTINCT u.ch) AS "NS_OBS", count(DISTINCT w.ch) AS "NA_OBS", 3 AS "NA_REQ" FROM rec LEFT JOIN u ON rec.id = CAST(u.id AS VARCHAR) AND u.ch = 'error' LEFT JOIN u w ON rec.id = CAST(w.id AS VARCHAR) AND w.ch IN ('error', 'view') GROUP BY rec.id""")
_table("cmd_report", "REPORT hide=CONTAINS & CONTAINS sig=view & REPORT show=CONTAINS & CONTAINS sig=nope", "CONTAINS", (), """SELECT id, 1 AS "NS_REQ", 0 AS "NS_OBS" FROM rec""")
_table("cmd_dump", "DUMP sig=error,view", "DUMP", (), "SELECT id, ch, k / 24.0 AS t, x FROM v WHERE ch IN ('error', 'view')")
_table("cmd_dump_records", "DUMP-RECORDS sig=click", "DUMP-RECORDS", (), "SELECT id, ch, k / 24.0 AS t, x FROM v WHERE ch = 'click'")
_table("cmd_matrix", "MATRIX sig=error,view", "MATRIX", (), "SELECT id, k / 24.0 AS t, max(x) FILTER (ch = 'error') AS error, max(x) FILTER (ch = 'view') AS view FROM v WHERE ch IN ('error', 'view') GROUP BY id, k")
_table("cmd_head", "EPOCH len=1 & HEAD epoch=3 sig=error,view", "HEAD", (), "SELECT id, k / 24.0 AS t, max(x) FILTER (ch = 'error') AS error, max(x) FILTER (ch = 'view') AS view FROM v WHERE ch IN ('error', 'view') AND k // 24 = 2 GROUP BY id, k")
_table("cmd_recs", "RECS", "RECS", ("REC",), 'SELECT id, r AS "REC", (r - 1) * 1000000000 AS start_ns, r * 1000000000 AS stop_ns FROM (SELECT id, unnest(range(1, dur + 1)) AS r FROM rec)')
_table("cmd_segments", "SEGMENTS", "SEGMENTS", ("SEG",), 'SELECT id, 1 AS "SEG", 0.0 AS "START", CAST(dur AS DOUBLE) AS "STOP", CAST(dur AS DOUBLE) AS "DUR_SEC" FROM rec')
_table("cmd_align_scan", "EPOCH len=1 & ALIGN-SCAN", "ALIGN-SCAN", ("ANNOT",), 'SELECT id, class, count(*) AS "ANN_N", count(*) FILTER (start_ns % 1000000000 = 0) AS "ANN_AT_EPOCH", count(*) FILTER (start_ns % 1000000000 != 0) AS "ANN_OFF_EPOCH" FROM a GROUP BY id, class')
_table("cmd_cache", "A2C annot=error cache=c & CACHE", "CACHE", (), "SELECT 'c' AS \"NAME\"")
_traces("cmd_read_requires_stop", "READ & REQUIRES version=v0.1 & FLIP & TIME-TRACK & EXIT & FLIP", "SELECT id, ch, k, -x AS x FROM v")
_traces("cmd_clean_freezer", "FREEZE tag=a & FLIP & CLEAN-FREEZER & THAW tag=a", "SELECT id, ch, k, -x AS x FROM v")
_traces("cmd_order_enforce", "ORDER sig=view,error & ZOH sig=view sr=30 & ENFORCE-SR sr=20,25", "SELECT id, ch, k, x FROM v WHERE ch != 'view'")
_traces("cmd_canonical", "CANONICAL cs=ONE:nope|view,TWO:error & SIGNALS keep=ONE,TWO", "SELECT id, CASE ch WHEN 'view' THEN 'ONE' ELSE 'TWO' END AS ch, k, x FROM v WHERE ch IN ('view', 'error')")
_traces("sig_first_present", "SIGNALS keep=nope|view|error,click|view", "SELECT id, ch, k, x FROM v WHERE ch IN ('view', 'click')")
_traces("cmd_microvolts", "mV & uV", "SELECT id, ch, k, x FROM v")
_traces("cmd_reference_two", "REFERENCE sig=error ref=view,click", "SELECT v.id, ch, v.k, CASE WHEN ch = 'error' THEN x - m ELSE x END AS x FROM v LEFT JOIN (SELECT id, k, avg(x) AS m FROM v WHERE ch IN ('view', 'click') GROUP BY id, k) r ON r.id = v.id AND r.k = v.k")


def cmd_anon(spark, d: str) -> DataFrame:
    return session(spark, d).eval("ANON root=P").recordings.select("id", "start")


_add("cmd_anon", cmd_anon, "SELECT 'P_' || row_number() OVER (ORDER BY id) AS id, '1985-01-01 00:00:00' AS start FROM rec", "Script: ANON root=P")


def cmd_fix_sampling(spark, d: str) -> DataFrame:
    s = session(spark, d)
    return s.with_samples(s.samples.withColumn("sr", F.lit(24.25))).eval("FIX-SAMPLING").samples.select("id", "ch", "sr", F.size("v").cast("long").alias("n"))


_add("cmd_fix_sampling", cmd_fix_sampling, 'SELECT id, ch, 24.0 AS sr, CAST(round_even(count(*) * 24.0 / 24.25, 0) AS BIGINT) AS n FROM v GROUP BY id, ch', "A fractional rate becomes whole")


def cmd_siggen(spark, d: str) -> DataFrame:
    s = session(spark, d).eval("SIGGEN sig=G sr=24 sine=2,3,0.5 & SIGNALS keep=G")
    return s.samples.select("id", "ch", F.posexplode("v").alias("k", "x")).select("id", "ch", "k", F.round(F.col("x"), 6).alias("x"))


_add("cmd_siggen", cmd_siggen, "SELECT id, 'G' AS ch, CAST(k AS INTEGER) AS k, round(3 * sin(2 * pi() * 2 * k / 24.0 + 0.5), 6) AS x FROM (SELECT id, unnest(range(0, dur * 24)) AS k FROM rec)", "Script: SIGGEN sig=G sr=24 sine=2,3,0.5")

# ---- channels ------------------------------------------------------------

_hj = """SELECT id, ch, e, n, CASE WHEN n < 3 THEN 0 ELSE v0 END AS h1, CASE WHEN n < 3 OR v0 = 0 THEN 0 ELSE sqrt(v1 / v0) END AS h2, CASE WHEN n < 3 OR v1 = 0 OR v0 = 0 THEN 0 ELSE sqrt(v2 / v1) / sqrt(v1 / v0) END AS h3
FROM (SELECT id, ch, e, count(*) AS n, var_pop(x) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM (SELECT *, d - lag(d) OVER (PARTITION BY id, ch, e ORDER BY k) AS dd FROM (SELECT *, k // {0} + 1 AS e, x - lag(x) OVER (PARTITION BY id, ch, k // {0} ORDER BY k) AS d FROM v)) GROUP BY id, ch, e)"""
_table("cmd_ctypes", "CTYPES", "CTYPES", ("CH",), f"""SELECT id, ch, h1 AS "H1", h2 AS "H2", h3 AS "H3", CASE WHEN regexp_matches(upper(ch), 'EEG|^[CFPOT][0-9Z]') THEN 'EEG' ELSE 'UNKNOWN' END AS "CTYPE" FROM ({_hj.format("1000000000")})""")
_table("cmd_dupes_channels", "COPY sig=error tag=B & DUPES", "DUPES", ("CH",), """, w AS (SELECT id, ch, x, k FROM v UNION ALL SELECT id, 'error_B', x, k FROM v WHERE ch = 'error'), g AS (SELECT id, ch, list(x ORDER BY k) AS l, min(x) = max(x) AS flat FROM w GROUP BY id, ch)
SELECT id, ch, CAST(flat AS INTEGER) AS "FLAT", CAST(count(*) OVER (PARTITION BY id, l) > 1 AS INTEGER) AS "DUPE" FROM g""")
_table("cmd_types", "TYPES", "TYPES", ("TYPE",), """SELECT * FROM (VALUES ('EEG', 'EEG|^[CFPOT][0-9Z]'), ('EOG', 'EOG|LOC|ROC'), ('EMG', 'EMG|CHIN|LEG'), ('ECG', 'ECG|EKG'), ('OXY', 'SAO2|SPO2'), ('RESP', 'RESP|AIR|THOR|ABD|NASAL|FLOW')) y("TYPE", "LABELS")""")
_table("cmd_sedf", "EPOCH len=1 & SEDF", "SEDF", ("CH",), """, q AS (SELECT id, ch, k // 24 AS k, avg(x) AS m, min(x) AS l, max(x) AS u FROM v GROUP BY ALL) SELECT id, 'M_' || ch AS ch, 1.0 AS sr, k, m AS x FROM q UNION ALL SELECT id, 'L_' || ch, 1.0, k, l FROM q UNION ALL SELECT id, 'U_' || ch, 1.0, k, u FROM q""", lambda t: t.select("id", "ch", "sr", F.posexplode("v").alias("k", "x")))
_traces("cmd_a2s", "A2S annot=error sr=24 label=E & SIGNALS keep=E", f"SELECT rec.id, 'E' AS ch, k, CASE WHEN max(f.start_ns) IS NULL THEN 0.0 ELSE 1.0 END AS x FROM (SELECT id, unnest(range(0, dur * 24)) AS k FROM rec) rec LEFT JOIN (SELECT id, min(start_ns) AS start_ns, max(stop_ns) AS stop_ns FROM (SELECT *, sum(CASE WHEN b IS NULL OR start_ns > b THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY start_ns, stop_ns ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, max(stop_ns) OVER (PARTITION BY id ORDER BY start_ns, stop_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a WHERE class = 'error')) GROUP BY id, run) f ON f.id = rec.id AND k >= round_even({_DBL('f.start_ns')} * 24 / 1e9, 0) AND k < round_even({_DBL('f.stop_ns')} * 24 / 1e9, 0) GROUP BY rec.id, k")
_notes("cmd_s2a", "DROP-ANNOTS annot=* & S2A sig=error encoding=hi,50,100000", "SELECT id, 'hi' AS class, CAST(round(CAST(min(k) AS DOUBLE) / 24 * 1000000000) AS BIGINT) AS start_ns, CAST(round(CAST(max(k) + 1 AS DOUBLE) / 24 * 1000000000) AS BIGINT) AS stop_ns FROM (SELECT id, k, k - row_number() OVER (PARTITION BY id ORDER BY k) AS g FROM v WHERE ch = 'error' AND x BETWEEN 50 AND 100000) GROUP BY id, g")
_table("cmd_s2c", "S2C", "S2C", ("CH", "N"), """, z AS (SELECT *, lag(x) OVER (PARTITION BY id, ch ORDER BY k) <= 0 AND x > 0 AS up FROM v), g AS (SELECT *, sum(CAST(coalesce(up, false) AS INTEGER)) OVER (PARTITION BY id, ch ORDER BY k) AS c FROM z), m AS (SELECT id, ch, max(c) AS last FROM g GROUP BY id, ch)
SELECT g.id, g.ch, min(k) / 24.0 AS "START", (max(k) + 1) / 24.0 AS "STOP", max(x) - min(x) AS "AMP", arg_max(k, (x, -k)) / 24.0 AS "T_PEAK", arg_min(k, (x, k)) / 24.0 AS "T_TROUGH" FROM g JOIN m ON g.id = m.id AND g.ch = m.ch WHERE c BETWEEN 1 AND last - 1 GROUP BY g.id, g.ch, c""")
_table("cmd_peaks_signal", "PEAKS", "PEAKS", ("CH", "N"), 'SELECT id, ch, k / 24.0 AS "T", x AS "X" FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS c FROM v WINDOW w AS (PARTITION BY id, ch ORDER BY k)) WHERE x > b AND x >= c')
_table("cmd_acf", "ACF lag=5", "ACF", ("CH", "LAG"), """, y AS (SELECT *, x - avg(x) OVER (PARTITION BY id, ch) AS z FROM v), l AS (SELECT *, unnest(range(1, 6)) AS g FROM y), d AS (SELECT id, ch, sum(z * z) AS d FROM y GROUP BY id, ch)
SELECT l.id, l.ch, CAST(l.g AS INTEGER) AS "LAG", sum(l.z * o.z) / CASE WHEN any_value(d) = 0 THEN 1 ELSE any_value(d) END AS "ACF" FROM l JOIN y o ON o.id = l.id AND o.ch = l.ch AND o.k = l.k + l.g JOIN d ON d.id = l.id AND d.ch = l.ch GROUP BY ALL""")
_table("cmd_ed", "ED", "ED", ("CH1", "CH2"), 'SELECT a.id, a.ch AS ch1, b.ch AS ch2, var_pop(a.x - b.x) AS "ED" FROM v a JOIN v b ON a.id = b.id AND a.k = b.k AND a.ch < b.ch GROUP BY ALL')
_table("cmd_mi", "MI nbins=8", "MI", ("CH1", "CH2"), """, b AS (SELECT id, ch, k, CASE WHEN hi > lo THEN CAST(least(7, floor((x - lo) / (hi - lo) * 8)) AS INTEGER) ELSE 4 END AS b FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM v WINDOW w AS (PARTITION BY id, ch))),
j AS (SELECT p.id, p.ch AS ch1, q.ch AS ch2, p.b AS b1, q.b AS b2, CAST(count(*) AS DOUBLE) AS c FROM b p JOIN b q ON p.id = q.id AND p.k = q.k AND p.ch < q.ch GROUP BY ALL), t AS (SELECT id, ch1, ch2, sum(c) AS n FROM j GROUP BY ALL),
hj AS (SELECT id, ch1, ch2, -sum(c / n * log2(c / n)) AS h FROM j JOIN t USING (id, ch1, ch2) GROUP BY ALL), ha AS (SELECT id, ch1, ch2, -sum(c / n * log2(c / n)) AS h FROM (SELECT id, ch1, ch2, b1, sum(c) AS c FROM j GROUP BY ALL) JOIN t USING (id, ch1, ch2) GROUP BY ALL), hb AS (SELECT id, ch1, ch2, -sum(c / n * log2(c / n)) AS h FROM (SELECT id, ch1, ch2, b2, sum(c) AS c FROM j GROUP BY ALL) JOIN t USING (id, ch1, ch2) GROUP BY ALL)
SELECT id, ch1, ch2, ha.h + hb.h - hj.h AS "MI", hj.h AS "JINF", ha.h AS "INFA", hb.h AS "INFB", 8 AS "NBINS" FROM hj JOIN ha USING (id, ch1, ch2) JOIN hb USING (id, ch1, ch2)""")
_LISTS = ", z AS (SELECT id, ch, list(x - m ORDER BY k) AS l, stddev_pop(x) AS sd, count(*) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY id, ch) AS m FROM v) GROUP BY id, ch)"
_LAGS = "list_dot_product(CASE WHEN g >= 0 THEN p.l[1:p.n - g] ELSE p.l[1 - g:] END, CASE WHEN g >= 0 THEN q.l[1 + g:] ELSE q.l[1:q.n + g] END) / CASE WHEN p.sd * q.sd = 0 THEN 1 ELSE p.n * p.sd * q.sd END"
_table("cmd_xcorr", "XCORR w=1", "XCORR", ("CH1", "CH2"), f"""{_LISTS}, r AS (SELECT p.id, p.ch AS ch1, q.ch AS ch2, g, {_LAGS} AS r FROM z p JOIN z q ON p.id = q.id AND p.ch < q.ch, (SELECT unnest(range(-24, 25)) AS g))
SELECT id, ch1, ch2, arg_max(g, (round(abs(r), 12), -g)) / 24.0 AS "D", arg_max(r, (round(abs(r), 12), -g)) AS "XCORR", CAST(arg_max(g, (round(abs(r), 12), -g)) AS INTEGER) AS "S" FROM r GROUP BY id, ch1, ch2""")
_table("cmd_insert_lag", "INSERT w=2 sig1=error sig2=view", "INSERT", ("CH1", "CH2"), f"""{_LISTS}, r AS (SELECT p.id, p.ch AS ch1, q.ch AS ch2, g, {_LAGS} AS r FROM z p JOIN z q ON p.id = q.id AND p.ch = 'error' AND q.ch = 'view', (SELECT unnest(range(-48, 49)) AS g))
SELECT id, ch1, ch2, arg_max(g, (round(r, 12), -g)) / 24.0 AS "SEC", max(r) AS "PEAK" FROM r GROUP BY id, ch1, ch2""")
_table("cmd_otsu", "OTSU", "OTSU", ("CH",), """, b AS (SELECT id, ch, lo, hi, CASE WHEN hi > lo THEN CAST(least(99, floor((x - lo) / (hi - lo) * 100)) AS INTEGER) ELSE 50 END AS b FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM v WINDOW w AS (PARTITION BY id, ch))),
c AS (SELECT id, ch, any_value(lo) AS lo, any_value(hi) AS hi, b, count(*) AS c FROM b GROUP BY id, ch, b), g AS (SELECT id, ch, any_value(lo) AS lo, any_value(hi) AS hi, unnest(range(0, 100)) AS b FROM c GROUP BY id, ch),
h AS (SELECT g.*, coalesce(c, 0) AS c FROM g LEFT JOIN c USING (id, ch, b)), m AS (SELECT *, sum(c) OVER w / sum(c) OVER (PARTITION BY id, ch) AS p, sum(c * b) OVER w / sum(c) OVER (PARTITION BY id, ch) AS m, sum(c * b) OVER (PARTITION BY id, ch) / sum(c) OVER (PARTITION BY id, ch) AS t FROM h WINDOW w AS (PARTITION BY id, ch ORDER BY b)),
s2 AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN pow(t * p - m, 2) / (p * (1 - p)) ELSE 0 END AS s FROM m)
SELECT id, ch, CASE WHEN any_value(hi) > any_value(lo) THEN any_value(lo) + (arg_max(b, (s, -b)) + 1) / 100.0 * (any_value(hi) - any_value(lo)) ELSE any_value(lo) - 0.5 + (arg_max(b, (s, -b)) + 1) / 100.0 END AS "TH", max(s) AS "SIGMA_B" FROM s2 GROUP BY id, ch""")
_table("cmd_rai", "RAI sig=error", "RAI", ("CH",), """, s1 AS (SELECT id, ch, k // 24 AS t, avg(abs(x)) AS a FROM v WHERE ch = 'error' GROUP BY ALL), s2 AS (SELECT id, ch, a - min(a) OVER (PARTITION BY id, ch ORDER BY t ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS a FROM s1)
SELECT id, ch, CAST(count(*) FILTER (a <= 1) AS DOUBLE) / nullif(count(*) FILTER (a <= 1 OR a > 2), 0) AS "REM_AI", count(*) AS "NE" FROM s2 GROUP BY id, ch""")
_table("cmd_qc", "QC win=5 inc=5", "QC", ("CH",), """, w AS (SELECT *, k // 120 AS w, abs(x - lag(x) OVER (PARTITION BY id, ch, k // 120 ORDER BY k)) AS d FROM v), m AS (SELECT *, min(x) OVER q AS lo, max(x) OVER q AS hi FROM w WINDOW q AS (PARTITION BY id, ch, w)),
f AS (SELECT id, ch, w, avg(CAST(d < 1e-6 AS INTEGER)) > 0.5 AS flat, avg(CAST(x = lo OR x = hi AS INTEGER)) > 0.05 AS clip FROM m GROUP BY id, ch, w HAVING count(*) = 120)
SELECT id, ch, avg(CAST(flat AS INTEGER)) AS "P_FLAT", avg(CAST(clip AS INTEGER)) AS "P_CLIP", avg(CAST(flat OR clip AS INTEGER)) AS "P_BAD", CAST(avg(CAST(flat OR clip AS INTEGER)) > 0.5 AS INTEGER) AS "FLAG" FROM f GROUP BY id, ch""")
_table("cmd_edger", "EPOCH len=1 & EDGER", "EDGER", ("CH",), """, r AS (SELECT id, ch, k // 24 + 1 AS e, ln(stddev_pop(x) + 1e-9) AS r FROM v GROUP BY ALL), q AS (SELECT id, ch, quantile_cont(r, 0.5) AS md, 0.7413 * (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) AS sd FROM r GROUP BY id, ch),
z AS (SELECT r.id, r.ch, e, CASE WHEN r - md > 3 * sd THEN 1.0 ELSE -1.0 END AS z FROM r JOIN q ON r.id = q.id AND r.ch = q.ch), f AS (SELECT *, sum(z) OVER a AS sa, count(*) OVER a AS na, sum(z) OVER d AS sd, count(*) OVER d AS nd FROM z WINDOW a AS (PARTITION BY id, ch ORDER BY e), d AS (PARTITION BY id, ch ORDER BY e DESC)),
g AS (SELECT id, ch, e, sign(sa) * sa * sa / na AS f, sign(sd) * sd * sd / nd AS g FROM f) SELECT id, ch, CASE WHEN max(f) > 0 THEN arg_max(e, (f, -e)) END AS "EOFF", CASE WHEN max(g) > 0 THEN arg_max(e, (g, e)) END AS "EON" FROM g GROUP BY id, ch""")
_table("cmd_sigstats", "EPOCH len=5 & SIGSTATS epoch", "SIGSTATS", ("CH", "E"), f""", h AS ({_hj.format("120")}), o AS (SELECT *, k // 120 + 1 AS e, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, min(x) OVER (PARTITION BY id, ch, k // 120) AS lo, max(x) OVER (PARTITION BY id, ch, k // 120) AS hi FROM v WINDOW w AS (PARTITION BY id, ch, k // 120 ORDER BY k)),
pc AS (SELECT id, ch, e, CAST(count(*) AS DOUBLE) AS c FROM o WHERE x2 IS NOT NULL GROUP BY id, ch, e, x2 <= x1, x2 <= x, x1 <= x), pe AS (SELECT id, ch, e, -sum(c / n * log2(c / n)) / log2(6) AS pe FROM (SELECT *, sum(c) OVER (PARTITION BY id, ch, e) AS n FROM pc) GROUP BY ALL),
g AS (SELECT id, ch, e, sqrt(avg(x * x)) AS rms, avg(CAST(x = lo OR x = hi AS INTEGER)) AS clip, avg(CAST(abs(x - x1) < 1e-6 AS INTEGER)) AS flat, max(abs(x)) AS top, count(*) FILTER (x2 IS NOT NULL AND (x - x1 > 0) != (x1 - x2 > 0)) AS turns, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY ALL)
SELECT id, ch, e, h1 AS "H1", h2 AS "H2", h3 AS "H3", rms AS "RMS", pe AS "PE", log10(g.n) / (log10(g.n) + log10(g.n / (g.n + 0.4 * turns))) AS "PFD", clip AS "CLIP", flat AS "FLAT", top AS "MAX" FROM h JOIN g USING (id, ch, e) JOIN pe USING (id, ch, e)""")
_CHEP = f""", h AS ({_hj.format("24")}), m AS (SELECT id, ch, e FROM (SELECT *, greatest(""" + ", ".join(f"coalesce(abs(h{i} - avg(h{i}) OVER w) / nullif(stddev_samp(h{i}) OVER w, 0), 0)" for i in (1, 2, 3)) + ") AS z FROM h WINDOW w AS (PARTITION BY id, ch)) WHERE z > 3)"
_table("cmd_chep_mask_signal", "EPOCH len=1 & CHEP-MASK ep-th=3", "CHEP-MASK", ("CH",), f'{_CHEP} SELECT id, ch, count(*) AS "ANY" FROM m GROUP BY id, ch')
_table("cmd_chep", "EPOCH len=1 & CHEP-MASK ep-th=3 & CHEP dump", "CHEP", ("CH", "E"), f"{_CHEP} SELECT id, e, ch FROM m")
_table("cmd_hdstats", "HDSTATS W=click N1=error N2=purchase N3=signup R=view", "HDSTATS", ("E",), """, t AS (SELECT *, CASE ch WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS o FROM v), p AS (SELECT id, k, o, x / greatest(sum(x) OVER (PARTITION BY id, k), 1e-12) AS p FROM t WHERE id IN (SELECT id FROM t GROUP BY id HAVING count(DISTINCT ch) = 5)), d AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY id, o ORDER BY k)) AS d FROM p)
SELECT id, k + 1 AS "E", -sum(p * log2(greatest(p, 1e-12))) AS "H", max(p) AS "C", max(p) - list(p ORDER BY p DESC)[2] AS "MG", coalesce(0.5 * sum(d), 0.0) AS "TV", ['W', 'N1', 'N2', 'N3', 'R'][CAST(arg_max(o, (p, -o)) AS BIGINT) + 1] AS "ARGMAX" FROM d GROUP BY id, k""", lambda t: t.withColumn("H", F.col("H") + 0.0))

# ---- traces by their statistics ------------------------------------------

_stats("cmd_moving_average_stats", "MOVING-AVERAGE hw=0.25", "SELECT v.id, v.ch, v.k, w.m AS x FROM v JOIN lim ON true JOIN (SELECT id, ch, k, avg(x) OVER (PARTITION BY id, ch ORDER BY k ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM v) w ON w.id = v.id AND w.ch = v.ch AND w.k = least(greatest(v.k, 6), n - 7)")
_stats("cmd_median_filter_stats", "MEDIAN-FILTER hwin=0.25", "SELECT id, ch, k, quantile_disc(x, 0.5) OVER (PARTITION BY id, ch ORDER BY k ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS x FROM v")
_stats("cmd_robust_norm_stats", "ROBUST-NORM", "SELECT id, ch, k, (x - md) / CASE WHEN s = 0 THEN 1 ELSE s END AS x FROM v JOIN (SELECT id, ch, quantile_disc(x, 0.5) AS md, 0.7413 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS s FROM v GROUP BY id, ch) q USING (id, ch)")
_stats("cmd_rolling_norm_stats", "ROLLING-NORM w=2", "SELECT id, ch, k, CASE WHEN sd > 1e-12 THEN (x - m) / sd ELSE 0 END AS x FROM (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS sd FROM (SELECT id, ch, k, k AS pos, x FROM v UNION ALL SELECT id, ch, NULL, k - 25, x FROM v WHERE k BETWEEN 1 AND 24 UNION ALL SELECT id, ch, NULL, k + 25, x FROM v, lim WHERE k BETWEEN n - 25 AND n - 2) WINDOW w AS (PARTITION BY id, ch ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING)) WHERE k IS NOT NULL")
_stats("cmd_combine_stats", "COMBINE mean=M", "SELECT id, ch, k, x FROM v UNION ALL SELECT id, 'M', k, avg(x) FROM v GROUP BY id, k")
_ADJUSTED = "SELECT v.id, v.ch, v.k, CASE WHEN v.ch = 'error' THEN v.x - coalesce(r.a + r.b * w.x, q.m) ELSE v.x END AS x FROM v LEFT JOIN v w ON w.id = v.id AND w.k = v.k AND w.ch = 'view' LEFT JOIN (SELECT p.id, regr_slope(p.x, q.x) AS b, regr_intercept(p.x, q.x) AS a FROM v p JOIN v q ON p.id = q.id AND p.k = q.k AND p.ch = 'error' AND q.ch = 'view' GROUP BY p.id) r ON r.id = v.id LEFT JOIN (SELECT id, avg(x) AS m FROM v WHERE ch = 'error' GROUP BY id) q ON q.id = v.id"
for _name, _text in (("adjust", "ADJUST sig=error adj=view"), ("alter", "ALTER sig=error corr=view")):
    _table(f"cmd_{_name}_stats", f"{_text} & STATS", "STATS", ("CH",), f"""SELECT id, ch, count(*) AS "N", stddev_samp(x) AS "SD", sqrt(avg(x * x)) AS "RMS", min(x) AS "MIN", max(x) AS "MAX" FROM ({_ADJUSTED}) y GROUP BY id, ch""", lambda t: t.select("id", "ch", "N", "SD", "RMS", "MIN", "MAX"))
_stats("cmd_zoh_stats", "ZOH sr=48", "SELECT id, ch, 2 * k + j AS k, x FROM v, (VALUES (0), (1)) y(j)")
_stats("cmd_resample_linear_stats", "RESAMPLE sr=12 linear", "SELECT id, ch, k // 2 AS k, x FROM v WHERE k % 2 = 0")
_table("cmd_zc_stats", "ZC & STATS", "STATS", ("CH",), """SELECT id, ch, count(*) AS "N", stddev_samp(x) AS "SD", min(x) AS "MIN", max(x) AS "MAX" FROM (SELECT id, ch, x - avg(x) OVER (PARTITION BY id, ch) AS x FROM v) GROUP BY id, ch""", lambda t: t.select("id", "ch", "N", "SD", "MIN", "MAX"))
_stats("cmd_scramble_stats", "SCRAMBLE", "SELECT * FROM v")
_table("cmd_cwt_design", "CWT-DESIGN fc=13 fs=100", "CWT-DESIGN", (), """SELECT 13.0 AS "FC", 7.0 AS "CYCLES", 100.0 AS "FS", w * s AS "FWHM", w / (2 * pi() * s) AS "FWHM_F", 13 - w / (2 * pi() * s) / 2 AS "FWHM_LWR", 13 + w / (2 * pi() * s) / 2 AS "FWHM_UPR" FROM (SELECT 2 * sqrt(2 * ln(2)) AS w, 7 / (2 * pi() * 13) AS s)""")

# ---- spectra by explicit sums of cosines and sines ------------------------


def _segments(n: int, step: int, window: str, epoch: int = 0, demean: bool = False) -> str:
    """CTEs sg (id, ch, e, g, windowed list), tr (f, i, cosines, sines), ww (sum of squared weights), ft (id, ch, e, g, i, f, re, im)."""
    edge = int(0.25 * (n - 1))
    w = {"tukey": f"CASE WHEN j <= {edge} THEN 0.5 * (1 + cos(pi() * (j / {edge}.0 - 1))) WHEN j >= {n - edge - 1} THEN 0.5 * (1 + cos(pi() * (({n - 1} - j) / {edge}.0 - 1))) ELSE 1.0 END", "hann": f"0.5 - 0.5 * cos(2 * pi() * j / {n - 1}.0)", "none": "1.0"}[window]
    e = f"k // {epoch}" if epoch else "0"
    at = f"k - {e} * {epoch or 1}"
    x = "x - avg(x) OVER (PARTITION BY id, ch, e, g)" if demean else "x"
    return f""", pt AS (SELECT id, ch, {e} AS e, {at} AS t, x FROM v), ln AS (SELECT {f"{epoch}" if epoch else "n"} AS n FROM lim), wt AS (SELECT j, {w} AS w FROM (SELECT unnest(range(0, {n})) AS j)),
sl AS (SELECT g, j, g * {step} + j AS t, w FROM wt, ln, (SELECT unnest(range(0, 100000)) AS g) WHERE g * {step} + {n} <= ln.n), sx AS (SELECT id, ch, e, g, j, w, {x} AS x FROM pt JOIN sl USING (t)), sg AS (SELECT id, ch, e, g, list(x * w ORDER BY j) AS l FROM sx GROUP BY ALL),
tr AS (SELECT i, i * 24.0 / {n} AS f, list(cos(2 * pi() * i * j / {n}.0) ORDER BY j) AS c, list(sin(2 * pi() * i * j / {n}.0) ORDER BY j) AS s FROM (SELECT unnest(range(0, {n // 2 + 1})) AS i), (SELECT unnest(range(0, {n})) AS j) GROUP BY i), ww AS (SELECT sum(w * w) AS ww FROM wt),
ft AS (SELECT id, ch, e, g, i, f, list_dot_product(l, c) AS re, -list_dot_product(l, s) AS im FROM sg, tr)"""


def _welch(n: int, step: int, window: str = "tukey", epoch: int = 0) -> str:
    """CTE ps (id, ch, e, i, f, p): mean one-sided density over segments."""
    return _segments(n, step, window, epoch) + f", ps AS (SELECT id, ch, e, i, f, avg((re * re + im * im) / (24.0 * ww) * CASE WHEN i BETWEEN 1 AND {(n + 1) // 2 - 1} THEN 2 ELSE 1 END) AS p FROM ft, ww GROUP BY ALL)"


def _bands(only: str = "lo < 12") -> str:
    from hypnoframe.functions.dsp import BANDS

    return ", bd AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {lo}, {hi})" for b, (lo, hi) in BANDS.items()) + f') y(b, lo, hi) WHERE {only})'


_BP = ", bp AS (SELECT id, ch, e, b, coalesce(sum(p) FILTER (f >= lo AND f < hi), 0) * 24.0 / {0} AS v FROM ps, bd GROUP BY ALL), tt AS (SELECT id, ch, e, CASE WHEN v = 0 THEN 1 ELSE v END AS t FROM bp WHERE b = 'TOTAL')"
_PSD = _welch(96, 48) + _bands() + _BP.format(96)
_table("cmd_psd", "PSD spectrum min=0.5 max=12", "PSD", ("CH", "B"), f'{_PSD} SELECT id, ch, b AS "B", v AS "PSD", v / t AS "RELPSD" FROM bp JOIN tt USING (id, ch, e)')
_table("cmd_psd_spectrum", "PSD spectrum min=0.5 max=12 sig=error", "PSD", ("CH", "F"), f"""{_welch(96, 48)} SELECT id, ch, f AS "F", p AS "PSD" FROM ps WHERE ch = 'error' AND f BETWEEN 0.5 AND 12""")
_table("cmd_psd_epoch", "EPOCH len=5 & PSD epoch", "PSD", ("CH", "B", "E"), f'{_welch(120, 120, epoch=120)}{_bands()}{_BP.format(120)} SELECT id, ch, e + 1 AS e, b AS "B", v AS "PSD", v / t AS "RELPSD" FROM bp JOIN tt USING (id, ch, e)')
_q = lambda a, b: f"({a}) / (({b}) + 1)"
_table("cmd_psd_ratio", "PSD ratio ratio1", "PSD-RATIO", ("CH",), f"""{_PSD}, w AS (SELECT id, ch, {", ".join(f"coalesce(max(v) FILTER (b = '{b}'), 0) AS {b}" for b in ("SLOW", "DELTA", "THETA", "ALPHA", "BETA"))} FROM bp GROUP BY id, ch)
SELECT id, ch, {_q("slow", "slow + delta")} AS "SOF", {_q("delta", "alpha")} AS "DAR", {_q("theta", "alpha")} AS "TAR", {_q("theta", "beta")} AS "TBR", {_q("delta + theta", "alpha + beta")} AS "GSI" FROM w""")
_table("cmd_asymm", "ASYMM left=error right=view", "ASYMM", ("B",), f"""{_PSD} SELECT p.id, p.b AS "B", log2(p.v / q.v) AS "ASYMM" FROM bp p JOIN bp q ON p.id = q.id AND p.b = q.b AND p.ch = 'error' AND q.ch = 'view'""")
_table("cmd_prep_massoc", "PREP-MASSOC", "PREP-MASSOC", ("CH",), f"""{_PSD} SELECT id, ch, {", ".join(f'''max(v) FILTER (b = '{b}') AS "{b}"''' for b in ("SLOW", "DELTA", "THETA", "ALPHA", "LOW_SIGMA", "TOTAL"))} FROM bp GROUP BY id, ch""", lambda t: t.drop("SIGMA", "HIGH_SIGMA", "BETA", "GAMMA"))
_ROUND = lambda t: t.withColumns({c: F.when(F.abs(F.col(c)) < 1e-9, 0.0).otherwise(F.col(c)) for c in ("RE", "IM", "PSD")})


def cmd_fft(spark, d: str) -> DataFrame:
    return _ROUND(session(spark, d).eval("EPOCH len=1 & MASK epoch=1-10 & RE & FFT").table("FFT", "CH", "F"))


_add("cmd_fft", cmd_fft, f'{_segments(240, 240, "none", 240)} SELECT id, ch, f AS "F", CASE WHEN abs(re / 240) < 1e-9 THEN 0.0 ELSE re / 240 END AS "RE", CASE WHEN abs(im / 240) < 1e-9 THEN 0.0 ELSE im / 240 END AS "IM", CASE WHEN abs((re * re + im * im) / 240 / 240) < 1e-9 THEN 0.0 ELSE (re * re + im * im) / 240 / 240 END AS "PSD" FROM ft WHERE e = 0', "Fourier transform of the first ten days; what is under 1e-9 is 0")
_table("cmd_zr", "EPOCH len=5 & ZR", "ZR", ("CH", "E"), f"""{_segments(48, 48, "tukey", 120)}, z AS (SELECT id, ch, e, g, {", ".join(f"coalesce(sum((re * re + im * im) * CASE WHEN i BETWEEN 1 AND 23 THEN 2 ELSE 1 END / (24.0 * ww)) FILTER (f >= {lo} AND f < {hi}), 0) AS b{k}" for k, (lo, hi) in enumerate(((0.5, 2), (2.5, 7.5), (8, 12.5), (13, 30))))} FROM ft, ww GROUP BY ALL)
SELECT id, ch, e + 1 AS e, avg((b0 + b1 - b2 - b3) / greatest(b0 + b1 + b2 + b3, 1e-300)) AS "ZR30" FROM z GROUP BY ALL""")
_table("cmd_artifacts", "EPOCH len=2 & ARTIFACTS no-mask", "ARTIFACTS", ("CH", "E"), f"""{_welch(48, 48, epoch=48)}, d AS (SELECT id, ch, e + 1 AS e, coalesce(sum(p) FILTER (f >= 0.6 AND f < 4.6), 0) * 0.5 AS d FROM ps GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY id, ch) AS n, avg(d) OVER (w ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM d WINDOW w AS (PARTITION BY id, ch ORDER BY e)),
l AS (SELECT r.id, r.ch, r.e, r.d, CASE WHEN r.n < 15 THEN (SELECT NULL) ELSE q.m END AS a FROM r JOIN r q ON q.id = r.id AND q.ch = r.ch AND q.rn = least(greatest(r.rn, 8), r.n - 7))
SELECT id, ch, e, d AS "DELTA", 0.0 AS "BETA", a AS "DELTA_AVG", d / nullif(a, 0) AS "DELTA_FAC", CASE WHEN d / nullif(a, 0) > 2.5 THEN 1 ELSE 0 END AS "DELTA_MASK", 0.0 AS "BETA_AVG", CAST(NULL AS DOUBLE) AS "BETA_FAC", 0 AS "BETA_MASK", CASE WHEN d / nullif(a, 0) > 2.5 THEN 1 ELSE 0 END AS "MASK" FROM l""")
_table("cmd_arousal_features", "AROUSALS sig=error", "AROUSALS", ("CH", "T"), f"""{_segments(24, 12, "hann")} SELECT id, ch, g * 0.5 AS "T", {", ".join(f'ln(coalesce(sum((re * re + im * im) * CASE WHEN i BETWEEN 1 AND 11 THEN 2 ELSE 1 END / (24.0 * ww)) FILTER (f >= {lo} AND f < {hi}), 0) + 1e-12) AS "{b}"' for b, lo, hi in (("ALPHA", 8, 12), ("BETA", 15, 30), ("SIGMA", 12, 15)))} FROM ft, ww WHERE ch = 'error' GROUP BY id, ch, g""")
_CROSS = _segments(120, 60, "hann", demean=True) + """, au AS (SELECT id, ch, i, f, avg(re * re + im * im) AS s FROM ft GROUP BY ALL), cr AS (SELECT a.id, a.ch AS ch1, b.ch AS ch2, a.i, a.f, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im FROM ft a JOIN ft b ON a.id = b.id AND a.g = b.g AND a.i = b.i AND a.ch < b.ch GROUP BY ALL),
cc AS (SELECT cr.id, ch1, ch2, cr.i, cr.f, re / sqrt(greatest(x.s * y.s, 1e-300)) AS re, im / sqrt(greatest(x.s * y.s, 1e-300)) AS im FROM cr JOIN au x ON x.id = cr.id AND x.ch = ch1 AND x.i = cr.i JOIN au y ON y.id = cr.id AND y.ch = ch2 AND y.i = cr.i)"""
_table("cmd_coh", "COH", "COH", ("CH1", "CH2", "B"), f'{_CROSS}{_bands("true")} SELECT id, ch1, ch2, b AS "B", avg(re * re + im * im) AS "COH", avg(im) AS "ICOH", avg(abs(im) / sqrt(greatest(1 - re * re, 1e-12))) AS "LCOH" FROM cc JOIN bd ON f >= lo AND f < hi GROUP BY ALL')
_table("cmd_psi", "PSI", "PSI", ("CH1", "CH2", "F"), f'{_CROSS}{_bands("hi <= 12")} SELECT p.id, p.ch1, p.ch2, b AS "F", -sum(p.re * q.im - p.im * q.re) AS "PSI" FROM cc p JOIN cc q ON p.id = q.id AND p.ch1 = q.ch1 AND p.ch2 = q.ch2 AND q.i = p.i + 1 JOIN bd ON p.f >= lo AND q.f <= hi GROUP BY ALL')

# ---- epochs, masks and annotations ----------------------------------------

_table("cmd_epoch", "EPOCH len=2 inc=1", "EPOCH", (), 'SELECT id, dur - 1 AS "NE", 2.0 * (dur - 1) AS "TOT_DUR" FROM rec')
_HAS = lambda c: f"EXISTS (SELECT 1 FROM a WHERE a.id = ep.id AND a.class = '{c}' AND {_FOUND.format('a', 'ep')})"
_mask("cmd_mask_if", "MASK if=error", _HAS("error"))
_mask("cmd_mask_ifnot_any", "MASK ifnot=error,view", f"NOT ({_HAS('error')} OR {_HAS('view')})")
_mask("cmd_mask_if_every", "MASK if-all=error,view", f"{_HAS('error')} AND {_HAS('view')}")
_mask("cmd_mask_expr", 'MASK expr="error && ! nosuchclass"', _HAS("error"))
_mask("cmd_mask_mode", "MASK all & MASK unmask-if=error & MASK mask-if=view", f"NOT {_HAS('error')} OR {_HAS('view')}")
_mask("cmd_mask_flip_edges", "MASK leading=3 & MASK flip & MASK trailing=20", "e > 3 OR e > (SELECT max(q.e) FROM ep q WHERE q.id = ep.id) - 20")
_mask("cmd_mask_interior_sec", "MASK sec=5-9 & MASK epoch=6-6,9-9 & MASK interior", "NOT e BETWEEN 6 AND 9")
_mask("cmd_mask_hms", "MASK hms=00:00:04-00:00:08", "NOT (start_ns < 8000000000 AND stop_ns > 4000000000)")
_mask("cmd_mask_first", "MASK if=error & MASK first=3", f"{_HAS('error')} OR e NOT IN (SELECT q.e FROM (SELECT ep.id, ep.e, row_number() OVER (PARTITION BY ep.id ORDER BY ep.e) AS r FROM ep WHERE NOT {_HAS('error')}) q WHERE q.id = ep.id AND r <= 3)")
_notes("cmd_annot_mask", "DROP-ANNOTS annot=* & EPOCH len=1 & MASK epoch=2-4,9-9,12-13 & ANNOT-MASK inc tag=kept", "SELECT id, 'kept' AS class, s * CAST(1000000000 AS BIGINT) AS start_ns, t * CAST(1000000000 AS BIGINT) AS stop_ns FROM rec, (VALUES (1, 4), (8, 9), (11, 13)) y(s, t)")
_table("cmd_dump_epochs", "EPOCH len=1 & DUMP-EPOCHS annot=error", "ANNOTS", ("E", "ANNOT"), f"{_EPOCH} SELECT ep.id, e, class, false AS masked FROM ep JOIN a ON a.id = ep.id AND class = 'error' AND {_FOUND.format('a', 'ep')}")
_table("cmd_annots", "ANNOTS annot=error,vi*", "ANNOTS", ("ANNOT",), """SELECT id, class, count(*) AS "COUNT", sum(stop_ns - start_ns) / 1e9 AS "DUR" FROM a WHERE class IN ('error', 'view') GROUP BY id, class""")
_table("cmd_spanning", "SPANNING annot=error", "SPANNING", (), f"""{_FLAT} SELECT rec.id, CAST(any_value(dur) AS DOUBLE) AS "REC_SEC", coalesce(sum(f.stop_ns - f.start_ns) / 1e9, 0.0) AS "SPANNED_SEC", coalesce(sum(f.stop_ns - f.start_ns) / 1e9, 0) / any_value(dur) * 100 AS "SPANNED_PCT", count(f.id) AS "NSEGS" FROM rec LEFT JOIN flat f ON f.id = rec.id AND class = 'error' GROUP BY rec.id""")
_table("cmd_espan_command", "EPOCH len=1 & ESPAN annot=error", "ESPAN", ("E",), f"""{_FLAT}{_EPOCH} SELECT ep.id, e, coalesce(sum(least(ep.stop_ns, f.stop_ns) - greatest(ep.start_ns, f.start_ns)) FILTER (f.id IS NOT NULL) / 1e9, 0.0) AS "SEC", coalesce(sum(least(ep.stop_ns, f.stop_ns) - greatest(ep.start_ns, f.start_ns)) FILTER (f.id IS NOT NULL) / 1e9, 0.0) * 100 AS "PCT", count(f.id) AS "CNT", CAST(count(f.id) > 0 AS INTEGER) AS "HAS"
FROM ep LEFT JOIN flat f ON f.id = ep.id AND class = 'error' AND {_FOUND.format('f', 'ep')} GROUP BY ep.id, e""")
_table("cmd_eval_command", 'EPOCH len=1 & EVAL expr="error.n > 1 && view.sec > 0" annot=busy', "EVAL", ("E",), f"""{_EPOCH} SELECT ep.id, e, count(*) FILTER (class = 'error') > 1 AND coalesce(sum(least(ep.stop_ns, a.stop_ns) - greatest(ep.start_ns, a.start_ns)) FILTER (class = 'view'), 0) > 0 AS "VALUE" FROM ep LEFT JOIN a ON a.id = ep.id AND {_FOUND.format('a', 'ep')} GROUP BY ep.id, e""")
_table("cmd_derive_command", 'DERIVE expr="sum(error) / length(error)" var=M', "DERIVE", (), """SELECT id, sum(stop_ns - start_ns) FILTER (class = 'error') / 1e9 / nullif(count(*) FILTER (class = 'error'), 0) AS "M" FROM a GROUP BY id""", lambda t: t.withColumn("M", F.col("M").cast("double")))
_table("cmd_annot_means", "MEANS annot=error", "MEANS", ("CH", "ANNOT"), f"""{_FLAT}, q AS (SELECT v.id, v.ch, f.class, x, k, floor(f.start_ns * {_DBL(24)} / 1e9) AS s, round((f.stop_ns - f.start_ns) * {_DBL(24)} / 1e9) AS c FROM flat f JOIN v ON v.id = f.id WHERE f.class = 'error'), g AS (SELECT id, ch, class, sum(x) AS t, count(*) AS n FROM q WHERE k >= s AND k < s + c GROUP BY ALL), l AS (SELECT id, ch, min(x) AS lo, max(x) AS hi FROM v GROUP BY id, ch)
SELECT l.id, l.ch, c.class, t / n AS "M", coalesce(n, 0) AS "S", (t / n - lo) / nullif(hi - lo, 0) AS "M1" FROM l JOIN (SELECT DISTINCT id, class FROM flat WHERE class = 'error') c ON c.id = l.id LEFT JOIN g ON g.id = l.id AND g.ch = l.ch""")
_notes("cmd_drop_remap", "DROP-ANNOTS annot=er*,view & REMAP map=click:tap", "SELECT id, CASE class WHEN 'click' THEN 'tap' ELSE class END AS class, start_ns, stop_ns FROM a WHERE class NOT IN ('error', 'view')")
_notes("cmd_extend", "EXTEND annots=error w=0.5", "SELECT id, class, CASE WHEN class = 'error' THEN greatest(0, start_ns - 500000000) ELSE start_ns END AS start_ns, CASE WHEN class = 'error' THEN stop_ns + 500000000 ELSE stop_ns END AS stop_ns FROM a")
_notes("cmd_a2c_c2a", "A2C annot=error cache=c & DROP-ANNOTS annot=* & C2A cache=c annot=mid w=0.01", f"SELECT id, 'mid' AS class, CAST(round((t - 0.01::DOUBLE) * 1000000000) AS BIGINT) AS start_ns, CAST(round((t + 0.01::DOUBLE) * 1000000000) AS BIGINT) AS stop_ns FROM (SELECT id, {_DBL('start_ns + (stop_ns - start_ns) // 2')} / 1e9 AS t FROM a WHERE class = 'error')")
_PAIR = _FLAT + ", x AS (SELECT * FROM flat WHERE class = 'error'), y AS (SELECT * FROM flat WHERE class = 'view')"
_make = lambda name, op, sql: _notes(f"cmd_make_{name}", f"MAKE-ANNOTS annot=new {op} & DROP-ANNOTS annot=click,error,purchase,signup,view", _counted(_PAIR, f"SELECT id, 'new' AS class, start_ns, stop_ns FROM ({sql}) q"))
_make("intersection", 'expr="error*view"', "SELECT x.id, greatest(x.start_ns, y.start_ns) AS start_ns, least(x.stop_ns, y.stop_ns) AS stop_ns FROM x JOIN y ON x.id = y.id AND x.start_ns < y.stop_ns AND y.start_ns < x.stop_ns")
_make("overlapping", 'expr="error+view"', f"SELECT DISTINCT a.id, a.start_ns, a.stop_ns FROM a JOIN (SELECT id, start_ns, stop_ns FROM a WHERE class = 'view') b ON a.id = b.id AND a.class = 'error' AND {_FOUND.format('b', 'a')}")
_make("apart", 'expr="error-view"', f"SELECT a.id, a.start_ns, a.stop_ns FROM a WHERE a.class = 'error' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.id = a.id AND b.class = 'view' AND {_FOUND.format('b', 'a')})")
_make("flatten", "flatten=error", "SELECT id, start_ns, stop_ns FROM x")
_make("midpoint", "midpoint=error", "SELECT id, start_ns + (stop_ns - start_ns) // 2 AS start_ns, start_ns + (stop_ns - start_ns) // 2 AS stop_ns FROM a WHERE class = 'error'")
_make("epochs", "epoch=1", "SELECT id, e * 30000000000 AS start_ns, (e + 1) * 30000000000 AS stop_ns FROM (SELECT id, unnest(range(0, dur // 30)) AS e FROM rec)")
_table("cmd_axa", "AXA annot=error,view", "AXA", ("SEED", "ANNOT"), f"""{_FLAT}, s1 AS (SELECT row_number() OVER () AS r, * FROM a WHERE class IN ('error', 'view') AND stop_ns > start_ns), h AS (SELECT s1.class AS seed, f.class AS annot, r, sum(least(s1.stop_ns, f.stop_ns) - greatest(s1.start_ns, f.start_ns)) / 1e9 AS t, count(*) AS n, any_value(s1.stop_ns - s1.start_ns) / 1e9 AS d FROM s1 JOIN flat f ON f.id = s1.id AND f.class IN ('error', 'view') AND f.class != s1.class AND {_FOUND.format('f', 's1')} GROUP BY ALL), c AS (SELECT class AS seed, count(*) AS seeds FROM s1 GROUP BY class)
SELECT seed, annot, sum(t / d) / any_value(seeds) AS "P", sum(t) / any_value(seeds) AS "T", sum(n) / any_value(seeds) AS "N", CAST(count(*) AS DOUBLE) / any_value(seeds) AS "A", CAST(sum(n) AS BIGINT) AS "TOT_N", sum(t) AS "TOT_T" FROM h JOIN c USING (seed) GROUP BY seed, annot""")
_table("cmd_overlap_observed", "OVERLAP seed=error other=view nreps=20", "OVERLAP", ("SEED",), f"""{_FLAT} SELECT 'error' AS seed, count(*) AS "OBS" FROM a WHERE class = 'error' AND EXISTS (SELECT 1 FROM flat f WHERE f.id = a.id AND f.class = 'view' AND (f.start_ns < greatest(a.stop_ns, a.start_ns + 1) AND f.stop_ns > a.start_ns))""", lambda t: t.select("seed", "OBS"))
_table("cmd_days", "DAYS", "DAYS", ("DAY",), """, t AS (SELECT id, dur, 1704067200 AS t0 FROM rec), d AS (SELECT *, (t0 - 43200) // 86400 AS f, unnest(range((t0 - 43200) // 86400, (t0 + dur - 1 - 43200) // 86400 + 1)) AS k FROM t)
SELECT id, k - f + 1 AS "DAY", CAST(greatest(0, k * 86400 + 43200 - t0) AS DOUBLE) AS "START_SEC", CAST(least(dur, (k + 1) * 86400 + 43200 - t0) AS DOUBLE) AS "STOP_SEC", CASE WHEN dayofweek(make_timestamp((k * 86400 + 43200) * 1000000)) IN (0, 6) THEN 1 ELSE 0 END AS "WEEKEND" FROM d""")
_table("cmd_hb", "HB oxygen=view events=error", "HB", (), f""", ev AS (SELECT id, row_number() OVER () AS r, floor({_DBL('start_ns')} * 24 / 1e9) AS s, floor(({_DBL('stop_ns')} / 1e9 + 45) * 24) AS t FROM a WHERE class = 'error'), ox AS (SELECT * FROM v WHERE ch = 'view'), bs AS (SELECT ev.id, r, s, t, CASE WHEN s > 0 THEN max(x) FILTER (k >= s - 2400 AND k < s) ELSE max(x) FILTER (k = 0) END AS base FROM ev JOIN ox ON ox.id = ev.id GROUP BY ev.id, r, s, t)
SELECT bs.id, count(DISTINCT r) AS "NE", coalesce(sum(greatest(base - x, 0)) FILTER (k >= s AND k < t), 0) / 24.0 / 60 AS "HB_TOT", coalesce(sum(greatest(base - x, 0)) FILTER (k >= s AND k < t), 0) / 24.0 / 60 / (any_value(n) / 24.0 / 3600) AS "HB" FROM bs JOIN ox ON ox.id = bs.id, lim GROUP BY bs.id""")
_LOCKED = lambda h: f""", ev AS (SELECT id, CAST(round_even({_DBL('start_ns + stop_ns')} / 2 / 1e9 * 24, 0) AS BIGINT) AS m FROM a WHERE class = 'error'), w AS (SELECT v.id, v.ch, k - m AS j, x FROM ev JOIN lim ON m >= {h} AND m + {h} < n JOIN v ON v.id = ev.id AND k BETWEEN m - {h} AND m + {h})
SELECT id, ch, j / 24.0 AS "SEC", avg(x) AS "M", stddev_pop(x) AS "SD", median(x) AS "MD", count(*) AS "N" FROM w GROUP BY id, ch, j"""  # noqa: E731
_table("cmd_tlock", "TLOCK annot=error w=0.5", "TLOCK", ("CH", "SEC"), _LOCKED(12))
_table("cmd_peri", "PERI annot=error w=0.25", "PERI", ("CH", "SEC"), _LOCKED(6))


def cmd_slice(spark, d: str) -> DataFrame:
    t = session(spark, d).eval("SLICE annot=error sig=view").table("SLICE", "CH", "ANNOT")
    return t.select("id", "ch", "class", "start_ns", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


_add("cmd_slice", cmd_slice, f"""{_FLAT}, q AS (SELECT f.id, class, start_ns, round({_DBL('start_ns')} * 24 / 1e9) AS s, round({_DBL('stop_ns - start_ns')} * 24 / 1e9) AS c FROM flat f WHERE class = 'error')
SELECT q.id, 'view' AS ch, class, start_ns, count(k) AS n, coalesce(sum(x), 0.0) AS total FROM q JOIN (SELECT DISTINCT id FROM v WHERE ch = 'view') i ON i.id = q.id LEFT JOIN v ON v.id = q.id AND v.ch = 'view' AND k >= s AND k < s + c GROUP BY ALL""", "Script: SLICE annot=error sig=view; length and sum of each slice")


def cmd_meta(spark, d: str) -> DataFrame:
    s = session(spark, d).eval("META annot=error other=view md=n count & META annot=error other=view md=sec")
    return s.annots.where("class = 'error'").select("id", "start_ns", "stop_ns", F.col("meta")["n"].cast("double").alias("n"), F.col("meta")["sec"].cast("double").alias("sec"))


_add("cmd_meta", cmd_meta, f"""{_FLAT} SELECT a.id, a.start_ns, a.stop_ns, CAST(count(f.id) AS DOUBLE) AS n, coalesce(sum(least(a.stop_ns, f.stop_ns) - greatest(a.start_ns, f.start_ns)) FILTER (f.id IS NOT NULL) / 1e9, 0.0) AS sec FROM (SELECT DISTINCT * FROM a WHERE class = 'error') a LEFT JOIN flat f ON f.id = a.id AND f.class = 'view' AND {_FOUND.format('f', 'a')} GROUP BY a.id, a.start_ns, a.stop_ns""", "Script: META with count and seconds of another class")


def cmd_dynam(spark, d: str) -> DataFrame:
    s = session(spark, d)
    per = s.samples.select("id", F.col("ch").alias("var"), F.posexplode("v").alias("k", "x")).groupBy("id", "var", F.floor(F.col("k") / RATE).alias("e")).agg(F.sum("x").alias("value"))
    return replace(s, caches={"c": per}).eval("DYNAM cache=c").table("DYNAM", "VAR", "Q")


_add("cmd_dynam", cmd_dynam, "SELECT id, var, q, avg(value) AS ss, count(*) AS n FROM (SELECT *, ntile(10) OVER (PARTITION BY id, var ORDER BY e) AS q FROM (SELECT id, ch AS var, k // 24 AS e, sum(x) AS value FROM v GROUP BY ALL)) GROUP BY ALL", "DYNAM over daily sums of each channel")

# ---- staging --------------------------------------------------------------

_STAGE = _STAGED + _EPOCH + f""", hy AS (SELECT ep.id, e, CASE WHEN count(DISTINCT class) = 1 THEN any_value(class) ELSE '?' END AS stage, CAST(count(DISTINCT class) > 1 AS INTEGER) AS conflict FROM ep LEFT JOIN st ON st.id = ep.id AND class IN ('W', 'N1', 'N2', 'N3', 'R') AND {_FOUND.format('st', 'ep')} GROUP BY ep.id, e)"""
_table("cmd_stage", f"{STAGES} & EPOCH len=1 & STAGE", "STAGE", ("E",), f'{_STAGE} SELECT id, e, stage AS "STAGE", conflict AS "CONFLICT" FROM hy')
_table("cmd_hypno_stages", f"{STAGES} & EPOCH len=1 & HYPNO", "HYPNO", ("SS",), f'{_STAGE} SELECT id, stage, count(*) * 0.5 AS "MINS", count(*) / sum(count(*)) OVER (PARTITION BY id) AS "PCT" FROM hy GROUP BY id, stage')
_RUNS = ", rn AS (SELECT *, e - row_number() OVER (PARTITION BY id, stage ORDER BY e) AS g FROM hy), bt AS (SELECT id, stage, g, min(e) AS first, count(*) AS n FROM rn GROUP BY id, stage, g)"
_table("cmd_hypno_bouts", f"{STAGES} & EPOCH len=1 & HYPNO", "HYPNO", ("BOUT",), f'{_STAGE}{_RUNS} SELECT id, stage, count(*) AS "BOUT_N", avg(n * 0.5) AS "BOUT_MN", quantile_disc(n * 0.5, 0.5) AS "BOUT_MD", max(n * 0.5) AS "BOUT_MX", coalesce(sum(n * 0.5) FILTER (n >= 10), 0) AS "BOUT_05", coalesce(sum(n * 0.5) FILTER (n >= 20), 0) AS "BOUT_10" FROM bt GROUP BY id, stage')
_table("cmd_hypno_transitions", f"{STAGES} & EPOCH len=1 & HYPNO", "HYPNO", ("PRE", "POST"), f"{_STAGE} SELECT stage AS pre, post, count(*) AS n FROM (SELECT *, lead(stage) OVER (PARTITION BY id ORDER BY e) AS post FROM hy) WHERE post IS NOT NULL GROUP BY ALL")
_table("cmd_hypno_epochs", f"{STAGES} & EPOCH len=1 & HYPNO", "HYPNO", ("E",), f"{_STAGE}{_RUNS} SELECT rn.id, e, rn.stage, e - first AS flank_left, first + n - 1 - e AS flank_right, least(e - first, first + n - 1 - e) AS flank_min FROM rn JOIN bt ON bt.id = rn.id AND bt.stage = rn.stage AND bt.g = rn.g")
