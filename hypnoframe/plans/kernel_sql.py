"""DuckDB SQL for script queries whose kernels run in numpy: filters, transforms and detectors.

The SQL holds each trace as a list and convolves by dot products of slices; tables
are the traces of ``scripted``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from hypnoframe.functions.dsp import BANDS
from hypnoframe.plans import proven, scripted
from hypnoframe.plans.proven import _LAGS, _LISTS, _STATS
from hypnoframe.plans.scripted import _TRACE, RATE

QUERIES: dict = {}
ORACLE: dict = {}


def _taps(name: str, sr: float, lo: float, hi: float, tw: float, ripple: float = 0.02) -> tuple[str, int]:
    """CTE ``name``(h) with a Kaiser-window bandpass of unit gain at its middle, and its half length."""
    a = -20 * math.log10(ripple)
    beta = 0.5842 * (a - 21) ** 0.4 + 0.07886 * (a - 21)
    half = (math.ceil((a - 7.95) * sr / (4.57 * math.pi * tw)) | 1) // 2
    sinc = f"CASE m WHEN 0 THEN {2 * (hi - lo) / sr!r} ELSE (sin(2 * pi() * {hi!r} * m / {sr!r}) - sin(2 * pi() * {lo!r} * m / {sr!r})) / (pi() * m) END"
    bessel = f"list_sum(list_transform(range(0, 31), lambda j: pow({beta / 2!r} * sqrt(1 - pow(CAST(m AS DOUBLE) / {half}, 2)), 2 * j) / pow(gamma(j + 1.0), 2)))"
    gain = f"abs(sum(h * cos(2 * pi() * {math.sqrt(lo * hi)!r} * m / {sr!r})) OVER ())"
    return f", {name} AS (SELECT list(h ORDER BY m) AS h FROM (SELECT m, h / {gain} AS h FROM (SELECT m, {sinc} * {bessel} AS h FROM (SELECT unnest(range({-half}, {half + 1})) AS m))))", half


def _filtered(name: str, source: str, lo: float, hi: float, tw: float = 1.0) -> str:
    """CTEs whose last, ``name``(id, ch, n, y), has the filtered lists of ``source``(id, ch, k, x); ends are reflected."""
    taps, k = _taps(f"{name}_h", float(RATE), lo, hi, tw)
    return f"""{taps}, {name}_x AS (SELECT id, ch, count(*) AS n, list(x ORDER BY k) AS x FROM {source} GROUP BY ALL),
{name} AS (SELECT id, ch, n, list_transform(range(1, n + 1), lambda t: list_dot_product(p[t : t + {2 * k}], h)) AS y FROM (SELECT id, ch, n, list_concat(list_reverse(x[2 : {k + 1}]), x, list_reverse(x[n - {k} : n - 1])) AS p FROM {name}_x), {name}_h)"""


def _analytic(name: str, source: str) -> str:
    """``name``(id, ch, n, y, z): ``source`` with its Hilbert transform, for even lengths."""
    return f""", {name} AS (SELECT id, ch, n, y, list_transform(range(1, n + 1), lambda t: list_dot_product(list_concat(y, y)[t + 1 : t + n], g)) AS z FROM {source},
(SELECT list(CASE WHEN d % 2 = 1 THEN 2.0 / n / tan(pi() * d / n) ELSE 0.0 END ORDER BY d DESC) AS g FROM (SELECT n, unnest(range(0, n)) AS d FROM lim)))"""


def _rows(source: str, ch: str = "ch", x: str = "y") -> str:
    """Rows id, ch, k, x of lists."""
    return f"SELECT id, {ch} AS ch, unnest(range(0, n)) AS k, unnest({x}) AS x FROM {source}"


def _after(ctes: str, rows: str) -> str:
    """Rows of all traces and of those that a command adds."""
    return f"{ctes}, added AS ({rows}) " + _STATS.format("SELECT id, ch, k, x FROM v UNION ALL SELECT id, ch, k, x FROM added")


_ERROR = ", er AS (SELECT id, ch, k, x FROM v WHERE ch = 'error')"
_MAG = "list_transform(range(1, n + 1), lambda t: sqrt(y[t] * y[t] + z[t] * z[t]))"



def _quiet(part: str) -> str:
    """A part of lists y, z without what is under 1e-9 of the largest amplitude, ``top``."""
    return f"list_transform(range(1, n + 1), lambda t: CASE WHEN sqrt(y[t] * y[t] + z[t] * z[t]) < 1e-9 * top THEN 0.0 ELSE {part}[t] END)"


ORACLE["cmd_filter_stats"] = _filtered("f", "v", 2.0, 5.0) + _STATS.format(_rows("f"))
ORACLE["cmd_bands_stats"] = _after(
    _ERROR + "".join(_filtered(b.lower(), "er", *map(float, BANDS[b])) for b in ("DELTA", "THETA")),
    " UNION ALL ".join(_rows(b.lower(), f"'error_{b}'") for b in ("DELTA", "THETA")),
)
ORACLE["cmd_hilbert_stats"] = _after(_ERROR + _filtered("f", "er", 2.0, 5.0) + _analytic("w", "f"), _rows("w", "'error_hilbert_mag'", _MAG))


def _morlet(fc: float, cycles: float = 7.0, source: str = "er") -> str:
    """``w``(id, ch, n, y, z): real and imaginary parts of the Morlet transform of ``source``."""
    sd = cycles / (2 * math.pi * fc)
    n = math.ceil(8 * sd * RATE + 1)
    t = f"({-4 * sd!r} + i / {RATE}.0)"
    zeros = f"list_transform(range(0, {n - 1}), lambda i: 0.0)"
    dot = lambda part: f"list_transform(range({n // 2 + 1}, n + {n // 2 + 1}), lambda q: list_dot_product(p[q : q + {n - 1}], {part}))"
    return f""", m0 AS (SELECT i, exp(-pow({t}, 2) / {2 * sd * sd!r}) AS g, 2 * pi() * {fc!r} * {t} AS a FROM (SELECT unnest(range(0, {n})) AS i)),
m1 AS (SELECT list(2 * g * cos(a) / s ORDER BY i DESC) AS re, list(2 * g * sin(a) / s ORDER BY i DESC) AS im FROM m0, (SELECT sum(g) AS s FROM m0)),
w AS (SELECT id, ch, n, {dot("re")} AS y, {dot("im")} AS z FROM (SELECT id, ch, count(*) AS n, list_concat({zeros}, list(x ORDER BY k), {zeros}) AS p FROM {source} GROUP BY ALL), m1)"""


ORACLE["cmd_cwt_stats"] = _after(_ERROR + _morlet(4.0), _rows("w", "'error_cwt_4_mag'", _MAG))

_design, _half = _taps("hd", 100.0, 8.0, 12.0, 1.0)
ORACLE["cmd_filter_design"] = f"""{_design}, tap AS (SELECT unnest(h) AS h, unnest(range(0, {2 * _half + 1})) AS i FROM hd)
SELECT q * 100.0 / 4096 AS "F", sqrt(pow(sum(h * cos(2 * pi() * q * i / 4096)), 2) + pow(sum(h * sin(2 * pi() * q * i / 4096)), 2)) AS "MAG" FROM tap, (SELECT unnest(range(0, 2049)) AS q) GROUP BY q"""

ORACLE["cmd_polarity"] = (
    _filtered("f", "v", 0.5, 4.0)
    + f""", r AS (SELECT *, avg(x) OVER (PARTITION BY id, ch) AS m FROM ({_rows("f")}))
SELECT id, ch, coalesce(avg(x) FILTER (x > 0) + avg(x) FILTER (x < 0), 0.0) AS "POL", avg(pow(x, 3)) / CASE WHEN avg(pow(x - any_value_m, 2)) > 0 THEN pow(avg(pow(x - any_value_m, 2)), 1.5) ELSE 1.0 END AS "SKEW" FROM (SELECT *, m AS any_value_m FROM r) GROUP BY id, ch"""
)

ORACLE["cmd_ipc"] = (
    ", f AS (SELECT id, ch, count(*) AS n, list(x ORDER BY k) AS y FROM v GROUP BY ALL)"
    + _analytic("w", "f")
    + f""", top AS (SELECT id, ch, n, y, z, list_max({_MAG}) AS top FROM w), w0 AS (SELECT id, ch, n, {_quiet("y")} AS y, {_quiet("z")} AS z FROM top)"""
    + """, r AS (SELECT id, ch, unnest(range(0, n)) AS k, unnest(y) AS y, unnest(z) AS z FROM w0),
d AS (SELECT a.id, a.ch AS ch1, b.ch AS ch2, atan2(a.z, a.y) - atan2(b.z, b.y) AS d, sqrt((a.y * a.y + a.z * a.z) * (b.y * b.y + b.z * b.z)) AS w FROM r a JOIN r b ON a.id = b.id AND a.k = b.k AND a.ch < b.ch),
g AS (SELECT id, ch1, ch2, count(*) AS n, avg(cos(d)) AS c, avg(sin(d)) AS s, sum(w) AS w, sum(w * cos(d)) AS wc, sum(w * sin(d)) AS ws FROM d GROUP BY ALL)
SELECT id, ch1, ch2, sqrt(c * c + s * s) AS "PLV", CASE WHEN w > 0 THEN sqrt(wc * wc + ws * ws) / w ELSE 0.0 END AS "WIPC", atan2(s, c) AS "PHASE", c AS "IPC", n AS "N_TOT" FROM g"""
)

_locked = ORACLE["cmd_ipc"]
ORACLE["cmd_tsync"] = (
    _LISTS
    + f""", lags AS (SELECT p.id, p.ch AS ch1, q.ch AS ch2, g, {_LAGS} AS r FROM z p JOIN z q ON p.id = q.id AND p.ch < q.ch, (SELECT unnest(range(-24, 25)) AS g)),
best AS (SELECT id, ch1, ch2, arg_max(g, (round(r, 12), -g)) / 24.0 AS d, arg_max(r, (round(r, 12), -g)) AS r FROM lags GROUP BY id, ch1, ch2)"""
    + _locked[: _locked.rindex("SELECT id, ch1")].replace("d AS (SELECT a.id", "turned AS (SELECT a.id").replace("FROM d GROUP BY ALL", "FROM turned GROUP BY ALL").replace(", r AS (SELECT id", ", parts AS (SELECT id").replace("FROM r a JOIN r b", "FROM parts a JOIN parts b")
    + """SELECT id, ch1, ch2, best.d AS "D", r AS "XCORR", sqrt(c * c + s * s) AS "PHL", atan2(s, c) AS "PHASE" FROM best JOIN g USING (id, ch1, ch2)"""
)

#: window lengths, as many as 20 in geometric steps
_lengths = sorted({int(4 * (240 / 4) ** (k / 19) + 1e-9) for k in range(20)})
ORACLE["cmd_dfa"] = f""", y AS (SELECT id, ch, k, sum(x - m) OVER (PARTITION BY id, ch ORDER BY k) AS y FROM (SELECT *, avg(x) OVER (PARTITION BY id, ch) AS m FROM v WHERE ch = 'error')),
wd AS (SELECT id, ch, s, regr_syy(y, k % s) - CASE WHEN regr_sxx(y, k % s) > 0 THEN pow(regr_sxy(y, k % s), 2) / regr_sxx(y, k % s) ELSE 0 END AS res FROM y, (SELECT unnest({_lengths}) AS s), lim WHERE k < n // s * s GROUP BY id, ch, s, k // s),
fl AS (SELECT id, ch, s / 24.0 AS w, sqrt(sum(res) / (count(*) * s)) AS f FROM wd GROUP BY id, ch, s)
SELECT id, ch, CAST(w AS DOUBLE) AS "SEC", f AS "FLUCT", regr_slope(ln(f), ln(w)) OVER (PARTITION BY id, ch) AS "ALPHA" FROM fl"""

ORACLE["cmd_mse"] = """, er AS (SELECT id, ch, k // 360 AS e, k % 360 AS k, x FROM v WHERE ch = 'error' AND k // 360 < (SELECT n // 360 FROM lim)),
sc AS (SELECT id, ch, e, s, k // s AS k, avg(x) AS x FROM er, (SELECT unnest([1, 2, 3]) AS s) GROUP BY id, ch, e, s, k // s),
p AS (SELECT id, ch, e, s, k, x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c, 0.15 * stddev_pop(x) OVER (PARTITION BY id, ch, e, s) AS tol FROM sc WINDOW w AS (PARTITION BY id, ch, e, s ORDER BY k)),
h AS (SELECT p.id, p.ch, p.e, p.s, count(*) FILTER (abs(p.a - q.a) <= p.tol AND abs(p.b - q.b) <= p.tol) AS two, count(*) FILTER (abs(p.a - q.a) <= p.tol AND abs(p.b - q.b) <= p.tol AND abs(p.c - q.c) <= p.tol) AS three
FROM p JOIN p q ON p.id = q.id AND p.ch = q.ch AND p.e = q.e AND p.s = q.s AND p.k < q.k WHERE p.c IS NOT NULL AND q.c IS NOT NULL GROUP BY ALL)
SELECT id, ch, CAST(s AS INTEGER) AS "SCALE", avg(CASE WHEN two > 0 AND three > 0 THEN -ln(CAST(three AS DOUBLE) / two) ELSE CAST('nan' AS DOUBLE) END) AS "MSE" FROM h GROUP BY id, ch, s"""

#: a run's identity is its position less the rank among the samples that hit
_RUNS = """, {0} AS (SELECT id, ch, min(k) AS a, max(k) + 1 AS b FROM (SELECT id, ch, k, k - row_number() OVER (PARTITION BY id, ch ORDER BY k) AS g FROM ({1})) GROUP BY id, ch, g)"""


def _summary(found: str, numbers: str) -> str:
    """Count and density of the rows of ``found``, and averages of them, for each channel."""
    return f"""SELECT c.id, c.ch, {numbers} n / 24.0 / 60 AS "MINS", count(f.id) AS "N", count(f.id) / (n / 24.0 / 60) AS "DENS" FROM (SELECT DISTINCT id, ch, n FROM v, lim) c LEFT JOIN ({found}) f ON f.id = c.id AND f.ch = c.ch GROUP BY c.id, c.ch, n"""


ORACLE["cmd_desat"] = (
    """, b AS (SELECT id, ch, k, x, max(x) OVER (PARTITION BY id, ch ORDER BY k ROWS BETWEEN 2880 PRECEDING AND CURRENT ROW) AS top, lag(x) OVER (PARTITION BY id, ch ORDER BY k) AS before FROM v),
g AS (SELECT *, max(CASE WHEN before > x THEN NULL ELSE k END) OVER (PARTITION BY id, ch ORDER BY k) AS fall FROM b)"""
    + _RUNS.format("r", "SELECT id, ch, k FROM b WHERE top - x >= 50")
    + ", ds AS (SELECT r.id, r.ch, g.fall AS a, r.b FROM r JOIN g ON g.id = r.id AND g.ch = r.ch AND g.k = r.a WHERE r.b - g.fall BETWEEN 240 AND 2880) "
    + _summary("SELECT ds.id, ds.ch, min(b.x) AS nadir, arg_min(b.top, b.k) AS base FROM ds JOIN b ON b.id = ds.id AND b.ch = ds.ch AND b.k >= ds.a AND b.k < ds.b GROUP BY ds.id, ds.ch, ds.a, ds.b", 'avg(nadir) AS "NADIR", avg(base) AS "BASELINE", avg(base - nadir) AS "DROP",')
)

ORACLE["cmd_ripples"] = (
    _filtered("f", "v", 6.0, 11.0, 5.0)
    + _analytic("w", "f")
    + f", env AS ({_rows('w', x=_MAG)}), cut AS (SELECT id, ch, quantile_cont(x, 0.98) AS c FROM env GROUP BY ALL)"
    + _RUNS.format("r", "SELECT env.id, env.ch, k FROM env JOIN cut ON cut.id = env.id AND cut.ch = env.ch WHERE x > c")
    + _summary("SELECT id, ch FROM r WHERE (b - a) / 24.0 * 1000 >= 10", "")
)


ORACLE["cmd_spindles"] = (
    _morlet(4.0, 5.0, "v")
    + f""", p0 AS ({_rows("w", x="list_transform(range(1, n + 1), lambda t: y[t] * y[t] + z[t] * z[t])")}),
p1 AS (SELECT id, ch, k, avg(x) OVER (PARTITION BY id, ch ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM p0),
p AS (SELECT a.id, a.ch, a.k, b.x, avg(b.x) OVER (PARTITION BY a.id, a.ch) AS base FROM p1 a, lim JOIN p1 b ON b.id = a.id AND b.ch = a.ch AND b.k = least(greatest(a.k, 1), n - 2))"""
    + _RUNS.format("core", "SELECT id, ch, k FROM p WHERE x > 4.5 * base")
    + _RUNS.format("wide", "SELECT id, ch, k FROM p WHERE x > 2 * base")
    + """, kept AS (SELECT w.id, w.ch, w.a, w.b FROM wide w SEMI JOIN (SELECT * FROM core WHERE b - a >= 2.4) c ON c.id = w.id AND c.ch = w.ch AND c.a >= w.a AND c.b <= w.b),
one AS (SELECT id, ch, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY id, ch ORDER BY a) AS g FROM (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY id, ch ORDER BY a) <= 12 THEN 0 ELSE 1 END AS fresh FROM kept)) GROUP BY id, ch, g)"""
    + _filtered("f", "v", 2.0, 6.0)
    + f""", band AS (SELECT id, ch, k, CASE WHEN abs(x) < 1e-9 * max(abs(x)) OVER (PARTITION BY id, ch) THEN 0.0 ELSE x END AS x FROM ({_rows("f")})),
turn AS (SELECT *, (x < 0) != (lag(x) OVER (PARTITION BY id, ch ORDER BY k) < 0) AS t FROM band),
found AS (SELECT o.id, o.ch, a, b, max(t.x) - min(t.x) AS amp, count(*) FILTER (t.t AND t.k > a) / 2.0 AS nosc, arg_max(t.k, (abs(t.x), -t.k)) AS top, sum(p.x / p.base) / 24.0 AS isa
FROM one o JOIN turn t ON t.id = o.id AND t.ch = o.ch AND t.k >= a AND t.k < b JOIN p ON p.id = t.id AND p.ch = t.ch AND p.k = t.k WHERE b - a BETWEEN 4.8 AND 72 GROUP BY ALL) """
    + _summary("SELECT * FROM found", 'avg((b - a) / 24.0) AS "DUR", avg(amp) AS "AMP", avg(nosc / ((b - a) / 24.0)) AS "FRQ", avg(top / 24.0) AS "PEAK", avg(isa) AS "ISA",')
)


ORACLE["cmd_z_peaks"] = (
    """, tr AS (SELECT id, ch, list(x ORDER BY k) AS x, 1e-9 * max(abs(x)) AS least FROM v GROUP BY ALL),
scan AS (WITH RECURSIVE r AS (SELECT id, ch, 47 AS k, x[1:48] AS win, 0 AS hit FROM tr
UNION ALL SELECT id, ch, k, list_append(win[2:], CASE WHEN hit = 0 THEN xi ELSE 0.01 * xi + 0.99 * win[48] END), hit FROM
(SELECT id, ch, k, win, xi, CASE WHEN abs(xi - m) > 3 * sqrt(greatest(m2 - m * m, 0)) + least THEN CASE WHEN xi > m THEN 1 ELSE -1 END ELSE 0 END AS hit FROM
(SELECT r.id, r.ch, r.k + 1 AS k, win, least, tr.x[r.k + 2] AS xi, list_avg(win) AS m, list_avg(list_transform(win, lambda u: u * u)) AS m2 FROM r JOIN tr ON tr.id = r.id AND tr.ch = r.ch WHERE r.k + 1 < len(tr.x)))) SELECT id, ch, k FROM r WHERE hit = 1)"""
    + _RUNS.format("z", "SELECT id, ch, k FROM scan")
    + ' SELECT id, ch, a / 24.0 AS "start", b / 24.0 AS "stop" FROM z'
)

_turns = "".join(_morlet(float(f), 7.0, "v").replace("m0 AS", f"m0{f} AS").replace("m1 AS", f"m1{f} AS").replace("FROM m0", f"FROM m0{f}").replace("), m1)", f"), m1{f})").replace("w AS (", f"w{f} AS (") for f in range(2, 7))
_all = " UNION ALL ".join(f"SELECT id, ch, {f}.0 AS f, unnest(range(0, n)) AS k, unnest(list_transform(range(1, n + 1), lambda t: atan2(z[t], y[t]))) AS a FROM w{f}" for f in range(2, 7))
ORACLE["cmd_sync"] = f"""{_turns}, ph AS ({_all}), o AS (SELECT id, f, k, sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)) AS o FROM ph GROUP BY ALL)
SELECT id, CAST(f AS DOUBLE) AS "F", avg(o) AS "KOP" FROM o GROUP BY id, f"""

# cosine transform of the mirrored trace, cut at the new rate and turned back
ORACLE["cmd_resample_stats"] = """, tr AS (SELECT id, ch, list(x ORDER BY k) AS x FROM v GROUP BY ALL),
ct AS (SELECT q, list(2 * cos(pi() * q * (2 * i + 1) / (2 * n)) ORDER BY i) AS c FROM (SELECT n, q, unnest(range(0, n)) AS i FROM (SELECT n, unnest(range(0, n // 2 + 1)) AS q FROM lim)) GROUP BY q),
co AS (SELECT id, ch, list(list_dot_product(x, c) ORDER BY q) AS c FROM tr, ct GROUP BY id, ch),
back AS (SELECT j, list(CASE WHEN q = 0 THEN 1.0 WHEN q = n // 2 THEN cos(pi() * q / (2 * n)) * CASE j % 2 WHEN 0 THEN 1 ELSE -1 END ELSE 2 * cos(pi() * q / (2 * n) + 2 * pi() * q * j / n) END / (2 * n) ORDER BY q) AS b
FROM (SELECT n, j, unnest(range(0, n // 2 + 1)) AS q FROM (SELECT n, unnest(range(0, n // 2)) AS j FROM lim)) GROUP BY j)""" + _STATS.format("SELECT id, ch, j AS k, list_dot_product(c, b) AS x FROM co, back")


ORACLE["cmd_lzw"] = """, ep AS (SELECT id, ch, k // 120 + 1 AS e, count(*) AS n, list(CASE WHEN x > m THEN '1' ELSE '0' END ORDER BY k) AS b FROM (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY id, ch, k // 120) AS m FROM v) GROUP BY ALL),
fin AS (WITH RECURSIVE r AS (SELECT id, ch, e, 0 AS i, CAST([] AS VARCHAR[]) AS seen, '' AS phrase FROM ep
UNION ALL SELECT id, ch, e, i, CASE WHEN list_contains(seen, p) THEN seen ELSE list_append(seen, p) END, CASE WHEN list_contains(seen, p) THEN p ELSE '' END FROM
(SELECT r.id, r.ch, r.e, r.i + 1 AS i, seen, phrase || b[r.i + 1] AS p FROM r JOIN ep ON ep.id = r.id AND ep.ch = r.ch AND ep.e = r.e WHERE r.i < ep.n)) SELECT * FROM r)
SELECT fin.id, fin.ch, fin.e, (len(seen) + CASE WHEN phrase != '' THEN 1 ELSE 0 END) * log2(n) / n AS "LZW" FROM fin JOIN ep ON ep.id = fin.id AND ep.ch = fin.ch AND ep.e = fin.e AND fin.i = ep.n WHERE n = 120"""

# the spectrum from 3 to 9 Hz; bins within 1 Hz of 6 take the others' mean magnitude
ORACLE["cmd_line_denoise_stats"] = """, tr AS (SELECT id, ch, list(x ORDER BY k) AS x FROM v GROUP BY ALL),
fq AS (SELECT q, abs(q * (CAST(1 AS DOUBLE) / (n / CAST(24 AS DOUBLE))) - 6) AS off FROM (SELECT n, unnest(range(1, n // 2)) AS q FROM lim)),
wave AS (SELECT q, off <= 1 AS inside, list(cos(2 * pi() * q * i / n) ORDER BY i) AS c, list(sin(2 * pi() * q * i / n) ORDER BY i) AS s FROM fq, (SELECT n, unnest(range(0, n)) AS i FROM lim) WHERE off <= 3 GROUP BY ALL),
sp AS (SELECT id, ch, q, inside, list_dot_product(x, c) AS re, -list_dot_product(x, s) AS im FROM tr, wave),
ring AS (SELECT id, ch, avg(sqrt(re * re + im * im)) AS m FROM sp WHERE NOT inside GROUP BY ALL),
dl AS (SELECT sp.id, sp.ch, list(re * g ORDER BY q) AS dr, list(im * g ORDER BY q) AS di FROM (SELECT sp.*, CASE WHEN re = 0 AND im = 0 THEN 0.0 ELSE m / sqrt(re * re + im * im) - 1 END AS g FROM sp JOIN ring ON ring.id = sp.id AND ring.ch = sp.ch WHERE inside) sp GROUP BY ALL),
col AS (SELECT i, list(cos(2 * pi() * q * i / n) ORDER BY q) AS c, list(sin(2 * pi() * q * i / n) ORDER BY q) AS s FROM fq, (SELECT n, unnest(range(0, n)) AS i FROM lim) WHERE off <= 1 GROUP BY i)""" + _STATS.format("SELECT tr.id, tr.ch, i AS k, x[i + 1] + 2.0 / len(x) * (list_dot_product(dr, c) - list_dot_product(di, s)) AS x FROM tr JOIN dl ON dl.id = tr.id AND dl.ch = tr.ch, col")


def _cycles(rows: str, up: bool) -> str:
    """``seg``(id, ch, a, b): stretches from one upward (or downward) zero crossing to the next; ``y``: the samples."""
    cross = "before <= 0 AND x > 0" if up else "before > 0 AND x <= 0"
    return f""", y AS (SELECT *, lag(x) OVER (PARTITION BY id, ch ORDER BY k) AS before FROM ({rows})),
seg AS (SELECT id, ch, k AS a, lead(k) OVER (PARTITION BY id, ch ORDER BY k) AS b FROM y WHERE {cross}),
part AS (SELECT seg.id, seg.ch, a, b, min(x) AS lo, max(x) AS hi, arg_min(k, (x, k)) AS at_lo, arg_max(k, (x, -k)) AS at_hi FROM seg JOIN y ON y.id = seg.id AND y.ch = seg.ch AND y.k >= a AND y.k < b GROUP BY ALL)"""


ORACLE["cmd_so"] = (
    _filtered("f", "v", 0.5, 4.0, 0.5)
    + _cycles(f"SELECT id, ch, k, CASE WHEN abs(x) < 1e-9 * max(abs(x)) OVER (PARTITION BY id, ch) THEN 0.0 ELSE x END AS x FROM ({_rows('f')})", False)
    + ", fit AS (SELECT *, avg(lo) OVER (PARTITION BY id, ch) AS neg, avg(hi - lo) OVER (PARTITION BY id, ch) AS p2p FROM part WHERE b - a BETWEEN 12 AND 48) "
    + _summary("SELECT * FROM fit WHERE lo <= 1.5 * neg AND hi - lo >= 1.5 * p2p", 'avg(lo) AS "NEG", avg(hi - lo) AS "P2P", avg(at_lo / 24.0) AS "NEG_AT", avg(at_hi / 24.0) AS "POS_AT",')
)

ORACLE["cmd_respbreath"] = (
    ", c AS (SELECT id, ch, k, x - avg(x) OVER (PARTITION BY id, ch) AS x FROM v)"
    + _filtered("f", "c", 0.05, 1.0, 0.1)
    + _cycles(_rows("f"), True)
    + _summary("SELECT * FROM part WHERE b - a BETWEEN 24 AND 288", 'avg(at_hi / 24.0) AS "PEAK", avg((at_hi - a) / 24.0) AS "TINSP", avg((b - at_hi) / 24.0) AS "TEXP", avg((b - a) / 24.0) AS "TTOT", avg(hi - lo) AS "AMP",')
)

ORACLE["cmd_actig"] = """, m AS (SELECT *, avg(x) OVER (PARTITION BY id, ch) AS m, x - lag(x) OVER (PARTITION BY id, ch ORDER BY k) AS d FROM v), var AS (SELECT id, ch, any_value(m) AS m, avg(pow(x - m, 2)) AS var, avg(d * d) AS iv FROM m GROUP BY ALL),
prof AS (SELECT id, ch, k % 24 AS h, avg(x) AS p FROM v GROUP BY ALL), ring AS (SELECT * FROM prof UNION ALL SELECT id, ch, h + 24, p FROM prof),
win AS (SELECT id, ch, h, avg(p) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l5, avg(p) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m10 FROM ring WINDOW w AS (PARTITION BY id, ch ORDER BY h)),
best AS (SELECT id, ch, min(l5) AS l5, max(m10) AS m10, arg_min(h, (round(l5, 9), h)) AS at5, arg_max(h, (round(m10, 9), -h)) AS at10 FROM win WHERE h < 24 GROUP BY ALL),
even AS (SELECT id, ch, k, avg(x) OVER (PARTITION BY id, ch ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM v), edge AS (SELECT e.id, e.ch, e.k, i.s FROM even e, lim JOIN even i ON i.id = e.id AND i.ch = e.ch AND i.k = least(greatest(e.k, 2), n - 3)),
low AS (SELECT edge.id, edge.ch, count(*) FILTER (s < 0.4 * m) AS low, count(*) AS n FROM edge JOIN var ON var.id = edge.id AND var.ch = edge.ch GROUP BY ALL),
sq AS (SELECT prof.id, prof.ch, avg(pow(p - m, 2)) AS q FROM prof JOIN var ON var.id = prof.id AND var.ch = prof.ch GROUP BY ALL)
SELECT id, ch, CASE WHEN var > 0 THEN q / var ELSE 0.0 END AS "NP_IS", CASE WHEN var > 0 THEN iv / var ELSE 0.0 END AS "NP_IV", l5 AS "NP_L5", m10 AS "NP_M10", CASE WHEN m10 + l5 != 0 THEN (m10 - l5) / (m10 + l5) ELSE 0.0 END AS "NP_RA",
CAST(at5 * 60 AS DOUBLE) AS "NP_L5_ONSET_MIN", CAST(at10 * 60 AS DOUBLE) AS "NP_M10_ONSET_MIN", CAST(low * 60 AS DOUBLE) AS "SCORE_TST", CAST((n - low) * 60 AS DOUBLE) AS "SCORE_TWT" FROM best JOIN var USING (id, ch) JOIN low USING (id, ch) JOIN sq USING (id, ch)"""


def _rounded(name: str, keys: list[str], names: list[str], start: str) -> None:
    """Numbers to nine places: below that a filtered silence is rounding noise. ``start``: how the last SELECT begins."""
    base = scripted.QUERIES[name]

    def run(spark, d: str):
        return base(spark, d).select(*keys, *((F.round(n, 9) + F.lit(0.0)).alias(n) for n in names))

    run.__name__, run.__doc__ = name, f"{base.__doc__}, to nine places"
    QUERIES[name] = run
    cols = ", ".join(f'round("{n}", 9) + 0.0 AS "{n}"' for n in names)
    at = ORACLE[name].rindex(start)
    ORACLE[name] = f"{ORACLE[name][:at]} SELECT {', '.join(keys)}, {cols} FROM ({ORACLE[name][at:]})"


for _name in ("cmd_filter_stats", "cmd_bands_stats", "cmd_hilbert_stats", "cmd_cwt_stats", "cmd_resample_stats", "cmd_line_denoise_stats"):
    _rounded(_name, ["id", "ch", "N"], [n for n in re.findall(r'AS "(\w+)"', _STATS) if n != "N"], _STATS[:30])
_rounded("cmd_ipc", ["id", "ch1", "ch2", "N_TOT"], ["PLV", "WIPC", "PHASE", "IPC"], "SELECT id, ch1")
_rounded("cmd_tsync", ["id", "ch1", "ch2"], ["D", "XCORR", "PHL", "PHASE"], "SELECT id, ch1, ch2, best.d")
ORACLE = {k: _TRACE + v for k, v in ORACLE.items()}


def _wrapped(name: str, keys: list[str], names: list[str]) -> None:
    """As ``_rounded``, for a query of ``proven``."""
    base = proven.QUERIES.get(name) or scripted.QUERIES[name]

    def run(spark, d: str):
        return base(spark, d).select(*keys, *((F.round(n, 9) + F.lit(0.0)).alias(n) for n in names))

    run.__name__, run.__doc__ = name, f"{base.__doc__}, to nine places"
    QUERIES[name] = run
    cols = ", ".join(f'round("{n}", 9) + 0.0 AS "{n}"' for n in names)
    ORACLE[name] = f"SELECT {', '.join(keys)}, {cols} FROM ({proven.ORACLE[name]})"


_wrapped("cmd_coh", ["id", "ch1", "ch2", "B"], ["COH", "ICOH", "LCOH"])
_wrapped("cmd_rolling_norm_stats", ["id", "ch", "N"], [n for n in re.findall(r'AS "(\w+)"', _STATS) if n != "N"])
