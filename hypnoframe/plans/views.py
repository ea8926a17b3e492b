"""Registered queries of the windowed viewer, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hypnoframe.plans.proven import _hj
from hypnoframe.plans.scripted import _TRACE, session
from hypnoframe.plans.session import NS
from hypnoframe.plans.viewer import EVENT, Viewer, apply_edits

QUERIES: dict = {}
ORACLE: dict = {}


def _view(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, _TRACE + sql
        return f

    return add


@_view("SELECT id, ch, k / 24.0 AS t, x FROM v WHERE k >= 48 AND k < 216")
def view_trace(spark, d):
    """Samples of a window of seven seconds, unfiltered."""
    v = Viewer(session(spark, d))
    v.set_window(2, 9)
    return v.signal()


@_view("SELECT id, ch, (k - 48) // 14 AS bucket, min(x) AS lo, max(x) AS hi FROM v WHERE k >= 48 AND k < 216 GROUP BY ALL")
def view_envelope(spark, d):
    """Limits of twelve parts of the window."""
    v = Viewer(session(spark, d))
    v.set_window(2, 9)
    return v.envelope(12)


@_view(""", w AS (SELECT id, ch, k, x FROM v WHERE k >= 48 AND k < 216 AND ch IN ('error', 'view')), q AS (SELECT id, ch, list_sort(list(x)) AS s FROM w GROUP BY ALL),
l AS (SELECT id, ch, CASE ch WHEN 'view' THEN 10.0 ELSE s[9] END AS bottom, CASE ch WHEN 'view' THEN 90.0 ELSE s[159] END AS top FROM q)
SELECT id, ch, k / 24.0 AS t, CASE ch WHEN 'error' THEN 0.5 ELSE 0.0 END + 0.5 * CASE WHEN top > bottom THEN least(1.0, greatest(0.0, (x - bottom) / (top - bottom))) ELSE 0.5 END AS y FROM w JOIN l USING (id, ch)""")
def view_scaled(spark, d):
    """Two channels in bands of the unit interval: one between its percentiles, one between fixed limits."""
    v = Viewer(session(spark, d))
    v.set_window(2, 9)
    v.fix_scale("view", 10, 90)
    return v.scaled(["error", "view"])


_Z = """CASE WHEN stddev_samp({0}) OVER w > 0 THEN greatest(-3.0, least(3.0, ({0} - avg({0}) OVER w) / stddev_samp({0}) OVER w)) ELSE 0.0 END AS "{1}" """


@_view(f""", h AS (SELECT id, ch, e, ln(h1 + 1e-12) AS h1, h2, h3 FROM ({_hj.format(120)}))
SELECT id, ch, e, {", ".join(_Z.format(f"h{k}", f"H{k}") for k in (1, 2, 3))} FROM h WINDOW w AS (PARTITION BY id, ch)""")
def view_hjorths(spark, d):
    """Hjorth tracks over epochs of five seconds."""
    return Viewer(session(spark, d)).hjorths(5)


@_view(""" SELECT id, class, ch, start_ns, stop_ns, count(*) AS n FROM (SELECT id, class, '.' AS ch, start_ns, stop_ns FROM a WHERE class NOT IN ('error', 'click', 'view')
UNION ALL SELECT DISTINCT id, class, '.', start_ns + 1000000000, stop_ns + 1000000000 FROM a WHERE class = 'click' UNION ALL SELECT DISTINCT id, class, 'F4', start_ns, stop_ns FROM a WHERE class = 'view') y GROUP BY ALL""")
def view_edits(spark, d):
    """Edits of whole classes: one deleted, one shifted by a second, one put on another channel."""
    a = session(spark, d).annots
    to = lambda cls, value, kind: F.when(F.col("class") == cls, value).cast(kind)
    none = F.create_map().cast("map<string,string>")
    edits = a.where(F.col("class").isin("error", "click", "view")).select(*EVENT, (F.col("class") == "error").alias("drop"), to("click", F.col("start_ns") + NS, "long").alias("new_start"), F.lit(None).cast("long").alias("new_stop"), to("view", F.lit("F4"), "string").alias("new_ch"), F.lit(None).cast("string").alias("new_inst"), F.lit(False).alias("clear"), none.alias("set"), F.lit(0).cast("long").alias("seq"))
    return apply_edits(a, edits).groupBy("id", "class", "ch", "start_ns", "stop_ns").agg(F.count("*").alias("n"))
