"""Windowed views of a session for display: traces, envelopes, tracks, events in lanes, edits of annotations.

A viewer covers all recordings of its session; every getter is a DataFrame over
them. Queued edits are what a user types, so the queue is a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypnoframe.functions import dsp
from hypnoframe.plans.session import NS, Session

#: what names an event
EVENT = ["id", "class", "inst", "ch", "start_ns", "stop_ns"]


@dataclass
class Edit:
    """A change of one event; fields left None keep what is there. A new start alone shifts the event."""

    id: str
    aclass: str
    start_ns: int
    stop_ns: int
    inst: str | None = None
    ch: str = "."
    delete: bool = False
    new_start: int | None = None
    new_stop: int | None = None
    new_ch: str | None = None
    new_inst: str | None = None
    clear_meta: bool = False
    meta: dict[str, str] | None = None

    def row(self) -> tuple:
        inst = self.aclass if self.inst is None else self.inst
        return (self.id, self.aclass, inst, self.ch, self.start_ns, self.stop_ns, self.delete, self.new_start, self.new_stop, self.new_ch, self.new_inst, self.clear_meta, self.meta or {})


def apply_edits(annots: DataFrame, edits: DataFrame) -> DataFrame:
    """``annots`` with ``edits`` (columns of ``Edit.row``) made.

    Of several edits of one event the last named in ``seq`` wins field by field. An
    event that is moved onto another takes its place.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    one = edits.groupBy(*EVENT).agg(F.max("drop").alias("drop"), last("new_start"), last("new_stop"), last("new_ch"), last("new_inst"), F.max("clear").alias("clear"), F.max_by("set", "seq").alias("set"))
    j = annots.join(one, EVENT, "left")
    kept = j.where("drop is null").select(*annots.columns)
    moved = j.where("drop = false").select(
        "id",
        "class",
        F.coalesce("new_inst", "inst").alias("inst"),
        F.coalesce("new_ch", "ch").alias("ch"),
        F.coalesce("new_start", "start_ns").alias("start_ns"),
        F.coalesce(F.col("new_stop"), F.col("new_start") + F.col("stop_ns") - F.col("start_ns"), F.col("stop_ns")).alias("stop_ns"),
        F.map_concat(F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: ~F.col("clear") & ~F.map_contains_key("set", k)), "set").alias("meta"),
        *(c for c in annots.columns if c not in (*EVENT, "meta")),
    )
    moved = moved.dropDuplicates(EVENT)
    return kept.join(moved.select(*EVENT), EVENT, "left_anti").select(*annots.columns).unionByName(moved.select(*annots.columns))


def lanes(events: DataFrame) -> DataFrame:
    """``events`` (id, start_ns, stop_ns, ...) with the lowest ``lane`` free at their start, lanes by start, then stop.

    A recording's events of a window are one group.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p, ends, out = p.sort_values(["start_ns", "stop_ns", "class", "ch"], kind="stable"), [], []
        for a, b in p[["start_ns", "stop_ns"]].itertuples(index=False):
            k = next((i for i, e in enumerate(ends) if e <= a), len(ends))
            ends[k : k + 1] = [max(b, a + 1)]
            out.append(k)
        return p.assign(lane=np.array(out, "int32"))

    d = events.select("id", "class", "inst", "ch", "start_ns", "stop_ns")
    return d.groupBy("id").applyInPandas(run, "id string, class string, inst string, ch string, start_ns long, stop_ns long, lane int")


class Viewer:
    """A window [a, b) in seconds over a session's channels and annotation classes."""

    def __init__(self, session: Session, sig: str = "*", classes: list[str] | None = None, throttle: float | None = None, most: int | None = None):
        """``throttle``: the most samples a second kept of a channel; ``most``: the most shown of a channel in a window."""
        self.session, self.classes, self.most = session, classes, most
        d = session.chosen(sig)
        self.samples = self._mapped(d, lambda ch, x, sr: thinned(x, sr, int(sr // throttle)) if throttle and sr > throttle else (x, sr)) if throttle else d
        self.a = self.b = 0.0
        self.threshold_s, self.filters, self.limits, self.queue = 3600.0, {}, {}, []

    @staticmethod
    def _mapped(d: DataFrame, f) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                rows = []
                for i, ch, sr, unit, v in p.itertuples(index=False):
                    y, to = f(ch, np.asarray(v, float), sr)
                    rows.append((i, ch, float(to), unit, y))
                yield pd.DataFrame(rows, columns=["id", "ch", "sr", "unit", "v"])

        return d.select("id", "ch", "sr", "unit", "v").mapInPandas(run, "id string, ch string, sr double, unit string, v array<double>")

    # -- window

    def total_sec(self) -> float:
        """Length of the longest recording."""
        return (self.session.recordings.agg(F.max("dur_ns")).first()[0] or 0) / NS

    def set_window(self, a: float, b: float) -> bool:
        """False, and the window stays, if [a, b) is empty or starts after the end."""
        total = self.total_sec()
        if not 0 <= a < b or a >= total:
            return False
        self.a, self.b = a, min(b, total)
        return True

    def clock(self) -> DataFrame:
        """(id, left, right): clock times of the window's ends."""
        at = lambda s: F.date_format(F.timestamp_seconds(F.unix_timestamp("start") + F.floor(F.lit(float(s))).cast("long")), "HH:mm:ss")
        return self.session.recordings.select("id", at(self.a).alias("left"), at(self.b).alias("right"))

    def time_scale(self) -> DataFrame:
        """(id, start, stop): contiguous stretches in seconds."""
        s = self.session.segments
        if s is None:
            return self.session.recordings.select("id", F.lit(0.0).alias("start"), (F.col("dur_ns") / NS).alias("stop"))
        return s.select("id", (F.col("start_ns") / NS).alias("start"), (F.col("stop_ns") / NS).alias("stop"))

    def summarised(self) -> bool:
        """Whether the window is longer than the threshold, so that envelopes fit better than samples."""
        return self.b - self.a > self.threshold_s

    # -- traces

    def apply_filter(self, ch: str, sections: list[float]) -> None:
        """Second-order sections b0, b1, b2, a0, a1, a2, one after another, for a channel's views."""
        self.filters[ch] = sections

    def clear_filter(self, ch: str | None = None) -> None:
        self.filters = {k: v for k, v in self.filters.items() if ch is not None and k != ch}

    def fix_scale(self, ch: str, lo: float, hi: float) -> None:
        self.limits[ch] = (lo, hi)

    def free_scale(self, ch: str) -> None:
        self.limits.pop(ch, None)

    def _window(self) -> DataFrame:
        """(id, ch, sr, q, x): the window's samples as an array, every q-th if there are more than ``most``."""
        filters = dict(self.filters)
        hit = F.col("ch").isin(list(filters))
        plain = ["id", "ch", "sr", "unit", "v"]
        d = self.samples.select(*plain) if not filters else self.samples.where(~hit).select(*plain).unionByName(self._mapped(self.samples.where(hit), lambda ch, x, sr: (sections(x, filters[ch]), sr)))
        lo, hi = F.ceil(F.col("sr") * self.a - 1e-9), F.ceil(F.col("sr") * self.b - 1e-9)
        d = d.select("id", "ch", "sr", lo.alias("lo"), F.slice("v", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
        q = F.greatest(F.lit(1), F.ceil(F.size("x") / self.most)).cast("int") if self.most else F.lit(1)
        return d.withColumn("q", q).withColumn("x", F.filter("x", lambda _, k: k % F.col("q") == 0))

    def signal(self, ch: str = "*") -> DataFrame:
        """(id, ch, t, x) of the window, in seconds."""
        d = self._window() if ch == "*" else self._window().where(F.col("ch") == ch)
        return d.select("id", "ch", "sr", "lo", "q", F.posexplode("x").alias("k", "x")).select("id", "ch", ((F.col("lo") + F.col("k") * F.col("q")) / F.col("sr")).alias("t"), "x")

    def envelope(self, buckets: int) -> DataFrame:
        """(id, ch, bucket, lo, hi) of equal parts of the window."""
        d = self._window().select("id", "ch", F.size("x").alias("n"), F.posexplode("x").alias("k", "x"))
        return d.groupBy("id", "ch", F.floor(F.col("k") * buckets / F.col("n")).alias("bucket")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))

    def scaled(self, slots: list[str], overlap: float = 0.0) -> DataFrame:
        """(id, ch, t, y): traces in [0, 1], a band for each of ``slots`` from the top down.

        A channel's limits are those fixed, else its 5th and 95th percentiles in the
        window; what is outside is clipped. Neighbouring bands share ``overlap`` of a band.
        """
        n = len(slots)
        order = F.array_position(F.array(*map(F.lit, slots)), F.col("ch"))
        d = self._window().where(F.col("ch").isin(slots)).withColumn("s", F.array_sort("x"))
        at = lambda p: F.element_at("s", (F.floor((F.size("s") - 1) * p) + 1).cast("int"))
        fixed = lambda k: F.coalesce(*(F.when(F.col("ch") == c, F.lit(float(v[k]))) for c, v in self.limits.items()), F.lit(None).cast("double"))
        d = d.where(F.size("s") > 0).select("id", "ch", "sr", "lo", "q", order.alias("slot"), F.coalesce(fixed(0), at(0.05)).alias("bottom"), F.coalesce(fixed(1), at(0.95)).alias("top"), F.posexplode("x").alias("k", "x"))
        unit = F.when(F.col("top") > F.col("bottom"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x") - F.col("bottom")) / (F.col("top") - F.col("bottom"))))).otherwise(0.5)
        height = min(1.0, (1 + overlap) / n)
        base = F.lit(0.0) if n == 1 else (n - F.col("slot")) * ((1 - height) / (n - 1))
        return d.select("id", "ch", ((F.col("lo") + F.col("k") * F.col("q")) / F.col("sr")).alias("t"), (base + unit * height).alias("y"))

    # -- tracks over all epochs

    def _track(self, f, names: list[str], len_s: float) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for i, ch, sr, v in p[["id", "ch", "sr", "v"]].itertuples(index=False):
                    x, n = np.asarray(v, float), round(len_s * sr)
                    rows = [(i, ch, e + 1, *f(x[e * n : (e + 1) * n], sr)) for e in range(len(x) // n if n else 0)]
                    yield pd.DataFrame(rows, columns=["id", "ch", "e", *names])

        d = self.samples.mapInPandas(run, f"id string, ch string, e long, {', '.join(f'{k} double' for k in names)}")
        w = Window.partitionBy("id", "ch")
        z = lambda k: F.when(F.stddev(k).over(w) > 0, F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col(k) - F.avg(k).over(w)) / F.stddev(k).over(w)))).otherwise(0.0)
        return d.select("id", "ch", "e", *(z(k).alias(k) for k in names))

    def bands(self, len_s: float = 30.0) -> DataFrame:
        """Log band powers of each epoch, standardised in the channel and held within 3 SDs."""
        names = ["SLOW", "DELTA", "THETA", "ALPHA", "SIGMA", "BETA"]

        def powers(x: np.ndarray, sr: float) -> list[float]:
            f, p = dsp.welch(x, sr)
            return [float(np.log(dsp.band_power(f, p, *dsp.BANDS[b]) + 1e-12)) for b in names]

        return self._track(powers, names, len_s)

    def hjorths(self, len_s: float = 30.0) -> DataFrame:
        """Hjorth numbers (the first as a logarithm) of each epoch, standardised likewise."""

        def numbers(x: np.ndarray, sr: float) -> tuple:
            a, m, c = dsp.hjorth(x)
            return float(np.log(a + 1e-12)), float(m), float(c)

        return self._track(numbers, ["H1", "H2", "H3"], len_s)

    # -- annotations

    def events(self, classes: list[str] | None = None) -> DataFrame:
        """Events that the window meets, whole, with their lanes; points count where they are."""
        a = self.session.of_class(classes or self.classes or ["*"])
        lo, hi = round(self.a * NS), round(self.b * NS)
        return lanes(a.where((F.col("start_ns") < hi) & ((F.col("stop_ns") > lo) | ((F.col("start_ns") == F.col("stop_ns")) & (F.col("start_ns") >= lo)))))

    def queue_edit(self, edit: Edit) -> None:
        self.queue.append(edit)

    def clear_edits(self) -> None:
        self.queue = []

    def apply_annot_edits(self, classes: list[str] | None = None) -> int:
        """Makes the queued edits (of ``classes``; others stay queued) and returns how many found their event."""
        now = [e for e in self.queue if not classes or e.aclass in classes]
        self.queue = [e for e in self.queue if classes and e.aclass not in classes]
        if not now:
            return 0
        schema = "id string, class string, inst string, ch string, start_ns long, stop_ns long, drop boolean, new_start long, new_stop long, new_ch string, new_inst string, clear boolean, set map<string,string>, seq long"
        edits = self.session.spark.createDataFrame([(*e.row(), k) for k, e in enumerate(now)], schema)
        found = edits.join(self.session.annots.select(*EVENT), EVENT, "left_semi").count()
        self.session = replace(self.session, annots=apply_edits(self.session.annots, edits))
        return found


def thinned(x: np.ndarray, sr: float, q: int) -> tuple[np.ndarray, float]:
    """Every q-th sample after a second-order low-pass run backwards and forwards at the new Nyquist rate."""
    if q < 2 or not len(x):
        return x, sr
    low = dsp.recursive(sr, "lowpass", [sr / q / 2], 2)
    back = dsp.one_pass(x[::-1], *low)[::-1]
    return dsp.one_pass(back, *low)[::q], sr / q


def sections(x: np.ndarray, sos: list[float]) -> np.ndarray:
    """x through second-order sections b0, b1, b2, a0, a1, a2, from rest; one with poles outside the circle is refused."""
    for k in range(0, len(sos), 6):
        b, a = sos[k : k + 3], sos[k + 3 : k + 6]
        poles = np.roots(a)
        if np.abs(poles).max(initial=0) >= 1:
            raise ValueError("unstable filter section")
        at = lambda f, b=b, a=a: np.polyval(b, np.exp(2j * np.pi * f)) / np.polyval(a, np.exp(2j * np.pi * f))
        x = dsp.ringing(x, poles, at)
    return x
