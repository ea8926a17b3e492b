"""The windowed viewer: traces, scaling, tracks, events and edits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnoframe.functions import dsp
from hypnoframe.plans.session import NS, Session
from hypnoframe.plans.viewer import Edit, Viewer, sections, thinned


def make(spark, dur=300, marks=((10.0, 11.0), (20.0, 22.0))):
    return Session.create(spark, {"T1": {"EEG": (256.0, dsp.sine(256, dur, 10.0)), "B": (64.0, np.arange(64.0 * dur))}}, [("T1", "Sp", a, b) for a, b in marks])


def rows(v, cls="Sp"):
    return sorted((r["start_ns"] // NS, r["stop_ns"] // NS, r["ch"], r["inst"], r["meta"]) for r in v.session.annots.where(F.col("class") == cls).collect())


def test_window_and_traces(spark):
    v = Viewer(make(spark), most=2000)
    assert v.total_sec() == 300 and v.set_window(0, 30) and not v.set_window(99999, 100000) and not v.set_window(5, 5)
    assert (v.a, v.b) == (0, 30)
    n = {r["ch"]: r["count"] for r in v.signal().groupBy("ch").count().collect()}
    assert n == {"EEG": 7680 // 4, "B": 1920}
    t = [r["t"] for r in v.signal("B").orderBy("t").collect()]
    assert t == [k / 64 for k in range(1920)]
    assert v.clock().collect()[0]["left"] == "22:00:00" and v.clock().collect()[0]["right"] == "22:00:30"
    assert [tuple(r) for r in v.time_scale().collect()] == [("T1", 0.0, 300.0)]
    env = v.envelope(10).where("ch = 'B'").orderBy("bucket").collect()
    assert [(r["lo"], r["hi"]) for r in env] == [(192.0 * k, 192.0 * k + 191) for k in range(10)]
    v.threshold_s = 60
    assert not v.summarised() and v.set_window(0, 300) and v.summarised()


def test_scaled_bands_do_not_leave_their_slots(spark):
    v = Viewer(make(spark))
    v.set_window(0, 4)
    v.fix_scale("B", 0.0, 255.0)
    y = {ch: [r["y"] for r in v.scaled(["EEG", "B"]).where(F.col("ch") == ch).orderBy("t").collect()] for ch in ("EEG", "B")}
    assert 0.5 <= min(y["EEG"]) and max(y["EEG"]) <= 1.0
    assert np.allclose(y["B"], np.arange(256) / 255 / 2)
    v.free_scale("B")
    assert 0 <= min(r["y"] for r in v.scaled(["B"]).collect())


def test_filters_and_throttle(spark):
    x = np.random.default_rng(3).normal(size=700)
    sos = [0.2, 0.3, -0.1, 2.0, -1.0, 0.5, 0.0, 1.0, 0.0, 1.0, 0.2, 0.0]
    y = x
    for b, a in ((sos[:3], sos[3:6]), (sos[6:9], sos[9:])):
        out = np.zeros(len(y))
        for n in range(len(y)):
            out[n] = (sum(b[i] * y[n - i] for i in range(3) if n >= i) - sum(a[i] * out[n - i] for i in (1, 2) if n >= i)) / a[0]
        y = out
    assert np.allclose(sections(x, sos), y)
    assert np.allclose(sections(x, [1, 0, 0, 1, 0, 0]), x)
    with pytest.raises(ValueError):
        sections(x, [1, 0, 0, 1, -2, 1.1])
    slow, sr = thinned(dsp.sine(256, 60, 1.0), 256, 5)
    assert sr == 51.2 and len(slow) == (256 * 60 - 1) // 5 + 1 and np.abs(slow[200:-200] - dsp.sine(51.2, 60, 1.0)[: len(slow)][200:-200]).max() < 0.02
    assert np.abs(thinned(dsp.sine(256, 60, 100.0), 256, 5)[0][50:-50]).max() < 0.1
    v = Viewer(make(spark), "EEG", throttle=50)
    v.set_window(0, 30)
    assert v.signal("EEG").count() == (256 * 30 - 1) // 5 + 1
    v.apply_filter("EEG", [0.5, 0, 0, 1, 0, 0])
    half = [r["x"] for r in v.signal("EEG").orderBy("t").collect()]
    v.clear_filter("EEG")
    assert not v.filters and np.allclose(half, [r["x"] / 2 for r in v.signal("EEG").orderBy("t").collect()])


def test_tracks(spark):
    x = np.concatenate([dsp.sine(64, 30, 2.0) + 0.01 * dsp.sine(64, 30, 10.0), dsp.sine(64, 30, 10.0), dsp.sine(64, 30, 10.0)])
    v = Viewer(Session.create(spark, {"T1": {"EEG": (64.0, x), "FLAT": (64.0, np.zeros(64 * 90))}}))
    b = {(r["ch"], r["e"]): r for r in v.bands().collect()}
    assert len(b) == 6 and b["EEG", 1]["DELTA"] > 0 > b["EEG", 2]["DELTA"] and b["EEG", 1]["ALPHA"] < 0 < b["EEG", 3]["ALPHA"]
    assert all(b["FLAT", e]["ALPHA"] == 0 for e in (1, 2, 3))
    h = {(r["ch"], r["e"]): r for r in v.hjorths().collect()}
    assert len(h) == 6 and h["EEG", 1]["H2"] < 0 < h["EEG", 2]["H2"]


def test_events_in_lanes(spark):
    s = make(spark, marks=((0, 10), (5, 15), (10, 12), (12, 13), (90, 95), (20, 20)))
    v = Viewer(s, classes=["Sp"])
    v.set_window(0, 90)
    assert [(r["start_ns"] // NS, r["lane"]) for r in v.events().orderBy("start_ns").collect()] == [(0, 0), (5, 1), (10, 0), (12, 0), (20, 0)]
    assert v.events(["Other"]).count() == 0


def test_edits(spark):
    v = Viewer(make(spark))
    e = lambda **k: Edit("T1", "Sp", 10 * NS, 11 * NS, **k)
    assert v.apply_annot_edits() == 0 and len(rows(v)) == 2
    v.queue_edit(e(delete=True))
    v.clear_edits()
    assert v.apply_annot_edits() == 0 and len(rows(v)) == 2
    v.queue_edit(e(delete=True))
    assert v.apply_annot_edits(["Other"]) == 0 and len(v.queue) == 1 and v.apply_annot_edits() == 1 and not v.queue
    assert [r[:2] for r in rows(v)] == [(20, 22)]

    v = Viewer(make(spark))
    v.queue_edit(e(new_start=50 * NS, new_ch="F4", meta={"a": "1"}))
    v.queue_edit(Edit("T1", "Sp", 1, 2, delete=True))
    assert v.apply_annot_edits() == 1
    assert rows(v) == [(20, 22, ".", "Sp", {}), (50, 51, "F4", "Sp", {"a": "1"})]
    v.queue_edit(Edit("T1", "Sp", 50 * NS, 51 * NS, ch="F4", new_start=12 * NS, new_stop=14 * NS, new_inst="x", clear_meta=True, meta={"b": "2"}))
    v.apply_annot_edits()
    assert rows(v)[0] == (12, 14, "F4", "x", {"b": "2"})


def test_an_event_moved_onto_another_takes_its_place(spark):
    v = Viewer(make(spark))
    v.queue_edit(Edit("T1", "Sp", 10 * NS, 11 * NS, new_start=20 * NS, new_stop=22 * NS, meta={"k": "v"}))
    v.apply_annot_edits()
    assert rows(v) == [(20, 22, ".", "Sp", {"k": "v"})]
    v = Viewer(make(spark))
    for a, b in ((10, 11), (20, 22)):
        v.queue_edit(Edit("T1", "Sp", a * NS, b * NS, delete=True))
    assert v.apply_annot_edits() == 2 and rows(v) == []
