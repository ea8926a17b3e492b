"""Spindle detection and the stateful peak scan against planted events and direct computation."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hypnoframe.functions import dsp
from hypnoframe.plans.session import Session


def bursts(sr=128, dur=120, at=((20, 1.0, 13.5), (60, 1.2, 13.5), (90, 1.0, 11.0)), sd=0.05):
    x = np.random.default_rng(99).normal(0, sd, sr * dur)
    for a, length, f in at:
        k = np.arange(round(length * sr))
        x[a * sr : a * sr + len(k)] += np.sin(2 * np.pi * f * k / sr)
    return x


def test_spindles_by_channel_frequency_and_event(spark):
    s = Session.create(spark, {"T1": {"C": (128.0, bursts()), "N": (128.0, bursts(at=()))}}).eval("SPINDLES sig=C,N fc=11,13.5 annot=sp collate")
    each = {(r["ch"], r["F"]): r for r in s.table("SPINDLES", "CH", "F").collect()}
    assert len(each) == 4 and each["C", 13.5]["N"] >= 2 and each["C", 11.0]["N"] >= 1
    ev = [r for r in s.table("SPINDLES", "CH", "F", "SPINDLE").orderBy("F", "SPINDLE").collect() if r["ch"] == "C" and r["F"] == 13.5]
    near = [r for r in ev if abs(r["start"] - 20) < 0.4]
    assert [r["SPINDLE"] for r in ev] == list(range(1, len(ev) + 1)) and len(near) == 1
    assert abs(near[0]["dur"] - 1.0) < 0.5 and abs(near[0]["frq"] - 13.5) < 1.5 and abs(near[0]["amp"] - 2) < 0.4
    assert 0 < near[0]["symm"] < 1 and abs(near[0]["nosc"] - near[0]["frq"] * near[0]["dur"]) < 1e-9
    total = {r["ch"]: r for r in s.table("SPINDLES", "CH").collect()}
    assert total["C"]["N"] == each["C", 11.0]["N"] + each["C", 13.5]["N"] and total["C"]["DENS"] == total["C"]["N"] / 2
    m = s.table("SPINDLES", "CH", "MSP").where("ch = 'C'").orderBy("MSP_START").collect()
    assert all(a["MSP_STOP"] <= b["MSP_START"] for a, b in zip(m, m[1:])) and sum(r["MSP_SIZE"] for r in m) == total["C"]["N"]
    assert s.annots.where("class = 'sp' and ch = 'C'").count() == total["C"]["N"]


def test_spindle_thresholds():
    x, sr = bursts(), 128
    usual = dsp.spindles(x, sr)
    starts = lambda rows: {round(r["peak"]) for r in rows}
    assert {20, 60} <= {k - 1 for k in starts(usual)} | starts(usual)
    assert len(dsp.spindles(x, sr, most=1.0)) == 0
    assert dsp.spindles(x, sr, local=40.0) and dsp.spindles(x, sr, th=None)
    assert dsp.spindles(np.zeros(sr * 30), sr) == [] == dsp.spindles(np.zeros(sr * 30), sr, th=None)
    two = np.concatenate([np.full(500, 1.0), np.full(300, 9.0)]) + np.random.default_rng(0).normal(0, 0.3, 800)
    assert 2 < dsp.between_modes(two) < 8


def test_smoothed_z_scan():
    x = np.concatenate([np.zeros(100), [5.0, 5.0], np.zeros(100), np.random.default_rng(4).normal(size=200), [9.0]])
    lag, th, infl, y, want = 20, 3.0, 0.1, list(x), np.zeros(len(x), int)
    for i in range(lag, len(x)):
        w = np.array(y[i - lag : i])
        if abs(x[i] - w.mean()) > th * w.std() + 1e-9 * 9:
            want[i] = 1 if x[i] > w.mean() else -1
            y[i] = infl * x[i] + (1 - infl) * y[i - 1]
    assert np.array_equal(dsp.smoothed_z_peaks(x, lag, th, infl), want) and want[100] == 1 and not want[150:200].any()


def test_silence_has_no_phase_and_no_cycles():
    x = np.zeros(2000)
    x[1000] = 1.0
    assert (dsp.filtered(x, 100, "bandpass", [8, 12], tw=4)[:800] == 0).all() and (dsp.morlet(x, 100, 20.0)[:800] == 0).all()
    assert dsp.slow_oscillations(np.zeros(2000), 100) == []
    assert dsp.phase_locking(np.zeros(50), np.zeros(50)) == (1.0, 0.0, 0.0)
    long = np.random.default_rng(5).normal(size=3000)
    h = dsp.kaiser_fir(100, "bandpass", [8, 12], tw=0.5)
    assert len(h) > dsp.DIRECT
    pad = np.pad(long, len(h) // 2, mode="reflect")
    assert np.allclose(dsp.fir(long, h), np.convolve(pad, h, "valid"))


@pytest.mark.parametrize("n", [1, 3, 40])
def test_short_traces(n):
    x = np.arange(float(n))
    assert len(dsp.filtered(x, 100, "bandpass", [8, 12], tw=4)) == n == len(dsp.morlet(x, 100, 20.0))
    assert not math.isnan(float(np.abs(dsp.morlet(x, 100, 20.0)).sum()))
