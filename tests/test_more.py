"""Kernels against direct computation, gapped time lines, model staging, sources and sinks."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnoframe.functions import boost, dsp
from hypnoframe.functions.expr import names_in
from hypnoframe.operators import intervals as iv
from hypnoframe.plans import results
from hypnoframe.plans.script import ScriptError
from hypnoframe.plans.session import COMMANDS, Session
from hypnoframe.sources import edf

NS = iv.SECOND
RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def nights(spark):
    """Two recordings of 40 epochs whose stages have spectra of their own."""
    sig, notes = {}, []
    for n, i in enumerate(("A", "B")):
        r, x = np.random.default_rng(n), []
        for k in range(40):
            stage = ("W", "N2", "R")[(k // 5) % 3]
            notes.append((i, stage, 30 * k, 30 * k + 30))
            x.append(dsp.sine(32, 30, {"W": 10, "N2": 2, "R": 6}[stage], 5) + r.normal(size=960))
        sig[i] = {"EEG": (32.0, np.concatenate(x))}
    return Session.create(spark, sig, notes)


# ---- kernels --------------------------------------------------------------


def test_recursive_filters():
    """Magnitudes by the analogue formulae, and one pass against the difference equation of the expanded polynomials."""
    f = np.array([1.0, 3, 8, 15, 20, 25, 40, 60, 100])
    w = np.tan(np.pi * f / 256)
    for kind, edges in (("lowpass", [10]), ("highpass", [10]), ("bandpass", [15, 25]), ("bandstop", [15, 25])):
        e = np.tan(np.pi * np.array(edges) / 256)
        u = {"lowpass": lambda: w / e[0], "highpass": lambda: e[0] / w, "bandpass": lambda: (w * w - e[0] * e[1]) / (w * (e[1] - e[0])), "bandstop": lambda: w * (e[1] - e[0]) / (w * w - e[0] * e[1])}[kind]()
        for order, eps in ((4, None), (3, None), (4, 0.5), (3, 0.5)):
            cheb = np.where(np.abs(u) <= 1, np.cos(order * np.arccos(np.clip(u, -1, 1))), np.cosh(order * np.arccosh(np.maximum(np.abs(u), 1))))
            want = 1 / np.sqrt(1 + (u ** (2 * order) if eps is None else (eps * cheb) ** 2))
            z, p, g = dsp.recursive(256, kind, edges, order, eps)
            assert np.abs(dsp.response(z, p, g, 256, f)) == pytest.approx(want, abs=1e-6), (kind, order, eps)
            b, a = g * np.real(np.poly(z)), np.real(np.poly(p))
            x, y = RNG.normal(size=400), np.zeros(400)
            for n in range(400):
                y[n] = sum(b[k] * x[n - k] for k in range(min(len(b), n + 1))) - sum(a[k] * y[n - k] for k in range(1, min(len(a), n + 1)))
            assert dsp.one_pass(x, z, p, g) == pytest.approx(y, abs=1e-6)


def test_bandstop_leaves_what_is_outside(spark):
    x = dsp.sine(256, 8, 3) + dsp.sine(256, 8, 20)
    s = Session.create(spark, {"a": {"C": (256.0, x)}}).eval("FILTER bandstop=15,25 butterworth=4")
    y = np.array(s.samples.first()["v"])[512:]
    amp = lambda f: 2 * abs(np.mean(y * np.exp(-2j * np.pi * f * np.arange(len(y)) / 256)))
    assert amp(3) == pytest.approx(1, abs=0.01) and amp(20) < 0.02


def test_convolutions_and_transforms():
    x = RNG.normal(size=300)
    h = dsp.kaiser_fir(100, "bandpass", [8, 12], 0.02, 4)
    k = len(h) // 2
    pad = np.pad(x, k, mode="reflect")
    assert dsp.fir(x, h) == pytest.approx([pad[i : i + len(h)] @ h[::-1] for i in range(300)], abs=1e-9)
    a = dsp.analytic(x)
    spec = np.array([sum(x[t] * np.exp(-2j * np.pi * f * t / 300) for t in range(300)) for f in range(300)])
    spec[1:150] *= 2
    spec[151:] = 0
    assert a == pytest.approx(np.array([(spec * np.exp(2j * np.pi * np.arange(300) * t / 300)).sum() / 300 for t in range(300)]), abs=1e-8)
    sd = 5 / (2 * np.pi * 10)
    t = np.arange(-4 * sd, 4 * sd + 1 / 100, 1 / 100)
    w = np.exp(2j * np.pi * 10 * t - t * t / (2 * sd * sd))
    w *= 2 / np.abs(w).sum()
    assert dsp.morlet(x, 100, 10, 5) == pytest.approx(np.convolve(x, w)[len(w) // 2 : len(w) // 2 + 300], abs=1e-9)
    tone = dsp.sine(64, 8, 5)
    assert dsp.resample(dsp.sine(128, 8, 5), 128, 64)[64:-64] == pytest.approx(tone[64:-64], abs=0.01)


def test_complexity_by_counting():
    x = RNG.normal(size=120)
    m, tol = 2, 0.15 * x.std()
    near = lambda i, j, n: max(abs(x[i + k] - x[j + k]) for k in range(n)) <= tol
    pairs = [(i, j) for i in range(118) for j in range(118) if i != j]
    b, a = sum(near(i, j, m) for i, j in pairs), sum(near(i, j, m + 1) for i, j in pairs)
    assert dsp.sample_entropy(x) == pytest.approx(-math.log(a / b))
    bits = [int(v > 0) for v in x]
    phrases, rest = set(), ""
    for c in map(str, bits):
        rest += c
        if rest not in phrases:
            phrases.add(rest)
            rest = ""
    assert dsp.lempel_ziv(tuple(bits)) == pytest.approx((len(phrases) + bool(rest)) * math.log(120, 2) / 120)
    w, f, _ = dsp.dfa(x, 10, 0.4, 3, 4)
    y = np.cumsum(x - x.mean())
    for s, v in zip((w * 10).round().astype(int), f):
        res = [np.polyval(np.polyfit(range(s), y[i : i + s], 1), range(s)) - y[i : i + s] for i in range(0, len(y) // s * s, s)]
        assert v == pytest.approx(math.sqrt(np.mean(np.square(res))))
    lag, th = 10, 2.0
    z, hits = x.copy(), []
    for i in range(lag, len(x)):
        mean, sd = z[i - lag : i].mean(), z[i - lag : i].std()
        hit = abs(x[i] - mean) > th * sd
        hits.append(int(hit) * (1 if x[i] > mean else -1))
        z[i] = 0.3 * x[i] + 0.7 * z[i - 1] if hit else x[i]
    assert dsp.smoothed_z_peaks(x, lag, th, 0.3)[lag:].tolist() == hits


def test_couplings_and_causes():
    x = RNG.normal(size=2000)
    y = 0.8 * np.r_[0, x[:-1]] + 0.3 * RNG.normal(size=2000)
    back, forth = dsp.granger(x, y, 2)
    assert forth > 1 and abs(back) < 0.02
    a, b = dsp.sine(100, 10, 6), dsp.sine(100, 10, 6, phase=1.0)
    plv, _, ph = dsp.phase_locking(a, b)
    assert plv == pytest.approx(1, abs=1e-6) and ph == pytest.approx(-1.0, abs=1e-6)
    assert dsp.weighted_phase_lag(a, b) == pytest.approx(1, abs=1e-6)
    phase = np.cumsum(0.3 + 0.3 * RNG.normal(size=3000))
    z, p = dsp.phase_amplitude(phase, 1 + np.cos(phase) + 0.2 * RNG.normal(size=3000), 200)
    assert p < 0.02 and z > 3


def test_decompositions():
    r = np.random.default_rng(3)
    src = np.array([np.sign(dsp.sine(100, 20, 3)), dsp.sine(100, 20, 7.3), r.uniform(-1, 1, 2000)])
    got, _ = dsp.fast_ica(r.normal(size=(3, 3)) @ src, 3)
    c = np.abs(np.corrcoef(np.vstack([src, got]))[:3, 3:])
    assert (c.max(1) > 0.95).all() and len(set(c.argmax(1))) == 3
    m = r.random((20, 2)) @ r.random((2, 30))
    w, h = dsp.nmf(m, 2)
    assert np.abs(w @ h - m).max() < 0.05 and (w >= 0).all() and (h >= 0).all()
    a, b = (lambda q: q @ q.T)(r.normal(size=(4, 9))), (lambda q: q @ q.T)(r.normal(size=(4, 9)))
    v, e = dsp.generalized_eigen(a, b, 0.0)
    assert a @ e == pytest.approx(b @ e * v, abs=1e-8)
    noisy = np.r_[np.zeros(50), np.ones(50)] + 0.1 * r.normal(size=100)
    cost = lambda y: 0.5 * ((y - noisy) ** 2).sum() + 0.5 * np.abs(np.diff(y)).sum()
    assert cost(dsp.tv_denoise(noisy, 1.0)) <= min(cost(noisy), *(cost(dsp.tv_denoise(noisy, 1.0) + 0.01 * r.normal(size=100)) for _ in range(5)))


def test_detectors_find_what_is_planted():
    sr, r = 100.0, np.random.default_rng(4)
    x = 0.2 * r.normal(size=6000)
    for k in range(5):
        x[1000 * k + 400 : 1000 * k + 500] += 2 * np.sin(2 * np.pi * 1.0 * np.arange(100) / 100 + np.pi)
    found = dsp.slow_oscillations(x, sr)
    assert all(any(abs(f["neg_at"] - (10 * k + 4.25)) < 0.2 for f in found) for k in range(5))
    ox = np.full(600, 97.0)
    ox[200:230] -= np.r_[np.linspace(0, 6, 15), np.linspace(6, 0, 15)]
    d = dsp.desaturations(ox, 1.0, 3.0)
    assert len(d) == 1 and d[0]["nadir"] == 91 and d[0]["baseline"] == 97
    ecg = np.zeros(3000)
    ecg[50::80] = 5
    assert np.diff(dsp.r_peaks(ecg + 0.01 * r.normal(size=3000), sr)) == pytest.approx(0.8, abs=0.021)
    breath = dsp.breaths(np.sin(2 * np.pi * 0.25 * np.arange(6000) / sr), sr)
    assert np.mean([b["ttot"] for b in breath]) == pytest.approx(4, abs=0.05)
    burst = 0.01 * r.normal(size=2000)
    burst[900:950] += np.sin(2 * np.pi * 35 * np.arange(50) / sr)
    assert any(abs(a - 9.2) < 0.4 for a, b in dsp.ripples(burst, sr, 30, 40, 0.97, 30))


def test_names_in_expressions():
    assert names_in("a = C3 * 2 ; a - sqrt(C4) + num") == ["C3", "C4", "num"] and names_in('N2.n > 1 && "x" == y') == ["N2.n", "y"]


# ---- shifts that wrap ------------------------------------------------------


def test_overlap_null_wraps(spark):
    """An event as long as the recording less a little always meets the other, wherever it is moved."""
    s = Session.create(spark, {"a": {"C": (1.0, np.zeros(100))}}, [("a", "x", 0, 95), ("a", "y", 2, 10)])
    r = s.eval("OVERLAP seed=x other=y nreps=200").table("OVERLAP", "SEED").first()
    assert r["OBS"] == 1 and r["EXP"] == 1.0 and r["P"] == 1.0


# ---- gaps -----------------------------------------------------------------


def test_time_lines_with_gaps(spark, tmp_path):
    x = np.arange(12.0)
    s = Session.create(spark, {"a": {"C": (2.0, x)}}, [("a", "k", 1.0, 4.5)])
    (tmp_path / "t").write_text("0 1\n5\n6\n7\n20\n")
    g = s.eval(f"SET-TIMESTAMPS file={tmp_path}/t & SEGMENTS")
    assert [(r["START"], r["STOP"]) for r in g.table("SEGMENTS", "SEG").orderBy("SEG").collect()] == [(0, 2), (5, 8), (20, 21)]
    assert [r["DUR_SEC"] for r in g.table("SEGMENTS", "GAP").orderBy("GAP").collect()] == [3, 12]
    m = {(r["e"]): r["MEAN"] for r in g.eval("EPOCH len=2 & STATS epoch").table("STATS", "CH", "E").collect()}
    assert m == {1: 1.5, 2: 5.5}
    z = g.eval("EDF- policy=zero")
    assert z.samples.first()["v"] == [0, 1, 2, 3, *[0] * 6, 4, 5, 6, 7, 8, 9, *[0] * 24, 10, 11] and z.recordings.first()["dur_ns"] == 21 * NS
    assert g.eval("EDF-MINUS policy=splice").samples.first()["v"] == x.tolist()
    assert s.eval("ALIGN align=k").samples.first()["v"] == [2, 3, 4, 5, 6, 7]
    (tmp_path / "bad").write_text("0 1 2")
    with pytest.raises(ScriptError):
        s.eval(f"SET-TIMESTAMPS file={tmp_path}/bad")


def test_edf_plus(spark, tmp_path):
    """Annotation lists, record times with a gap, compressed files."""
    raw = bytearray(edf.encode([("EEG", 4.0, "uV", np.arange(12.0)), ("EDF Annotations", 20.0, "", np.arange(60.0))]))
    for r, text in enumerate((b"+0\x14\x14\x00+0.5\x151\x14arousal\x14\x00", b"+1\x14\x14\x00", b"+9\x14\x14\x00+9.25\x14a\x14b\x14\x00")):
        at = 256 * 3 + r * 48 + 8
        raw[at : at + 40] = text.ljust(40, b"\x00")
    (tmp_path / "p.edf.gz").write_bytes(gzip.compress(bytes(raw)))
    recs, samples = edf.read(spark, f"file://{tmp_path}/*.gz")
    assert [r["ch"] for r in samples.collect()] == ["EEG"] and recs.first()["id"] == "p"
    notes, segs = edf.read_annotations(spark, f"file://{tmp_path}/*.gz")
    assert sorted((r["class"], r["start_ns"] / NS, r["stop_ns"] / NS) for r in notes.collect()) == [("a", 9.25, 9.25), ("arousal", 0.5, 1.5), ("b", 9.25, 9.25)]
    assert [(r["seg"], r["start_ns"] // NS, r["stop_ns"] // NS) for r in segs.orderBy("seg").collect()] == [(1, 0, 2), (2, 9, 10)]


def test_ascii_aliases_lists_and_sinks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("#C3 C4\n1 2\n3\t4\n5,6\n")
    recs, samples = edf.read_ascii(spark, f"file://{tmp_path}/x.txt", 2.0)
    assert {r["ch"]: r["v"] for r in samples.collect()} == {"C3": [1, 3, 5], "C4": [2, 4, 6]} and recs.first()["dur_ns"] == 1.5 * NS
    s = Session.create(spark, {i: {"c3-m2": (1.0, np.arange(4.0))} for i in "abc"}, [("a", "Stage2", 0, 2)])
    s = s.aliased({"C3-M2": "C3"}, {"Stage2": "N2"}).only(exclude=["b"])
    assert {(r["id"], r["ch"]) for r in s.samples.collect()} == {("a", "C3"), ("c", "C3")} and s.annots.first()["class"] == "N2"
    out = s.eval("ALIASES & STATS")
    assert {(r["KIND"], r["NAME"], r["ORIG"]) for r in out.table("ALIASES", "KIND", "NAME").collect()} == {("signal", "C3", "C3-M2"), ("annot", "N2", "Stage2")}
    results.to_sqlite(out.results, str(tmp_path / "r.db"))
    back = results.from_sqlite(spark, str(tmp_path / "r.db"))
    assert {r["id"]: r["MEAN"] for r in back["STATS_CH"].collect()} == {"a": 1.5, "c": 1.5}
    results.to_text(out.results, f"file://{tmp_path}/text")
    assert spark.read.csv(f"file://{tmp_path}/text/STATS_CH", sep="\t", header=True).count() == 2


# ---- models ---------------------------------------------------------------


def test_boosted_trees():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 4))
    y = np.where(x[:, 0] * x[:, 1] > 0, "a", np.where(x[:, 2] > 0, "b", "c"))
    m = boost.fit(x[:400], y[:400])
    assert np.mean(np.array(m.classes)[m.predict(x[400:]).argmax(1)] == y[400:]) > 0.85
    text = "tree\nnum_class=2\n\nTree=0\nsplit_feature=0 1\nthreshold=0.5 1.5\nleft_child=1 -1\nright_child=-3 -2\nleaf_value=1 2 3\n"
    got = boost.parsed(text, ["n", "y"])
    assert got.raw(np.array([[0, 1.0], [0, 2], [1, 0]]))[:, 0].tolist() == [1, 2, 3]


def test_staging_models(nights):
    for script, name, least in (("POPS train & POPS", "POPS", 0.9), ("MAKE-SUDS & SUDS", "SUDS", 0.9), ("COMPLETE pick=4", "COMPLETE", 0.9), ("TSLIB & SSS", "SSS", 0.75)):
        got = {r["id"]: r for r in nights.eval(f"EPOCH & {script}").table(name).collect()}
        assert set(got) == {"A", "B"} and min(r["ACC"] for r in got.values()) > least and got["A"]["NE"] == 40, name
    e = nights.eval("EPOCH & REBASE dur=10").table("REBASE", "E").collect()
    truth = lambda k: ("W", "N2", "R")[((k - 1) // 15) % 3]
    assert len(e) == 240 and np.mean([r["PRED"] == truth(r["e"]) for r in e]) > 0.9
    with pytest.raises(ScriptError):
        nights.eval("EPOCH & SUDS")


def test_commands_that_work():
    """All command names but the one that is refused by design."""
    assert "EPOCH-MASK" in COMMANDS and len(COMMANDS) - 1 > 190


def test_session_commands(nights):
    s = nights.eval("EPOCH & SOAP & STAGE")
    assert min(r["ACC"] for r in s.table("SOAP", "CH").collect()) > 0.9
    p = {(r["id"], r["OFFSET"]): r["FIT"] for r in nights.eval("EPOCH & PLACE").table("PLACE", "CH", "OFFSET").collect()}
    assert max((k for k in p if k[0] == "A"), key=p.get)[1] % 5 == 0  # stages last five epochs each
    c = nights.eval("EPOCH & PEAKS sig=EEG cache=pk percentile=1").caches["pk"]
    assert c.count() > 0 and set(c.columns) == {"id", "ch", "t"}
    r = random.Random(1)
    kept = {nights.eval("EPOCH & MASK random=7").epochs.where("not masked and id = 'A'").count() for _ in range(1 + r.randint(0, 0))}
    assert kept == {7} and nights.epochs is None
    assert nights.eval("EPOCH & MASK ifnot=N2 & RE").recordings.agg(F.sum("dur_ns")).first()[0] == 2 * 15 * 30 * NS
