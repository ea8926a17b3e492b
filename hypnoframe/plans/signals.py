"""Commands over traces: transforms, spectra, connectivity, complexity and event detection.

Maps that array expressions can say run in Catalyst; the rest are numpy kernels on
Arrow batches, one trace (or one recording's traces) at a time.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hypnoframe.functions import dsp
from hypnoframe.operators import rolling
from hypnoframe.plans.commands import _ensured
from hypnoframe.plans.script import Command, ScriptError
from hypnoframe.plans.session import NS, Session, command


def _bands(c: Command) -> dict[str, tuple[float, float]]:
    return dsp.BANDS


def _list(c: Command, key: str, default: str) -> list[float]:
    return [float(x) for x in c.list(key, default)]


# ---- native maps ---------------------------------------------------------

NATIVE = {
    "FLIP": lambda c: lambda v: F.transform(v, lambda x: -x),
    "RECTIFY": lambda c: lambda v: F.transform(v, F.abs),
    "REVERSE": lambda c: lambda v: F.reverse(v),
    "LOG": lambda c: lambda v: F.transform(v, lambda x: F.signum(x) * F.log1p(F.abs(x))) if c.has("signed") else F.transform(v, lambda x: F.log(x + c.num("offset", c.num("eps", 0.0)))),
    "CLIP": lambda c: lambda v: F.transform(v, lambda x: F.greatest(F.lit(c.num("lwr", -1e300)), F.least(F.lit(c.num("upr", 1e300)), x))),
    # no lambda names v: Spark may put there what v is made of, and make it anew for each sample
    "1FNORM": lambda c: lambda v: F.when(F.size(v) > 0, F.concat(F.array(F.lit(0.0)), F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, y: x - y))).otherwise(v),
}


def _native(name):
    @command(name)
    def run(s: Session, c: Command) -> Session:
        return s.native(c, NATIVE[name](c))

    return run


for _n in NATIVE:
    _native(_n)


@command("uV", "mV")
def microvolts(s: Session, c: Command) -> Session:
    to = {"uV": 1e6, "mV": 1e3}[c.name]
    have = F.when(F.lower("unit") == "uv", 1e6).when(F.lower("unit") == "mv", 1e3).when(F.lower("unit") == "v", 1.0)
    hit = s.matching(c.get("sig")) & have.isNotNull()
    d = s.samples.withColumn("_k", F.when(hit, to / have).otherwise(1.0))
    return s.with_samples(d.withColumns({"v": F.transform("v", lambda x: x * F.col("_k")), "unit": F.when(hit, F.lit(c.name)).otherwise(F.col("unit"))}))


@command("SCALE")
def scale(s: Session, c: Command) -> Session:
    lo, hi = _list(c, "min-max", "0,1")
    # the limits are bound once by the outer lambda; inside the inner one they would be found again for each sample

    def scaled(v):
        ends = F.array(F.struct(F.array_min(v).alias("a"), F.array_max(v).alias("b")))
        return F.flatten(F.transform(ends, lambda e: F.transform(v, lambda x: lo + F.try_divide(x - e["a"], e["b"] - e["a"]) * (hi - lo))))

    return s.native(c, scaled)


@command("MINMAX")
def minmax(s: Session, c: Command) -> Session:
    """Common limits over the matched channels of a recording: given, or the widest found."""
    r = s.channels(c).groupBy("id").agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))
    lo, hi = (F.lit(c.num("min")) if c.has("min") else F.col("lo")), (F.lit(c.num("max")) if c.has("max") else F.col("hi"))
    d = s.samples.join(r, "id", "left")
    return s.with_samples(d.withColumn("v", F.when(s.matching(c.get("sig")), F.transform("v", lambda x: F.greatest(lo, F.least(hi, x)))).otherwise(F.col("v"))))


@command("SHIFT")
def shift(s: Session, c: Command) -> Session:
    k = int(c.num("sp", 0))

    def moved(v):
        n = F.size(v)
        if c.has("no-wrap"):
            pad = F.array_repeat(F.lit(0.0), abs(k))
            return F.concat(pad, F.slice(v, F.lit(1), n - k)) if k >= 0 else F.concat(F.slice(v, F.lit(1 - k), n + k), pad)
        at = F.pmod(F.lit(-k), n)
        return F.concat(F.slice(v, at + 1, n - at), F.slice(v, F.lit(1), at))

    return s.native(c, moved)


@command("REFERENCE", "DEREFERENCE")
def reference(s: Session, c: Command) -> Session:
    """Subtracts (or adds back) the mean of the reference channels, in array expressions; ``pairwise`` pairs sig with ref.

    The references of a recording are added up once, and each trace meets their sum.
    """
    sign = -1.0 if c.name == "REFERENCE" else 1.0
    if c.has("pairwise"):
        for a, b in zip(c.list("sig"), c.list("ref"), strict=True):
            s = reference(s, Command(c.name, {"sig": a, "ref": b} | ({"new": c.get("new")} if c.has("new") else {})))
        return s
    refs = s.chosen(c.get("ref")).groupBy("id", "sr").agg(F.collect_list("v").alias("r"))
    total = F.aggregate(F.slice("r", 2, F.size("r")), F.element_at("r", 1), lambda a, q: F.zip_with(a, q, lambda x, y: x + y))
    refs = refs.select("id", "sr", total.alias("r"), F.size("r").alias("n"))
    d = s.samples.withColumn("_hit", s.matching(c.get("sig"))).join(refs, ["id", "sr"], "left")
    moved = F.zip_with("v", "r", lambda x, y: x + F.lit(sign) * y / F.col("n"))
    if c.has("new"):
        new = d.where("_hit and r is not null").withColumns({"v": moved, "ch": F.lit(c.get("new"))})
        return s.with_samples(s.samples.unionByName(new.select(*s.samples.columns)))
    return s.with_samples(d.withColumn("v", F.when(F.col("_hit") & F.col("r").isNotNull(), moved).otherwise(F.col("v"))))


@command("COMBINE")
def combine(s: Session, c: Command) -> Session:
    kind = "median" if c.has("median") else "sum" if c.has("sum") else "mean"
    new = c.get("new", c.get(kind, kind) or kind)

    def f(chs):
        m = np.array([v for _, v in chs.values()])
        return {new: (next(iter(chs.values()))[0], {"sum": m.sum, "mean": m.mean}[kind](0) if kind != "median" else np.median(m, 0))}

    return s.joint(c, f)


@command("SIGGEN")
def siggen(s: Session, c: Command) -> Session:
    """Sine ``sine=f,amp,phase`` or impulses on new or existing channels, made by Spark expressions."""
    sr, p = c.num("sr"), _list(c, "sine", "1,1,0") + [1.0, 0.0]
    f, amp, phase = p[0], p[1], p[2] if len(c.list("sine")) > 2 else 0.0
    gen = lambda i, r: amp * F.sin(2 * math.pi * f * i / r + phase)
    if c.yes("add") or not c.has("sr"):
        return s.native(c, lambda v: F.transform(v, lambda x, i: x + gen(i, F.col("sr"))))
    n = F.round(F.col("dur_ns") / NS * sr).cast("int")
    new = s.recordings.select("id", F.lit(c.get("sig")).alias("ch"), F.lit(sr).alias("sr"), F.lit("uV").alias("unit"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: gen(i, F.lit(sr))).alias("v"))
    return s.with_samples(s.samples.where(F.col("ch") != c.get("sig")).unionByName(new))


@command("SIMUL")
def simul(s: Session, c: Command) -> Session:
    """Noise with a 1/f^alpha spectrum in place of the matched traces."""
    seed, alpha = int(s.variables.get("srand", "1")), c.num("alpha", 1.0)
    return s.mapped(c, lambda x, sr: dsp.shaped_noise(sr, len(x), 0.0 if c.has("white") else alpha, seed))


@command("SPIKE")
def spike(s: Session, c: Command) -> Session:
    """Adds ``wgt`` times one channel to another."""
    src = s.chosen(c.get("from")).select("id", F.col("v").alias("w"))
    d = s.samples.join(src, "id", "left")
    hit = s.matching(c.get("to")) & F.col("w").isNotNull()
    return s.with_samples(d.withColumn("v", F.when(hit, F.zip_with("v", "w", lambda x, y: x + c.num("wgt", 1.0) * y)).otherwise(F.col("v"))))


# ---- kernels on one trace ------------------------------------------------


def _edges(c: Command) -> tuple[str, list[float]]:
    for kind in ("bandpass", "lowpass", "highpass", "bandstop"):
        if c.has(kind):
            return kind, _list(c, kind, "")
    raise ScriptError(f"{c.name} needs bandpass, lowpass, highpass or bandstop")


@command("FILTER")
def filter_(s: Session, c: Command) -> Session:
    """Kaiser-window FIR, or with butterworth=order or chebyshev=order,eps one pass of that recursive filter."""
    kind, edges = _edges(c)
    if c.has("butterworth") or c.has("chebyshev"):
        order, eps = ([*_list(c, "chebyshev", "4,0.5"), 0.5])[:2] if c.has("chebyshev") else (c.num("butterworth", c.num("order", 4)), None)
        return s.mapped(c, lambda x, sr: dsp.one_pass(x, *dsp.recursive(sr, kind, edges, int(order), eps)))
    ripple, tw = _list(c, "ripple", "0.02")[0], _list(c, "tw", "1")[0]
    return s.mapped(c, lambda x, sr: dsp.filtered(x, sr, kind, edges, ripple, tw))


@command("FILTER-DESIGN")
def filter_design(s: Session, c: Command) -> Session:
    kind, edges = _edges(c)
    sr = c.num("fs")
    h = dsp.kaiser_fir(sr, kind, edges, _list(c, "ripple", "0.02")[0], _list(c, "tw", "1")[0])
    f = np.fft.rfftfreq(4096, 1 / sr)
    mag = np.abs(np.fft.rfft(h, 4096))
    return s.emit("FILTER-DESIGN", s.spark.createDataFrame([(float(a), float(b)) for a, b in zip(f, mag, strict=True)], "F double, MAG double"), "F")


@command("CWT-DESIGN")
def cwt_design(s: Session, c: Command) -> Session:
    fc, cyc, sr = float(c.num("fc")), float(c.num("cycles", 7)), float(c.num("fs"))
    sd = cyc / (2 * np.pi * fc)
    fwhm_t, fwhm_f = 2 * math.sqrt(2 * math.log(2)) * sd, 2 * math.sqrt(2 * math.log(2)) / (2 * np.pi * sd)
    return s.emit("CWT-DESIGN", s.spark.createDataFrame([(fc, cyc, sr, fwhm_t, fwhm_f, fc - fwhm_f / 2, fc + fwhm_f / 2)], "FC double, CYCLES double, FS double, FWHM double, FWHM_F double, FWHM_LWR double, FWHM_UPR double"))


def _per_epoch(x: np.ndarray, sr: float, n_s: float, f) -> np.ndarray:
    n = max(1, round(n_s * sr))
    return np.concatenate([f(x[i : i + n]) for i in range(0, len(x), n)])


KERNELS = {
    "RESAMPLE": lambda c: lambda x, sr: (dsp.resample(x, sr, c.num("sr"), c.get("method", "linear" if c.has("linear") else "zoh" if c.has("zoh") else "sinc")), c.num("sr")),
    "ZOH": lambda c: lambda x, sr: (dsp.resample(x, sr, c.num("sr"), "zoh"), c.num("sr")),
    "FIX-SAMPLING": lambda c: lambda x, sr: (dsp.resample(x, sr, round(sr)), float(round(sr))),
    "MOVING-AVERAGE": lambda c: lambda x, sr: dsp.median_filter(x, round(2 * c.num("hw", 1) * sr) | 1) if c.has("median") else dsp.moving_average(x, round(2 * c.num("hw", 1) * sr) | 1),
    "MEDIAN-FILTER": lambda c: lambda x, sr: (x - dsp.median_filter(x, round(2 * c.num("hwin", 1) * sr) | 1)) if c.has("remove") else dsp.median_filter(x, round(2 * c.num("hwin", 1) * sr) | 1),
    "TV": lambda c: lambda x, sr: dsp.tv_denoise(x, c.num("lambda", 10)),
    "LINE-DENOISE": lambda c: lambda x, sr: dsp.line_denoise(x, sr, _list(c, "f", "50,100")),
    "ZC": lambda c: lambda x, sr: _per_epoch(x, sr, c.num("epoch", 30) if c.has("epoch") else len(x) / sr, lambda v: v - v.mean()) if not c.has("linear") else x - np.polyval(np.polyfit(np.arange(len(x)), x, 1), np.arange(len(x))),
    "ROBUST-NORM": lambda c: lambda x, sr: (x - np.sort(x)[(len(x) - 1) // 2]) / ((0.7413 * (np.quantile(x, 0.75) - np.quantile(x, 0.25))) or 1.0),
    "ROLLING-NORM": lambda c: lambda x, sr: _rolling_z(x, round(c.num("w", 30) * sr) | 1),
    "SCRAMBLE": lambda c: lambda x, sr: np.random.default_rng(1).permutation(x),
    "FFT": lambda c: lambda x, sr: x,
}


def _rolling_z(x: np.ndarray, n: int) -> np.ndarray:
    """z-scores in whole windows: those at the ends take in the values next to the first and before the last once more."""
    h = n // 2
    if len(x) <= h:
        return np.zeros(len(x))
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate([x[1 : h + 1], x, x[len(x) - h - 1 : len(x) - 1]]), n)
    sd = w.std(1, ddof=1)
    return np.divide(x - w.mean(1), sd, out=np.zeros(len(x)), where=sd > 0)


def _kernel(name):
    @command(name)
    def run(s: Session, c: Command) -> Session:
        return s.mapped(c, KERNELS[name](c))

    return run


for _n in KERNELS:
    if _n != "FFT":
        _kernel(_n)


@command("CWT")
def cwt(s: Session, c: Command) -> Session:
    fcs, cyc = _list(c, "fc", "13.5"), c.num("cycles", 7)

    def f(ch, x, sr):
        out = []
        for k in fcs:
            w = dsp.morlet(x, sr, k, cyc)
            out.append((f"{ch}_{c.get('tag', 'cwt')}_{k:g}_mag", np.abs(w), sr))
            if c.has("phase"):
                out.append((f"{ch}_{c.get('tag', 'cwt')}_{k:g}_ph", np.angle(w), sr))
        return out

    return s.expanded(c, f)


@command("HILBERT")
def hilbert(s: Session, c: Command) -> Session:
    edges = _list(c, "f", c.get("bandpass", ""))

    def f(ch, x, sr):
        a = dsp.analytic(dsp.filtered(x, sr, "bandpass", edges) if edges else x)
        out = [(f"{ch}_hilbert_mag", np.abs(a), sr)]
        if c.has("phase"):
            out.append((f"{ch}_hilbert_ph", np.angle(a), sr))
        if c.has("ifrq"):
            out.append((f"{ch}_hilbert_ifrq", np.gradient(np.unwrap(np.angle(a))) * sr / (2 * np.pi), sr))
        return out

    return s.expanded(c, f)


@command("BANDS")
def bands(s: Session, c: Command) -> Session:
    want = c.list("bands") or ["DELTA", "THETA", "ALPHA", "SIGMA", "BETA"]

    def f(ch, x, sr):
        out = []
        for b in want:
            y = dsp.filtered(x, sr, "bandpass", list(dsp.BANDS[b]))
            out.append((f"{ch}_{b}", np.abs(dsp.analytic(y)) if c.has("envelope") else y, sr))
        return out

    return s.expanded(c, f)


@command("SSA")
def ssa(s: Session, c: Command) -> Session:
    k = int(c.num("nc", 4))

    def f(ch, x, sr):
        return [(f"{ch}_ssa_{i + 1}", rc, sr) for i, rc in enumerate(dsp.ssa(x, int(c.num("L", min(len(x) // 2, 100))), k)[1])]

    return s.expanded(c, f)


@command("EMD")
def emd(s: Session, c: Command) -> Session:
    def f(ch, x, sr):
        imf, rest = dsp.emd(x, int(c.num("imf", 8)), int(c.num("sift", 20)))
        return [(f"{ch}_imf_{i + 1}", y, sr) for i, y in enumerate(imf)] + [(f"{ch}_imf_0", rest, sr)]

    return s.expanded(c, f)


# ---- several channels together -------------------------------------------


def _matrix(chs) -> tuple[list[str], float, np.ndarray]:
    names = list(chs)
    return names, chs[names[0]][0], np.array([chs[n][1] for n in names])


@command("ICA")
def ica(s: Session, c: Command) -> Session:
    def f(chs):
        names, sr, x = _matrix(chs)
        src, _ = dsp.fast_ica(x, int(c.num("nc", len(names))))
        return {f"{c.get('tag', 'IC_')}{i + 1}": (sr, v) for i, v in enumerate(src)}

    return s.joint(c, f)


@command("SVD")
def svd(s: Session, c: Command) -> Session:
    def f(chs):
        _, sr, x = _matrix(chs)
        x = x - x.mean(1, keepdims=True)
        u, w, v = np.linalg.svd(x, full_matrices=False)
        return {f"{c.get('tag', 'U_')}{i + 1}": (sr, v[i] * w[i]) for i in range(min(int(c.num("nc", 4)), len(w)))}

    def table(_, chs):
        _, sr, x = _matrix(chs)
        w = np.linalg.svd(x - x.mean(1, keepdims=True), compute_uv=False)
        ve = w**2 / (w**2).sum()
        return [{"C": i + 1, "W": float(a), "VE": float(b), "CVE": float(d)} for i, (a, b, d) in enumerate(zip(w, ve, np.cumsum(ve), strict=True))]

    out = s.emit("SVD", s.grouped(c, table, "C int, W double, VE double, CVE double"), "C")
    return out if c.has("no-new-channels") else out.joint(c, f)


@command("ADJUST")
def adjust(s: Session, c: Command) -> Session:
    """Regresses the ``adj`` channels out of ``sig``."""
    out, adj = set(c.list("sig")), set(c.list("adj"))

    def f(chs):
        a = np.column_stack([chs[n][1] for n in chs if n in adj] + [np.ones(len(next(iter(chs.values()))[1]))])
        return {n: (sr, v - a @ np.linalg.lstsq(a, v, rcond=None)[0] if n in out else v) for n, (sr, v) in chs.items()}

    return s.joint(Command(c.name, {"sig": ",".join(sorted(out | adj))}), f, keep=False)


@command("ALTER")
def alter(s: Session, c: Command) -> Session:
    return adjust(s, Command("ADJUST", {"sig": c.get("sig"), "adj": c.get("corr")}))


def _positions(c: Command, names: list[str]) -> np.ndarray:
    """Electrode positions of a ``clocs`` text file (name x y z), else a ring in the order of names."""
    if c.has("clocs"):
        at = {p[0].upper(): [float(v) for v in p[1:4]] for p in (x.split() for x in open(c.get("clocs"))) if len(p) >= 4}
        return np.array([at[n.upper()] for n in names])
    t = 2 * np.pi * np.arange(len(names)) / len(names)
    return np.column_stack([np.cos(t), np.sin(t), 0.3 + 0 * t])


@command("SL")
def surface_laplacian(s: Session, c: Command) -> Session:
    def f(chs):
        names, sr, x = _matrix(chs)
        y = dsp.surface_laplacian(_positions(c, names), int(c.num("m", 4)), int(c.num("order", 10)), c.num("lambda", 1e-5)) @ x
        return {n: (sr, v) for n, v in zip(names, y, strict=True)}

    return s.joint(c, f, keep=False)


@command("L1OUT", "INTERPOLATE")
def leave_one_out(s: Session, c: Command) -> Session:
    """Each channel interpolated from the others: L1OUT gives their correlation; INTERPOLATE replaces ``bad`` channels."""
    if c.name == "INTERPOLATE":
        bad = set(c.list("bad"))

        def f(chs):
            names, sr, x = _matrix(chs)
            xyz = _positions(c, names)
            g = [i for i, n in enumerate(names) if n not in bad]
            b = [i for i, n in enumerate(names) if n in bad]
            if b:
                x[b] = dsp.spline_interpolation(xyz[g], xyz[b], 4, 10) @ x[g]
            return {n: (sr, v) for n, v in zip(names, x, strict=True)}

        return s.joint(c, f, keep=False)

    def one(_, chs):
        names, sr, x = _matrix(chs)
        xyz = _positions(c, names)
        rows = []
        for i, n in enumerate(names):
            g = [j for j in range(len(names)) if j != i]
            y = dsp.spline_interpolation(xyz[g], xyz[[i]], 4, 10) @ x[g]
            rows.append({"ch": n, "R": float(np.corrcoef(y[0], x[i])[0, 1])})
        return rows

    return s.emit("L1OUT", s.grouped(c, one, "ch string, R double"), "CH")


@command("GED")
def ged(s: Session, c: Command) -> Session:
    """Components that maximise the power of a band (f1, fwhm1) against broadband."""
    f1, bw = c.num("f1", 10.0), c.num("fwhm1", 2.0)

    def f(chs):
        _, sr, x = _matrix(chs)
        nb = np.array([dsp.filtered(v, sr, "bandpass", [max(0.1, f1 - bw), f1 + bw]) for v in x])
        _, v = dsp.generalized_eigen(np.cov(nb), np.cov(x))
        return {f"GED_{i + 1}": (sr, v[:, i] @ x) for i in range(min(int(c.num("nc", 1)), len(x)))}

    return s.joint(c, f)


@command("MS")
def microstates(s: Session, c: Command) -> Session:
    def one(_, chs):
        names, sr, x = _matrix(chs)
        _, lab, gev = dsp.microstates(x, int(c.num("k", 4)))
        edges = np.flatnonzero(np.diff(lab)) + 1
        segs = np.split(lab, edges)
        return [{"K": j, "COV": float((lab == j).mean()), "OCC": float(sum(g[0] == j for g in segs) / (len(lab) / sr)), "DUR": float(np.mean([len(g) for g in segs if g[0] == j]) / sr * 1000) if any(g[0] == j for g in segs) else 0.0, "GEV": gev, "LZW": dsp.lempel_ziv(tuple(int(g[0]) for g in segs))} for j in range(int(c.num("k", 4)))]

    return s.emit("MS", s.grouped(c, one, "K int, COV double, OCC double, DUR double, GEV double, LZW double"), "K")


@command("SYNC")
def sync(s: Session, c: Command) -> Session:
    """Kuramoto order parameter across channels per frequency."""

    def one(_, chs):
        _, sr, x = _matrix(chs)
        rows = []
        for f in np.arange(c.num("f-lwr", 1), c.num("f-upr", 20) + 1e-9, c.num("r", 1)):
            ph = [np.angle(dsp.morlet(v, sr, float(f))) for v in x]
            rows.append({"F": float(f), "KOP": float(np.abs(np.exp(1j * np.array(ph)).mean(0)).mean())})
        return rows

    return s.emit("SYNC", s.grouped(c, one, "F double, KOP double"), "F")


@command("SUPPRESS-ECG")
def suppress_ecg(s: Session, c: Command) -> Session:
    """Subtracts each channel's average around R peaks of the ``ecg`` channel."""
    ecg = c.get("ecg")

    def f(chs):
        sr, e = chs[ecg]
        peaks = (dsp.r_peaks(e, sr) * sr).round().astype(int)
        w = round(0.4 * sr)
        out = {ecg: chs[ecg]}
        for n, (r, x) in chs.items():
            if n == ecg or r != sr:
                out[n] = (r, x)
                continue
            ok = [p for p in peaks if p >= w and p + w < len(x)]
            y = x.copy()
            if ok:
                art = np.mean([x[p - w : p + w] for p in ok], 0)
                for p in ok:
                    y[p - w : p + w] -= (art - art.mean()) * np.hanning(2 * w)
            out[n] = (r, y)
        return out

    return s.joint(Command(c.name, {"sig": c.get("sig") + "," + ecg if c.has("sig") else "*"}), f, keep=False)


# ---- pairs ---------------------------------------------------------------


def _pair(name, schema, f, *factors, once=None):
    @command(name)
    def run(s: Session, c: Command) -> Session:
        return s.emit(name, s.pairs(c, lambda x, y, sr: f(c, x, y, sr), schema, once and (lambda x, sr: once(c, x, sr))), "CH1", "CH2", *factors)

    return run


def _coh(c, x, y, sr):
    f, m, im, lag = dsp.coherences(x[0], *dsp.crossed(x[1], y[1]))
    out = []
    for b, (lo, hi) in dsp.BANDS.items():
        k = (f >= lo) & (f < hi)
        if k.any():
            out.append({"B": b, "COH": float(m[k].mean()), "ICOH": float(im[k].mean()), "LCOH": float(lag[k].mean())})
    return out


def _xcorr(c, x, y, sr):
    t, r = dsp.xcorr(x, y, sr, c.num("w", 1))
    k = int(np.argmax(np.round(np.abs(r), 12)))  # of equal peaks the first
    return [{"D": float(t[k]), "XCORR": float(r[k]), "S": int(round(t[k] * sr))}]


def _tsync(c, x, y, sr):
    w = c.num("w", 0.25)
    t, r = dsp.xcorr(x, y, sr, w)
    k = int(np.argmax(np.round(r, 12)))  # of lags that differ by rounding alone the first
    plv, _, ph = dsp.phase_locking(x, y)
    return [{"D": float(t[k]), "XCORR": float(r[k]), "PHL": plv, "PHASE": ph}]


def _mi(c, x, y, sr):
    n = int(c.num("nbins", max(2, math.ceil(len(x) ** (1 / 3)))))
    h = np.bincount(dsp.bins(x, n) * n + dsp.bins(y, n), minlength=n * n).reshape(n, n)
    p = h / h.sum()
    px, py = p.sum(1), p.sum(0)
    ent = lambda q: float(-(q[q > 0] * np.log2(q[q > 0])).sum())
    return [{"MI": ent(px) + ent(py) - ent(p), "JINF": ent(p), "INFA": ent(px), "INFB": ent(py), "NBINS": n}]


def _psi(c, x, y, sr):
    bands = {b: span for b, span in dsp.BANDS.items() if span[1] <= sr / 2}
    return [{"F": b, "PSI": v} for b, v in zip(bands, dsp.phase_slopes(x[0], *dsp.crossed(x[1], y[1]), list(bands.values())), strict=True)]


def _cc(c, x, y, sr):
    lo, hi = c.num("lwr", 8), c.num("upr", 12)
    a, b = (dsp.filtered(v, sr, "bandpass", [lo, hi]) for v in (x, y))
    z, p = dsp.phase_amplitude(np.angle(dsp.analytic(a)), np.abs(dsp.analytic(b)), int(c.num("nreps", 1000)))
    return [{"WPLI": dsp.weighted_phase_lag(a, b), "DPAC_Z": z, "DPAC_P": p}]


def _ipc(c, x, y, sr):
    plv, w, ph = dsp.locked(x, y)
    return [{"PLV": plv, "WIPC": w, "PHASE": ph, "IPC": math.cos(ph) * plv, "N_TOT": len(x)}]


_pair("COH", "B string, COH double, ICOH double, LCOH double", _coh, "B", once=lambda c, x, sr: dsp.segment_spectra(x, sr, c.num("segment-sec", 5), c.num("segment-inc", 2.5)))
_pair("XCORR", "D double, XCORR double, S int", _xcorr)
_pair("TSYNC", "D double, XCORR double, PHL double, PHASE double", _tsync)
_pair("MI", "MI double, JINF double, INFA double, INFB double, NBINS int", _mi)
_pair("PSI", "F string, PSI double", _psi, "F", once=lambda c, x, sr: dsp.segment_spectra(x, sr))
_pair("CC", "WPLI double, DPAC_Z double, DPAC_P double", _cc)
_pair("IPC", "PLV double, WIPC double, PHASE double, IPC double, N_TOT long", _ipc, once=lambda c, x, sr: dsp.settled(dsp.analytic(x)))
_pair("CORREL", "R double", lambda c, x, y, sr: [{"R": float(np.corrcoef(x, y)[0, 1])}])
_pair("COVAR", "COV double", lambda c, x, y, sr: [{"COV": float(np.cov(x, y)[0, 1])}])
_pair("ED", "ED double", lambda c, x, y, sr: [{"ED": float(np.var(x - y))}])
_pair("GP", "Y2X double, X2Y double", lambda c, x, y, sr: [dict(zip(("Y2X", "X2Y"), dsp.granger(x - x.mean(), y - y.mean(), int(c.num("order", 5))), strict=True))])


@command("DUPES")
def dupes(s: Session, c: Command) -> Session:
    """Flat channels, and channels of equal content found by hash (no pair is made for the others)."""
    d = s.channels(c).select("id", "ch", F.xxhash64("v").alias("h"), F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))).alias("m"), (F.array_min("v") == F.array_max("v")).cast("int").alias("FLAT"))
    n = F.count("*").over(Window.partitionBy("id", "h", "m"))
    return s.emit("DUPES", d.withColumn("DUPE", (n > 1).cast("int")).drop("h", "m"), "CH")


@command("ASYMM")
def asymmetry(s: Session, c: Command) -> Session:
    """log2 of left over right band power, per band."""
    pw = _psd_bands(s, c)
    left, right = (pw.where(s.matching(c.get(k))).select("id", "B", F.col("PSD").alias(k)) for k in ("left", "right"))
    return s.emit("ASYMM", left.join(right, ["id", "B"]).select("id", "B", F.log2(F.try_divide("left", "right")).alias("ASYMM")), "B")


# ---- spectra -------------------------------------------------------------


def _psd_rows(c: Command):
    def one(x, sr):
        f, p = dsp.welch(x, sr, c.num("segment-sec", 4), c.num("segment-inc", 2), "hann" if c.has("hann") else "hamming" if c.has("hamming") else "none" if c.has("no-window") else "tukey50", c.has("segment-median"))
        pw = {b: dsp.band_power(f, p, lo, hi) for b, (lo, hi) in dsp.BANDS.items() if lo < sr / 2}
        total = pw.get("TOTAL") or 1.0
        db = lambda v: 10 * math.log10(v) if v > 0 else None
        return [{"B": b, "PSD": db(v) if c.has("dB") else v, "RELPSD": v / total} for b, v in pw.items()]

    return one


def _psd_bands(s: Session, c: Command):
    return s.rows(Command("PSD", {"sig": "*"}), _psd_rows(c), "B string, PSD double, RELPSD double")


@command("PSD")
def psd(s: Session, c: Command) -> Session:
    """Welch power by band (and bin, epoch), relative power, ratios, slope."""
    if s.epochs is None:
        d = s.rows(c, _psd_rows(c), "B string, PSD double, RELPSD double")
    else:
        e = s.epoch_rows(c, _psd_rows(c), "B string, PSD double, RELPSD double")
        if c.has("epoch"):
            s = s.emit("PSD", e, "CH", "B", "E")
        d = e.groupBy("id", "ch", "B").agg(F.avg("PSD").alias("PSD"), F.avg("RELPSD").alias("RELPSD"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY PSD)").alias("PSD_MD"), F.stddev_samp("PSD").alias("PSD_SD"))
    s = s.emit("PSD", d, "CH", "B")
    lo, hi = c.num("min", 0.5), c.num("max", 25)
    if c.has("spectrum"):
        spec = lambda x, sr: [{"F": float(a), "PSD": float(b)} for a, b in zip(*dsp.welch(x, sr, c.num("segment-sec", 4), c.num("segment-inc", 2)), strict=True) if lo <= a <= hi]
        rows = s.rows(c, spec, "F double, PSD double") if s.epochs is None else s.epoch_rows(c, spec, "F double, PSD double").groupBy("id", "ch", "F").agg(F.avg("PSD").alias("PSD"))
        s = s.emit("PSD", rows, "CH", "F")
    if c.has("slope"):
        a, b = _list(c, "slope", "30,45")
        s = s.emit("PSD-SLOPE", s.rows(c, lambda x, sr: [dict(zip(("SPEC_SLOPE", "SPEC_INTERCEPT", "SPEC_RSQ"), dsp.slope(*dsp.welch(x, sr), a, b), strict=True))], "SPEC_SLOPE double, SPEC_INTERCEPT double, SPEC_RSQ double"), "CH")
    if c.has("ratio") or c.has("slowing"):
        k = 1.0 if c.has("ratio1") else 0.0
        w = d.groupBy("id", "ch").pivot("B", list(dsp.BANDS)).agg(F.first("PSD")).na.fill(0.0, list(dsp.BANDS))
        q = lambda a, b: F.try_divide(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)) + k)
        col = F.col
        s = s.emit("PSD-RATIO", w.select("id", "ch", q(col("SLOW"), col("SLOW") + col("DELTA")).alias("SOF"), q(col("DELTA"), col("ALPHA")).alias("DAR"), q(col("THETA"), col("ALPHA")).alias("TAR"), q(col("THETA"), col("BETA")).alias("TBR"), q(col("DELTA") + col("THETA"), col("ALPHA") + col("BETA")).alias("GSI")), "CH")
    return s


@command("FFT")
def fft(s: Session, c: Command) -> Session:
    def one(x, sr):
        z = np.fft.rfft(x) / len(x)
        return [{"F": float(f), "RE": float(v.real), "IM": float(v.imag), "PSD": float(abs(v) ** 2)} for f, v in zip(np.fft.rfftfreq(len(x), 1 / sr), z, strict=True)]

    return s.emit("FFT", s.rows(c, one, "F double, RE double, IM double, PSD double"), "CH", "F")


@command("MTM")
def mtm(s: Session, c: Command) -> Session:
    def one(x, sr):
        f, p = dsp.multitaper(x, sr, c.num("segment-sec", 30), c.num("segment-inc"), c.num("nw", 3), int(c.num("t")) if c.has("t") else None)
        m = p.mean(0)
        return [{"F": float(a), "MTM": float(b)} for a, b in zip(f, m, strict=True) if c.num("min", 0.5) <= a <= c.num("max", 25)]

    return s.emit("MTM", s.rows(c, one, "F double, MTM double"), "CH", "F")


@command("IRASA")
def irasa(s: Session, c: Command) -> Session:
    def one(x, sr):
        f, a, p = dsp.irasa(x, sr)
        return [{"F": float(u), "APER": float(v), "PER": float(w)} for u, v, w in zip(f, a, p, strict=True) if c.num("min", 1) <= u <= c.num("max", 20)]

    return s.emit("IRASA", s.rows(c, one, "F double, APER double, PER double"), "CH", "F")


@command("ACF")
def acf(s: Session, c: Command) -> Session:
    def one(x, sr):
        y = x - x.mean()
        d = float(y @ y) or 1.0
        return [{"LAG": k, "ACF": float(y[: len(y) - k] @ y[k:]) / d} for k in range(1, int(c.num("lag", 10)) + 1)]

    return s.emit("ACF", s.rows(c, one, "LAG int, ACF double"), "CH", "LAG")


@command("PAC", "CFC")
def pac(s: Session, c: Command) -> Session:
    """Phase-amplitude coupling of one channel: Z and p against shifts (PAC), and GLM R2 (CFC)."""
    ph, am = _list(c, "ph", c.get("a", "1,4")), _list(c, "amp", c.get("b", "12,15"))

    def one(x, sr):
        phase = np.angle(dsp.analytic(dsp.filtered(x, sr, "bandpass", ph)))
        amp = np.abs(dsp.analytic(dsp.filtered(x, sr, "bandpass", am)))
        z, p = dsp.phase_amplitude(phase, amp, int(c.num("nreps", 1000)))
        _, _, r2 = dsp.ols(np.column_stack([np.sin(phase), np.cos(phase), np.ones(len(phase))]), amp)
        return [{"ZPAC": z, "PPAC": p, "R2_PAC": r2}]

    return s.emit(c.name, s.rows(c, one, "ZPAC double, PPAC double, R2_PAC double"), "CH")


@command("DFA")
def dfa(s: Session, c: Command) -> Session:
    def one(x, sr):
        w, f, a = dsp.dfa(x, sr, c.num("min", 0.1), c.num("max", 10), int(c.num("n", 20)))
        return [{"SEC": float(u), "FLUCT": float(v), "ALPHA": a} for u, v in zip(w, f, strict=True)]

    return s.emit("DFA", s.rows(c, one, "SEC double, FLUCT double, ALPHA double"), "CH", "SEC")


@command("FIP")
def fip(s: Session, c: Command) -> Session:
    """Frequency-interval plot: share of time in runs above the median wavelet power, by frequency and run length."""

    def one(x, sr):
        out = []
        for f in np.arange(c.num("f-lwr", 5), c.num("f-upr", 20) + 1e-9, c.num("f-inc", 1)):
            p = np.abs(dsp.morlet(x, sr, float(f)))
            n = np.array([b - a for a, b in dsp.runs(p > np.median(p))]) / sr
            out += [{"F": float(f), "T": float(t), "FIP": float(n[(n >= t) & (n < t + 0.1)].sum() / (len(x) / sr))} for t in np.arange(c.num("t-lwr", 0.1), c.num("t-upr", 1.0), 0.1)]
        return out

    return s.emit("FIP", s.rows(c, one, "F double, T double, FIP double"), "CH", "F", "T")


@command("PSC")
def psc(s: Session, c: Command) -> Session:
    """Principal spectral components of log band powers across recordings (a row per recording and channel; band columns are few)."""
    names = [b for b in dsp.BANDS if b != "TOTAL"]
    w = _psd_bands(s, c).groupBy("id", "ch").pivot("B", names).agg(F.first("PSD")).na.fill(0.0, names)
    logs = w.select("id", "ch", F.array(*(F.log(F.greatest(F.col(b), F.lit(1e-12))) for b in names)).alias("x"))
    n, k = len(names), min(int(c.num("nc", 3)), len(names))
    mean = logs.agg(*(F.avg(F.element_at("x", i + 1)).alias(f"m{i}") for i in range(n))).first()
    mu = np.array([mean[f"m{i}"] or 0.0 for i in range(n)])
    cov = logs.agg(*(F.avg((F.element_at("x", i + 1) - mu[i]) * (F.element_at("x", j + 1) - mu[j])).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n))).first()
    m = np.array([[cov[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    val, vec = np.linalg.eigh(m)
    vec = vec[:, ::-1][:, :k]
    proj = [sum((F.element_at("x", i + 1) - float(mu[i])) * float(vec[i, q]) for i in range(n)).alias(f"PSC{q + 1}") for q in range(k)]
    return s.emit("PSC", logs.select("id", "ch", *proj), "CH")


@command("POL")
def polarity(s: Session, c: Command) -> Session:
    def one(x, sr):
        y = dsp.filtered(x, sr, "bandpass", [0.5, 4])
        up, down = y[y > 0], -y[y < 0]
        return [{"POL": float(up.mean() - down.mean()) if len(up) and len(down) else 0.0, "SKEW": float((y**3).mean() / (y.std() ** 3 or 1.0))}]

    return s.emit("POL", s.rows(c, one, "POL double, SKEW double"), "CH")


# ---- descriptive numbers per epoch ---------------------------------------


@command("SIGSTATS", "RMS")
def sigstats(s: Session, c: Command) -> Session:
    def one(x, sr):
        h = dsp.hjorth(x)
        d = np.diff(x)
        turns = int(np.count_nonzero((d[1:] > 0) != (d[:-1] > 0)))
        n = len(x)
        pfd = math.log10(n) / (math.log10(n) + math.log10(n / (n + 0.4 * turns))) if n >= 3 else 0.0
        return [{"H1": h[0], "H2": h[1], "H3": h[2], "RMS": float(np.sqrt((x * x).mean())), "PE": dsp.permutation_entropy(x), "PFD": pfd, "CLIP": float(np.mean((x == x.max()) | (x == x.min()))), "FLAT": float(np.mean(np.abs(d) < 1e-6)), "MAX": float(np.abs(x).max())}]

    schema = ", ".join(f"{k} double" for k in ("H1", "H2", "H3", "RMS", "PE", "PFD", "CLIP", "FLAT", "MAX"))
    e = _ensured(s).epoch_rows(c, one, schema)
    s = _ensured(s).emit("SIGSTATS", e.groupBy("id", "ch").agg(*(F.avg(k).alias(k) for k in ("H1", "H2", "H3", "RMS", "PE", "PFD", "CLIP", "FLAT", "MAX"))), "CH")
    return s.emit("SIGSTATS", e, "CH", "E") if c.has("epoch") else s


def _epoch_number(name, var, f):
    @command(name)
    def run(s: Session, c: Command) -> Session:
        return _ensured(s).emit(name, _ensured(s).epoch_rows(c, lambda x, sr: [{var: f(c, x, sr)}], f"{var} double"), "CH", "E")

    return run


_epoch_number("LZW", "LZW", lambda c, x, sr: dsp.lempel_ziv(tuple(np.searchsorted(np.quantile(x, np.linspace(0, 1, int(c.num("nbins", 2)) + 1)[1:-1]), x).tolist())))


@command("MSE")
def mse(s: Session, c: Command) -> Session:
    e = _ensured(s).epoch_rows(c, lambda x, sr: [{"SCALE": k, "MSE": v} for k, v in dsp.multiscale_entropy(x, range(1, int(_list(c, "s", "1,5,1")[1]) + 1), int(c.num("m", 2)), c.num("r", 0.15))], "SCALE int, MSE double")
    return _ensured(s).emit("MSE", e.groupBy("id", "ch", "SCALE").agg(F.avg("MSE").alias("MSE")), "CH", "SCALE")


@command("RAI")
def rai(s: Session, c: Command) -> Session:
    """REM atonia index: mean rectified EMG a second, less the minimum of its 60 s, share of low values."""
    th, th2 = c.num("th", 1), c.num("th2", 2)

    def one(x, sr):
        n = round(sr)
        a = np.abs(x[: len(x) // n * n]).reshape(-1, n).mean(1)
        pad = np.pad(a, 30, mode="edge")
        a = a - np.lib.stride_tricks.sliding_window_view(pad, 61).min(1)[: len(a)]
        used = (a <= th) | (a > th2)
        return [{"REM_AI": float((a <= th).sum() / used.sum()) if used.any() else None, "NE": int(len(a))}]

    return s.emit("RAI", s.rows(c, one, "REM_AI double, NE long"), "CH")


@command("OTSU")
def otsu(s: Session, c: Command) -> Session:
    def one(x, sr):
        k, lo, hi = int(c.num("k", 100)), x.min(), x.max()
        h = np.bincount(dsp.bins(x, k), minlength=k)
        p, m = np.cumsum(h) / h.sum(), np.cumsum(h * np.arange(len(h))) / h.sum()
        with np.errstate(all="ignore"):
            v = np.nan_to_num((m[-1] * p - m) ** 2 / (p * (1 - p)))
        at = (int(v.argmax()) + 1) / k
        return [{"TH": float(lo + at * (hi - lo) if hi > lo else lo - 0.5 + at), "SIGMA_B": float(v.max())}]

    return s.emit("OTSU", s.rows(c, one, "TH double, SIGMA_B double"), "CH")


@command("ARTIFACTS")
def artifacts(s: Session, c: Command) -> Session:
    """Epochs whose delta or beta power is too large against the 15-epoch moving mean; masked unless no-mask."""

    def one(x, sr):
        f, p = dsp.welch(x, sr)
        return [{"DELTA": dsp.band_power(f, p, 0.6, 4.6), "BETA": dsp.band_power(f, p, 40, 60)}]

    s = _ensured(s)
    e = s.epoch_rows(c, one, "DELTA double, BETA double")
    for v, th in (("DELTA", 2.5), ("BETA", 2.0)):
        e = rolling.local_ratio(e, ["id", "ch"], ["e"], v, 15, th).withColumnsRenamed({"local": f"{v}_AVG", "fac": f"{v}_FAC", "flag": f"{v}_MASK"})
    e = e.withColumn("MASK", F.greatest("DELTA_MASK", "BETA_MASK"))
    s = s.emit("ARTIFACTS", e, "CH", "E").emit("ARTIFACTS", e.groupBy("id", "ch").agg(F.sum("MASK").alias("FLAGGED_EPOCHS"), F.count("*").alias("TOTAL_EPOCHS")), "CH")
    if c.has("no-mask"):
        return s
    bad = e.where("MASK = 1").select("id", "e", F.lit(True).alias("_b")).distinct()
    return replace(s, epochs=s.epochs.join(bad, ["id", "e"], "left").withColumn("masked", F.col("masked") | F.coalesce("_b", F.lit(False))).drop("_b"))


@command("EDGER")
def edger(s: Session, c: Command) -> Session:
    """Epochs of outlying RMS at both ends: lights-off and lights-on suggestions by the largest sum^2 / n from each edge."""
    s = _ensured(s)
    e = s.epoch_rows(c, lambda x, sr: [{"R": float(np.log(x.std() + 1e-9))}], "R double")
    q = e.groupBy("id", "ch").agg(F.percentile("R", F.lit(0.5)).alias("md"), (0.7413 * (F.percentile("R", F.lit(0.75)) - F.percentile("R", F.lit(0.25)))).alias("sd"))
    z = e.join(q, ["id", "ch"]).withColumn("z", F.when((F.col("R") - F.col("md")) > c.num("th", 3) * F.col("sd"), 1.0).otherwise(-1.0))
    a, b = (Window.partitionBy("id", "ch").orderBy(F.col("e") if k else F.desc("e")).rowsBetween(Window.unboundedPreceding, 0) for k in (1, 0))
    st = lambda w: F.signum(F.sum("z").over(w)) * F.pow(F.sum("z").over(w), 2) / F.count("*").over(w)
    z = z.withColumns({"f": st(a), "g": st(b)})
    # among equal sums the epoch nearest the edge
    top = lambda v, e: F.max(F.struct(F.col(v).alias("s"), e.alias("k")))
    out = z.groupBy("id", "ch").agg(top("f", -F.col("e")).alias("a"), top("g", F.col("e")).alias("b"))
    out = out.select("id", "ch", F.col("a.s").alias("_fs"), (-F.col("a.k")).alias("_f"), F.col("b.s").alias("_gs"), F.col("b.k").alias("_g"))
    return s.emit("EDGER", out.select("id", "ch", F.when(F.col("_fs") > 0, F.col("_f")).alias("EOFF"), F.when(F.col("_gs") > 0, F.col("_g")).alias("EON")), "CH")


@command("QC")
def qc(s: Session, c: Command) -> Session:
    """Windowed flags per channel: flat, clipped, jumps, line noise."""

    def one(x, sr):
        w = dsp.frames(x, sr, min(c.num("win", 10), len(x) / sr), c.num("inc", 10))
        d = np.abs(np.diff(w, axis=1))
        flat, clip = (d < 1e-6).mean(1) > 0.5, ((w == w.max(1, keepdims=True)) | (w == w.min(1, keepdims=True))).mean(1) > 0.05
        return [{"P_FLAT": float(flat.mean()), "P_CLIP": float(clip.mean()), "P_BAD": float((flat | clip).mean()), "FLAG": int((flat | clip).mean() > 0.5)}]

    return s.emit("QC", s.rows(c, one, "P_FLAT double, P_CLIP double, P_BAD double, FLAG int"), "CH")


@command("ZR")
def zratio(s: Session, c: Command) -> Session:
    """Z-ratio in 2-s parts: (delta + theta - alpha - beta) over their sum."""

    def one(x, sr):
        f, p = dsp.spectra(x, sr, 2, 2)
        b = [p[:, (f >= lo) & (f < hi)].sum(1) for lo, hi in ((0.5, 2), (2.5, 7.5), (8, 12.5), (13, 30))]
        z = (b[0] + b[1] - b[2] - b[3]) / np.maximum(sum(b), 1e-300)
        return [{"ZR30": float(z.mean())}]

    return _ensured(s).emit("ZR", _ensured(s).epoch_rows(c, one, "ZR30 double"), "CH", "E")


# ---- events --------------------------------------------------------------


@command("PEAKS")
def peaks(s: Session, c: Command) -> Session:
    def one(x, sr):
        k = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
        if c.has("percentile") and len(k):
            k = k[x[k] >= np.quantile(x[k], 1 - c.num("percentile") / 100)]
        return [{"T": float(i / sr), "X": float(x[i])} for i in k]

    d = s.rows(c, one, "T double, X double")
    s = s.emit("PEAKS", d, "CH", "N")
    if c.has("cache"):
        s = replace(s, caches={**s.caches, c.get("cache"): d.select("id", "ch", F.col("T").alias("t"))})
    return s.events(d.withColumn("U", F.col("T") + 1e-9), c.get("annot"), "T", "U") if c.has("annot") else s


@command("Z-PEAKS")
def z_peaks(s: Session, c: Command) -> Session:
    def one(x, sr):
        hit = dsp.smoothed_z_peaks(x, round(c.num("w", 5) * sr), c.num("th", 3), c.num("influence", 0.01))
        return [{"start": a / sr, "stop": b / sr} for a, b in dsp.runs(hit > 0) if (b - a) / sr >= c.num("sec", 0)]

    d = s.rows(c, one, "start double, stop double")
    s = s.emit("Z-PEAKS", d, "CH", "N")
    return s.events(d, c.get("annot")) if c.has("annot") else s


def _detector(name, schema, f, summary=None):
    @command(name)
    def run(s: Session, c: Command) -> Session:
        d = s.rows(c, lambda x, sr: f(c, x, sr), schema)
        s = s.emit(name, d, "CH", "N")
        dur = s.samples.select("id", "ch", (F.size("v") / F.col("sr") / 60).alias("MINS"))
        numbers = [x.split()[0] for x in schema.split(", ") if x.split()[0] not in ("start", "stop")]
        agg = d.groupBy("id", "ch").agg(F.count("*").alias("_n"), *(F.avg(k).alias(k.upper()) for k in numbers))
        s = s.emit(name, s.channels(c).select("id", "ch").join(agg, ["id", "ch"], "left").join(dur, ["id", "ch"]).withColumn("N", F.coalesce("_n", F.lit(0))).drop("_n").withColumn("DENS", F.col("N") / F.col("MINS")), "CH")
        return s.events(d, c.get("annot", name)) if c.has("annot") else s

    return run


@command("SPINDLES")
def spindles(s: Session, c: Command) -> Session:
    """Spindles at each target frequency: every event, and numbers by channel and by channel and frequency.

    th=empirical cuts between modes; local=sec takes means in a window; th-max drops
    artifacts; collate joins events of one channel that overlap across frequencies.
    """
    names = ("dur", "amp", "frq", "peak", "isa", "nosc", "symm", "symm2", "chirp")
    th = None if c.get("th", "") == "empirical" or c.has("empirical") else c.num("th", 4.5)

    def one(x, sr):
        return [{"F": fc} | r for fc in _list(c, "fc", "13.5") for r in dsp.spindles(x, sr, fc, c.num("cycles", 7), th, c.num("th2", 2), c.num("min", 0.5), c.num("max", 3), c.num("min0", 0.3), c.num("merge", 0.5), c.num("win", 0.1), c.num("local", 0), c.num("th-max", math.inf))]

    d = s.rows(c, one, "F double, start double, stop double, " + ", ".join(f"{k} double" for k in names))
    mins = s.channels(c).select("id", "ch", (F.size("v") / F.col("sr") / 60).alias("MINS"))
    w = Window.partitionBy("id", "ch", "F").orderBy("start")
    s = s.emit("SPINDLES", d.withColumn("SPINDLE", F.row_number().over(w)), "CH", "F", "SPINDLE")
    numbers = lambda keys, ns: d.groupBy("id", "ch", *keys).agg(F.count("*").alias("_n"), *(F.avg(k).alias(k.upper()) for k in ns))
    filled = lambda t, g, keys: t.join(g, ["id", "ch", *keys], "left").withColumn("N", F.coalesce("_n", F.lit(0))).drop("_n").withColumn("DENS", F.col("N") / F.col("MINS"))
    fcs = F.explode(F.array(*(F.lit(f) for f in _list(c, "fc", "13.5")))).alias("F")
    s = s.emit("SPINDLES", filled(mins.select("*", fcs), numbers(["F"], names), ["F"]), "CH", "F")
    s = s.emit("SPINDLES", filled(mins, numbers([], names[:5]), []), "CH")
    if c.has("collate"):
        after = F.max("stop").over(Window.partitionBy("id", "ch").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
        g = d.withColumn("_new", F.when(F.col("start") < after, 0).otherwise(1)).withColumn("MSP", F.sum("_new").over(Window.partitionBy("id", "ch").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
        m = g.groupBy("id", "ch", "MSP").agg(F.min("start").alias("MSP_START"), F.max("stop").alias("MSP_STOP"), F.count("*").alias("MSP_SIZE"), F.avg("F").alias("MSP_F"), F.min("F").alias("MSP_FL"), F.max("F").alias("MSP_FU"))
        s = s.emit("SPINDLES", m.withColumn("MSP_DUR", F.col("MSP_STOP") - F.col("MSP_START")), "CH", "MSP")
    return s.events(d, c.get("annot", "SPINDLES")) if c.has("annot") else s


_detector("SO", "start double, stop double, neg double, p2p double, neg_at double, pos_at double", lambda c, x, sr: dsp.slow_oscillations(x, sr, c.num("f-lwr", 0.5), c.num("f-upr", 4), c.num("t-lwr", 0.5), c.num("t-upr", 2), c.num("mag", 1.5)))
_detector("RIPPLES", "start double, stop double", lambda c, x, sr: [{"start": a, "stop": b} for a, b in dsp.ripples(x, sr, c.num("f-lwr", 70), c.num("f-upr", 150), c.num("th", 0.98), c.num("msec", 30))])
_detector("DESAT", "start double, stop double, nadir double, baseline double, drop double", lambda c, x, sr: dsp.desaturations(x, sr, c.num("drop", 3)))
_detector("RESPBREATH", "start double, stop double, peak double, tinsp double, texp double, ttot double, amp double", lambda c, x, sr: [r | {"stop": r["end"]} for r in dsp.breaths(x, sr)])


@command("AROUSALS")
def arousals(s: Session, c: Command) -> Session:
    """Sliding features: log power of bands over 1 s every 0.5 s, per channel."""

    def one(x, sr):
        # a second of up to 128 samples directly, as short convolutions are
        f, p = dsp.direct_spectra(x, sr, 1, 0.5) if sr <= dsp.DIRECT else dsp.spectra(x, sr, 1, 0.5, "hann")
        return [{"T": i * 0.5, **{b: math.log(sum(q[(f >= lo) & (f < hi)].tolist()) + 1e-12) for b, (lo, hi) in (("ALPHA", (8, 12)), ("BETA", (15, 30)), ("SIGMA", (12, 15)))}} for i, q in enumerate(p)]

    return s.emit("AROUSALS", s.rows(c, one, "T double, ALPHA double, BETA double, SIGMA double"), "CH", "T")


@command("COUPL", "PCOUPL")
def coupling(s: Session, c: Command) -> Session:
    """Phase of a narrow band at events: resultant length, angle, Rayleigh p, and Z against shifted events."""
    lo, hi = c.num("lwr", 0.5), c.num("upr", 4)
    at = s.of_class(c.list("events") or c.list("spindles") or ["*"]).groupBy("id").agg(F.collect_list((F.col("start_ns") + F.col("stop_ns")) / 2 / NS).alias("ev"))

    def run(parts):
        import pandas as pd

        for p in parts:
            rows = []
            for i, ch, sr, v, ev in p[["id", "ch", "sr", "v", "ev"]].itertuples(index=False):
                x = np.asarray(v, float)
                ph = np.angle(dsp.analytic(dsp.filtered(x, sr, "bandpass", [lo, hi], tw=0.5)))
                k = (np.sort(np.asarray(ev)) * sr).astype(int)
                k = k[k < len(x)]
                if not len(k):
                    continue
                m = np.exp(1j * ph[k]).mean()
                r = np.random.default_rng(1)
                null = np.array([abs(np.exp(1j * ph[(k + r.integers(len(x))) % len(x)]).mean()) for _ in range(int(c.num("nreps", 1000)))])
                rows.append((i, ch, len(k), abs(m), float(np.degrees(np.angle(m)) % 360), float(math.exp(-len(k) * abs(m) ** 2)), float((abs(m) - null.mean()) / (null.std() or 1)), float((1 + (null >= abs(m)).sum()) / (len(null) + 1))))
            yield pd.DataFrame(rows, columns=["id", "ch", "N", "MAG", "ANGLE", "PV", "MAG_Z", "MAG_EMP"])

    d = s.channels(c).join(at, "id").mapInPandas(run, "id string, ch string, N long, MAG double, ANGLE double, PV double, MAG_Z double, MAG_EMP double")
    return s.emit(c.name, d, "CH")


@command("HR", "HRV")
def heart(s: Session, c: Command) -> Session:
    key = "ecg" if c.has("ecg") else "sig"
    names = ("BPM", "SDNN", "RMSSD", "PNN50", "LF", "HF")
    return s.emit(c.name, s.rows(c, lambda x, sr: [dsp.hrv(dsp.r_peaks(x, sr))], ", ".join(f"{n} double" for n in names), key), "CH")


@command("HB")
def hypoxic_burden(s: Session, c: Command) -> Session:
    """Area of desaturation below each event's baseline (100 s before it), in %min per hour."""
    ev = s.of_class(c.list("events")).groupBy("id").agg(F.collect_list(F.struct("start_ns", "stop_ns")).alias("ev"))

    def run(parts):
        import pandas as pd

        for p in parts:
            rows = []
            for i, sr, v, g in p[["id", "sr", "v", "ev"]].itertuples(index=False):
                x, area = np.asarray(v, float), 0.0
                for r in g:
                    a, b = int(r["start_ns"] * sr / NS), min(len(x), int((r["stop_ns"] / NS + 45) * sr))
                    base = x[max(0, int(a - 100 * sr)) : a].max() if a > 0 else x[0]
                    area += float(np.maximum(base - x[a:b], 0).sum() / sr / 60)
                rows.append((i, len(g), area, area / (len(x) / sr / 3600)))
            yield pd.DataFrame(rows, columns=["id", "NE", "HB_TOT", "HB"])

    return s.emit("HB", s.chosen(c.get("oxygen")).join(ev, "id").mapInPandas(run, "id string, NE long, HB_TOT double, HB double"))


@command("TLOCK", "PERI")
def time_locked(s: Session, c: Command) -> Session:
    """Mean, SD and median of traces around cached time points or annotation midpoints, by time from the event."""
    w = c.num("w", 1.0)
    src = s.caches[c.get("cache")] if c.has("cache") else s.of_class(c.list("annot") or ["*"]).select("id", "ch", ((F.col("start_ns") + F.col("stop_ns")) / 2 / NS).alias("t"))
    at = src.groupBy("id").agg(F.collect_list("t").alias("ev"))

    def run(parts):
        import pandas as pd

        for p in parts:
            rows = []
            for i, ch, sr, v, ev in p[["id", "ch", "sr", "v", "ev"]].itertuples(index=False):
                x, k = np.asarray(v, float), round(w * sr)
                cut = [x[m - k : m + k + 1] for m in (int(round(t * sr)) for t in ev) if m >= k and m + k < len(x)]
                if cut:
                    m = np.array(cut)
                    rows += [(i, ch, j / sr, float(a), float(b), float(d), len(cut)) for j, a, b, d in zip(range(-k, k + 1), m.mean(0), m.std(0), np.median(m, 0), strict=True)]
            yield pd.DataFrame(rows, columns=["id", "ch", "SEC", "M", "SD", "MD", "N"])

    return s.emit(c.name, s.channels(c).join(at, "id").mapInPandas(run, "id string, ch string, SEC double, M double, SD double, MD double, N long"), "CH", "SEC")


@command("EXE")
def clusters(s: Session, c: Command) -> Session:
    """Windows grouped by their permutation-pattern distributions with k-means, a trace at a time."""
    k = int(c.num("k", 2))

    def one(x, sr):
        n = round(c.num("win", 30) * sr)
        parts = [x[i : i + n] for i in range(0, len(x) - n + 1, n)]
        if len(parts) < k:
            return []
        m, t = int(c.num("m", 3)), int(c.num("t", 1))
        feats = []
        for q in parts:
            w = np.lib.stride_tricks.sliding_window_view(q, (m - 1) * t + 1)[:, ::t]
            feats.append(np.bincount(np.argsort(w, 1, kind="stable") @ (m ** np.arange(m)), minlength=m**m) / len(w))
        z = np.sqrt(np.array(feats))
        cent = z[np.linspace(0, len(z) - 1, k).astype(int)]
        for _ in range(50):
            lab = ((z[:, None] - cent[None]) ** 2).sum(2).argmin(1)
            cent = np.array([z[lab == j].mean(0) if (lab == j).any() else cent[j] for j in range(k)])
        return [{"E": i + 1, "CL": int(j), "DIST": float(np.sqrt(((z[i] - cent[j]) ** 2).sum()))} for i, j in enumerate(lab)]

    return s.emit(c.name, s.rows(c, one, "E long, CL int, DIST double"), "CH", "E")


@command("INSERT")
def insert(s: Session, c: Command) -> Session:
    """Lag of each channel pair by cross-correlation (the offset at which a second recording would be inserted)."""
    return s.emit("INSERT", s.pairs(c, lambda x, y, sr: [dict(zip(("SEC", "PEAK"), (lambda t, r: (float(t[np.argmax(r)]), float(r.max())))(*dsp.xcorr(x, y, sr, c.num("w", 10))), strict=True))], "SEC double, PEAK double"), "CH1", "CH2")


@command("SOAP")
def soap(s: Session, c: Command) -> Session:
    """Self-consistency of the staging: LDA on log band powers per recording and channel; kappa, and each epoch's posterior and entropy."""
    from hypnoframe.operators import hypno

    s = _ensured(s)
    h = hypno.staged(s.epochs, s.annots).select("id", "e", "stage").where("stage != '?'")
    bands = ["DELTA", "THETA", "ALPHA", "SIGMA", "BETA"]

    def one(x, sr):
        f, p = dsp.welch(x, sr)
        return [{b: math.log(dsp.band_power(f, p, *dsp.BANDS[b]) + 1e-12) for b in bands}]

    d = s.epoch_rows(c, one, ", ".join(f"{b} double" for b in bands)).join(h, ["id", "e"])

    def fit(p):
        p = p.sort_values("e").reset_index(drop=True)
        x, y = p[bands].to_numpy(), p["stage"].to_numpy()
        if len(set(y)) < 2:
            return p.assign(PRED=y, MAXPP=1.0, H=0.0)[["id", "ch", "e", "stage", "PRED", "MAXPP", "H"]]
        names, post = dsp.lda(x, y, x)
        ent = -(post * np.log2(np.maximum(post, 1e-12))).sum(1)
        return p.assign(PRED=[names[i] for i in post.argmax(1)], MAXPP=post.max(1), H=ent)[["id", "ch", "e", "stage", "PRED", "MAXPP", "H"]]

    e = d.groupBy("id", "ch").applyInPandas(fit, "id string, ch string, e long, stage string, PRED string, MAXPP double, H double")
    s = s.emit(c.name, e, "CH", "E")
    n = e.groupBy("id", "ch").agg(F.avg((F.col("stage") == F.col("PRED")).cast("double")).alias("ACC"), F.avg("H").alias("H"), F.count("*").alias("NE"))
    return s.emit(c.name, n, "CH")


@command("PREP-MASSOC")
def prep_massoc(s: Session, c: Command) -> Session:
    """Wide feature rows: band powers of every channel in one row per recording."""
    names = [f"{b}" for b in dsp.BANDS]
    return s.emit("PREP-MASSOC", _psd_bands(s, c).groupBy("id", "ch").pivot("B", names).agg(F.first("PSD")), "CH")


@command("HDSTATS")
def hypnodensity(s: Session, c: Command) -> Session:
    """Entropy, confidence, margin and change of stage posteriors given as channels W, N1, N2, N3, R (names by those keys)."""
    keys = ["W", "N1", "N2", "N3", "R"]
    names = [c.get(k, f"PP_{k}") for k in keys]

    def one(_, chs):
        if any(n not in chs for n in names):
            return []
        p = np.array([chs[n][1] for n in names])
        p = p / np.maximum(p.sum(0), 1e-12)
        srt = np.sort(p, 0)[::-1]
        tv = np.concatenate([[0.0], 0.5 * np.abs(np.diff(p, axis=1)).sum(0)])
        h = -(p * np.log2(np.maximum(p, 1e-12))).sum(0)
        return pd.DataFrame({"E": np.arange(1, p.shape[1] + 1), "H": h, "C": srt[0], "MG": srt[0] - srt[1], "TV": tv, "ARGMAX": np.array(keys, object)[p.argmax(0)]})

    return s.emit("HDSTATS", s.grouped(Command(c.name, {"sig": ",".join(names)}), one, "E long, H double, C double, MG double, TV double, ARGMAX string"), "E")


@command("SIG-CYCLES")
def signal_cycles(s: Session, c: Command) -> Session:
    """Cycles of the first component of epoch log band powers: smoothed, then cut at its peaks."""
    bands = ["DELTA", "THETA", "ALPHA", "SIGMA", "BETA"]

    def one(x, sr):
        n = max(8, round(c.num("epoch-sec", 30) * sr))
        m = np.array([[math.log(dsp.band_power(*dsp.welch(x[i : i + n], sr), *dsp.BANDS[b]) + 1e-12) for b in bands] for i in range(0, len(x) - n + 1, n)])
        if len(m) < 3:
            return []
        m = (m - m.mean(0)) / np.maximum(m.std(0), 1e-12)
        u = np.linalg.svd(m, full_matrices=False)[0][:, 0]
        u = u * np.sign(np.corrcoef(u, m[:, 0])[0, 1] or 1)
        z = dsp.moving_average(u, min(len(u) if len(u) % 2 else len(u) - 1, int(c.num("w", 11)) | 1))
        top = np.flatnonzero((z[1:-1] > z[:-2]) & (z[1:-1] >= z[2:])) + 1
        cyc = np.searchsorted(top, np.arange(len(z)), "right")
        return [{"E": i + 1, "U": float(u[i]), "SS": float(z[i]), "CYC": int(cyc[i])} for i in range(len(z))]

    return s.emit("SIG-CYCLES", s.rows(c, one, "E long, U double, SS double, CYC int"), "CH", "E")


@command("PLACE")
def place(s: Session, c: Command) -> Session:
    """Best offset (epochs) of a stage list: per channel, the shift at which an LDA on band powers fits its labels best."""
    from hypnoframe.operators import hypno

    s = _ensured(s)
    bands = ["DELTA", "THETA", "ALPHA", "SIGMA", "BETA"]
    f = s.epoch_rows(c, lambda x, sr: [{b: math.log(dsp.band_power(*dsp.welch(x, sr), *dsp.BANDS[b]) + 1e-12) for b in bands}], ", ".join(f"{b} double" for b in bands))
    d = f.join(hypno.staged(s.epochs, s.annots).select("id", "e", "stage"), ["id", "e"])

    def fit(p):
        import pandas as pd

        p = p.sort_values("e")
        x, y = p[bands].to_numpy(), p["stage"].to_numpy()
        rows = []
        for k in range(-len(y) // 4, len(y) // 4 + 1):
            a, b = (x[k:], y[: len(y) - k]) if k >= 0 else (x[:k], y[-k:])
            if len(set(b)) > 1 and len(b) > len(bands) + 2:
                names, post = dsp.lda(a, b, a)
                rows.append((p["id"].iloc[0], p["ch"].iloc[0], k, float(np.mean([names[i] == z for i, z in zip(post.argmax(1), b, strict=True)]))))
        return pd.DataFrame(rows, columns=["id", "ch", "OFFSET", "FIT"])

    return s.emit("PLACE", d.groupBy("id", "ch").applyInPandas(fit, "id string, ch string, OFFSET long, FIT double"), "CH", "OFFSET")


@command("TCLST")
def trace_clusters(s: Session, c: Command) -> Session:
    """Windows around cached points or annotation midpoints, clustered by k-means on their normalised waveforms."""
    k, w = int(c.num("k", 2)), c.num("w", 0.5)
    src = s.caches[c.get("cache")] if c.has("cache") else s.of_class(c.list("annot") or ["*"]).select("id", ((F.col("start_ns") + F.col("stop_ns")) / 2 / NS).alias("t"))
    at = src.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ev"))

    def run(parts):
        import pandas as pd

        for p in parts:
            rows = []
            for i, ch, sr, v, ev in p[["id", "ch", "sr", "v", "ev"]].itertuples(index=False):
                x, h = np.asarray(v, float), round(w * sr)
                mid = [m for m in (int(round(t * sr)) for t in ev) if m >= h and m + h < len(x)]
                if len(mid) < k:
                    continue
                z = np.array([x[m - h : m + h + 1] for m in mid])
                z = (z - z.mean(1, keepdims=True)) / np.maximum(z.std(1, keepdims=True), 1e-12)
                cent = z[np.linspace(0, len(z) - 1, k).astype(int)]
                for _ in range(50):
                    lab = ((z[:, None] - cent[None]) ** 2).sum(2).argmin(1)
                    cent = np.array([z[lab == j].mean(0) if (lab == j).any() else cent[j] for j in range(k)])
                rows += [(i, ch, n + 1, m / sr, int(j)) for n, (m, j) in enumerate(zip(mid, lab, strict=True))]
            yield pd.DataFrame(rows, columns=["id", "ch", "N", "T", "C"])

    return s.emit("TCLST", s.channels(c).join(at, "id").mapInPandas(run, "id string, ch string, N long, T double, C int"), "CH", "N")


@command("NMF")
def nmf_(s: Session, c: Command) -> Session:
    """Non-negative factors of each trace's spectrogram."""

    def one(x, sr):
        f, p = dsp.spectra(x, sr)
        w, h = dsp.nmf(p, int(c.num("nc", 2)))
        return [{"NMF": j + 1, "F": float(a), "H": float(b)} for j in range(len(h)) for a, b in zip(f, h[j], strict=True)]

    return s.emit("NMF", s.rows(c, one, "NMF int, F double, H double"), "CH", "F")
