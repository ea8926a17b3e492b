"""Signal kernels in numpy (float64 in, float64 out); no other library is needed.

They run inside grouped or mapped Arrow functions, a channel or a recording at a
time.  Sampling rates are in Hz, times in seconds.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: fixed values: frequency bands in Hz, lower edge included
BANDS = {"SLOW": (0.5, 1), "DELTA": (1, 4), "THETA": (4, 8), "ALPHA": (8, 12), "SIGMA": (12, 15), "LOW_SIGMA": (10, 13), "HIGH_SIGMA": (13, 15), "BETA": (15, 30), "GAMMA": (30, 50), "TOTAL": (0.5, 50)}


# ---- generators ----------------------------------------------------------


def sine(sr: float, dur: float, f: float, amp: float = 1.0, phase: float = 0.0) -> np.ndarray:
    return amp * np.sin(2 * np.pi * f * np.arange(round(sr * dur)) / sr + phase)


def shaped_noise(sr: float, n: int, alpha: float = 1.0, seed: int = 1) -> np.ndarray:
    """Noise whose power falls as f to the -alpha."""
    r = np.random.default_rng(seed)
    f = np.fft.rfftfreq(n, 1 / sr)
    mag = np.zeros(len(f))
    mag[1:] = f[1:] ** (-alpha / 2)
    return np.fft.irfft(mag * np.exp(2j * np.pi * r.random(len(f))), n) * math.sqrt(n)


# ---- filters -------------------------------------------------------------

#: convolutions up to this length are made directly: silent stretches stay exactly zero
DIRECT = 128


def kaiser_fir(sr: float, kind: str, edges: list[float], ripple: float = 0.02, tw: float = 1.0) -> np.ndarray:
    """Linear-phase windowed sinc of odd length from a ripple and a transition width."""
    a = -20 * math.log10(ripple)
    beta = 0.1102 * (a - 8.7) if a > 50 else 0.5842 * (a - 21) ** 0.4 + 0.07886 * (a - 21) if a > 21 else 0.0
    n = math.ceil((a - 7.95) / (2.285 * 2 * np.pi * tw / sr)) | 1
    m = np.arange(n) - n // 2
    low = lambda f: 2 * f / sr * np.sinc(2 * f / sr * m)
    unit = (m == 0).astype(float)
    h = {"lowpass": lambda: low(edges[0]), "highpass": lambda: unit - low(edges[0]), "bandpass": lambda: low(edges[1]) - low(edges[0]), "bandstop": lambda: unit - low(edges[1]) + low(edges[0])}[kind]()
    h = h * np.kaiser(n, beta)
    if kind in ("lowpass", "bandstop"):
        return h / h.sum()
    if kind == "highpass":
        return h - (h.sum()) * np.kaiser(n, beta) / np.kaiser(n, beta).sum()
    mid = math.sqrt(edges[0] * edges[1]) if edges[0] > 0 else edges[1] / 2
    return h / abs((h * np.exp(-2j * np.pi * mid / sr * m)).sum())


def fir(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Convolution (short filters directly, long ones by FFT), the group delay taken out, edges reflected."""
    k = len(h) // 2
    pad = np.pad(x, min(k, max(len(x) - 1, 0)), mode="reflect") if len(x) > 1 else x
    if 0 < len(x) and len(h) <= DIRECT:
        at = k + (len(pad) - len(x)) // 2
        return np.convolve(pad, h)[at : at + len(x)]
    n = 1 << (len(pad) + len(h) - 2).bit_length()
    y = np.fft.irfft(np.fft.rfft(pad, n) * np.fft.rfft(h, n), n)
    at = k + (len(pad) - len(x)) // 2
    return y[at : at + len(x)]


def recursive(sr: float, kind: str, edges: list[float], order: int = 4, eps: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a Butterworth (or, with ``eps``, Chebyshev type I) filter by the bilinear transform.

    Band filters have ``order`` poles at each edge.
    """
    t = np.pi * (2 * np.arange(order) + 1) / (2 * order)
    if eps is None:
        p = -np.sin(t) + 1j * np.cos(t)
    else:
        mu = math.asinh(1 / eps) / order
        p = -math.sinh(mu) * np.sin(t) + 1j * math.cosh(mu) * np.cos(t)
    w = np.tan(np.pi * np.asarray(edges, float) / sr)
    if kind in ("lowpass", "highpass"):
        p = p * w[0] if kind == "lowpass" else w[0] / p
        z = np.zeros(0 if kind == "lowpass" else order, complex)
    else:
        mid, half = w[0] * w[1], (w[1] - w[0]) / 2
        q = p * half if kind == "bandpass" else half / p
        r = np.sqrt(q * q - mid)
        p = np.concatenate([q + r, q - r])
        z = np.zeros(order, complex) if kind == "bandpass" else np.repeat([1j, -1j], order) * math.sqrt(mid)
    zd = np.concatenate([(1 + z) / (1 - z), np.full(len(p) - len(z), -1.0 + 0j)])
    pd = (1 + p) / (1 - p)
    at = {"lowpass": 0.0, "bandstop": 0.0, "highpass": sr / 2}.get(kind)
    at = np.arctan(math.sqrt(w[0] * w[1])) * sr / np.pi if at is None else at
    # a Chebyshev filter of even order has a trough at the middle of its pass band
    peak = 1.0 if eps is None or order % 2 else 1 / math.sqrt(1 + eps * eps)
    return zd, pd, peak / abs(response(zd, pd, 1.0, sr, np.array([at]))[0])


def response(zeros: np.ndarray, poles: np.ndarray, gain: float, sr: float, f: np.ndarray) -> np.ndarray:
    e = np.exp(2j * np.pi * f / sr)
    h = np.full(len(f), gain, complex)
    for k in range(len(poles)):
        h *= (e - zeros[k]) / (e - poles[k])
    return h


def ringing(x: np.ndarray, poles: np.ndarray, gain_at) -> np.ndarray:
    """x through a recursive filter from rest, by a spectrum padded until its tail is under 1e-12; ``gain_at``: response at cycles a sample."""
    tail = math.ceil(-27.7 / math.log(np.clip(np.abs(poles).max(initial=0), 1e-6, 1 - 1e-6)))
    n = 1 << (len(x) + min(tail, 50 * len(x) + 1000)).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * gain_at(np.fft.rfftfreq(n)), n)[: len(x)]


def one_pass(x: np.ndarray, zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    return ringing(x, poles, lambda f: response(zeros, poles, gain, 1.0, f))


@lru_cache(64)
def _designed(sr: float, kind: str, edges: tuple[float, ...], ripple: float, tw: float) -> np.ndarray:
    return kaiser_fir(sr, kind, list(edges), ripple, tw)


def filtered(x: np.ndarray, sr: float, kind: str, edges: list[float], ripple: float = 0.02, tw: float = 1.0) -> np.ndarray:
    return fir(x, _designed(sr, kind, tuple(edges), ripple, tw))


def resample(x: np.ndarray, sr: float, to: float, method: str = "sinc") -> np.ndarray:
    n = round(len(x) * to / sr)
    t = np.arange(n) * sr / to
    if method == "linear":
        return np.interp(t, np.arange(len(x)), x)
    if method == "zoh":
        return x[np.minimum(np.floor(t + 1e-9).astype(int), len(x) - 1)]
    k = max(n, len(x))
    y = np.concatenate([x, x[::-1]])  # mirrored, so the ends meet
    spec = np.fft.rfft(y)
    out = np.zeros(n + 1, complex)
    m = min(len(spec), n + 1)
    out[:m] = spec[:m]
    return np.fft.irfft(out, 2 * n)[:n] * n / len(x) if k else x


def line_denoise(x: np.ndarray, sr: float, freqs: list[float], w: float = 2.0) -> np.ndarray:
    """Replaces the magnitude around line frequencies by the mean of their surroundings, phases kept."""
    s, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / sr)
    for c in freqs:
        inner, ring = np.abs(f - c) <= w / 2, (np.abs(f - c) > w / 2) & (np.abs(f - c) <= 1.5 * w)
        if inner.any() and ring.any():
            s[inner] = np.abs(s[ring]).mean() * np.exp(1j * np.angle(s[inner]))
    return np.fft.irfft(s, len(x))


def median_filter(x: np.ndarray, n: int) -> np.ndarray:
    """Running lower median, frames cut at the edges."""
    lo, hi = (n // 2, n // 2) if n % 2 else (n // 2, n // 2 - 1)
    pad = np.concatenate([np.full(lo, np.nan), x, np.full(hi, np.nan)])
    v = np.sort(np.lib.stride_tricks.sliding_window_view(pad, lo + hi + 1), 1)
    k = (~np.isnan(v)).sum(1)
    return v[np.arange(len(x)), (k - 1) // 2]


def moving_average(x: np.ndarray, n: int) -> np.ndarray:
    """Centred mean; the edges copy the nearest full window's mean."""
    n = min(n, len(x) if len(x) % 2 else len(x) - 1)
    c = np.convolve(x, np.ones(n) / n, "valid")
    return np.concatenate([np.full(n // 2, c[0]), c, np.full(n // 2, c[-1])])


def tv_denoise(x: np.ndarray, lam: float, steps: int = 200) -> np.ndarray:
    """Total-variation denoising by projected gradients of the dual."""
    z = np.zeros(len(x) - 1)
    for _ in range(steps):
        y = x + np.concatenate([z, [0]]) - np.concatenate([[0], z])
        z = np.clip(z + np.diff(y) / 4, -lam / 2, lam / 2)
    return x + np.concatenate([z, [0]]) - np.concatenate([[0], z])


# ---- spectra -------------------------------------------------------------


def taper(n: int, kind: str = "tukey50") -> np.ndarray:
    if kind == "none":
        return np.ones(n)
    if kind == "hamming":
        return np.hamming(n)
    if kind == "hann":
        return np.hanning(n)
    w, k = np.ones(n), int(0.25 * (n - 1))
    edge = 0.5 * (1 + np.cos(np.pi * (np.arange(k + 1) / max(k, 1) - 1)))
    w[: k + 1], w[n - k - 1 :] = edge, edge[::-1]
    return w


def frames(x: np.ndarray, sr: float, seg: float, inc: float) -> np.ndarray:
    n, i = round(seg * sr), round(inc * sr)
    return np.lib.stride_tricks.sliding_window_view(x, n)[::i] if len(x) >= n else np.empty((0, n))


def spectra(x: np.ndarray, sr: float, seg: float = 4.0, inc: float = 2.0, window: str = "tukey50", center: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided densities of each segment."""
    if len(x) < round((seg + inc) * sr):
        seg = inc = len(x) / sr
    s = frames(x, sr, seg, inc)
    s = s - s.mean(1, keepdims=True) if center else s
    w = taper(s.shape[1], window)
    p = np.abs(np.fft.rfft(s * w, axis=1)) ** 2 / (sr * (w * w).sum())
    p[:, 1 : (s.shape[1] + 1) // 2] *= 2
    return np.fft.rfftfreq(s.shape[1], 1 / sr), p


@lru_cache(64)
def _waves(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Hann window of ``n``, and cosines and sines (sample, bin)."""
    turn = [[2 * math.pi * i * j / n for i in range(n // 2 + 1)] for j in range(n)]
    w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * j / (n - 1)) for j in range(n)]) if n > 1 else np.ones(1)
    return w, np.array([[math.cos(a) for a in r] for r in turn]), np.array([[math.sin(a) for a in r] for r in turn])


def direct_spectra(x: np.ndarray, sr: float, seg: float, inc: float) -> tuple[np.ndarray, np.ndarray]:
    """``spectra`` of short Hann segments, summed sample by sample: what cancels leaves the rest that such sums leave in SQL."""
    if len(x) < round((seg + inc) * sr):
        seg = inc = len(x) / sr
    s = frames(x, sr, seg, inc)
    n = s.shape[1]
    w, c, d = _waves(n)
    re, im, ww = np.zeros((len(s), n // 2 + 1)), np.zeros((len(s), n // 2 + 1)), 0.0
    for j in range(n):
        v = (s[:, j] * w[j])[:, None]
        re, im, ww = re + v * c[j], im + v * d[j], ww + w[j] * w[j]
    k = np.arange(n // 2 + 1)
    return k * sr / n, (re * re + im * im) * np.where((k >= 1) & (k <= (n + 1) // 2 - 1), 2, 1) / (sr * ww)


def welch(x: np.ndarray, sr: float, seg: float = 4.0, inc: float = 2.0, window: str = "tukey50", median: bool = False) -> tuple[np.ndarray, np.ndarray]:
    f, p = spectra(x, sr, seg, inc, window)
    return f, (np.median(p, 0) if median else p.mean(0))


def band_power(f: np.ndarray, p: np.ndarray, lo: float, hi: float) -> float:
    """Sum of densities over lo <= f < hi times the bin width."""
    return float(p[(f >= lo) & (f < hi)].sum() * (f[1] - f[0])) if len(f) > 1 else 0.0


@lru_cache(64)
def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """Slepian tapers: leading eigenvectors of the commuting tridiagonal matrix."""
    i = np.arange(n)
    d = ((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * nw / n)
    o = i[1:] * (n - i[1:]) / 2
    _, v = np.linalg.eigh(np.diag(d) + np.diag(o, 1) + np.diag(o, -1))
    v = v[:, ::-1][:, :k].T
    return v * np.where(v.sum(1) < 0, -1, 1)[:, None]


def multitaper(x: np.ndarray, sr: float, seg: float = 30.0, inc: float | None = None, nw: float = 3.0, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the mean over tapers of each segment's spectra; tapers of long segments are interpolated."""
    s = frames(x, sr, min(seg, len(x) / sr), inc or seg)
    n = s.shape[1]
    k = k or max(1, int(2 * nw) - 1)
    base = min(n, 512)
    v = dpss(base, nw, k)
    if base < n:
        v = np.array([np.interp(np.linspace(0, base - 1, n), np.arange(base), t) for t in v])
        v /= np.sqrt((v * v).sum(1, keepdims=True))
    p = sum(np.abs(np.fft.rfft(s * t, axis=1)) ** 2 for t in v) / (k * sr)
    p[:, 1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / sr), p


def slope(f: np.ndarray, p: np.ndarray, lo: float = 30, hi: float = 45) -> tuple[float, float, float]:
    """Slope, intercept and R2 of log power on log frequency."""
    ok = (f >= lo) & (f <= hi) & (p > 0)
    if ok.sum() < 3:
        return (math.nan,) * 3
    a, b = np.log(f[ok]), np.log(p[ok])
    m, c = np.polyfit(a, b, 1)
    r = b - m * a - c
    return float(m), float(c), float(1 - r.var() / b.var()) if b.var() else math.nan


def irasa(x: np.ndarray, sr: float, seg: float = 4.0, factors=tuple(np.arange(1.05, 1.96, 0.05))) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, aperiodic and periodic density, by up- and down-sampled spectra."""
    f, p = welch(x, sr, seg, seg / 2)
    both = []
    for h in factors:
        pair = []
        for g in (h, 1 / h):
            fg, pg = welch(resample(x, sr, sr * g), sr, seg, seg / 2)
            pair.append(np.interp(f, fg, pg))
        both.append(np.sqrt(pair[0] * pair[1]))
    a = np.median(both, 0)
    return f, a, p - a


def morlet(x: np.ndarray, sr: float, f: float, cycles: float = 7.0) -> np.ndarray:
    """Complex Morlet transform (unit peak gain), short wavelets directly and long ones by FFT."""
    sd = cycles / (2 * np.pi * f)
    t = np.arange(-4 * sd, 4 * sd + 1 / sr, 1 / sr)
    w = np.exp(2j * np.pi * f * t) * np.exp(-t * t / (2 * sd * sd))
    w *= 2 / np.abs(w).sum()
    if 0 < len(x) and len(w) <= DIRECT:
        return np.convolve(x, w)[len(w) // 2 : len(w) // 2 + len(x)]
    n = 1 << (len(x) + len(w) - 2).bit_length()
    return np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(w, n))[len(w) // 2 : len(w) // 2 + len(x)]


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def segment_spectra(x: np.ndarray, sr: float, seg: float = 5.0, inc: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the complex spectra of Hann segments."""
    a = frames(x, sr, min(seg, len(x) / sr), inc)
    return np.fft.rfftfreq(a.shape[1], 1 / sr), np.fft.rfft((a - a.mean(1, keepdims=True)) * np.hanning(a.shape[1]), axis=1)


def crossed(fa: np.ndarray, fb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross- and both auto-spectra, averaged over segments."""
    return (fa * fb.conj()).mean(0), (np.abs(fa) ** 2).mean(0), (np.abs(fb) ** 2).mean(0)


def cross(x: np.ndarray, y: np.ndarray, sr: float, seg: float = 5.0, inc: float = 2.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, cross- and both auto-spectra, averaged over Hann segments."""
    (f, fa), (_, fb) = (segment_spectra(v, sr, seg, inc) for v in (x, y))
    return f, *crossed(fa, fb)


def coherence(x: np.ndarray, y: np.ndarray, sr: float, **kw) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, magnitude-squared, imaginary and lagged coherence."""
    return coherences(*cross(x, y, sr, **kw))


def coherences(f: np.ndarray, sxy: np.ndarray, sxx: np.ndarray, syy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``coherence`` from cross- and auto-spectra."""
    c = sxy / np.sqrt(np.maximum(sxx * syy, 1e-300))
    return f, np.abs(c) ** 2, c.imag, np.abs(c.imag) / np.sqrt(np.maximum(1 - c.real**2, 1e-12))


def phase_slope(x: np.ndarray, y: np.ndarray, sr: float, lo: float, hi: float, **kw) -> float:
    """Phase-slope index: positive where x leads."""
    f, *s = cross(x, y, sr, **kw)
    return phase_slopes(f, *s, [(lo, hi)])[0]


def phase_slopes(f: np.ndarray, sxy: np.ndarray, sxx: np.ndarray, syy: np.ndarray, bands: list[tuple[float, float]]) -> list[float]:
    """``phase_slope`` of each band, from cross- and auto-spectra."""
    c = sxy / np.sqrt(np.maximum(sxx * syy, 1e-300))
    of = [c[(f >= lo) & (f <= hi)] for lo, hi in bands]
    return [float(np.imag((b[:-1].conj() * b[1:]).sum()) * -1) for b in of]


def xcorr(x: np.ndarray, y: np.ndarray, sr: float, w: float) -> tuple[np.ndarray, np.ndarray]:
    """Lags in seconds within +-w (positive: y is later) and the normalised cross-correlation."""
    x, y = x - x.mean(), y - y.mean()
    n = 1 << (2 * len(x)).bit_length()
    c = np.fft.irfft(np.fft.rfft(y, n) * np.fft.rfft(x, n).conj(), n) / (len(x) * x.std() * y.std() or 1)
    k = round(w * sr)
    return np.arange(-k, k + 1) / sr, np.concatenate([c[-k:], c[: k + 1]]) if k else c[:1]


def settled(y: np.ndarray) -> np.ndarray:
    """Rounding noise, under 1e-9 of the largest amplitude, made zero: it has no sign and no phase."""
    size = np.abs(y)
    return np.where(size < 1e-9 * size.max(initial=0), 0, y)


def phase_locking(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """PLV, amplitude-weighted coherence and mean phase difference of two narrow-band signals; silence has phase 0."""
    return locked(settled(analytic(x)), settled(analytic(y)))


def locked(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """``phase_locking`` of analytic signals."""
    d = np.angle(a) - np.angle(b)
    w = np.abs(a) * np.abs(b)
    m = np.exp(1j * d)
    return float(abs(m.mean())), float(abs((w * m).sum()) / w.sum()) if w.sum() else 0.0, float(np.angle(m.mean()))


def weighted_phase_lag(x: np.ndarray, y: np.ndarray) -> float:
    s = np.imag(analytic(x) * analytic(y).conj())
    return float(abs(s.mean()) / np.abs(s).mean()) if np.abs(s).any() else 0.0


@lru_cache(64)
def _shifts(n: int, reps: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, n, reps)


def phase_amplitude(phase: np.ndarray, amp: np.ndarray, reps: int = 200, seed: int = 1) -> tuple[float, float]:
    """Z and p of phase-amplitude coupling against circular shifts.

    The means of all shifts are one circular correlation.
    """
    e = np.exp(1j * phase)
    obs = abs((amp * e).mean())
    null = np.abs(np.fft.ifft(np.fft.fft(e) * np.fft.fft(amp).conj()))[_shifts(len(amp), reps, seed)] / len(amp)
    return float((obs - null.mean()) / null.std()) if null.std() else 0.0, float((1 + (null >= obs).sum()) / (reps + 1))


def granger(x: np.ndarray, y: np.ndarray, order: int) -> tuple[float, float]:
    """Granger prediction y -> x and x -> y: log ratio of residual variances of AR models."""

    def resid(target, *sources):
        rows = np.column_stack([s[order - k - 1 : len(s) - k - 1] for s in sources for k in range(order)])
        t = target[order:]
        return float(np.var(t - rows @ np.linalg.lstsq(rows, t, rcond=None)[0]))

    return math.log(resid(x, x) / resid(x, x, y)), math.log(resid(y, y) / resid(y, y, x))


# ---- complexity ----------------------------------------------------------


def hjorth(x: np.ndarray) -> tuple[float, float, float]:
    """Variance-mode activity, mobility, complexity."""
    if len(x) < 3:
        return 0.0, 0.0, 0.0
    d = np.diff(x)
    v, v1, v2 = x.var(), d.var(), np.diff(d).var()
    m = math.sqrt(v1 / v) if v else 0.0
    return float(v), m, math.sqrt(v2 / v1) / m if v1 and m else 0.0


def hjorths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hjorth`` of each row."""
    if x.shape[1] < 3:
        return np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    d = np.diff(x, axis=1)
    v, v1, v2 = x.var(1), d.var(1), np.diff(d, axis=1).var(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.where(v != 0, np.sqrt(v1 / v), 0.0)
        return v, m, np.where((v1 != 0) & (m != 0), np.sqrt(v2 / v1) / m, 0.0)


def permutation_entropy(x: np.ndarray, m: int = 3, t: int = 1) -> float:
    w = np.lib.stride_tricks.sliding_window_view(x, (m - 1) * t + 1)[:, ::t]
    codes = np.argsort(w, 1, kind="stable") @ (m ** np.arange(m))
    p = np.unique(codes, return_counts=True)[1] / len(codes)
    return float(-(p * np.log2(p)).sum() / math.log2(math.factorial(m)))


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.15) -> float:
    """-log of the share of m-matches that stay matches at m + 1, within r SDs; rows are compared a block at a time."""
    tol, n = r * x.std(), len(x) - m
    hits = np.zeros(2)
    for a in range(0, n, 256):
        b = min(a + 256, n)
        within = lambda k: np.abs(x[a + k : b + k, None] - x[None, k : n + k]) <= tol  # noqa: B023, E731
        near = within(0)
        for k in range(1, m):
            near &= within(k)
        hits += near.sum() - len(near), (near & within(m)).sum() - len(near)
    return float(-math.log(hits[1] / hits[0])) if hits.all() else math.nan


def multiscale_entropy(x: np.ndarray, scales=range(1, 11), m: int = 2, r: float = 0.15) -> list[tuple[int, float]]:
    return [(s, sample_entropy(x[: len(x) // s * s].reshape(-1, s).mean(1), m, r)) for s in scales]


def lempel_ziv(symbols) -> float:
    """Number of phrases of an incremental parse, over n / log_k n."""
    seen, phrase, count = set(), (), 0
    for s in symbols:
        phrase += (s,)
        if phrase not in seen:
            seen.add(phrase)
            count, phrase = count + 1, ()
    n, k = len(symbols), max(2, len(set(symbols)))
    return (count + bool(phrase)) * math.log(n, k) / n if n > 1 else 0.0


def dfa(x: np.ndarray, sr: float, lo: float = 0.1, hi: float = 10.0, grid: int = 20) -> tuple[np.ndarray, np.ndarray, float]:
    """Window lengths (s), fluctuations and the scaling exponent."""
    y = np.cumsum(x - x.mean())
    out = []
    for s in np.unique(np.geomspace(max(4, lo * sr), min(hi * sr, len(x) / 2), grid).astype(int)):
        b = y[: len(y) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        b = b - b.mean(1, keepdims=True)
        res = b - np.outer(b @ t / (t @ t), t)
        out.append((s / sr, math.sqrt((res**2).mean())))
    w, f = np.array(out).T
    return w, f, float(np.polyfit(np.log(w), np.log(f), 1)[0])


# ---- decompositions ------------------------------------------------------


def ssa(x: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and the first k reconstructed components; all of them add up to x."""
    n = len(x)
    t = np.lib.stride_tricks.sliding_window_view(x, length)
    u, s, v = np.linalg.svd(t, full_matrices=False)
    rc = np.zeros((min(k, len(s)), n))
    weight = np.convolve(np.ones(len(t)), np.ones(length))
    for i in range(len(rc)):
        rc[i] = np.convolve(u[:, i] * s[i], v[i]) / weight
    return s, rc


def emd(x: np.ndarray, imfs: int = 8, sift: int = 20) -> tuple[list[np.ndarray], np.ndarray]:
    """Intrinsic modes and residual; envelopes are linear through the extremes."""
    out, res, t = [], x.copy(), np.arange(len(x))
    for _ in range(imfs):
        h = res.copy()
        for _ in range(sift):
            d = np.diff(h)
            top = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
            low = np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(top) < 2 or len(low) < 2:
                return out, res
            h = h - (np.interp(t, top, h[top]) + np.interp(t, low, h[low])) / 2
        out.append(h)
        res = res - h
    return out, res


def fast_ica(x: np.ndarray, k: int, seed: int = 1, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Sources (k by n) and mixing matrix of rows of x, symmetric tanh iterations on whitened data."""
    c = x - x.mean(1, keepdims=True)
    d, e = np.linalg.eigh(np.cov(c))
    d, e = d[::-1][:k], e[:, ::-1][:, :k]
    white = (e / np.sqrt(d)).T
    z = white @ c
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(steps):
        g = np.tanh(w @ z)
        new = g @ z.T / z.shape[1] - np.diag((1 - g * g).mean(1)) @ w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-8
        w = new
        if done:
            break
    return w @ z, np.linalg.pinv(w @ white)


def generalized_eigen(a: np.ndarray, b: np.ndarray, reg: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and vectors of a v = l b v, b regularised."""
    b = (1 - reg) * b + reg * np.trace(b) / len(b) * np.eye(len(b))
    c = np.linalg.inv(np.linalg.cholesky(b))
    w, v = np.linalg.eigh(c @ a @ c.T)
    return w[::-1], (c.T @ v)[:, ::-1]


def surface_laplacian(xyz: np.ndarray, m: int = 4, order: int = 30, lam: float = 1e-5) -> np.ndarray:
    """Channel-by-channel weights of the spherical-spline surface Laplacian."""
    u = xyz / np.linalg.norm(xyz, axis=1, keepdims=True)
    g, h = _splines(u @ u.T, m, order)
    gi = np.linalg.inv(g + lam * np.eye(len(g)))
    s = gi.sum(0)
    return h.T @ (gi - np.outer(gi.sum(1), s) / s.sum())


def spline_interpolation(good: np.ndarray, bad: np.ndarray, m: int = 4, order: int = 30, lam: float = 1e-5) -> np.ndarray:
    """Weights that give the bad channels from the good ones."""
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (good, bad))
    n = len(a)
    big = np.ones((n + 1, n + 1))
    big[:n, :n], big[n, n] = _splines(a @ a.T, m, order)[0] + lam * np.eye(n), 0
    return np.hstack([_splines(b @ a.T, m, order)[0], np.ones((len(b), 1))]) @ np.linalg.inv(big)[:, :n]


def _splines(cos: np.ndarray, m: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    before, now = np.ones_like(cos), cos.copy()
    g, h = np.zeros_like(cos), np.zeros_like(cos)
    for n in range(1, order + 1):
        g += (2 * n + 1) / (n * (n + 1)) ** m * now
        h += (2 * n + 1) / (n * (n + 1)) ** (m - 1) * now
        before, now = now, ((2 * n + 1) * cos * now - n * before) / (n + 1)
    return g / (4 * np.pi), h / (4 * np.pi)


# ---- events --------------------------------------------------------------


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of runs of true."""
    e = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
    return list(zip(e[::2].tolist(), e[1::2].tolist(), strict=True))


def merged(found: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def bins(x: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal parts of its range each value is in, the largest in the last; without a range the middle one."""
    lo, hi = x.min(), x.max()
    return np.minimum(n - 1, np.floor((x - lo) / (hi - lo) * n)).astype(int) if hi > lo else np.full(len(x), n // 2)


def between_modes(v: np.ndarray, bins: int = 100) -> float:
    """The cut of a histogram with the largest variance between its two sides."""
    n, edges = np.histogram(v, bins)
    mid = (edges[:-1] + edges[1:]) / 2
    w, m = np.cumsum(n), np.cumsum(n * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num((m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w)))
    return float(edges[1 + int(gain[:-1].argmax())]) if len(gain) > 1 else float(edges[-1])


def spindles(x: np.ndarray, sr: float, fc: float = 13.5, cycles: float = 7, th: float | None = 4.5, th2: float = 2.0, lo: float = 0.5, hi: float = 3.0, core: float = 0.3, gap: float = 0.5, smooth: float = 0.1, local: float = 0.0, most: float = math.inf) -> list[dict]:
    """Wavelet detections: a core above th times the mean, its flanks above th2 times, joined over gaps, of ``lo`` to ``hi`` s.

    ``th`` None: cut between the modes of the logarithms. ``local``: the mean is taken
    in a window of as many seconds. A detection that reaches ``most`` times the mean goes.
    """
    p = np.abs(morlet(x, sr, fc, cycles)) ** 2
    p = moving_average(p, max(1, round(smooth * sr)) | 1)
    base = moving_average(p, round(local * sr) | 1) if local else np.full(len(p), p.mean())
    if th is None:
        some = (p > 0) & (base > 0)
        if not some.any():
            return []
        th = math.exp(between_modes(np.log(p[some] / base[some])))
        th2 = min(th2, th)
    cores = [r for r in runs(p > th * base) if r[1] - r[0] >= core * sr]
    wide = runs(p > th2 * base)
    keep = [w for w in wide if any(c[0] >= w[0] and c[1] <= w[1] for c in cores) and (p[w[0] : w[1]] < most * base[w[0] : w[1]]).all()]
    out = []
    band = settled(filtered(x, sr, "bandpass", [max(0.5, fc - 2), fc + 2]))
    for a, b in merged(keep, round(gap * sr)):
        if lo * sr <= b - a <= hi * sr:
            s = band[a:b]
            zc = np.flatnonzero(np.diff((s < 0).astype(int)))
            top, half = int(np.argmax(np.abs(s))), len(zc) // 2
            rate = lambda k: (len(k) - 1) * sr / 2 / (k[-1] - k[0]) if len(k) > 1 else math.nan
            where = (top + 0.5) / (b - a)
            out.append({"start": a / sr, "stop": b / sr, "dur": (b - a) / sr, "amp": float(np.ptp(s)), "frq": float(len(zc) / 2 / ((b - a) / sr)), "peak": (a + top) / sr, "isa": float((p[a:b] / base[a:b]).sum() / sr), "nosc": len(zc) / 2, "symm": where, "symm2": 2 * abs(where - 0.5), "chirp": float(rate(zc[half:]) - rate(zc[: half + 1]))})
    return out


def slow_oscillations(x: np.ndarray, sr: float, flo: float = 0.5, fhi: float = 4.0, tlo: float = 0.5, thi: float = 2.0, mag: float = 1.5) -> list[dict]:
    """Half-waves between zero crossings (down to down) whose length fits and whose amplitude is above ``mag`` times the mean."""
    y = settled(filtered(x, sr, "bandpass", [flo, fhi], tw=0.5))
    down = np.flatnonzero((y[:-1] > 0) & (y[1:] <= 0)) + 1
    rows = []
    for a, b in zip(down[:-1], down[1:], strict=True):
        if tlo * sr <= b - a <= thi * sr:
            s = y[a:b]
            rows.append({"start": a / sr, "stop": b / sr, "neg": float(s.min()), "p2p": float(s.max() - s.min()), "neg_at": (a + int(s.argmin())) / sr, "pos_at": (a + int(s.argmax())) / sr})
    if not rows:
        return []
    neg, p2p = np.mean([r["neg"] for r in rows]), np.mean([r["p2p"] for r in rows])
    return [r for r in rows if r["neg"] <= mag * neg and r["p2p"] >= mag * p2p]


def smoothed_z_peaks(x: np.ndarray, lag: int, th: float, influence: float) -> np.ndarray:
    """+1, -1 or 0 a sample: a stateful scan in which signals enter the baseline damped; differences under 1e-9 of the range are none."""
    out, y = np.zeros(len(x), int), x.astype(float).copy()
    if len(x) <= lag:
        return out
    s, ss, least = y[:lag].sum(), (y[:lag] ** 2).sum(), 1e-9 * np.abs(x).max()
    for i in range(lag, len(x)):
        m = s / lag
        sd = math.sqrt(max(ss / lag - m * m, 0.0))
        if abs(x[i] - m) > th * sd + least:
            out[i] = 1 if x[i] > m else -1
            y[i] = influence * x[i] + (1 - influence) * y[i - 1]
        s += y[i] - y[i - lag]
        ss += y[i] ** 2 - y[i - lag] ** 2
    return out


def ripples(x: np.ndarray, sr: float, lo: float = 70, hi: float = 150, pct: float = 0.98, msec: float = 30) -> list[tuple[float, float]]:
    env = np.abs(analytic(filtered(x, sr, "bandpass", [lo, min(hi, 0.49 * sr)], tw=5)))
    return [(a / sr, b / sr) for a, b in runs(env > np.quantile(env, pct)) if (b - a) / sr * 1000 >= msec]


def r_peaks(x: np.ndarray, sr: float) -> np.ndarray:
    """R peaks (s): squared slope of the 5-20 Hz signal, adaptive threshold, 240 ms refractory."""
    y = filtered(x, sr, "bandpass", [5, min(20, 0.45 * sr)], tw=2)
    e = moving_average(np.gradient(y) ** 2, round(0.12 * sr) | 1)
    out: list[int] = []
    for a, b in runs(e > 2 * e.mean()):
        k = a + int(np.argmax(np.abs(y[a:b])))
        if not out or k - out[-1] > 0.24 * sr:
            out.append(k)
    return np.array(out) / sr


def hrv(r: np.ndarray) -> dict:
    rr = np.diff(r) * 1000
    rr = rr[(rr > 300) & (rr < 2000)]
    if len(rr) < 3:
        return {"BPM": math.nan, "SDNN": math.nan, "RMSSD": math.nan, "PNN50": math.nan, "LF": math.nan, "HF": math.nan}
    t = np.cumsum(rr) / 1000
    even = np.interp(np.arange(t[0], t[-1], 0.25), t, rr)
    f, p = welch(even - even.mean(), 4.0, min(120.0, len(even) / 4), min(60.0, len(even) / 8)) if len(even) >= 32 else (np.array([0.0, 1.0]), np.zeros(2))
    d = np.diff(rr)
    return {"BPM": 60000 / rr.mean(), "SDNN": float(rr.std(ddof=1)), "RMSSD": math.sqrt((d * d).mean()), "PNN50": float((np.abs(d) > 50).mean()), "LF": band_power(f, p, 0.04, 0.15), "HF": band_power(f, p, 0.15, 0.4)}


def trailing_max(x: np.ndarray, n: int) -> np.ndarray:
    """Largest of each sample and the n - 1 before it: the rest of one block and the beginning of the next."""
    if n >= len(x):
        return np.maximum.accumulate(x)
    blocks = np.concatenate([np.full(n - 1, -np.inf), x, np.full(-(len(x) + n - 1) % n, -np.inf)]).reshape(-1, n)
    ahead, back = np.maximum.accumulate(blocks, 1).ravel(), np.maximum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.maximum(back[: len(x)], ahead[n - 1 : n - 1 + len(x)])


def desaturations(x: np.ndarray, sr: float, drop: float = 3.0, lo: float = 10.0, hi: float = 120.0, baseline: float = 120.0) -> list[dict]:
    """Falls of at least ``drop`` below the running baseline maximum, each with its nadir."""
    base = trailing_max(x, max(1, round(baseline * sr)) + 1)
    out = []
    for a, b in runs(base - x >= drop):
        while a and x[a - 1] > x[a]:
            a -= 1
        if lo * sr <= b - a <= hi * sr:
            out.append({"start": a / sr, "stop": b / sr, "nadir": float(x[a:b].min()), "baseline": float(base[a]), "drop": float(base[a] - x[a:b].min())})
    return out


def breaths(x: np.ndarray, sr: float) -> list[dict]:
    """Breaths between upward zero crossings of the 0.05-1 Hz signal: start, peak, end, amplitude."""
    y = filtered(x - x.mean(), sr, "bandpass", [0.05, min(1.0, 0.45 * sr)], tw=0.1)
    up = np.flatnonzero((y[:-1] <= 0) & (y[1:] > 0)) + 1
    out = []
    for a, b in zip(up[:-1], up[1:], strict=True):
        if 1.0 <= (b - a) / sr <= 12.0:
            s = y[a:b]
            k = a + int(s.argmax())
            out.append({"start": a / sr, "peak": k / sr, "end": b / sr, "tinsp": (k - a) / sr, "texp": (b - k) / sr, "ttot": (b - a) / sr, "amp": float(np.ptp(s))})
    return out


def microstates(x: np.ndarray, k: int = 4, seed: int = 1, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Maps, label of each sample and explained variance: polarity-blind k-means on peaks of global field power."""
    c = x - x.mean(0)
    gfp = c.std(0)
    peak = np.flatnonzero((gfp[1:-1] > gfp[:-2]) & (gfp[1:-1] > gfp[2:])) + 1
    d = c[:, peak] / np.linalg.norm(c[:, peak], axis=0)
    r = np.random.default_rng(seed)
    maps = d[:, r.choice(d.shape[1], k, replace=False)]
    for _ in range(steps):
        lab = np.abs(maps.T @ d).argmax(0)
        new = maps.copy()
        for j in range(k):
            if (lab == j).any():
                new[:, j] = np.linalg.eigh(d[:, lab == j] @ d[:, lab == j].T)[1][:, -1]
        if np.allclose(np.abs((new * maps).sum(0)), 1, atol=1e-9):
            break
        maps = new
    fit = np.abs(maps.T @ (c / np.maximum(np.linalg.norm(c, axis=0), 1e-12)))
    lab = fit.argmax(0)
    return maps, lab, float(((gfp * fit.max(0)) ** 2).sum() / (gfp**2).sum())


# ---- models --------------------------------------------------------------


def lda(x: np.ndarray, y: np.ndarray, to: np.ndarray) -> tuple[list, np.ndarray]:
    """Classes and posteriors of ``to`` under linear discriminants with a pooled, lightly ridged covariance."""
    names = sorted(set(y))
    mu = np.array([x[y == c].mean(0) for c in names])
    s = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(names, mu, strict=True)) / max(1, len(x) - len(names))
    si = np.linalg.inv(s + 1e-6 * np.trace(s) / len(s) * np.eye(len(s)))
    prior = np.array([(y == c).mean() for c in names])
    z = to @ si @ mu.T - 0.5 * np.einsum("ij,jk,ik->i", mu, si, mu) + np.log(prior)
    p = np.exp(z - z.max(1, keepdims=True))
    return names, p / p.sum(1, keepdims=True)


def knn_impute(x: np.ndarray, k: int = 5) -> np.ndarray:
    """Fills gaps by the mean of the k rows nearest on the shared columns."""
    out = x.copy()
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    for i in np.flatnonzero(np.isnan(x).any(1)):
        d = np.sqrt(np.nanmean((z - z[i]) ** 2, 1))
        d[i] = np.inf
        for j in np.flatnonzero(np.isnan(x[i])):
            ok = np.flatnonzero(~np.isnan(x[:, j]) & np.isfinite(d))
            out[i, j] = x[ok[np.argsort(d[ok], kind="stable")[:k]], j].mean() if len(ok) else np.nan
    return out


def nmf(x: np.ndarray, k: int, seed: int = 1, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    w, h = r.random((x.shape[0], k)), r.random((k, x.shape[1]))
    for _ in range(steps):
        h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
        w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
    return w, h


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, t values and R2."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ b
    s = (r @ r) / max(1, len(y) - x.shape[1])
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * s, 1e-300))
    return b, b / se, float(1 - r.var() / y.var()) if y.var() else 0.0


def permutation_pvalue(x: np.ndarray, y: np.ndarray, reps: int = 1000, seed: int = 1) -> float:
    """Two-sided p of a correlation by permuting y."""
    r = np.random.default_rng(seed)
    obs = abs(np.corrcoef(x, y)[0, 1])
    return (1 + sum(abs(np.corrcoef(x, r.permutation(y))[0, 1]) >= obs for _ in range(reps))) / (reps + 1)
