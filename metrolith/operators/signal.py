"""Per-key signal kernels: the ordered samples of a key go through numpy once.

A kernel sees one series at a time. Series too long for a task are first cut into blocks
(`series.blocks`) and handled block by block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_series(df: DataFrame, key: str, order: list[str], value: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str) -> DataFrame:
    """Rows (key, n, columns...) of what a kernel makes of each series."""
    kind = df.schema[key].dataType.simpleString()

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf.sort_values(order, kind="stable")[value].to_numpy(float))
        n = len(next(iter(out.values())))
        return pd.DataFrame({key: [k[0]] * n, "n": np.arange(n), **out})

    return df.select(key, *order, value).groupBy(key).applyInPandas(run, f"{key} {kind}, n bigint, {columns}")


def same(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    return lambda x: {"y": f(x)}


def window(name: str, n: int) -> np.ndarray:
    i = np.arange(n)
    a = 2 * np.pi * i / max(1, n - 1)
    return {"hann": 0.5 - 0.5 * np.cos(a), "hamming": 0.54 - 0.46 * np.cos(a), "blackman": 0.42 - 0.5 * np.cos(a) + 0.08 * np.cos(2 * a), "rect": np.ones(n)}[name]


def spectrum(x: np.ndarray, fs: float = 1.0) -> dict[str, np.ndarray]:
    s = np.fft.rfft(x)
    return {"freq": np.fft.rfftfreq(len(x), 1 / fs), "re": s.real, "im": s.imag}


def periodogram(x: np.ndarray, fs: float = 1.0) -> dict[str, np.ndarray]:
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / (fs * len(x))
    p[1 : (len(x) + 1) // 2] *= 2
    return {"freq": np.fft.rfftfreq(len(x), 1 / fs), "psd": p}


def welch(x: np.ndarray, fs: float = 1.0, n: int = 256) -> dict[str, np.ndarray]:
    n = min(n, len(x))
    w, hop = window("hann", n), max(1, n // 2)
    parts = [np.abs(np.fft.rfft((x[i : i + n] - x[i : i + n].mean()) * w)) ** 2 for i in range(0, len(x) - n + 1, hop)]
    p = np.mean(parts, 0) / (fs * (w**2).sum() or 1)
    p[1 : (n + 1) // 2] *= 2
    return {"freq": np.fft.rfftfreq(n, 1 / fs), "psd": p}


def stft(x: np.ndarray, fs: float = 1.0, n: int = 64) -> dict[str, np.ndarray]:
    n = min(n, len(x))
    w, hop = window("hann", n), max(1, n // 2)
    at = range(0, len(x) - n + 1, hop)
    m = np.abs(np.array([np.fft.rfft(x[i : i + n] * w) for i in at]))
    f = np.fft.rfftfreq(n, 1 / fs)
    return {"frame": np.repeat(np.arange(len(m)), len(f)).astype(float), "freq": np.tile(f, len(m)), "magnitude": m.reshape(-1)}


def detrend(x: np.ndarray, order: int = 1) -> np.ndarray:
    t = np.linspace(-1, 1, len(x)) if len(x) > 1 else np.zeros(len(x))
    return x - np.polyval(np.polyfit(t, x, min(order, max(0, len(x) - 1))), t)


def savgol(x: np.ndarray, n: int = 5, order: int = 2) -> np.ndarray:
    """Least-squares polynomial in a centred window; at the ends the window stays and its fit is read off-centre."""
    if len(x) < n:
        return x.copy()
    h = n // 2
    a = np.vander(np.arange(-h, h + 1.0), order + 1)
    p = np.linalg.pinv(a)
    y = np.convolve(x, p[-1][::-1], "same")
    y[:h], y[-h:] = (a @ (p @ x[:n]))[:h], (a @ (p @ x[-n:]))[-h:]
    return y


def butter(order: int, cut: float, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth (b, a) for a cut-off as a share of the Nyquist frequency, by the bilinear transform."""
    w = 2 * math.tan(math.pi * cut / 2)
    p = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    p = p * w if kind == "low" else w / p
    z = (2 + p) / (2 - p)
    a = np.poly(z).real
    b = np.poly([-1 if kind == "low" else 1] * order)
    at = 1 if kind == "low" else -1
    return b * np.polyval(a, at) / np.polyval(b, at), a


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    if n == 1:
        return b[0] * x
    if not a[1:].any():
        return np.convolve(x, b)[: len(x)]
    z, y = [0.0] * n, np.empty(len(x))
    bl, al = b.tolist(), a.tolist()
    for i, v in enumerate(x.tolist()):
        o = bl[0] * v + z[0]
        for k in range(1, n):
            z[k - 1] = bl[k] * v + (z[k] if k < n - 1 else 0.0) - al[k] * o
        y[i] = o
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    n = min(3 * max(len(a), len(b)), len(x) - 1)
    if n < 1:
        return x.copy()
    e = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    y = lfilter(b, a, lfilter(b, a, e)[::-1])[::-1]
    return y[n : n + len(x)]


def fir1(n: int, cut: float) -> np.ndarray:
    k = np.arange(n + 1) - n / 2
    h = cut * np.sinc(cut * k) * window("hamming", n + 1)
    return h / h.sum()


def hilbert_envelope(x: np.ndarray) -> np.ndarray:
    n, s = len(x), np.fft.fft(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(s * h))


def resample_linear(x: np.ndarray, n: int) -> np.ndarray:
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)


def dct2(x: np.ndarray) -> np.ndarray:
    n = len(x)
    s = np.fft.fft(np.concatenate([x, x[::-1]]))[:n]
    y = (s * np.exp(-1j * np.pi * np.arange(n) / (2 * n))).real / 2
    return y * np.where(np.arange(n) == 0, math.sqrt(1 / n), math.sqrt(2 / n)) if n else y


def haar(x: np.ndarray) -> dict[str, np.ndarray]:
    x = x[: len(x) // 2 * 2]
    a, b = x[::2], x[1::2]
    return {"approx": (a + b) / math.sqrt(2), "detail": (a - b) / math.sqrt(2)}


def find_peaks(x: np.ndarray, height: float = -math.inf, distance: int = 1, prominence: float = 0.0) -> dict[str, np.ndarray]:
    at = [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] > x[i + 1] and x[i] >= height]
    keep = []
    for i in sorted(at, key=lambda i: (-x[i], i)):
        if all(abs(i - j) >= distance for j in keep):
            keep.append(i)
    out, prom = [], []
    for i in sorted(keep):
        lo = i
        while lo > 0 and x[lo - 1] <= x[i]:
            lo -= 1
        hi = i
        while hi < len(x) - 1 and x[hi + 1] <= x[i]:
            hi += 1
        p = x[i] - max(x[lo : i + 1].min(), x[i : hi + 1].min())
        if p >= prominence:
            out.append(i)
            prom.append(p)
    return {"at": np.array(out, float), "height": x[out] if out else np.zeros(0), "prominence": np.array(prom, float)}


def goertzel(x: np.ndarray, f: float, fs: float = 1.0) -> complex:
    t = np.arange(len(x))
    return complex((x * np.exp(-2j * np.pi * f / fs * t)).sum())


def xcorr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.correlate(x, y, "full")


def tv_denoise(y: np.ndarray, lam: float = 1.0, steps: int = 200) -> np.ndarray:
    """Total variation by projected gradient on the dual."""
    z = np.zeros(max(0, len(y) - 1))
    out = y.astype(float)
    for _ in range(steps if len(z) else 0):
        z = np.clip(z + np.diff(out) / 4, -lam, lam)
        out = y + np.diff(np.concatenate([[0.0], z, [0.0]]))
    return out


def kalman(x: np.ndarray, q: float = 1e-3, r: float = 1.0) -> np.ndarray:
    out, m, p = np.empty(len(x)), x[0] if len(x) else 0.0, 1.0
    for i, v in enumerate(x):
        p += q
        k = p / (p + r)
        m += k * (v - m)
        p *= 1 - k
        out[i] = m
    return out


def cheby1(order: int, ripple: float, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital low-pass Chebyshev filter (b, a) with `ripple` dB in the pass band."""
    eps = math.sqrt(10 ** (ripple / 10) - 1)
    mu = math.asinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    w = 2 * math.tan(math.pi * cut / 2)
    p = w * (-math.sinh(mu) * np.sin(theta) + 1j * math.cosh(mu) * np.cos(theta))
    a = np.poly((2 + p) / (2 - p)).real
    b = np.poly([-1.0] * order)
    gain = 1 if order % 2 else 1 / math.sqrt(1 + eps**2)
    return b * gain * a.sum() / b.sum(), a


def notch(f: float, q: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch at f as a share of the Nyquist frequency."""
    w = math.pi * f
    alpha = math.sin(w) / (2 * q)
    a0 = 1 + alpha
    return np.array([1, -2 * math.cos(w), 1]) / a0, np.array([a0, -2 * math.cos(w), 1 - alpha]) / a0


def freqz(b: np.ndarray, a: np.ndarray, n: int = 512) -> tuple[np.ndarray, np.ndarray]:
    w = np.pi * np.arange(n) / n
    z = np.exp(-1j * w)
    return w, np.polyval(b[::-1], z) / np.polyval(a[::-1], z)


def ar_model(x: np.ndarray, order: int) -> np.ndarray:
    """Yule-Walker coefficients."""
    d = x - x.mean()
    r = np.array([(d[: len(d) - k] * d[k:]).sum() for k in range(order + 1)]) / max(1, len(d))
    m = r[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))]
    return np.linalg.lstsq(m, r[1:], rcond=None)[0]


def hurst(x: np.ndarray) -> float:
    """Slope of log rescaled range against log block length."""
    sizes = [n for n in 2 ** np.arange(3, 20) if n <= len(x) // 2]
    points = []
    for n in sizes:
        parts = x[: len(x) // n * n].reshape(-1, n)
        dev = np.cumsum(parts - parts.mean(1, keepdims=True), 1)
        s = parts.std(1)
        if (s > 0).any():
            points.append((math.log(n), math.log(((dev.max(1) - dev.min(1))[s > 0] / s[s > 0]).mean())))
    return float(np.polyfit(*zip(*points, strict=True), 1)[0]) if len(points) > 1 else math.nan


def spectral_entropy(x: np.ndarray) -> float:
    p = periodogram(x)["psd"]
    p = p[p > 0] / p.sum() if p.sum() else p
    return float(-(p * np.log2(p)).sum() / math.log2(len(p))) if len(p) > 1 else 0.0


def dominant_frequency(x: np.ndarray, fs: float = 1.0) -> float:
    s = periodogram(x, fs)
    return float(s["freq"][int(np.argmax(s["psd"]))]) if len(x) else math.nan


def thd(x: np.ndarray, fs: float, f0: float, harmonics: int = 5) -> float:
    a = [abs(goertzel(x, f0 * k, fs)) for k in range(1, harmonics + 1)]
    return math.sqrt(sum(v * v for v in a[1:])) / a[0] if a[0] else math.nan


def features(x: np.ndarray) -> dict[str, np.ndarray]:
    """One row a series: what describes its shape and spectrum."""
    rms = math.sqrt((x**2).mean()) if len(x) else math.nan
    one = {"rms": rms, "crest": np.abs(x).max() / rms if rms else math.nan, "entropy": spectral_entropy(x), "dominant": dominant_frequency(x), "ar1": float(ar_model(x, 1)[0]), "hurst": hurst(x)}
    return {k: np.array([v], float) for k, v in one.items()}


def daubechies4(x: np.ndarray) -> dict[str, np.ndarray]:
    """One level of the four-tap wavelet on a periodic series of even length."""
    x = x[: len(x) // 2 * 2]
    s = math.sqrt(3)
    h = np.array([1 + s, 3 + s, 3 - s, 1 - s]) / (4 * math.sqrt(2))
    g = h[::-1] * [1, -1, 1, -1]
    wide = np.concatenate([x, x[:2]])
    rows = np.stack([wide[i : i + len(x) : 2] for i in range(4)]) if len(x) >= 2 else np.zeros((4, 0))
    return {"approx": h @ rows, "detail": g @ rows}


def cwt(x: np.ndarray, scales: tuple[float, ...] = (1, 2, 4, 8)) -> dict[str, np.ndarray]:
    """Continuous transform with the second derivative of a Gaussian."""
    out = []
    for a in scales:
        t = np.arange(-int(5 * a), int(5 * a) + 1) / a
        w = (1 - t**2) * np.exp(-(t**2) / 2) * 2 / (math.sqrt(3 * a) * math.pi**0.25)
        full = np.convolve(x, w)
        lo = (len(w) - 1) // 2
        out.append(full[lo : lo + len(x)])
    return {"scale": np.repeat(np.array(scales, float), len(x)), "value": np.concatenate(out) if len(x) else np.zeros(0)}


def vmd(x: np.ndarray, modes: int = 3, alpha: float = 2000.0, tolerance: float = 1e-7, rounds: int = 500) -> dict[str, np.ndarray]:
    """Band-limited modes of a series mirrored at both ends, each a Wiener filter around its own centre (cycles a sample)."""
    n = len(x)
    half = n // 2
    f = np.r_[x[:half][::-1], x, x[n - half :][::-1]] if half else x
    size = len(f)
    spectrum_ = np.fft.fft(f)
    w = np.fft.fftfreq(size)
    positive = w >= 0
    spectrum_ = np.where(positive, spectrum_, 0)
    u = np.zeros((modes, size), complex)
    centre = 0.5 / modes * np.arange(modes)
    for _ in range(rounds):
        change = 0.0
        for k in range(modes):
            rest = spectrum_ - u.sum(0) + u[k]
            new = np.where(positive, rest / (1 + 2 * alpha * (w - centre[k]) ** 2), 0)
            power = np.abs(new[positive]) ** 2
            centre[k] = (w[positive] @ power) / power.sum() if power.sum() > 0 else centre[k]
            change += (np.abs(new - u[k]) ** 2).sum() / max((np.abs(u[k]) ** 2).sum(), 1e-300)
            u[k] = new
        if change < tolerance:
            break
    order = np.argsort(centre, kind="stable")
    double = np.where(w > 0, 2.0, 1.0)
    out = np.real(np.fft.ifft(u * double, axis=1))[:, half : half + n]
    return {"mode": np.repeat(np.arange(modes), n), "i": np.tile(np.arange(n), modes), "centre": np.repeat(centre[order], n), "y": out[order].reshape(-1)}


def cqt(x: np.ndarray, fs: float = 1.0, fmin: float = 1 / 64, fmax: float | None = None, per_octave: int = 12, hop: int | None = None) -> dict[str, np.ndarray]:
    """Frames and bins in octave steps, all of one ratio of frequency to width; a bin's window is as long as its width asks."""
    fmax, hop = fmax or fs / 2, hop or max(1, round(fs / 100))
    bins = int(np.floor(per_octave * np.log2(fmax / fmin) + 1e-9)) + 1
    freq = fmin * 2.0 ** (np.arange(bins) / per_octave)
    freq = freq[freq < fs / 2 + 1e-12]
    q = 1 / (2 ** (1 / per_octave) - 1)
    at = np.arange(0, len(x), hop)
    frames, out = [], []
    for f in freq:
        n = int(np.ceil(q * fs / f))
        t = np.arange(n) - n // 2
        shape = np.hanning(n + 2)[1:-1]
        kernel = shape / shape.sum() * np.exp(-2j * np.pi * f / fs * t)
        p = np.r_[np.zeros(n // 2), x, np.zeros(n)]
        size = 1 << int(np.ceil(np.log2(len(p) + n)))
        y = np.fft.ifft(np.fft.fft(p, size) * np.conj(np.fft.fft(np.conj(kernel), size)))
        frames.append(np.abs(y[at]))
        out.append(np.full(len(at), f))
    return {"frame": np.tile(np.arange(len(at)), len(freq)), "freq": np.concatenate(out) if out else np.zeros(0), "magnitude": np.concatenate(frames) if frames else np.zeros(0)}
