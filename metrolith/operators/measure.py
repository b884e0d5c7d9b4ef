"""Measures of whole signals: purity of tones, pulses and steps, frames, decompositions; codes and bus frames."""

from __future__ import annotations

import math

import numpy as np

from metrolith.operators.signal import window


def tone(x: np.ndarray, fs: float = 1.0, harmonics: int = 6, lobe: int = 3) -> dict[str, np.ndarray]:
    """snr, sinad, sfdr, thd+n in dB and effective bits of the strongest tone, from one windowed spectrum."""
    n = len(x)
    if n < 16:
        return {k: np.array([np.nan]) for k in ("freq", "snr", "sinad", "sfdr", "thd_n", "enob")}
    p = np.abs(np.fft.rfft((x - x.mean()) * window("blackman", n))) ** 2
    p[: lobe + 1] = 0
    top = int(p.argmax())
    near = lambda k: slice(max(0, k - lobe), k + lobe + 1)
    signal, rest = p[near(top)].sum(), p.copy()
    rest[near(top)] = 0
    spur, noise = rest.max(), rest.copy()
    for h in range(2, harmonics + 1):
        k = (top * h) % n
        noise[near(k if k <= n // 2 else n - k)] = 0
    db = lambda a, b: 10 * math.log10(a / b) if a > 0 and b > 0 else math.inf
    sinad = db(signal, rest.sum())
    return {k: np.array([v]) for k, v in (("freq", top * fs / n), ("snr", db(signal, noise.sum())), ("sinad", sinad), ("sfdr", db(p[top], spur)), ("thd_n", -sinad), ("enob", (sinad - 1.76) / 6.02))}


def measure_snr(clean: np.ndarray, noisy: np.ndarray) -> float:
    e = ((noisy - clean) ** 2).sum()
    return 10 * math.log10((clean**2).sum() / e) if e else math.inf


def band_power(x: np.ndarray, fs: float, low: float, high: float) -> float:
    """A tone of amplitude A inside the band reads A**2 / 2."""
    s, f = np.abs(np.fft.rfft(x)) ** 2 / len(x) ** 2, np.fft.rfftfreq(len(x), 1 / fs)
    two = np.where((f > 0) & (f < fs / 2), 2.0, 1.0)
    return float((s * two)[(f >= low) & (f <= high)].sum())


def band_zero(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    s, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / fs)
    return np.fft.irfft(np.where((f >= low) & (f <= high), 0, s), len(x))


def short_time_energy(x: np.ndarray, n: int = 256, hop: int | None = None) -> np.ndarray:
    hop = hop or max(1, n // 2)
    c = np.r_[0, np.cumsum(x * x)]
    at = np.arange(0, max(1, len(x) - n + 1), hop)
    return c[np.minimum(at + n, len(x))] - c[at]


def _cross(x: np.ndarray, level: float, up: bool = True) -> np.ndarray:
    """Interpolated places where a level is passed."""
    a, b = (x[:-1], x[1:]) if up else (-x[:-1], -x[1:])
    v = level if up else -level
    i = np.flatnonzero((a < v) & (b >= v))
    return i + (v - a[i]) / (b[i] - a[i])


def transition_time(x: np.ndarray, low: float = 0.1, high: float = 0.9, rising: bool = True) -> float:
    """Samples of the first complete transition between two shares of the range; NaN without one."""
    y = x if rising else -x
    lo, hi = y.min() + low * np.ptp(y), y.min() + high * np.ptp(y)
    starts, ends = _cross(y, lo), _cross(y, hi)
    for e in ends:
        s = starts[starts <= e]
        if len(s):
            return float(e - s[-1])
    return math.nan


def overshoot(x: np.ndarray, tail: float = 0.1) -> tuple[float, float]:
    """(overshoot, undershoot) in percent of the step, whose final level is the mean of the last part."""
    end, start = float(x[-max(1, int(len(x) * tail)) :].mean()), float(x[0])
    size = abs(end - start)
    if not size:
        return 0.0, 0.0
    s = 1 if end > start else -1
    return max(0.0, float((s * (x - end)).max())) / size * 100, max(0.0, float((s * (start - x)).max())) / size * 100


def pulses(x: np.ndarray, level: float | None = None) -> dict[str, np.ndarray]:
    """Mean width, period, frequency, duty cycle and count of complete pulses, in samples."""
    v = float((x.min() + x.max()) / 2) if level is None else level
    up, down = _cross(x, v), _cross(x, v, False)
    width = [down[down > u][0] - u for u in up if (down > u).any()]
    period = float(np.diff(up).mean()) if len(up) > 1 else math.nan
    w = float(np.mean(width)) if width else math.nan
    return {k: np.array([float(q)]) for k, q in (("width", w), ("period", period), ("frequency", 1 / period if period == period else math.nan), ("duty", w / period if period == period else math.nan), ("count", len(width)))}


def hilbert(x: np.ndarray) -> np.ndarray:
    """Analytic signal."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def instantaneous_frequency(x: np.ndarray, fs: float = 1.0) -> np.ndarray:
    return np.diff(np.unwrap(np.angle(hilbert(x)))) * fs / (2 * np.pi)


def csd(x: np.ndarray, y: np.ndarray, fs: float = 1.0, n: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(freq, cross spectrum, both own spectra): averaged half-overlapped frames."""
    n = min(n, len(x))
    w, at = window("hann", n), range(0, len(x) - n + 1, max(1, n // 2))
    a = np.array([np.fft.rfft((x[i : i + n] - x[i : i + n].mean()) * w) for i in at])
    b = np.array([np.fft.rfft((y[i : i + n] - y[i : i + n].mean()) * w) for i in at])
    k = fs * (w**2).sum()
    return np.fft.rfftfreq(n, 1 / fs), (a.conj() * b).mean(0) / k, (np.abs(a) ** 2).mean(0) / k, (np.abs(b) ** 2).mean(0) / k


def coherence(x: np.ndarray, y: np.ndarray, fs: float = 1.0, n: int = 256) -> tuple[np.ndarray, np.ndarray]:
    f, xy, xx, yy = csd(x, y, fs, n)
    d = xx * yy
    return f, np.where(d > 0, np.abs(xy) ** 2 / np.where(d > 0, d, 1), 0.0)


def mel_filters(fs: float, n: int, bands: int = 40) -> np.ndarray:
    """Triangles evenly spaced in mel over the bins of a real transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(fs / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n, 1 / fs)
    up = (f[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_spectrogram(x: np.ndarray, fs: float, n: int = 256, hop: int = 128, bands: int = 40) -> np.ndarray:
    w = window("hann", n)
    frames = np.array([np.abs(np.fft.rfft(x[i : i + n] * w)) ** 2 for i in range(0, len(x) - n + 1, hop)])
    return frames @ mel_filters(fs, n, bands).T


def resample(x: np.ndarray, up: int, down: int, taps: int = 60) -> np.ndarray:
    """Rate times up / down: zeros between samples, one windowed-sinc low-pass, every down-th sample."""
    cut = 1 / max(up, down)
    k = np.arange(-taps // 2, taps // 2 + 1)
    h = np.sinc(k * cut) * cut * window("hamming", len(k))
    h *= up / h.sum()
    z = np.zeros(len(x) * up)
    z[::up] = x
    return np.convolve(z, h)[len(k) // 2 : len(k) // 2 + len(z)][::down]


def emd(x: np.ndarray, modes: int = 4, sifts: int = 10) -> list[np.ndarray]:
    """Intrinsic modes and the rest; envelopes are lines through the extremes. The parts sum to x."""
    out, rest, t = [], np.asarray(x, float), np.arange(len(x))
    for _ in range(modes):
        h = rest.copy()
        hi = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] >= h[2:])) + 1
        if len(hi) < 3:
            break
        for _ in range(sifts):
            hi = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] >= h[2:])) + 1
            lo = np.flatnonzero((h[1:-1] < h[:-2]) & (h[1:-1] <= h[2:])) + 1
            if len(hi) < 2 or len(lo) < 2:
                break
            h = h - (np.interp(t, hi, h[hi]) + np.interp(t, lo, h[lo])) / 2
        out.append(h)
        rest = rest - h
    return [*out, rest]


def beamform(x: np.ndarray, delays: np.ndarray) -> np.ndarray:
    """Channels (rows) advanced by fractional delays in samples and averaged."""
    f = np.fft.rfftfreq(x.shape[1])
    return np.fft.irfft((np.fft.rfft(x, axis=1) * np.exp(2j * np.pi * np.outer(delays, f))).mean(0), x.shape[1])


def steer_delays(positions: np.ndarray, angle: float, fs: float, speed: float = 343.0) -> np.ndarray:
    """Of a line of sensors for a plane wave at an angle from its normal."""
    return np.asarray(positions) * math.sin(angle) / speed * fs


def lms(x: np.ndarray, d: np.ndarray, taps: int = 8, mu: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(error, weights) of an adaptive filter; its weights are the whole state."""
    w, buf, e = np.zeros(taps), np.zeros(taps), np.empty(len(x))
    for i, v in enumerate(x):
        buf = np.r_[v, buf[:-1]]
        e[i] = d[i] - w @ buf
        w = w + 2 * mu * e[i] * buf
    return e, w


# codes


def crc(data: bytes, width: int, poly: int, init: int = 0, final: int = 0, reflected: bool = False) -> int:
    """Any cyclic check of 8 bits and more, bit by bit."""
    mask, r = (1 << width) - 1, init
    for byte in data:
        b = int(f"{byte:08b}"[::-1], 2) if reflected else byte
        r ^= b << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r >> (width - 1) & 1 else r << 1) & mask
    return (int(f"{r:0{width}b}"[::-1], 2) if reflected else r) ^ final


_PARITY = ((0, 1, 3), (0, 2, 3), (1, 2, 3))


def hamming74_encode(bits: np.ndarray) -> np.ndarray:
    """Blocks of four bits as p1 p2 d1 p3 d2 d3 d4."""
    d = np.asarray(bits, int).reshape(-1, 4)
    p = np.array([d[:, list(k)].sum(1) % 2 for k in _PARITY]).T
    return np.column_stack([p[:, 0], p[:, 1], d[:, 0], p[:, 2], d[:, 1:]]).reshape(-1)


def hamming74_decode(bits: np.ndarray) -> tuple[np.ndarray, int]:
    """(data bits, corrected bits); one wrong bit a block is put right."""
    c = np.asarray(bits, int).reshape(-1, 7).copy()
    place = np.arange(1, 8)
    at = sum((c[:, (place & (1 << k)) > 0].sum(1) % 2) << k for k in range(3))
    bad = np.flatnonzero(at)
    c[bad, at[bad] - 1] ^= 1
    return c[:, [2, 4, 5, 6]].reshape(-1), len(bad)


def _grid(order: int) -> np.ndarray:
    """Gray-coded square constellation of unit mean power."""
    m = int(round(math.sqrt(order)))
    level = 2 * np.arange(m) - m + 1.0
    gray = np.arange(m) ^ (np.arange(m) >> 1)
    axis = np.empty(m)
    axis[gray] = level
    p = axis[np.arange(order) // m] + 1j * axis[np.arange(order) % m]
    return p / np.sqrt((np.abs(p) ** 2).mean())


def qam_modulate(symbols: np.ndarray, order: int = 16) -> np.ndarray:
    return _grid(order)[np.asarray(symbols, int)]


def qam_demodulate(z: np.ndarray, order: int = 16) -> np.ndarray:
    return np.abs(np.asarray(z)[:, None] - _grid(order)[None, :]).argmin(1)


def decode_uart(x: np.ndarray, samples: float, bits: int = 8, level: float = 0.5) -> list[int]:
    """Frames on an idle-high line: start bit low, bits from the least, stop bit high (others are dropped)."""
    on, i, out = x > level, 1, []
    while i < len(on):
        if on[i - 1] and not on[i]:
            mid = [int(i + samples * (k + 0.5)) for k in range(bits + 2)]
            if mid[-1] >= len(on):
                break
            v = [bool(on[k]) for k in mid]
            if not v[0] and v[-1]:
                out.append(sum(b << k for k, b in enumerate(v[1:-1])))
                i = mid[-1]
        i += 1
    return out


def decode_spi(clock: np.ndarray, data: np.ndarray, bits: int = 8, level: float = 0.5) -> list[int]:
    """Data read at rising clock edges, highest bit first."""
    edge = np.flatnonzero((clock[1:] > level) & (clock[:-1] <= level)) + 1
    v = (data[edge] > level).astype(int)
    v = v[: len(v) // bits * bits].reshape(-1, bits)
    return [int("".join(map(str, r)), 2) for r in v]


def decode_i2c(scl: np.ndarray, sda: np.ndarray, level: float = 0.5) -> list[tuple[str, int]]:
    """Events ('start', 0), ('byte', value), ('ack' or 'nack', 0), ('stop', 0)."""
    c, d, out, bits = scl > level, sda > level, [], []
    for i in range(1, len(c)):
        if c[i] and c[i - 1] and d[i] != d[i - 1]:
            out.append(("stop" if d[i] else "start", 0))
            bits = []
        elif c[i] and not c[i - 1]:
            bits.append(int(d[i]))
            if len(bits) == 9:
                out += [("byte", int("".join(map(str, bits[:8])), 2)), ("nack" if bits[8] else "ack", 0)]
                bits = []
    return out
