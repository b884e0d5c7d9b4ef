"""Linear systems and filter design: small polynomials and matrices, applied to series by `signal.per_series`."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from metrolith.functions.special import expm_of


@dataclass(frozen=True)
class System:
    """Numerator and denominator, highest power first; `dt` is None for continuous time."""

    num: np.ndarray
    den: np.ndarray
    dt: float | None = None


def tf(num, den, dt: float | None = None) -> System:
    n, d = np.trim_zeros(np.atleast_1d(np.asarray(num, float)), "f"), np.trim_zeros(np.atleast_1d(np.asarray(den, float)), "f")
    if not len(d):
        raise ValueError("the denominator is zero")
    n = n if len(n) else np.zeros(1)
    return System(n / d[0], d / d[0], dt)


def zpk(zeros, poles, gain: float, dt: float | None = None) -> System:
    return tf(gain * np.real(np.poly(zeros)) if len(zeros) else [gain], np.real(np.poly(poles)) if len(poles) else [1.0], dt)


def zeros(s: System) -> np.ndarray:
    return np.roots(s.num)


def poles(s: System) -> np.ndarray:
    return np.roots(s.den)


def gain(s: System) -> float:
    """The leading factor of the zpk form."""
    return float(s.num[0])


def is_stable(s: System) -> bool:
    p = poles(s)
    return bool(np.all(p.real < 0) if s.dt is None else np.all(np.abs(p) < 1))


def dc_gain(s: System) -> float:
    at = 0.0 if s.dt is None else 1.0
    d = np.polyval(s.den, at)
    return float(np.polyval(s.num, at) / d) if abs(d) > 1e-14 else float("inf")


def in_series(a: System, b: System) -> System:
    return tf(np.polymul(a.num, b.num), np.polymul(a.den, b.den), a.dt)


def in_parallel(a: System, b: System) -> System:
    return tf(np.polyadd(np.polymul(a.num, b.den), np.polymul(b.num, a.den)), np.polymul(a.den, b.den), a.dt)


def feedback(a: System, b: System | None = None, sign: int = -1) -> System:
    """a / (1 - sign a b); without b, a unit return path."""
    b = b or tf([1.0], [1.0], a.dt)
    return tf(np.polymul(a.num, b.den), np.polysub(np.polymul(a.den, b.den), sign * np.polymul(a.num, b.num)), a.dt)


def to_ss(s: System) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Controllable canonical form."""
    n = len(s.den) - 1
    num = np.r_[np.zeros(n + 1 - len(s.num)), s.num]
    d = float(num[0])
    a = np.zeros((n, n))
    if n:
        a[0] = -s.den[1:]
        a[1:, :-1] = np.eye(n - 1)
    b = np.zeros((n, 1))
    b[:1] = 1.0
    return a, b, (num[1:] - d * s.den[1:]).reshape(1, n), d


def from_ss(a, b, c, d: float, dt: float | None = None) -> System:
    a, b, c = np.atleast_2d(a), np.asarray(b, float).reshape(-1, 1), np.asarray(c, float).reshape(1, -1)
    den = np.poly(a)
    return tf(np.real(np.poly(a - b @ c) + (d - 1) * den), np.real(den), dt)


def c2d(s: System, dt: float, method: str = "zoh") -> System:
    """Zero-order hold by the exponential of the augmented matrix, or Tustin's substitution."""
    if method == "tustin":
        return _bilinear(s, 2 / dt, dt)
    a, b, c, d = to_ss(s)
    n = len(a)
    m = np.zeros((n + 1, n + 1))
    m[:n, :n], m[:n, n:] = a * dt, b * dt
    e = expm_of(m)
    return from_ss(e[:n, :n], e[:n, n:], c, d, dt) if n else System(s.num, s.den, dt)


def _bilinear(s: System, k: float, dt: float | None) -> System:
    """s = k (z - 1) / (z + 1)."""
    n = max(len(s.num), len(s.den)) - 1

    def mapped(p: np.ndarray) -> np.ndarray:
        out = np.zeros(n + 1)
        for i, c in enumerate(p[::-1]):
            out = np.polyadd(out, c * k**i * np.polymul(np.poly([1.0] * i), np.poly([-1.0] * (n - i))))
        return out

    return tf(mapped(s.num), mapped(s.den), dt)


def d2c(s: System) -> System:
    """Back by Tustin's substitution: z = (1 + s dt/2) / (1 - s dt/2)."""
    n = max(len(s.num), len(s.den)) - 1
    h = s.dt / 2

    def mapped(p: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for i, c in enumerate(p[::-1]):
            term = np.ones(1)
            for _ in range(i):
                term = np.polymul(term, [h, 1.0])
            for _ in range(n - i):
                term = np.polymul(term, [-h, 1.0])
            out = np.polyadd(out, c * term)
        return out

    return tf(mapped(s.num), mapped(s.den))


def freqresp(s: System, w: np.ndarray) -> np.ndarray:
    """At angular frequencies w."""
    z = 1j * np.asarray(w) if s.dt is None else np.exp(1j * np.asarray(w) * s.dt)
    return np.polyval(s.num, z) / np.polyval(s.den, z)


def bode(s: System, w: np.ndarray) -> dict[str, np.ndarray]:
    h = freqresp(s, w)
    return {"w": np.asarray(w, float), "db": 20 * np.log10(np.abs(h)), "phase": np.degrees(np.unwrap(np.angle(h)))}


def lsim(s: System, u: np.ndarray, dt: float) -> np.ndarray:
    """Response to an input held between samples."""
    d = s if s.dt is not None else c2d(s, dt)
    a, b, c, k = to_ss(d)
    x, out = np.zeros(len(a)), np.empty(len(u))
    for i, v in enumerate(u):
        out[i] = (c @ x).item() + k * v if len(a) else k * v
        x = a @ x + b[:, 0] * v
    return out


def step(s: System, t: np.ndarray) -> np.ndarray:
    return lsim(s, np.ones(len(t)), float(t[1] - t[0]))


def impulse(s: System, t: np.ndarray) -> np.ndarray:
    """From the exponential of the state matrix; the direct term, a spike, is left out in continuous time."""
    if s.dt is not None:
        return lsim(s, np.r_[1.0, np.zeros(len(t) - 1)], s.dt)
    a, b, c, _ = to_ss(s)
    e, x, out = expm_of(a * float(t[1] - t[0])), b[:, 0], np.empty(len(t))
    for i in range(len(t)):
        out[i] = (c @ x).item()
        x = e @ x
    return out


def step_info(t: np.ndarray, y: np.ndarray, settle: float = 0.02) -> dict[str, float]:
    """Rise from 10 to 90 percent, settling, overshoot in percent, peak."""
    end = float(y[-1])
    first = lambda level: float(t[np.argmax(y / end >= level)])
    out = np.flatnonzero(np.abs(y - end) > settle * abs(end))
    return {"rise_time": first(0.9) - first(0.1), "settling_time": float(t[min(len(t) - 1, out[-1] + 1)]) if len(out) else 0.0, "overshoot": max(0.0, float((y / end).max() - 1) * 100), "peak": float(y[np.argmax(np.abs(y))]), "final": end}


def margins(s: System, w: np.ndarray) -> dict[str, float]:
    """Gain margin in dB and phase margin in degrees, with their frequencies; infinite where nothing crosses."""
    h = freqresp(s, w)
    db, ph = 20 * np.log10(np.abs(h)), np.degrees(np.unwrap(np.angle(h)))

    def cross(y: np.ndarray) -> float | None:
        i = np.flatnonzero((y[:-1] > 0) & (y[1:] <= 0))
        return float(i[0] + y[i[0]] / (y[i[0]] - y[i[0] + 1])) if len(i) else None

    at = lambda y, i: float(np.interp(i, np.arange(len(y)), y))
    g, p = cross(ph + 180), cross(db)
    inf = float("inf")
    return {"gain_margin": -at(db, g) if g is not None else inf, "gain_w": at(w, g) if g is not None else inf, "phase_margin": 180 + at(ph, p) if p is not None else inf, "phase_w": at(w, p) if p is not None else inf}


def pid(kp: float, ki: float, kd: float, dt: float, low: float = -np.inf, high: float = np.inf):
    """A step (state, error) -> (state, output) whose integral stops while the output is clipped."""

    def one(state: tuple[float, float], e: float) -> tuple[tuple[float, float], float]:
        total, last = state
        new = total + e * dt
        raw = kp * e + ki * new + kd * (e - last) / dt
        out = min(high, max(low, raw))
        return (new if raw == out else total, e), out

    return one


# filter design


def _to_digital(z: np.ndarray, p: np.ndarray, k: float, cut: float, kind: str) -> System:
    """A normalised analogue low-pass as digital low- or high-pass; `cut` is a share of the Nyquist frequency."""
    w = 4 * np.tan(np.pi * cut / 2)
    extra = len(p) - len(z)
    if kind == "high":
        k = k * float(np.real(np.prod(-z) / np.prod(-p)))
        z, p = np.r_[w / z, np.zeros(extra)] if len(z) else np.zeros(extra), w / p
    else:
        z, p, k = z * w, p * w, k * w**extra
    kd = float(np.real(k * np.prod(4 - z) / np.prod(4 - p)))
    zd = np.r_[(4 + z) / (4 - z), -np.ones(len(p) - len(z))]
    return zpk(zd, (4 + p) / (4 - p), kd, 1.0)


def cheby2(order: int, attenuation: float, cut: float, kind: str = "low") -> System:
    """Flat pass band; the stop band starts at `cut`, that many dB down."""
    e = 1 / np.sqrt(10 ** (attenuation / 10) - 1)
    mu = np.arcsinh(1 / e) / order
    m = np.arange(-order + 1, order, 2)
    z = np.delete(m, len(m) // 2) if order % 2 else m
    z = 1j / np.sin(z * np.pi / (2 * order))
    p = -np.exp(1j * np.pi * m / (2 * order))
    p = 1 / (np.sinh(mu) * p.real + 1j * np.cosh(mu) * p.imag)
    return _to_digital(z, p, float(np.real(np.prod(-p) / np.prod(-z))), cut, kind)


def bessel(order: int, cut: float, kind: str = "low") -> System:
    """Maximally flat delay (before the bilinear step); reverse Bessel polynomial, -3 dB at `cut`."""
    c = np.ones(1)
    before = np.ones(1)
    for n in range(1, order + 1):
        c, before = (np.array([1.0, 1.0]) if n == 1 else np.polyadd((2 * n - 1) * c, np.r_[before, 0, 0])), c
    p = np.roots(c)
    w = np.linspace(0.01, 5.0 * order, 200000)
    h = np.abs(c[-1] / np.polyval(c, 1j * w))
    p = p / w[np.argmax(h < 1 / np.sqrt(2))]
    return _to_digital(np.zeros(0), p, float(np.real(np.prod(-p))), cut, kind)


def buttord(wp: float, ws: float, ripple: float, attenuation: float) -> tuple[int, float]:
    """Least order of a low-pass and its -3 dB cut."""
    a, b = np.tan(np.pi * wp / 2), np.tan(np.pi * ws / 2)
    gp, gs = 10 ** (ripple / 10) - 1, 10 ** (attenuation / 10) - 1
    n = int(np.ceil(np.log10(gs / gp) / (2 * np.log10(b / a))))
    return n, float(2 / np.pi * np.arctan(a * gp ** (-1 / (2 * n))))


def cheb1ord(wp: float, ws: float, ripple: float, attenuation: float) -> tuple[int, float]:
    a, b = np.tan(np.pi * wp / 2), np.tan(np.pi * ws / 2)
    return int(np.ceil(np.arccosh(np.sqrt((10 ** (attenuation / 10) - 1) / (10 ** (ripple / 10) - 1))) / np.arccosh(b / a))), wp


def kaiser(n: int, beta: float) -> np.ndarray:
    return np.kaiser(n, beta)


def kaiserord(attenuation: float, width: float) -> tuple[int, float]:
    """Taps and beta for an attenuation in dB and a transition width as a share of the Nyquist frequency."""
    n = int(np.ceil((attenuation - 7.95) / (2.285 * np.pi * width) + 1))
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * (attenuation - 21) ** 0.4 + 0.07886 * (attenuation - 21) if attenuation > 21 else 0.0
    return n, float(beta)


def firls(n: int, bands: list[float], desired: list[float], weight: list[float] | None = None) -> np.ndarray:
    """Least-squares taps of odd length: bands as shares of the Nyquist frequency, gains linear within each."""
    m = (n - 1) // 2
    q, b = np.zeros((m + 1, m + 1)), np.zeros(m + 1)
    k = np.arange(m + 1)
    for i in range(0, len(bands), 2):
        f = np.linspace(bands[i], bands[i + 1], 4001)
        g = np.interp(f, bands[i : i + 2], desired[i : i + 2])
        w = np.full(len(f), (weight or [1.0] * (len(bands) // 2))[i // 2] * (f[1] - f[0]))
        w[[0, -1]] /= 2
        c = np.cos(np.pi * np.outer(f, k))
        q += c.T @ (c * w[:, None])
        b += c.T @ (w * g)
    a = np.linalg.solve(q, b)
    return np.r_[a[:0:-1] / 2, a[0], a[1:] / 2]


def sos(s: System) -> np.ndarray:
    """Second-order sections: conjugate pairs, then real roots two by two; the gain is in the first."""

    def pairs(r: np.ndarray, n: int) -> list[np.ndarray]:
        up = sorted(r[r.imag > 1e-10], key=abs)
        real = sorted(r[np.abs(r.imag) <= 1e-10].real, key=abs)
        out = [np.array([1.0, -2 * x.real, abs(x) ** 2]) for x in up]
        out += [np.poly(real[i : i + 2]) for i in range(0, len(real), 2)]
        out = [np.r_[x, np.zeros(3 - len(x))] for x in out]
        return out + [np.array([1.0, 0, 0])] * (n - len(out))

    n = (max(len(s.num), len(s.den))) // 2
    rows = np.array([np.r_[a, b] for a, b in zip(pairs(zeros(s), n), pairs(poles(s), n), strict=True)])
    rows[0, :3] *= gain(s)
    return rows


def sosfilt(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    from metrolith.operators.signal import lfilter

    for r in rows:
        x = lfilter(r[:3], r[3:], x)
    return x


def impz(b, a, n: int = 64) -> np.ndarray:
    from metrolith.operators.signal import lfilter

    return lfilter(np.asarray(b, float), np.asarray(a, float), np.r_[1.0, np.zeros(n - 1)])


def group_delay(b, a, n: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(angular frequency, delay in samples): the real part of the ramped over the plain response."""
    c = np.convolve(np.asarray(b, float), np.asarray(a, float)[::-1])
    w = np.linspace(0, np.pi, n, endpoint=False)
    z = np.exp(-1j * np.outer(w, np.arange(len(c))))
    return w, np.real((z @ (c * np.arange(len(c)))) / (z @ c)) - (len(a) - 1)


def allpass(c: float) -> tuple[np.ndarray, np.ndarray]:
    """First order: all frequencies at gain 1."""
    return np.array([c, 1.0]), np.array([1.0, c])


# elliptic filters


def agm(a: float, b: float) -> float:
    """Arithmetic-geometric mean."""
    while abs(a - b) > 4e-16 * a:
        a, b = (a + b) / 2, np.sqrt(a * b)
    return float(a)


def _incomplete(angle: float, k: float) -> float:
    """Elliptic integral of the first kind up to an angle, along the same means."""
    a, b, n = 1.0, np.sqrt(1 - k * k), 0
    while abs(a - b) > 1e-15 * a:
        angle += np.arctan(b / a * np.tan(angle)) + np.pi * np.floor(angle / np.pi + 0.5)
        a, b, n = (a + b) / 2, np.sqrt(a * b), n + 1
    return float(angle / (2**n * a))


def _cd(u: np.ndarray, k: float) -> np.ndarray:
    """Jacobi's cd at u quarter periods, by ascent from the cosine of a vanishing modulus."""
    steps = []
    while k > 1e-16:
        k = (k / (1 + np.sqrt(1 - k * k))) ** 2
        steps.append(k)
    w = np.cos(np.asarray(u) * np.pi / 2)
    for v in reversed(steps):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def ellip(order: int, ripple: float, attenuation: float, cut: float, kind: str = "low") -> System:
    """Equal ripple in both bands: `ripple` dB up to `cut`, `attenuation` dB beyond a transition as narrow as the order allows."""
    e, stop = np.sqrt(10 ** (ripple / 10) - 1), np.sqrt(10 ** (attenuation / 10) - 1)
    if not 0 < e < stop:
        raise ValueError("the attenuation exceeds the ripple, and the ripple is positive")
    k1 = e / stop
    k1c = np.sqrt(1 - k1 * k1)
    # the modulus of which the nome is the order-th root of that of k1
    q = np.exp(-np.pi * agm(1, k1c) / agm(1, k1) / order)
    m = np.arange(1, 40)
    k = float(4 * np.sqrt(q) * ((1 + np.sum(q ** (m * (m + 1.0)))) / (1 + 2 * np.sum(q ** (m * m * 1.0)))) ** 2)
    shift = _incomplete(np.arctan(1 / e), k1c) * 2 * agm(1, k1c) / np.pi / order
    u = (2 * np.arange(1, order // 2 + 1) - 1) / order
    z = 1j / (k * _cd(u, k))
    p = 1j * _cd(u - 1j * shift, k)
    z, p = np.r_[z, z.conj()], np.r_[p, p.conj()]
    if order % 2:
        p = np.r_[p, 1j * _cd(1 - 1j * shift, k)]
    level = 1.0 if order % 2 else 10 ** (-ripple / 20)
    return _to_digital(z, p, float(level * np.real(np.prod(-p) / np.prod(-z))), cut, kind)


def ellipord(wp: float, ws: float, ripple: float, attenuation: float) -> tuple[int, float]:
    """Least order of an elliptic low-pass, and its cut."""
    k = np.tan(np.pi * wp / 2) / np.tan(np.pi * ws / 2)
    k1 = np.sqrt((10 ** (ripple / 10) - 1) / (10 ** (attenuation / 10) - 1))
    ratio = lambda x: agm(1, x) / agm(1, np.sqrt(1 - x * x))
    return int(np.ceil(ratio(k1) ** -1 * ratio(k) - 1e-9)), wp


def remez(n: int, bands: list[float], desired: list[float], weight: list[float] | None = None, rounds: int = 60) -> np.ndarray:
    """Equiripple taps of odd length: bands as shares of the Nyquist frequency, one gain and weight a band."""
    if n % 2 == 0:
        raise ValueError("the length is odd")
    r = (n - 1) // 2 + 2
    per = [max(8, int(np.ceil(32 * r * (hi - lo)))) for lo, hi in zip(bands[::2], bands[1::2], strict=True)]
    grid = [np.linspace(lo, hi, k) for lo, hi, k in zip(bands[::2], bands[1::2], per, strict=True)]
    want = np.concatenate([np.full(len(g), d) for g, d in zip(grid, desired, strict=True)])
    w = np.concatenate([np.full(len(g), x) for g, x in zip(grid, weight or [1.0] * len(grid), strict=True)])
    edge = np.cumsum(per)[:-1]
    x = np.cos(np.pi * np.concatenate(grid))
    at = np.round(np.linspace(0, len(x) - 1, r)).astype(int)
    sign = (-1.0) ** np.arange(r)
    for _ in range(rounds):
        # cosine polynomial and level through the alternation
        c = np.column_stack([np.cos(np.outer(np.arccos(x[at]), np.arange(r - 1))), sign / w[at]])
        a = np.linalg.solve(c, want[at])
        error = w * (want - np.cos(np.outer(np.arccos(x), np.arange(r - 1))) @ a[:-1])
        size = np.abs(error)
        # extrema within each band, then one for each run of a sign
        peaks = []
        for lo, hi in zip(np.r_[0, edge], np.r_[edge, len(x)], strict=True):
            s = size[lo:hi]
            peaks += (lo + np.flatnonzero((s >= np.r_[-1, s[:-1]]) & (s >= np.r_[s[1:], -1]))).tolist()
        best = []
        for i in peaks:
            if best and np.sign(error[best[-1]]) == np.sign(error[i]):
                best[-1] = i if size[i] > size[best[-1]] else best[-1]
            else:
                best.append(i)
        while len(best) > r:
            if len(best) == r + 1 or size[best[0]] < size[best[-1]]:
                best.pop(0 if size[best[0]] < size[best[-1]] else -1)
            else:
                best.pop()
        if len(best) < r:
            break
        done = size[best].max() - size[best].min() <= 1e-6 * size[best].max()
        at = np.array(best)
        if done:
            break
    a = a[:-1]
    return np.r_[a[:0:-1] / 2, a[0], a[1:] / 2]
