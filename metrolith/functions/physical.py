"""Bits, encodings, paths, colours, waveforms, impedances and units as Column expressions.

Complex values are structs (re, im), as in `mathfn`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions import mathfn as M


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# bits


def get_bit(x, i: int) -> Column:
    return F.shiftright(_c(x), i).bitwiseAND(F.lit(1))


def set_bit(x, i: int) -> Column:
    return _c(x).bitwiseOR(F.lit(1 << i))


def clear_bit(x, i: int) -> Column:
    return _c(x).bitwiseAND(F.lit(~(1 << i)))


def toggle_bit(x, i: int) -> Column:
    return _c(x).bitwiseXOR(F.lit(1 << i))


def nand(a, b) -> Column:
    return ~(_c(a) & _c(b))


def nor(a, b) -> Column:
    return ~(_c(a) | _c(b))


def swap_endian(data, width: int = 4) -> Column:
    """Bytes reversed within each chunk of `width`; the last chunk may be shorter."""
    h = F.hex(_c(data))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(h) - 1) / (2 * width)).cast("int"))), lambda i: F.substr(h, i * 2 * width + 1, F.lit(2 * width)))
    turned = F.transform(parts, lambda p: F.array_join(F.reverse(F.regexp_extract_all(p, F.lit("(..)"))), ""))
    return F.unhex(F.array_join(turned, ""))


def reverse_bytes(data) -> Column:
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(_c(data)), F.lit("(..)"))), ""))


def pad_bytes(data, n: int) -> Column:
    """Zero bytes on the right up to n; longer data stays as it is."""
    b = _c(data).cast("binary")
    return F.when(F.octet_length(b) >= n, b).otherwise(F.rpad(b, n, b"\x00"))


# encodings and text


def base64_encode(s) -> Column:
    """One line, whatever chunks Spark makes."""
    return F.translate(F.base64(_c(s).cast("binary")), "\r\n", "")


def base64_decode(s) -> Column:
    return F.unbase64(_c(s))


def hex_encode(s) -> Column:
    return F.lower(F.hex(_c(s).cast("binary")))


def hex_decode(s) -> Column:
    return F.unhex(_c(s))


def sha256(s) -> Column:
    return F.sha2(_c(s), 256)


def nbytes(s) -> Column:
    return F.octet_length(_c(s))


def levenshtein(a, b) -> Column:
    return F.levenshtein(_c(a), _c(b))


def similar(a, b) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    n = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(n == 0, 1.0).otherwise(1 - levenshtein(a, b) / F.nullif(n, F.lit(0)))


def codepoints(s) -> Column:
    return F.transform(F.filter(F.split(_c(s), ""), lambda ch: ch != ""), F.ord if hasattr(F, "ord") else F.ascii)


def line_count(s) -> Column:
    """Lines by either ending; an ending at the end starts no further line."""
    return F.when(F.length(_c(s)) == 0, 0).otherwise(F.regexp_count(_c(s), F.lit(r"\r?\n")) + F.when(_c(s).endswith("\n"), 0).otherwise(1))


def line_at(s, i: int) -> Column:
    """Line i from 0; none beyond the end."""
    return F.try_element_at(F.split(_c(s), r"\r?\n"), F.lit(i + 1))


def indent(s, n: int = 4) -> Column:
    """Spaces before each line that is not blank."""
    return F.regexp_replace(_c(s), r"(?m)^(?=.*\S)", " " * n)


def dedent(s) -> Column:
    """The smallest indentation of the lines that are not blank, taken from all."""
    depth = F.array_min(F.transform(F.regexp_extract_all(_c(s), F.lit(r"(?m)^([ \t]*)\S"), 1), F.length))
    rows = F.transform(F.split(_c(s), "\n"), lambda r: F.when(F.length(F.ltrim(r)) == 0, F.lit("")).otherwise(F.substr(r, F.coalesce(depth, F.lit(0)) + 1)))
    return F.array_join(rows, "\n")


def strip_ansi(s) -> Column:
    return F.regexp_replace(_c(s), "\x1b\\[[0-9;?]*[A-Za-z]", "")


def path_name(p) -> Column:
    return F.regexp_extract(_c(p), r"([^/]*)/?$", 1)


def path_parent(p) -> Column:
    return F.regexp_extract(_c(p), r"^(.*?)/?[^/]*/?$", 1)


def path_extension(p) -> Column:
    return F.regexp_extract(path_name(p), r"[^.](\.[^.]*)$", 1)


def path_stem(p) -> Column:
    return F.regexp_replace(path_name(p), r"(?<=[^.])\.[^.]*$", "")


def path_join(*parts) -> Column:
    """Joined by one slash each; a later absolute part starts again."""
    return reduce(lambda a, b: F.when(b.startswith("/") | (a == ""), b).otherwise(F.concat(F.rtrim(a, F.lit("/")), F.lit("/"), b)), [_c(p) for p in parts])


# colours: channels of 0..1, hue in degrees


def rgb_hsv(r, g, b) -> Column:
    r, g, b = _c(r), _c(g), _c(b)
    v, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    safe = F.nullif(d, F.lit(0.0))
    turn = F.when(d == 0, 0.0).when(v == r, F.pmod((g - b) / safe, F.lit(6.0))).when(v == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
    return F.struct((turn * 60).alias("h"), F.when(v == 0, 0.0).otherwise(d / F.nullif(v, F.lit(0.0))).alias("s"), v.alias("v"))


def hsv_rgb(h, s, v) -> Column:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + _c(h) / 60, F.lit(6.0))
        return _c(v) - _c(v) * _c(s) * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def rgb_hsl(r, g, b) -> Column:
    hi, lo = F.greatest(_c(r), _c(g), _c(b)), F.least(_c(r), _c(g), _c(b))
    light = (hi + lo) / 2
    room = 1 - F.abs(2 * light - 1)
    return F.struct(rgb_hsv(r, g, b)["h"].alias("h"), F.when(room == 0, 0.0).otherwise((hi - lo) / F.nullif(room, F.lit(0.0))).alias("s"), light.alias("l"))


def rgb_cmyk(r, g, b) -> Column:
    k = 1 - F.greatest(_c(r), _c(g), _c(b))
    part = lambda x: F.when(k == 1, 0.0).otherwise((1 - _c(x) - k) / F.nullif(1 - k, F.lit(0.0)))
    return F.struct(part(r).alias("c"), part(g).alias("m"), part(b).alias("y"), k.alias("k"))


def luma(r, g, b) -> Column:
    """Rec. 601 weights."""
    return _c(r) * 0.299 + _c(g) * 0.587 + _c(b) * 0.114


#: Linear sRGB to XYZ (D65), and the white point.
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_WHITE = (0.95047, 1.0, 1.08883)


def rgb_lab(r, g, b) -> Column:
    """CIE Lab under D65."""
    lin = [F.when(_c(x) <= 0.04045, _c(x) / 12.92).otherwise(F.pow((_c(x) + 0.055) / 1.055, F.lit(2.4))) for x in (r, g, b)]
    xyz = [sum((w * x for w, x in zip(row, lin, strict=True)), F.lit(0.0)) / n for row, n in zip(_XYZ, _WHITE, strict=True)]
    f = [F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t * (29 / 6) ** 2 / 3 + 4 / 29) for t in xyz]
    return F.struct((116 * f[1] - 16).alias("L"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def delta_e(p: Column, q: Column) -> Column:
    """CIE76: the distance of two Lab structs."""
    return F.sqrt(sum(((p[k] - q[k]) * (p[k] - q[k]) for k in ("L", "a", "b")), F.lit(0.0)))


# waveforms of a time in seconds: a signal of any length is one projection of spark.range


def sine(t, freq: float, phase: float = 0.0, amplitude: float = 1.0) -> Column:
    return amplitude * F.sin(2 * math.pi * freq * _c(t) + phase)


def _turn(t, freq: float) -> Column:
    x = _c(t) * freq
    return x - F.floor(x)


def square(t, freq: float, duty: float = 0.5) -> Column:
    return F.when(_turn(t, freq) < duty, 1.0).otherwise(-1.0)


def sawtooth(t, freq: float) -> Column:
    return 2 * _turn(t, freq) - 1


def triangle(t, freq: float) -> Column:
    """-1 at the start of a period, 1 in its middle."""
    return 1 - 4 * F.abs(_turn(t, freq) - 0.5)


def chirp(t, f0: float, f1: float, length: float) -> Column:
    """Linear sweep over `length` seconds."""
    return F.sin(2 * math.pi * (f0 * _c(t) + (f1 - f0) / (2 * length) * _c(t) * _c(t)))


def multisine(t, freqs: list[float], amps: list[float], phases: list[float] | None = None) -> Column:
    return sum((a * F.cos(2 * math.pi * f * _c(t) + p) for f, a, p in zip(freqs, amps, phases or [0.0] * len(freqs), strict=True)), F.lit(0.0))


def pwm(modulator, t, carrier: float) -> Column:
    """1 while the modulator is above a triangular carrier."""
    return F.when(_c(modulator) > triangle(t, carrier), 1.0).otherwise(0.0)


def adc(x, bits: int = 12, low: float = -1.0, high: float = 1.0) -> Column:
    """The value that a converter of so many bits reads: clipped, then the nearest of its levels."""
    step = (high - low) / ((1 << bits) - 1)
    return low + F.round((F.greatest(F.lit(low), F.least(F.lit(high), _c(x))) - low) / step) * step


# impedances at an angular frequency w


def _polar(r: Column, a: Column) -> Column:
    return M.complex_(r * F.cos(a), r * F.sin(a))


def _size(z: Column) -> Column:
    return F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])


def cpow(z: Column, p: float) -> Column:
    """Principal power."""
    return M.let(z, lambda q: _polar(F.pow(_size(q), F.lit(float(p))), F.atan2(q["im"], q["re"]) * p))


def cdiv(a: Column, b: Column) -> Column:
    return M.let(F.struct(a.alias("a"), b.alias("b")), lambda s: M.let(
        F.struct((s["b"]["re"] * s["b"]["re"] + s["b"]["im"] * s["b"]["im"]).alias("d"), s["a"].alias("a"), s["b"].alias("b")),
        lambda t: M.complex_((t["a"]["re"] * t["b"]["re"] + t["a"]["im"] * t["b"]["im"]) / t["d"], (t["a"]["im"] * t["b"]["re"] - t["a"]["re"] * t["b"]["im"]) / t["d"]),
    ))


def cadd(*z: Column) -> Column:
    return M.complex_(sum((x["re"] for x in z), F.lit(0.0)), sum((x["im"] for x in z), F.lit(0.0)))


def cscale(z: Column, k) -> Column:
    return M.complex_(z["re"] * k, z["im"] * k)


def ctanh(z: Column) -> Column:
    """Through exp(-2 |Re z|), which does not overflow."""

    def at(q: Column) -> Column:
        s = F.when(q["re"] < 0, -1.0).otherwise(1.0)
        e = F.exp(-2 * F.abs(q["re"]))
        a = -2 * s * q["im"]
        x, y = e * F.cos(a), e * F.sin(a)
        t = cdiv(M.complex_(1 - x, -y), M.complex_(1 + x, y))
        return cscale(t, s)

    return M.let(z, at)


def _one() -> Column:
    return M.complex_(F.lit(1.0), F.lit(0.0))


def resistor(r: float) -> Callable[[Column], Column]:
    return lambda w: M.complex_(F.lit(float(r)), F.lit(0.0))


def capacitor(c: float) -> Callable[[Column], Column]:
    return lambda w: M.complex_(F.lit(0.0), -1 / (w * c))


def inductor(h: float) -> Callable[[Column], Column]:
    return lambda w: M.complex_(F.lit(0.0), w * h)


def cpe(q: float, n: float) -> Callable[[Column], Column]:
    """1 / (q (jw)^n)."""
    return lambda w: _polar(F.pow(w, F.lit(-float(n))) / q, F.lit(-n * math.pi / 2))


def warburg(a: float) -> Callable[[Column], Column]:
    return lambda w: M.complex_(a / F.sqrt(w), -a / F.sqrt(w))


def _root(w: Column, tau: float) -> Column:
    return _polar(F.sqrt(w * tau), F.lit(math.pi / 4))


def warburg_open(r: float, tau: float) -> Callable[[Column], Column]:
    """r coth(x) / x with x = sqrt(jw tau)."""
    return lambda w: cdiv(M.complex_(F.lit(float(r)), F.lit(0.0)), M.cmul(_root(w, tau), ctanh(_root(w, tau))))


def warburg_short(r: float, tau: float) -> Callable[[Column], Column]:
    """r tanh(x) / x with x = sqrt(jw tau)."""
    return lambda w: cscale(cdiv(ctanh(_root(w, tau)), _root(w, tau)), float(r))


def gerischer(z: float, k: float) -> Callable[[Column], Column]:
    return lambda w: cscale(cpow(M.complex_(F.lit(float(k)), w), -0.5), float(z))


def havriliak_negami(r: float, tau: float, a: float, g: float) -> Callable[[Column], Column]:
    return lambda w: cscale(cpow(cadd(_one(), _polar(F.pow(w * tau, F.lit(float(a))), F.lit(a * math.pi / 2))), -g), float(r))


def porous(r: float, q: float, n: float) -> Callable[[Column], Column]:
    """sqrt(r z) / tanh(sqrt(r / z)) with z the impedance of a constant-phase element."""
    z = cpe(q, n)
    return lambda w: cdiv(cpow(cscale(z(w), float(r)), 0.5), ctanh(cpow(cdiv(M.complex_(F.lit(float(r)), F.lit(0.0)), z(w)), 0.5)))


def series(*parts: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda w: cadd(*[p(w) for p in parts])


def parallel(*parts: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda w: cdiv(_one(), cadd(*[cdiv(_one(), p(w)) for p in parts]))


def impedance(circuit: Callable[[Column], Column], freq) -> Column:
    """Of a circuit at a frequency in Hz."""
    return circuit(2 * math.pi * _c(freq))


def reflection_coefficient(z: Column, z0: float = 50.0) -> Column:
    return M.let(z, lambda q: cdiv(M.complex_(q["re"] - z0, q["im"]), M.complex_(q["re"] + z0, q["im"])))


def impedance_from_reflection(g: Column, z0: float = 50.0) -> Column:
    return M.let(g, lambda q: cscale(cdiv(M.complex_(1 + q["re"], q["im"]), M.complex_(1 - q["re"], -q["im"])), z0))


def vswr(g: Column) -> Column:
    """Infinite for total reflection."""
    return M.let(_size(g), lambda m: M.div(1 + m, 1 - m))


def return_loss(g: Column) -> Column:
    return -20 * M.log10(_size(g))


def mismatch_loss(g: Column) -> Column:
    return M.let(_size(g), lambda m: -10 * M.log10(1 - m * m))


# units: factor to the base unit of a quantity

#: Fixed values by quantity.
UNITS = {
    "length": {"m": 1.0, "cm": 0.01, "mm": 0.001, "um": 1e-6, "km": 1000.0, "inch": 0.0254, "pt": 0.0254 / 72},
    "time": {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "min": 60.0, "h": 3600.0},
    "voltage": {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "kV": 1e3},
    "current": {"A": 1.0, "mA": 1e-3, "uA": 1e-6},
    "pressure": {"Pa": 1.0, "kPa": 1e3, "bar": 1e5, "mbar": 100.0},
    "frequency": {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9},
    "angle": {"rad": 1.0, "deg": math.pi / 180},
}


def convert_unit(x, old: str, new: str) -> Column:
    """Within one quantity; other pairs are errors."""
    for table in UNITS.values():
        if old in table and new in table:
            return _c(x) * (table[old] / table[new])
    raise ValueError(f"no conversion from {old} to {new}")


def apply_calibration_curve(x, raw: list[float], physical: list[float]) -> Column:
    """Piecewise linear between the points, NaN outside them."""
    out = F.lit(float("nan"))
    for a, b, p, q in zip(raw, raw[1:], physical, physical[1:], strict=False):
        out = F.when((_c(x) >= a) & (_c(x) <= b), p + (_c(x) - a) * ((q - p) / (b - a))).otherwise(out)
    return out
