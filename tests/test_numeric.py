"""Control systems, filter design and solvers against closed forms and identities; image kernels against small cases."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolith.functions import physical as H
from metrolith.functions import special as P
from metrolith.operators import control as C
from metrolith.operators import image
from metrolith.operators import learn as L
from metrolith.operators import measure as M
from metrolith.operators import nn as N
from metrolith.operators import signal
from metrolith.operators import solve as S
from metrolith.sources import documents as D


def test_first_order_system():
    s = C.tf([2.0], [0.5, 1.0])
    t = np.linspace(0, 3, 301)
    assert C.step(s, t) == pytest.approx(2 * (1 - np.exp(-t / 0.5)), abs=1e-9)
    assert C.impulse(s, t) == pytest.approx(4 * np.exp(-t / 0.5), abs=1e-9)
    assert C.dc_gain(s) == pytest.approx(2) and C.is_stable(s) and C.poles(s) == pytest.approx([-2.0])
    b = C.bode(s, np.array([2.0]))
    assert b["db"][0] == pytest.approx(20 * np.log10(2 / np.sqrt(2))) and b["phase"][0] == pytest.approx(-45)


def test_systems_combine_and_convert():
    a, b = C.tf([1.0], [1.0, 2.0]), C.tf([3.0], [1.0, 0.0])
    w = np.array([0.3, 1.0, 4.0])
    ga, gb = C.freqresp(a, w), C.freqresp(b, w)
    assert C.freqresp(C.in_series(a, b), w) == pytest.approx(ga * gb)
    assert C.freqresp(C.in_parallel(a, b), w) == pytest.approx(ga + gb)
    assert C.freqresp(C.feedback(a, b), w) == pytest.approx(ga / (1 + ga * gb))
    s = C.tf([1.0, 3.0], [1.0, 2.0, 5.0])
    back = C.from_ss(*C.to_ss(s))
    assert back.num == pytest.approx(s.num) and back.den == pytest.approx(s.den)
    d = C.d2c(C.c2d(s, 0.05, "tustin"))
    assert C.freqresp(d, w) == pytest.approx(C.freqresp(s, w))
    z = C.zpk(C.zeros(s), C.poles(s), C.gain(s))
    assert z.num == pytest.approx(s.num) and z.den == pytest.approx(s.den)


def test_margins_and_step_measures():
    m = C.margins(C.tf([4.0], [1.0, 3.0, 3.0, 1.0]), np.logspace(-2, 2, 20001))
    assert m["gain_margin"] == pytest.approx(20 * np.log10(2), abs=1e-3) and m["gain_w"] == pytest.approx(np.sqrt(3), abs=1e-3)
    zeta = 0.5
    t = np.linspace(0, 40, 8001)
    info = C.step_info(t, C.step(C.tf([1.0], [1.0, 2 * zeta, 1.0]), t))
    assert info["overshoot"] == pytest.approx(100 * np.exp(-np.pi * zeta / np.sqrt(1 - zeta**2)), abs=0.01)


def test_integral_part_stops_while_clipped():
    one = C.pid(1.0, 1.0, 0.0, 1.0, -2.0, 2.0)
    state, out = one((0.0, 0.0), 10.0)
    assert out == 2.0 and state[0] == 0.0
    assert one((0.0, 0.0), 0.5)[1] == pytest.approx(1.0)


@pytest.mark.parametrize("kind", ["low", "high"])
def test_filter_designs_meet_their_marks(kind):
    at = lambda s, f: abs(C.freqresp(s, np.array([np.pi * f]))[0])
    keep, stop = (0.0, 1.0) if kind == "low" else (1.0, 0.0)
    for s in (C.cheby2(4, 40.0, 0.4, kind), C.bessel(4, 0.4, kind)):
        assert C.is_stable(s) and at(s, keep) == pytest.approx(1, abs=1e-6) and at(s, stop) < 0.011
    assert at(C.cheby2(5, 40.0, 0.4, kind), 0.4) == pytest.approx(0.01, rel=1e-6)
    assert at(C.bessel(4, 0.4, kind), 0.4) == pytest.approx(np.sqrt(0.5), rel=1e-3)


def test_sections_taps_delay():
    s = C.cheby2(5, 40.0, 0.3)
    x = np.sin(np.arange(80) ** 1.3)
    assert C.sosfilt(C.sos(s), x) == pytest.approx(signal.lfilter(s.num, s.den, x), abs=1e-9)
    h = C.firls(31, [0, 0.3, 0.45, 1], [1, 1, 0, 0])
    w, d = C.group_delay(h, [1.0], 16)
    assert h == pytest.approx(h[::-1]) and h.sum() == pytest.approx(1, abs=0.01) and d[:4] == pytest.approx(15, abs=1e-6)
    b, a = C.allpass(0.4)
    z = np.exp(1j * np.linspace(0, 3, 9))
    assert np.abs(np.polyval(b, z) / np.polyval(a, z)) == pytest.approx(1)
    assert C.impz([1.0], [1.0, -0.5], 4) == pytest.approx([1, 0.5, 0.25, 0.125])
    n, c = C.buttord(0.2, 0.4, 1.0, 40.0)
    f = lambda w: 1 / (1 + (np.tan(np.pi * w / 2) / np.tan(np.pi * c / 2)) ** (2 * n))
    assert f(0.2) == pytest.approx(10**-0.1) and f(0.4) <= 1e-4
    assert C.cheb1ord(0.2, 0.4, 1.0, 40.0)[0] <= n and C.kaiserord(60.0, 0.1)[1] == pytest.approx(5.65326)


def test_roots_minima_integrals():
    assert S.fzero(lambda x: x**3 - 2, 0, 2) == pytest.approx(2 ** (1 / 3))
    assert S.fminbnd(lambda x: (x - 1.25) ** 2, 0, 4) == pytest.approx(1.25, abs=1e-6)
    assert S.quad(np.exp, 0, 1) == pytest.approx(np.e - 1) and S.quad(lambda x: abs(x - 0.3), 0, 1) == pytest.approx(0.29)
    assert S.integral2(lambda x, y: x * y, 0, 1, 0, 2) == pytest.approx(1)
    banana = lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2
    assert S.minimize(banana, [-1.2, 1.0]) == pytest.approx([1, 1], abs=1e-4)
    assert S.gradient(banana, np.array([1.0, 1.0])) == pytest.approx([0, 0], abs=1e-6)
    assert S.hessian(banana, np.array([1.0, 1.0])) == pytest.approx(np.array([[802, -400], [-400, 200]]), rel=1e-3)
    assert S.fsolve(lambda p: np.array([p[0] + p[1] - 3, p[0] * p[1] - 2]), [5.0, 0.0]) == pytest.approx([2, 1], abs=1e-8)
    t = np.linspace(0, 4, 50)
    assert S.curve_fit(lambda t, a, k: a * np.exp(-k * t), t, 3 * np.exp(-0.7 * t), [1.0, 1.0]) == pytest.approx([3, 0.7])


def test_differential_equations():
    t, y = S.ode45(lambda t, y: np.array([y[1], -y[0]]), (0.0, 10.0), [1.0, 0.0])
    assert y[:, 0] == pytest.approx(np.cos(t), abs=1e-6)
    t = np.linspace(0, 1, 101)
    assert S.rk4(lambda t, y: -2 * y, t, [1.0])[:, 0] == pytest.approx(np.exp(-2 * t), abs=1e-8)


def test_programs_and_matrix_equations():
    assert S.linprog([-3, -5], [[1, 0], [0, 2], [3, 2]], [4, 12, 18]) == pytest.approx([2, 6])
    assert S.nnls(np.array([[1.0, 1], [1, -1], [0, 1]]), np.array([1.0, 3, -1])) == pytest.approx([2, 0])
    assert S.quadprog(np.eye(2), [0, 0], np.array([[1.0, 1]]), [2.0]) == pytest.approx([1, 1])
    a, b, c = np.array([[4.0, 1], [2, 3]]), np.array([[1.0, 0], [2, 5]]), np.array([[1.0, 2], [3, 4]])
    x = S.sylvester(a, b, c)
    assert a @ x + x @ b == pytest.approx(c) and S.sqrtm(a) @ S.sqrtm(a) == pytest.approx(a)
    q = S.lyapunov(-a, np.eye(2))
    assert -a @ q - q @ a.T == pytest.approx(-np.eye(2))


def test_image_kernels():
    m = np.ones((7, 9))
    m[3, 4] = 0
    yy, xx = np.indices(m.shape)
    assert image.distance_transform(m) == pytest.approx(np.hypot(yy - 3, xx - 4))
    ring = np.zeros((5, 5))
    ring[1:4, 1:4] = 1
    ring[2, 2] = 0
    full = image.fill_holes(ring)
    assert full[2, 2] == 1 and full.sum() == 9
    bar = np.zeros((9, 20))
    bar[3:6, 2:18] = 1
    thin = image.skeleton(bar)
    assert thin.sum(0).max() == 1 and thin[4, 5:14].all()
    assert image.bilateral(np.full((4, 4), 7.0)) == pytest.approx(np.full((4, 4), 7.0))


def test_signal_measures():
    fs, n = 1000.0, 4000
    t = np.arange(n) / fs
    x = np.sin(2 * np.pi * 50 * t)
    noisy = x + 0.01 * np.random.default_rng(1).standard_normal(n)
    q = M.tone(noisy, fs)
    assert q["freq"][0] == pytest.approx(50, abs=0.3) and q["sinad"][0] == pytest.approx(37, abs=1.0) and q["enob"][0] == pytest.approx((q["sinad"][0] - 1.76) / 6.02)
    assert M.measure_snr(x, noisy) == pytest.approx(37, abs=0.5) and M.band_power(3 * x, fs, 40, 60) == pytest.approx(4.5)
    assert np.abs(M.band_zero(x, fs, 40, 60)).max() < 1e-9 and M.short_time_energy(np.ones(8), 4, 2) == pytest.approx([4, 4, 4])
    assert np.abs(M.hilbert(x)) == pytest.approx(1) and M.instantaneous_frequency(x, fs)[100:-100] == pytest.approx(50)
    f, c = M.coherence(x, 2 * x, fs)
    assert c[f == f[13]] == pytest.approx(1) and np.sum(M.emd(x + 0.2 * np.sin(2 * np.pi * 3 * t)), 0) == pytest.approx(x + 0.2 * np.sin(2 * np.pi * 3 * t))
    up = M.resample(x, 3, 2)
    assert len(up) == 6000 and up[300:-300] == pytest.approx(np.sin(2 * np.pi * 50 * np.arange(6000) / 1500)[300:-300], abs=0.01)
    d = M.steer_delays(np.array([0.0, 0.1, 0.2]), 0.5, fs)
    late = np.array([np.sin(2 * np.pi * 50 * (t - k / fs)) for k in d])
    assert M.beamform(late, d) == pytest.approx(x, abs=1e-6) and M.mel_spectrogram(x, fs).shape == (30, 40)
    e, w = M.lms(noisy, np.convolve(noisy, [0.5, -0.3])[:n], 2, 0.1)
    assert w == pytest.approx([0.5, -0.3], abs=1e-6) and abs(e[-1]) < 1e-6


def test_steps_and_pulses():
    ramp = np.r_[np.zeros(10), np.linspace(0, 1, 11), np.ones(10)]
    assert M.transition_time(ramp) == pytest.approx(8) and np.isnan(M.transition_time(ramp, rising=False))
    assert M.overshoot(np.r_[0.0, -0.1, 1.2, np.ones(37)]) == pytest.approx((20, 10))
    p = M.pulses(np.tile([0.0, 0, 0, 1], 8))
    assert p["period"][0] == pytest.approx(4) and p["width"][0] == pytest.approx(1) and p["duty"][0] == pytest.approx(0.25) and p["count"][0] == 7


def test_codes_and_buses():
    assert M.crc(b"123456789", 16, 0x1021, 0xFFFF) == 0x29B1 and M.crc(b"123456789", 32, 0x04C11DB7, 0xFFFFFFFF, 0xFFFFFFFF, True) == 0xCBF43926
    bits = np.random.default_rng(0).integers(0, 2, 40)
    sent = M.hamming74_encode(bits)
    sent[[3, 9, 20]] ^= 1
    got, fixed = M.hamming74_decode(sent)
    assert (got == bits).all() and fixed == 3
    s = np.arange(16)
    assert (M.qam_demodulate(M.qam_modulate(s) + 0.05) == s).all()
    line = [1] * 10
    for v in (0x55, 0x00, 0xA7):
        line += [0] + [v >> k & 1 for k in range(8)] + [1, 1]
    assert M.decode_uart(np.repeat(line, 8).astype(float), 8) == [0x55, 0x00, 0xA7]
    v = [int(b) for b in f"{0xB2:08b}"]
    assert M.decode_spi(np.tile([0.0, 1.0], 8), np.repeat(v, 2).astype(float)) == [0xB2]
    scl, sda = [1, 1, 0], [1, 0, 0]
    for b in [*v, 0]:
        scl += [0, 1, 0]
        sda += [b, b, b]
    assert M.decode_i2c(np.array([*scl, 0, 1, 1], float), np.array([*sda, 0, 0, 1], float)) == [("start", 0), ("byte", 0xB2), ("ack", 0), ("stop", 0)]


def test_sequence_models():
    start, move, emit = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]])
    obs = [0, 1, 2]
    paths = [(start[a] * emit[a, 0] * move[a, b] * emit[b, 1] * move[b, c] * emit[c, 2], (a, b, c)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    assert tuple(L.viterbi(obs, start, move, emit)) == max(paths)[1]
    assert np.exp(L.hmm_likelihood(obs, start, move, emit)) == pytest.approx(sum(p for p, _ in paths))
    g, x = np.random.default_rng(3), [0.0, 0.0]
    for _ in range(6000):
        x.append(1.0 + 0.6 * x[-1] - 0.2 * x[-2] + g.standard_normal())
    c, _, e = L.arma(np.array(x), 2, 0)
    assert c == pytest.approx([1.0, 0.6, -0.2], abs=0.06) and np.nanstd(e) == pytest.approx(1, abs=0.05)
    walk = np.cumsum(g.standard_normal(300))
    seen = walk + 2 * g.standard_normal(300)
    assert np.mean((L.particle_filter(seen, 1.0, 2.0) - walk) ** 2) < 0.7 * np.mean((seen - walk) ** 2)
    a = np.outer([1.0, 2, 3], [1.0, 0, 2]) + np.outer([0, 1.0, 1], [0, 3.0, 1])
    w, h = L.nmf(a, 2, 3000)
    assert w @ h == pytest.approx(a, abs=1e-2) and (w >= 0).all() and (h >= 0).all()


def test_layers():
    x = np.random.default_rng(0).standard_normal((6, 8))
    assert N.softmax_rows(x).sum(1) == pytest.approx(1) and N.layer_norm(x).mean(1) == pytest.approx(0, abs=1e-9)
    one = np.eye(8)
    assert N.multi_head_attention(x, one, one, one, one, 1) == pytest.approx(N.attention(x, x, x)) and N.attention(x, x, x, causal=True)[0] == pytest.approx(x[0])
    assert N.conv1d(x[:, :1], np.array([1.0, 2, 3]).reshape(3, 1, 1))[:, 0] == pytest.approx(np.correlate(x[:, 0], [1, 2, 3], "valid"))
    img = np.arange(16.0).reshape(4, 4, 1)
    assert N.pool2d(img)[..., 0] == pytest.approx(np.array([[5, 7], [13, 15]])) and N.conv2d(img, np.ones((2, 2, 1, 1)))[0, 0, 0] == 10
    z = np.zeros((8, 12))
    assert N.lstm(x, np.zeros((8, 12)), np.zeros((3, 12)), np.zeros(12)).shape == (6, 3) and not N.gru(x, z[:, :9], np.zeros((3, 9)), np.zeros(9)).any()


@pytest.mark.parametrize("kind", ["sgd", "nesterov", "adagrad", "adadelta", "rmsprop", "adam", "adamw", "adamax", "nadam"])
def test_optimizers_go_down(kind):
    move, s, p = N.optimizer(kind, lr=0.05), {}, np.array([3.0, -2.0])
    for _ in range(400):
        p = move(p, 2 * p, s)
    assert p @ p < 12.0 and (kind in ("adadelta", "adagrad") or p @ p < 1.5)


def test_workbooks_and_mat_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(D.write_xlsx([["name", "v"], ["x & y", 1.5], [None, 2]]))
    got = {(r["row"], r["col"]): r["number"] if r["number"] is not None else r["text"] for r in D.read_xlsx(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): "name", (0, 1): "v", (1, 0): "x & y", (1, 1): 1.5, (2, 1): 2.0}
    m = np.array([[1.0, 2, 3], [4, 5, 6]])
    part = lambda k, b: struct.pack("<II", k, len(b)) + b + b"\0" * (-len(b) % 8)
    body = part(6, struct.pack("<II", 6, 0)) + part(5, struct.pack("<ii", 2, 3)) + struct.pack("<HH4s", 1, 1, b"m") + part(9, m.tobytes("F"))
    packed = zlib.compress(part(14, body))
    head = b"MATLAB 5.0".ljust(124) + b"\x00\x01IM"
    (tmp_path / "a.mat").write_bytes(head + part(14, body) + struct.pack("<II", 15, len(packed)) + packed)
    rows = D.read_mat(spark, str(tmp_path)).collect()
    assert [(r["name"], r["rows"], r["value"]) for r in rows] == [("m", 2, v) for v in m.reshape(-1, order="F")] * 2


def test_json_edits_and_texts(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2]},"c":3}',), (None,)], "s string")
    r = df.select(D.json_set("s", "a.d.e", 5).alias("x"), D.json_delete("s", "a.b.0").alias("y"), D.json_delete("s", "q.r").alias("z")).collect()
    assert tuple(r[0]) == ('{"a":{"b":[1,2],"d":{"e":5}},"c":3}', '{"a":{"b":[2]},"c":3}', '{"a":{"b":[1,2]},"c":3}') and tuple(r[1]) == (None, None, None)
    t = spark.createDataFrame([("  if x:\n    y\n\n  z", "a/b.tar.gz", "\x1b[31mred\x1b[0m", bytes(range(6)))], "s string, p string, c string, b binary")
    g = t.select(H.dedent("s").alias("d"), H.indent("s", 2).alias("i"), H.path_name("p").alias("n"), H.path_stem("p").alias("st"), H.path_extension("p").alias("e"), H.path_parent("p").alias("q"), H.strip_ansi("c").alias("c"), H.swap_endian("b").alias("b"), H.pad_bytes("b", 8).alias("w")).first()
    assert g["d"] == "if x:\n  y\n\nz" and g["i"] == "    if x:\n      y\n\n    z" and (g["n"], g["st"], g["e"], g["q"], g["c"]) == ("b.tar.gz", "b.tar", ".gz", "a", "red")
    assert bytes(g["b"]) == bytes([3, 2, 1, 0, 5, 4]) and bytes(g["w"]) == bytes([0, 1, 2, 3, 4, 5, 0, 0])


def test_impedances_and_colours(spark):
    w = 2 * np.pi * 7.0
    f = spark.range(1).select(F.lit(7.0).alias("f"))
    cases = {
        "open": (H.warburg_open(3.0, 0.2), 3 / np.tanh(np.sqrt(1j * w * 0.2)) / np.sqrt(1j * w * 0.2)), "short": (H.warburg_short(3.0, 0.2), 3 * np.tanh(np.sqrt(1j * w * 0.2)) / np.sqrt(1j * w * 0.2)),
        "ger": (H.gerischer(2.0, 5.0), 2 / np.sqrt(5 + 1j * w)), "hn": (H.havriliak_negami(4.0, 0.1, 0.8, 0.6), 4 / (1 + (1j * w * 0.1) ** 0.8) ** 0.6),
        "por": (H.porous(2.0, 0.01, 0.9), np.sqrt(2 / (0.01 * (1j * w) ** 0.9)) / np.tanh(np.sqrt(2 * 0.01 * (1j * w) ** 0.9))),
    }
    r = f.select(*[H.impedance(c, "f").alias(k) for k, (c, _) in cases.items()]).first()
    for k, (_, want) in cases.items():
        assert complex(r[k]["re"], r[k]["im"]) == pytest.approx(want), k
    g = f.select(H.impedance_from_reflection(H.reflection_coefficient(H.impedance(H.series(H.resistor(30), H.inductor(0.5)), "f"))).alias("z"), H.rgb_lab(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("white"), H.rgb_lab(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("red"), H.vswr(H.reflection_coefficient(H.impedance(H.resistor(100), "f"))).alias("v")).first()
    assert complex(g["z"]["re"], g["z"]["im"]) == pytest.approx(30 + 0.5j * w) and g["v"] == pytest.approx(2)
    assert tuple(g["white"]) == pytest.approx((100, 0, 0), abs=0.02) and tuple(g["red"]) == pytest.approx((53.24, 80.09, 67.20), abs=0.02)


def test_blobs(spark):
    m = ["110010", "110001", "000100", "011101"]
    df = spark.createDataFrame([(0, y, x, float(v)) for y, r in enumerate(m) for x, v in enumerate(r)], "image int, y int, x int, v double")
    r = sorted(tuple(q) for q in image.region_props(image.label_blobs(df)).select("label", "area", "top", "left", "bottom", "right").collect())
    assert r == [(1, 4, 0, 0, 1, 1), (2, 2, 0, 4, 1, 5), (3, 4, 2, 1, 3, 3), (4, 1, 3, 5, 3, 5)]
    assert image.label_blobs(df, 4).select("label").distinct().count() == 5
    assert image.remove_small_blobs(df, 3).agg({"v": "sum"}).first()[0] == 8


def test_estimators(spark):
    g = np.random.default_rng(5)
    a, b = g.standard_normal((300, 2)) @ np.array([[1, 0.4], [0, 0.6]]), g.standard_normal((300, 2)) * 0.3 + [3, 3]
    rows = [(i, float(p), float(q), int(i >= 300)) for i, (p, q) in enumerate(np.vstack([a, b]))]
    df = spark.createDataFrame(rows, "i int, p double, q double, y int")
    for kind in ("lda", "qda"):
        assert L.discriminant(df, ["p", "q"], "y", kind).filter("prediction = y").count() > 590
    t = df.withColumn("z", 2 + 3 * F.col("p") - F.col("q"))
    assert L.pls(t, ["p", "q"], "z", 2) == pytest.approx([2, 3, -1])
    far = spark.createDataFrame([(999, 40.0, -40.0, 0)], df.schema)
    top = L.isolation_forest(df.union(far), ["p", "q"]).orderBy(F.col("anomaly").desc()).first()
    assert top["i"] == 999
    s = L.stratified_split(df, "y", 0.2, "i")
    assert sorted(tuple(r) for r in s.groupBy("y").agg(F.sum(F.col("test").cast("int"))).collect()) == [(0, 60), (1, 60)]
    mix = np.column_stack([g.uniform(-1, 1, 2000), np.sign(g.standard_normal(2000)) * g.uniform(0.5, 1, 2000)])
    mixed = mix @ np.array([[1.0, 0.5], [0.3, 1.0]]).T
    u = L.ica(spark.createDataFrame([tuple(map(float, r)) for r in mixed], "a double, b double"), ["a", "b"])
    c = np.abs(np.corrcoef(((mixed - mixed.mean(0)) @ u.T).T, mix.T)[:2, 2:])
    assert sorted(c.max(1)) == pytest.approx([1, 1], abs=0.02) and c.argmax(1)[0] != c.argmax(1)[1]
    assert L.conformal(spark.range(99).select((F.col("id") + 1).cast("double").alias("e")), "e", 0.1) == 90 and L.conformal(spark.range(3).select(F.col("id").alias("e")), "e") == np.inf
    grad = lambda p, x, y: np.r_[2 * x.T @ (x @ p[:2] + p[2] - y), 2 * (x @ p[:2] + p[2] - y).sum()]
    got = N.train(t.repartition(2), ["p", "q"], "z", grad, np.zeros(3), 5, "adam", lr=0.4)
    xy, move, state, want = t.select("p", "q", "z").toPandas().to_numpy(), N.optimizer("adam", lr=0.4), {}, np.zeros(3)
    for _ in range(5):
        want = move(want, grad(want, xy[:, :2], xy[:, 2]) / len(xy), state)
    assert got == pytest.approx(want)


def test_inverse_at_the_ends_of_the_support(spark):
    ends = spark.createDataFrame([(0.0,), (1.0,)], "q double")
    inf = float("inf")
    want = {("norm", 4.0, 2.0): (-inf, inf), ("exp", 2.0): (0, inf), ("unif", -1.0, 5.0): (-1, 5), ("beta", 2.0, 3.0): (0, 1), ("unid", 9.0): (1, 9), ("hyge", 10.0, 8.0, 5.0): (3, 5), ("bern", 0.3): (0, 1), ("bino", 12.0, 0.4): (0, 12)}
    for (family, *p), bounds in want.items():
        assert [r[0] for r in ends.orderBy("q").select(P.inv(family, F.col("q"), *p)).collect()] == list(bounds), family
