"""Further filters, solvers, image and signal kernels, codes and searches against identities and small cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolith.functions import codes
from metrolith.functions import special as P
from metrolith.operators import control as C
from metrolith.operators import image, ml, signal, table
from metrolith.operators import learn as L
from metrolith.operators import solve as S
from metrolith.sources import files


def test_elliptic_integrals():
    assert P.ellipke_of(0.0) == pytest.approx((math.pi / 2, math.pi / 2))
    k, e = P.ellipke_of(0.5)
    t = (np.arange(200000) + 0.5) / 200000 * math.pi / 2
    assert k == pytest.approx(np.mean(1 / np.sqrt(1 - 0.5 * np.sin(t) ** 2)) * math.pi / 2, rel=1e-9)
    assert e == pytest.approx(np.mean(np.sqrt(1 - 0.5 * np.sin(t) ** 2)) * math.pi / 2, rel=1e-9)
    # Legendre's relation
    k2, e2 = P.ellipke_of(0.3)
    k7, e7 = P.ellipke_of(0.7)
    assert e2 * k7 + e7 * k2 - k2 * k7 == pytest.approx(math.pi / 2)


@pytest.mark.parametrize("order", [2, 3, 4, 5, 6])
@pytest.mark.parametrize("kind", ["low", "high"])
def test_elliptic_filter_ripples(order, kind):
    s = C.ellip(order, 1.0, 40.0, 0.3, kind)
    assert C.is_stable(s) and len(s.den) == order + 1
    w = np.linspace(0, np.pi, 20001)
    db = 20 * np.log10(np.maximum(np.abs(C.freqresp(s, w)), 1e-12))
    band = w <= 0.3 * np.pi if kind == "low" else w >= 0.3 * np.pi
    assert db[band].max() == pytest.approx(0, abs=1e-3) and db[band].min() == pytest.approx(-1, abs=1e-2)
    # beyond the transition every lobe reaches the attenuation, none passes it
    far = db[~band] if kind == "high" else db[~band][::-1]
    peaks = far[1:-1][(far[1:-1] >= far[:-2]) & (far[1:-1] > far[2:])]
    assert (peaks <= -40 + 1e-2).all() and max(far[0], peaks.max(initial=-400)) == pytest.approx(-40, abs=0.05)


def test_elliptic_order_is_the_least():
    n, cut = C.ellipord(0.2, 0.3, 1.0, 40.0)
    at = lambda order: 20 * np.log10(np.abs(C.freqresp(C.ellip(order, 1.0, 40.0, cut), np.linspace(0.3, 1, 2001) * np.pi))).max()
    assert at(n) <= -40 + 1e-6 < at(n - 1)


def test_equiripple_taps():
    h = C.remez(31, [0, 0.3, 0.4, 1], [1, 0], [1, 2])
    assert h == pytest.approx(h[::-1])
    w = np.linspace(0, 1, 8001)
    a = np.abs(np.exp(-1j * np.pi * np.outer(w, np.arange(31))) @ h)
    low, high = np.abs(a[w <= 0.3] - 1).max(), a[w >= 0.4].max()
    assert low == pytest.approx(2 * high, rel=0.03)
    f = C.firls(31, [0, 0.3, 0.4, 1], [1, 1, 0, 0], [1, 4])
    b = np.abs(np.exp(-1j * np.pi * np.outer(w, np.arange(31))) @ f)
    assert max(low, 2 * high) < max(np.abs(b[w <= 0.3] - 1).max(), 2 * b[w >= 0.4].max())


def test_logarithm_and_schur():
    r = np.random.default_rng(1)
    a = r.normal(size=(5, 5))
    t, u = S.schur(a)
    assert u @ t @ u.T == pytest.approx(a) and u.T @ u == pytest.approx(np.eye(5))
    assert np.abs(np.tril(t, -2)).max() < 1e-9
    assert sorted(np.linalg.eigvals(t), key=lambda z: (z.real, z.imag)) == pytest.approx(sorted(np.linalg.eigvals(a), key=lambda z: (z.real, z.imag)))
    p = a @ a.T + np.eye(5)
    from metrolith.functions.special import expm_of

    assert expm_of(S.logm(p)) == pytest.approx(p)
    assert S.logm(expm_of(a / 5)) == pytest.approx(a / 5)
    with pytest.raises(ValueError):
        S.logm(np.diag([1.0, -1.0]))


def test_stiff_solver_on_robertsons_kinetics():
    f = lambda t, y: np.array([-0.04 * y[0] + 1e4 * y[1] * y[2], 0.04 * y[0] - 1e4 * y[1] * y[2] - 3e7 * y[1] ** 2, 3e7 * y[1] ** 2])
    t, y = S.ode_stiff(f, (0, 40), [1.0, 0, 0])
    assert len(t) < 1000 and y[-1].sum() == pytest.approx(1)
    assert y[-1][0] == pytest.approx(0.7158, abs=2e-4) and y[-1][1] == pytest.approx(9.185e-6, rel=1e-2)
    t, y = S.ode_stiff(lambda t, y: -1000 * (y - np.cos(t)) - np.sin(t), (0, 1), [1.0])
    assert y[-1][0] == pytest.approx(math.cos(1), abs=1e-5)


def test_boundary_values():
    x, y = S.bvp(lambda x, y: np.array([y[1], -y[0]]), lambda a, b: np.array([a[0], b[0] - 1]), np.linspace(0, math.pi / 2, 5), np.zeros((5, 2)))
    assert y[:, 0] == pytest.approx(np.sin(x), abs=1e-6)
    assert S.bvp_eval(lambda x, y: np.array([y[1], -y[0]]), x, y, [0.123])[0, 0] == pytest.approx(math.sin(0.123), abs=1e-6)
    # Bratu's problem, lower branch
    x, y = S.bvp(lambda x, y: np.array([y[1], -math.exp(y[0])]), lambda a, b: np.array([a[0], b[0]]), np.linspace(0, 1, 6), np.zeros((6, 2)))
    assert y[len(x) // 2, 0] == pytest.approx(0.140539, abs=1e-5)


def test_basin_hopping_leaves_a_local_minimum():
    f = lambda v: float((v[0] ** 2 - 4) ** 2 + v[0])
    assert S.minimize(f, [2.0])[0] > 1
    assert S.basin_hopping(f, [2.0], 30, step=3.0)[0] == pytest.approx(-2.0305, abs=1e-3)


def test_canny_follows_a_step():
    m = np.zeros((20, 20))
    m[:, 10:] = 100
    e = image.canny(m)
    assert e[5:15].sum(1) == pytest.approx(np.ones(10)) and set(np.flatnonzero(e[8])) <= {9, 10}
    assert image.canny(np.full((9, 9), 7.0)).sum() == 0


def test_clahe():
    r = np.random.default_rng(2)
    m = r.integers(100, 120, (40, 50)).astype(float)
    out = image.clahe(m, 16, 40.0)
    assert out.shape == m.shape and out.min() >= 0 and out.max() <= 255 and out.std() > 3 * m.std()
    one = image.clahe(m, 64, 1e9)  # one tile, no clip: plain equalisation
    v = m.astype(int)
    assert (one == np.round(np.cumsum(np.bincount(v.reshape(-1), minlength=256))[v] * 255 / v.size)).all()


def test_watershed_parts_two_basins(spark):
    x = np.arange(11)
    surface = np.tile(np.minimum(np.abs(x - 2), np.abs(x - 8)).astype(float), (5, 1))
    marker = np.zeros((5, 11), int)
    marker[2, 2], marker[2, 8] = 1, 2
    out = image.flooded(surface, marker)
    assert (out[:, :5] == 1).all() and (out[:, 6:] == 2).all() and set(out[:, 5]) <= {1, 2}
    rows = [(7, int(a), int(b), float(surface[a, b]), int(marker[a, b])) for a in range(5) for b in range(11)]
    got = image.watershed(spark.createDataFrame(rows, "image int, y int, x int, v double, marker int")).collect()
    assert len(got) == 55 and all(r.v == out[r.y, r.x] for r in got)


def test_modes_and_constant_q():
    t = np.arange(1000)
    a, b = np.cos(2 * np.pi * 0.01 * t), 0.5 * np.cos(2 * np.pi * 0.1 * t)
    out = signal.vmd(a + b, 2)
    modes = out["y"].reshape(2, -1)
    assert sorted(set(out["centre"])) == pytest.approx([0.01, 0.1], abs=2e-3)
    assert np.abs(modes[0] - a)[50:-50].max() < 0.05 and np.abs(modes[1] - b)[50:-50].max() < 0.05
    x = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    c = signal.cqt(x, 8000, 110, 3000)
    at = c["freq"][c["frame"] == 50][np.argmax(c["magnitude"][c["frame"] == 50])]
    assert at == pytest.approx(440) and c["magnitude"][c["frame"] == 50].max() == pytest.approx(0.5, abs=0.01)
    assert len(signal.cqt(np.zeros(0), 100.0, 10.0)["freq"]) == 0


def test_zeta():
    z = P.zeta_of(np.array([2.0, 4.0, 0.0, -1.0, -2.0, 3.0, np.inf, 0.5, -3.0, np.nan]))
    assert z[:9] == pytest.approx([math.pi**2 / 6, math.pi**4 / 90, -0.5, -1 / 12, 0, 1.2020569031595942, 1, -1.4603545088095868, 1 / 120], rel=1e-13) and math.isnan(z[9])
    with pytest.raises(ValueError):
        P.zeta_of(np.array([1.0]))


@pytest.mark.parametrize("data", [b"a", b"aaaa", b"abracadabra" * 40, bytes(range(256)) * 3, np.random.default_rng(0).geometric(0.3, 5000).clip(0, 255).astype(np.uint8).tobytes()])
def test_codes_come_back(data):
    h, r = codes.huffman(data), codes.rans(data)
    assert codes.unhuffman(np.array(h["lengths"]), h["bits"], h["bit_len"]) == data
    assert codes.unrans(np.array(r["freqs"]), r["bytes"], r["state"], r["symbol_count"]) == data
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    entropy = -(p * np.log2(p)).sum() * len(data)
    assert entropy <= h["bit_len"] + 1e-6 and h["bit_len"] <= entropy + len(data)
    assert sum(2.0**-k for k in h["lengths"] if k) <= 1
    assert 8 * len(r["bytes"]) <= entropy * 1.02 + 64


def test_codes_of_columns(spark):
    df = spark.createDataFrame([(1, "hello hello"), (2, ""), (3, None), (4, "\u00e9\u4e2d")], "i int, s string")
    for to, back in ((codes.huffman_encode, codes.huffman_decode), (codes.rans_encode, codes.rans_decode)):
        got = df.select("i", to(F.col("s")).alias("e")).select("i", back(F.col("e")).cast("string").alias("s"), "e.symbol_count").orderBy("i").collect()
        assert [(r.s, r.symbol_count) for r in got] == [("hello hello", 11), (None, None), (None, None), ("\u00e9\u4e2d", 5)]


def test_exact_sum_does_not_depend_on_order(spark):
    x = [1e16, 1.0, -1e16, 1e-3, 3.0, 1e100, -1e100, 0.1] * 50
    for parts in (1, 7):
        df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double").repartition(parts)
        assert table.exact_sum(df, "v") == math.fsum(x)
    assert table.exact_sum(spark.createDataFrame([], "v double"), "v") == 0
    assert math.isnan(table.exact_sum(spark.createDataFrame([(math.inf,), (-math.inf,), (1.0,)], "v double"), "v"))


def test_arrays_are_written(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") != 5, F.col("id") * 0.5).alias("v")).repartition(5)
    files.write_npy(df, str(tmp_path / "a.npy"), "id", "v")
    x = np.load(tmp_path / "a.npy")
    assert len(x) == 1000 and math.isnan(x[5]) and x[999] == 499.5
    files.write_npz(str(tmp_path / "b.npz"), {"v": (df, "id", "v"), "none": (df.limit(0), "id", "v")})
    with np.load(tmp_path / "b.npz") as z:
        assert z["v"][7] == 3.5 and len(z["none"]) == 0
    assert files.read_npz(spark, str(tmp_path)).filter("name = 'v'").count() == 1000


def test_arima_follows_a_trend():
    r = np.random.default_rng(5)
    e = r.normal(size=4000)
    z = np.zeros(4000)
    for i in range(1, 4000):
        z[i] = 0.5 + 0.6 * z[i - 1] + e[i]
    m = L.arima(np.cumsum(z), 1, 1, 0)
    assert m["ar"] == pytest.approx([0.6], abs=0.05) and m["mu"] == pytest.approx(1.25, abs=0.15)
    f = L.forecast(m, 200)
    assert np.diff(f)[-1] == pytest.approx(m["mu"], abs=1e-6) and abs(f[0] - np.cumsum(z)[-1] - (m["constant"] + m["ar"][0] * z[-1])) < 1e-9
    line = L.forecast(L.arima(np.arange(300.0) ** 2, 0, 2, 0), 3)
    assert line == pytest.approx([300**2, 301**2, 302**2])


def test_kmedians_ignore_an_outlier(spark):
    rows = [(float(v), 0.0) for v in (1, 2, 3, 1000)] + [(v + 5000.0, 1.0) for v in range(5)]
    centres = L.kmedians(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 2)
    assert sorted(map(tuple, centres)) == [(2.5, 0.0), (5002.0, 1.0)]


def test_mrmr_is_the_best_set(spark):
    r = np.random.default_rng(3)
    a, b, c = r.normal(size=(3, 300))
    data = {"x0": a, "x1": a + 0.05 * c, "x2": b, "x3": c, "x4": r.normal(size=300), "y": a + 0.8 * b}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()], strict=True)), list(data))
    corr = np.abs(np.corrcoef(list(data.values())))
    for n in (1, 2, 3, 5):
        score = lambda s, n=n: corr[list(s), 5].sum() / n - sum(corr[i, j] for i, j in itertools.combinations(s, 2)) / max(1, n * (n - 1) / 2)
        best = max(itertools.combinations(range(5), n), key=score)
        assert L.mrmr(df, ["x0", "x1", "x2", "x3", "x4"], "y", n) == [f"x{i}" for i in best]


def test_grid_search(spark):
    df = spark.range(60).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0 + 1).alias("y"), F.sin(F.col("id") * 1.0).alias("z"))
    got = L.grid_search(df, lambda name, tag: ml.linear_estimator([name], "y"), {"name": ["z", "x"], "tag": [1, 2]}, F.pmod("id", F.lit(3)), 3)
    assert got["best_params"] == {"name": "x", "tag": 1} and got["best_index"] == 2 and got["best_score"] == pytest.approx(1) and len(got["results"]) == 4
