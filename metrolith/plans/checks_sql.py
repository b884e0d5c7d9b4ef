"""SQL of queries whose kernels run in Python: series kernels, distributions, images and fitted lines, written out from their definitions."""

from __future__ import annotations

#: Each series numbered from 0, with its length.
_S = "s as (select user_id, value as x, row_number() over (partition by user_id order by ts, event_id) - 1 as n, count(*) over (partition by user_id) as m from events)"
_DFT = """f as (select user_id, k, m, sum(x * cos(2 * pi() * (k * n % m) / m)) as re, -sum(x * sin(2 * pi() * (k * n % m) / m)) as im
    from (select *, unnest(range(0, m // 2 + 1)) as k from (select user_id, n, m, {x} as x from s)) group by all)"""
_CENTRED = "x - avg(x) over (partition by user_id)"


def _recursive(b: tuple[str, str, str], a: tuple[str, str]) -> str:
    """y from two inputs and two outputs back, a sample a step."""
    return f"""with recursive {_S}, r as (
        select user_id, n, x, 0.0::double as x1, ({b[0]}) * x as y, 0.0::double as y1 from s where n = 0
        union all select s.user_id, s.n, s.x, r.x, ({b[0]}) * s.x + ({b[1]}) * r.x + ({b[2]}) * r.x1 - ({a[0]}) * r.y - ({a[1]}) * r.y1, r.y from r join s on s.user_id = r.user_id and s.n = r.n + 1)
        select user_id, n, round(y, 6) + 0.0 as y from r"""


_K = "tan(pi() * 0.1)"
_LOW = f"(1 + sqrt(2) * {_K} + {_K} * {_K})"
_ALPHA = "(sin(pi() * 0.4) / 60)"
_C = "(-2 * cos(pi() * 0.4))"

#: Digits compared, where not 6: short series give residuals of 7 decimals, which are ties at 6.
DIGITS = {"detrend": 9}
#: By name of the series query.
SERIES = {
    "fft": f"with {_S}, {_DFT.format(x='x')} select user_id, k as n, round(k / m::double, 6) as freq, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from f",
    "periodogram": f"with {_S}, {_DFT.format(x=_CENTRED)} select user_id, k as n, round(k / m::double, 6) as freq, round((re * re + im * im) / m * case when k >= 1 and k < (m + 1) // 2 then 2 else 1 end, 6) + 0.0 as psd from f",
    "welch": f"""with {_S}, i as (select *, unnest(range(0, m - l + 1, greatest(1, l // 2))) as i from (select distinct user_id, m, least(16, m) as l from s)),
        c as (select user_id, l, i, n - i as j, x - avg(x) over (partition by user_id, i) as x from i join s using (user_id) where n >= i and n < i + l),
        h as (select *, 0.5 - 0.5 * cos(2 * pi() * j / greatest(1, l - 1)) as h from c),
        p as (select user_id, l, i, k, sum(x * h * cos(2 * pi() * k * j / l)) as re, sum(x * h * sin(2 * pi() * k * j / l)) as im, sum(h * h) as e from (select *, unnest(range(0, l // 2 + 1)) as k from h) group by all)
        select user_id, k as n, round(k / l::double, 6) as freq, round(avg(re * re + im * im) / case when avg(e) = 0 then 1 else avg(e) end * case when k >= 1 and k < (l + 1) // 2 then 2 else 1 end, 6) + 0.0 as psd from p group by user_id, l, k""",
    "detrend": f"with {_S}, c as (select user_id, avg(x) as a, avg(n) as b, coalesce(regr_slope(x, n), 0) as d from s group by 1) select user_id, n, round(x - a - d * (n - b), 9) + 0.0 as y from s join c using (user_id)",
    "savgol": f"""with {_S}, l as (select user_id, n, m, x, list(x) over (partition by user_id order by n rows between unbounded preceding and unbounded following) as v from s),
        c as (select user_id, n, x, m, case when n < 2 then v[1:5] when n >= m - 2 then list_reverse(v[m - 4:m]) else v[n - 1:n + 3] end as v, case when n < 2 then n when n >= m - 2 then m - 1 - n else 2 end as j from l)
        select user_id, n, round(case when m < 5 then x else list_dot_product(v, case j when 0 then [31.0, 9, -3, -5, 3] when 1 then [9.0, 13, 12, 6, -5] else [-3.0, 12, 17, 12, -3] end::double[]) / 35 end, 6) + 0.0 as y from c""",
    "lowpass": _recursive((f"{_K} * {_K} / {_LOW}", f"2 * {_K} * {_K} / {_LOW}", f"{_K} * {_K} / {_LOW}"), (f"2 * ({_K} * {_K} - 1) / {_LOW}", f"(1 - sqrt(2) * {_K} + {_K} * {_K}) / {_LOW}")),
    "notch": _recursive((f"1 / (1 + {_ALPHA})", f"{_C} / (1 + {_ALPHA})", f"1 / (1 + {_ALPHA})"), (f"{_C} / (1 + {_ALPHA})", f"(1 - {_ALPHA}) / (1 + {_ALPHA})")),
    "fir": f"""with {_S}, w as (select k, (case when k = 4 then 0.3 else sin(0.3 * pi() * (k - 4)) / (pi() * (k - 4)) end) * (0.54 - 0.46 * cos(2 * pi() * k / 8)) as h from range(9) r(k)), g as (select k, h / sum(h) over () as h from w)
        select a.user_id, a.n, round(sum(b.x * h), 6) + 0.0 as y from s a, g, s b where b.user_id = a.user_id and b.n = a.n - k group by 1, 2""",
    "envelope": f"""with {_S}, {_DFT.format(x='x')}, q as (select s.user_id, s.n, s.x, sum(case when k >= 1 and k < (s.m + 1) // 2 then 2 * (re * sin(2 * pi() * (k * s.n % s.m) / s.m) + im * cos(2 * pi() * (k * s.n % s.m) / s.m)) else 0 end) / s.m as q
            from s join f using (user_id) group by s.user_id, s.n, s.x, s.m)
        select user_id, n, round(sqrt(x * x + q * q), 6) + 0.0 as y from q""",
    "resample": f"""with {_S}, g as (select user_id, i, (m - 1) * i / 63.0::double as t, least(floor((m - 1) * i / 63.0::double), m - 1) as lo from (select distinct user_id, m from s), range(64) r(i))
        select g.user_id, i as n, round(a.x + (t - lo) * (coalesce(b.x, a.x) - a.x), 6) + 0.0 as y from g join s a on a.user_id = g.user_id and a.n = lo left join s b on b.user_id = g.user_id and b.n = lo + 1""",
    "dct": f"with {_S} select user_id, k as n, round(sum(x * cos(pi() * k * (2 * n + 1) / (2 * m))) * sqrt(case when k = 0 then 1.0::double else 2.0::double end / m), 6) + 0.0 as y from (select *, unnest(range(0, m)) as k from s) group by user_id, m, k",
    "haar": f"with {_S} select a.user_id, a.n // 2 as n, round((a.x + b.x) / sqrt(2), 6) + 0.0 as approx, round((a.x - b.x) / sqrt(2), 6) + 0.0 as detail from s a join s b on a.user_id = b.user_id and b.n = a.n + 1 where a.n % 2 = 0",
    "kalman": f"""with recursive {_S}, r as (select user_id, n, x as y, 1.001::double * (1 - 1.001::double / 2.001::double) as p from s where n = 0
        union all select s.user_id, s.n, r.y + (r.p + 1e-3) / (r.p + 1e-3 + 1) * (s.x - r.y), (r.p + 1e-3) * (1 - (r.p + 1e-3) / (r.p + 1e-3 + 1)) from r join s on s.user_id = r.user_id and s.n = r.n + 1)
        select user_id, n, round(y, 6) + 0.0 as y from r""",
    "energy_frames": f"with {_S}, g as (select distinct user_id, unnest(range(0, greatest(1, m - 7), 4)) as i from s) select user_id, i // 4 as n, round(sum(x * x), 6) + 0.0 as y from g join s using (user_id) where s.n >= i and s.n < i + 8 group by 1, 2",
}

EXPONENTIAL = f"""with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events),
    r as (select user_id, event_id, n, value as y from e where n = 1 union all select e.user_id, e.event_id, e.n, r.y + 0.25 * (e.value - r.y) from r join e on e.user_id = r.user_id and e.n = r.n + 1)
    select user_id, event_id, y from r"""

#: The closed loop 4 / (s^2 + s + 4).
STEP = """select round(i / 20.0::double, 6) as t, round(1 - exp(-i / 40.0::double) * (cos(sqrt(3.75) * i / 20) + sin(sqrt(3.75) * i / 20) / (2 * sqrt(3.75))), 6) + 0.0 as y from range(201) r(i)"""


def _erf(z: str) -> str:
    """A series of positive terms."""
    return f"(case when {z} = 0 then 0 else sign({z}) * list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(abs({z}) + 1e-300) - lgamma(k + 1.5) - pow({z}, 2)))) end)"


def _sum(term: str) -> str:
    return f"list_sum(list_transform(range(0, x::bigint + 1), lambda k: {term}))"


def _choose(n: str, k: str) -> str:
    return f"exp(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def _distribution(pdf: str, cdf: str, inv: str = "x", by: int = 5, whole: bool = False) -> str:
    x = f"p_size / {by}.0::double"
    return f"select p_partkey, round(({pdf})::double, 8) + 0.0 as pdf, round(({cdf})::double, 8) + 0.0 as cdf, round(({inv})::double, 8) + 0.0 as inv from (select p_partkey, {f'floor({x})' if whole else x} as x from part)"


def _counted(term: str) -> str:
    return _distribution(term.replace("@", "x"), _sum(term.replace("@", "k")), whole=True)


_SIN, _COS = "(x / sqrt(7 + x * x))", "sqrt(7 / (7 + x * x))"
#: By family: pdf, cdf and the value that the inverse returns for the cdf.
DISTRIBUTIONS = {
    "norm": _distribution("exp(-pow((x - 4) / 2, 2) / 2) / (2 * sqrt(2 * pi()))", f"(1 + {_erf('((x - 4) / sqrt(8))')}) / 2"),
    "logn": _distribution("exp(-pow((ln(x) - 0.5) / 0.8, 2) / 2) / (x * 0.8 * sqrt(2 * pi()))", f"(1 + {_erf('((ln(x) - 0.5) / (0.8 * sqrt(2)))')}) / 2"),
    "gam": _distribution("x * exp(-x / 1.5) / 2.25", "1 - exp(-x / 1.5) * (1 + x / 1.5)"),
    "chi2": _distribution("x * exp(-x / 2) / 4", "1 - exp(-x / 2) * (1 + x / 2)"),
    "beta": _distribution("12 * x * pow(1 - x, 2)", "6 * x * x - 8 * pow(x, 3) + 3 * pow(x, 4)", by=50),
    "t": _distribution("6 / (sqrt(7 * pi()) * 15 * sqrt(pi()) / 8) * pow(1 + x * x / 7, -4)", f"0.5 + (atan(x / sqrt(7)) + {_SIN} * ({_COS} + 2 / 3.0 * pow({_COS}, 3) + 8 / 15.0 * pow({_COS}, 5))) / pi()"),
    "wbl": _distribution("0.5 * sqrt(x / 3) * exp(-pow(x / 3, 1.5))", "1 - exp(-pow(x / 3, 1.5))"),
    "exp": _distribution("exp(-x / 2) / 2", "1 - exp(-x / 2)"),
    "unif": _distribution("case when x <= 5 then 0.2 else 0 end", "least(x / 5, 1)", "least(x, 5)"),
    "bino": _counted(f"{_choose('12', '@')} * pow(0.4, @) * pow(0.6, 12 - @)"),
    "poiss": _counted("exp(-3.5 + @ * ln(3.5) - lgamma(@ + 1.0))"),
    "geo": _counted("0.3 * pow(0.7, @)"),
    "nbin": _counted("(@ + 1) * (@ + 2) / 2.0::double * pow(0.4, 3) * pow(0.6, @)"),
    "hyge": _counted(f"{_choose('15', '@')} * {_choose('25', '(10 - @)')} / {_choose('40', '10')}"),
    "bern": _distribution("case x when 0 then 0.7 when 1 then 0.3 else 0 end", "case when x < 1 then 0.7 else 1 end", "least(x, 1)", whole=True),
    "unid": _distribution("case when x between 1 and 9 then 1 / 9.0::double else 0 end", "least(x, 9) / 9.0::double", "greatest(1, least(x, 9))", whole=True),
}

SPECIAL = f"select p_partkey, round({_erf('x')}, 8) + 0.0 as erf, round(gamma(x), 8) + 0.0 as gamma, round(lgamma(x), 8) + 0.0 as lgamma from (select p_partkey, p_size / 10.0::double as x from part)"

POLYFIT = """with z as (select p_size - (select avg(p_size) from part) as z, p_retailprice as y, (select avg(p_size) from part) as m from part), c as (select avg(z * z) as s2, avg(z * z * z) / avg(z * z) as r from z),
    w as (select z, y, m, s2, r, z * z - s2 - r * z as w from z, c), k as (select sum(w * y) / sum(w * w) as a, sum(z * y) / sum(z * z) as b, avg(y) as c, any_value(m) as m, any_value(s2) as s2, any_value(r) as r from w)
    select round(a, 4) + 0.0 as a, round(b - a * (2 * m + r), 4) + 0.0 as b, round(c - b * m + a * (m * m - s2 + r * m), 4) + 0.0 as c from k"""


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _ridge() -> str:
    x = ["l_quantity", "l_discount", "l_tax"]
    sums = ", ".join(f"(covar_pop({a}, {b}) * count(*)){' + 1' if a == b else ''} as s{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x)) + ", " + ", ".join(f"covar_pop({a}, l_extendedprice) * count(*) as t{i}" for i, a in enumerate(x))
    means = ", ".join(f"avg({a}) as m{i}" for i, a in enumerate(x))
    base = [[f"s{i}{j}" for j in range(3)] for i in range(3)]
    slopes = [_det([[f"t{i}" if j == k else base[i][j] for j in range(3)] for i in range(3)]) + " / " + _det(base) for k in range(3)]
    return f"""with c as (select {sums}, {means}, avg(l_extendedprice) as my from lineitem), b as (select *, {', '.join(f'{s} as b{k + 1}' for k, s in enumerate(slopes))} from c)
        select round(my - b1 * m0 - b2 * m1 - b3 * m2, 4) + 0.0 as b0, round(b1, 4) + 0.0 as b1, round(b2, 4) + 0.0 as b2, round(b3, 4) + 0.0 as b3 from b"""


RIDGE = _ridge()

LAYER_NORM = """select vec_id, list_transform(e, lambda v: round(greatest(0, (v - list_avg(e)) / sqrt(list_var_pop(e) + 1e-5)), 6)) as output from (select vec_id, embedding::double[] as e from embeddings)"""


def otsu(pixels: str) -> str:
    return f"""with p as {pixels}, h as (select image, floor(v) as v, count(*) as n from p group by 1, 2),
        c as (select image, v, sum(n) over w as w, sum(n * v) over w as m, sum(n) over (partition by image) as t, sum(n * v) over (partition by image) as s from h window w as (partition by image order by v)),
        b as (select image, v, case when t > w then w * (t - w) * pow(m / w - (s - m) / (t - w), 2) else -1 end as b from c)
        select image, cast(v as double) as threshold from (select *, row_number() over (partition by image order by b desc, v) as k from b) where k = 1"""


def kapur(pixels: str) -> str:
    return f"""with p as {pixels}, h as (select image, floor(v) as v, count(*) as n from p group by 1, 2), q as (select image, v, n / sum(n) over (partition by image)::double as q from h),
        c as (select image, v, sum(q) over w as c, -sum(q * ln(q)) over w as h, -sum(q * ln(q)) over (partition by image) as t, row_number() over (partition by image order by v desc) as last, count(*) over (partition by image) as values from q window w as (partition by image order by v)),
        e as (select image, v, case when last = 1 then -1e300 else ln(c) + h / c + ln(1 - c) + (t - h) / (1 - c) end as e from c)
        select image, 0 as k, cast(v as double) as threshold from (select *, row_number() over (partition by image order by e desc, v) as r from e) where r = 1"""


def resized(pixels: str, height: int, width: int) -> str:
    return f"""with p as {pixels}, s as (select image, max(y) + 1 as h, max(x) + 1 as w from p group by 1),
        g as (select image, a.y, b.x, least(h - 1, floor((a.y + 0.5) * h / {height})) as sy, least(w - 1, floor((b.x + 0.5) * w / {width})) as sx from s, range({height}) a(y), range({width}) b(x))
        select g.image, g.y, g.x, round(p.v, 5) as v from g join p on p.image = g.image and p.y = sy and p.x = sx"""
