"""Queries of bits, encodings, paths, colours, waveforms, impedances, images and sparse matrices."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from metrolith.catalog import register
from metrolith.functions import physical as H
from metrolith.operators import image, sparse
from metrolith.plans import checks_sql as C
from metrolith.plans.function_queries import many
from metrolith.plans.model_queries import _ENTRIES, _PIXELS, _entries, _pixels
from metrolith.plans.table_queries import query, read, rounded

many("bits", "orders", "o_orderkey", {
    "g": (lambda: H.get_bit("o_orderkey", 3), "(o_orderkey >> 3) & 1"), "s": (lambda: H.set_bit("o_orderkey", 5), "o_orderkey | 32"), "c": (lambda: H.clear_bit("o_orderkey", 0), "o_orderkey & ~1::bigint"),
    "t": (lambda: H.toggle_bit("o_orderkey", 1), "xor(o_orderkey, 2)"), "na": (lambda: H.nand(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 2 == 0).cast("int"), "cast(not (o_orderkey % 2 = 0 and o_custkey % 2 = 0) as int)"),
    "no": (lambda: H.nor(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 2 == 0).cast("int"), "cast(not (o_orderkey % 2 = 0 or o_custkey % 2 = 0) as int)"),
})
many("encodings", "documents", "doc_id", {
    "b64": (lambda: F.md5(H.base64_encode("text")), "md5(base64(encode(text)))"), "back": (lambda: F.md5(H.base64_decode(H.base64_encode("text")).cast("string")), "md5(text)"), "hx": (lambda: F.md5(H.hex_encode("text")), "md5(lower(hex(encode(text))))"),
    "sha": (lambda: H.sha256("text"), "sha256(text)"), "nb": (lambda: H.nbytes("text"), "octet_length(encode(text))"), "nl": (lambda: H.line_count("text"), "case when text = '' then 0 else len(string_split(text, chr(10))) - case when ends_with(text, chr(10)) then 1 else 0 end end"),
    "l0": (lambda: F.md5(H.line_at("text", 0)), "md5(string_split(text, chr(10))[1])"), "len": (lambda: F.octet_length(H.reverse_bytes("text")), "octet_length(encode(text))"),
})
many("text_distance", "part", "p_partkey", {
    "lev": (lambda: H.levenshtein("p_name", "p_brand"), "levenshtein(p_name, p_brand)"), "sim": (lambda: H.similar("p_name", "p_brand"), "round(1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand)), 6)"),
    "cp": (lambda: F.array_join(H.codepoints("p_brand"), ","), "array_to_string(list_transform(string_split(p_brand, ''), lambda ch: ord(ch)), ',')"),
})
_P = "split_part(split_part(url, '://', 2), '?', 1)"
many("paths", "pages", "page_id", {
    "name": (lambda: H.path_name(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1))), rf"regexp_extract({_P}, '([^/]*)/?$', 1)"),
    "parent": (lambda: H.path_parent(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1))), rf"regexp_extract({_P}, '^(.*?)/?[^/]*/?$', 1)"),
    "joined": (lambda: H.path_join(F.lit("a/"), F.lit("b"), F.col("page_id").cast("string")), "'a/b/' || page_id"),
})

_RGB = "(select p_partkey, p_partkey % 256 / 255.0::double as r, p_size % 51 / 50.0::double as g, p_partkey * 37 % 256 / 255.0::double as b from part)"


@query("colours", "part", f"""
    select p_partkey, round(greatest(r, g, b), 6) as v, round(1 - greatest(r, g, b), 6) as k, round((greatest(r, g, b) + least(r, g, b)) / 2, 6) as l,
           round(0.299 * r + 0.587 * g + 0.114 * b, 6) as luma, round(case when greatest(r, g, b) = 0 then 0 else 1 - least(r, g, b) / greatest(r, g, b) end, 6) as s, round(r, 6) as r2, round(g, 6) as g2, round(b, 6) as b2 from {_RGB}""")
def _(df):
    c = df.select("p_partkey", (F.col("p_partkey") % 256 / F.lit(255.0)).alias("r"), (F.col("p_size") % 51 / F.lit(50.0)).alias("g"), (F.col("p_partkey") * 37 % 256 / F.lit(255.0)).alias("b"))
    c = c.withColumn("h", H.rgb_hsv("r", "g", "b")).withColumn("back", H.hsv_rgb(F.col("h.h"), F.col("h.s"), F.col("h.v")))
    return rounded(c.select("p_partkey", F.col("h.v").alias("v"), H.rgb_cmyk("r", "g", "b")["k"].alias("k"), H.rgb_hsl("r", "g", "b")["l"].alias("l"), H.luma("r", "g", "b").alias("luma"), F.col("h.s").alias("s"), F.col("back.r").alias("r2"), F.col("back.g").alias("g2"), F.col("back.b").alias("b2")), 6)


_T = "(select i, i / 1000.0::double as t from range(2000) r(i))"


@register("waveforms", f"""
    select i, round(sin(2 * pi() * 50 * t), 6) + 0.0::double as sine, case when t * 8 - floor(t * 8) < 0.25 then 1.0::double else -1.0::double end as square, round(2 * (t * 8 - floor(t * 8)) - 1, 6) + 0.0::double as saw,
           round(1 - 4 * abs(t * 8 - floor(t * 8) - 0.5), 6) + 0.0::double as tri, round(sin(2 * pi() * (5 * t + 95 / 4.0 * t * t)), 6) + 0.0::double as chirp, round(cos(2 * pi() * 3 * t) + 0.5 * cos(2 * pi() * 7 * t), 6) + 0.0::double as multi from {_T}""")
def _(spark, d):
    t = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") / F.lit(1000.0)).alias("t"))
    return rounded(t.select("i", H.sine("t", 50).alias("sine"), H.square("t", 8, 0.25).alias("square"), H.sawtooth("t", 8).alias("saw"), H.triangle("t", 8).alias("tri"), H.chirp("t", 5, 100, 2).alias("chirp"), H.multisine("t", [3, 7], [1, 0.5]).alias("multi")), 6)


@register("impedances", f"""
    with w as (select i, 2 * pi() * pow(10.0, i / 20.0) as w from range(100) r(i)),
         z as (select i, w, 20 + 100 / (1 + pow(w * 1e-3, 2)) as re, -100 * w * 1e-3 / (1 + pow(w * 1e-3, 2)) as im from w)
    select i, round(re, 6) as re, round(im, 6) as im, round(5 / sqrt(w), 6) as warburg, round(cos(0.4 * pi()) * pow(w, -0.8) * 100, 6) as cpe,
           round(sqrt((pow(re - 50, 2) + im * im) / (pow(re + 50, 2) + im * im)), 6) as gamma from z""")
def _(spark, d):
    f = spark.range(100).select(F.col("id").alias("i"), F.pow(F.lit(10.0), F.col("id") / 20).alias("f"))
    cell = H.series(H.resistor(20), H.parallel(H.resistor(100), H.capacitor(1e-5)))
    z = f.select("i", "f", H.impedance(cell, "f").alias("z"), H.impedance(H.warburg(5), "f").alias("wb"), H.impedance(H.cpe(0.01, 0.8), "f").alias("q")).withColumn("g", H.reflection_coefficient(F.col("z")))
    return rounded(z.select("i", "z.re", "z.im", F.col("wb.re").alias("warburg"), F.col("q.re").alias("cpe"), F.sqrt(F.col("g.re") * F.col("g.re") + F.col("g.im") * F.col("g.im")).alias("gamma")), 6)


many("units", "part", "p_partkey", {
    "inch": (lambda: H.convert_unit("p_retailprice", "mm", "inch"), "round(p_retailprice / 25.4, 6)"), "h": (lambda: H.convert_unit("p_size", "min", "h"), "round(p_size / 60.0::double, 6)"),
    "adc": (lambda: H.adc(F.col("p_size"), 4, 0.0, 30.0), "round(round(least(p_size, 30) / 2.0) * 2.0::double, 6)"), "cal": (lambda: H.apply_calibration_curve("p_size", [0, 10, 50], [0, 100, 120]), "round(case when p_size <= 10 then p_size * 10.0::double else 100 + (p_size - 10) * 0.5::double end, 6)"),
})

_NEAR = "join p b on a.image = b.image and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1"


def _opened(first: str, second: str) -> str:
    return f"e as (select a.image, a.y, a.x, {first}(b.v) as v from p a {_NEAR} group by 1, 2, 3), o as (select a.image, a.y, a.x, {second}(b.v) as v from e a {_NEAR.replace('join p b', 'join e b')} group by 1, 2, 3)"


for _name, _first, _second, _value in (("opened", "min", "max", "o.v"), ("closed", "max", "min", "o.v"), ("top_hat", "min", "max", "p.v - o.v"), ("bottom_hat", "max", "min", "o.v - p.v")):
    query(f"image_{_name}", "lineitem", f"with p as {_PIXELS}, {_opened(_first, _second)} select image, y, x, round({_value}, 5) + 0.0::double as v from p join o using (image, y, x)")(lambda df, n=_name: rounded(getattr(image, n)(_pixels(df)), 5))

for _name, _weight in (("laplacian", "case when b.y = a.y and b.x = a.x then -4 when b.y = a.y or b.x = a.x then 1 else 0 end"), ("sharpen", "case when b.y = a.y and b.x = a.x then 5 when b.y = a.y or b.x = a.x then -1 else 0 end"), ("scharr_x", "(b.x - a.x) * case when b.y = a.y then 10 else 3 end"), ("prewitt_y", "(b.y - a.y)")):
    query(f"image_{_name}", "lineitem", f"with p as {_PIXELS} select a.image, a.y, a.x, round(sum(b.v * {_weight}), 4) + 0.0::double as v from p a {_NEAR} group by 1, 2, 3")(lambda df, n=_name: rounded(image.convolve(_pixels(df), image.KERNELS[n]), 4))


@query("image_gradient_magnitude", "lineitem", f"""
    with p as {_PIXELS}, g as (select a.image, a.y, a.x, sum(b.v * (b.x - a.x) * case when b.y = a.y then 2 else 1 end) as gx, sum(b.v * (b.y - a.y) * case when b.x = a.x then 2 else 1 end) as gy from p a {_NEAR} group by 1, 2, 3)
    select image, y, x, round(sqrt(gx * gx + gy * gy), 4) as v from g""")
def _(df):
    return rounded(image.gradient_magnitude(_pixels(df)), 4)


@query("image_sauvola", "lineitem", f"with p as {_PIXELS} select a.image, a.y, a.x, round(avg(b.v) * (1 + 0.5 * (stddev_pop(b.v) / 128 - 1)), 4) as v from p a {_NEAR} group by 1, 2, 3")
def _(df):
    return rounded(image.sauvola_threshold(_pixels(df), 1), 4)


@query("image_adaptive_threshold", "lineitem", f"with p as {_PIXELS}, m as (select a.image, a.y, a.x, avg(b.v) as m from p a {_NEAR} group by 1, 2, 3) select image, y, x, case when v > m - 0.123 then 1.0::double else 0.0::double end as v from p join m using (image, y, x)")
def _(df):
    return image.adaptive_threshold(_pixels(df), 1, 0.123)


@query("image_histogram", "lineitem", f"select image, cast(least(15, floor(v / 64 * 16)) as bigint) as bin, count(*) as n from {_PIXELS} group by 1, 2")
def _(df):
    return image.imhist(_pixels(df), 16, 0.0, 64.0)


@query("image_adjusted", "lineitem", f"select image, y, x, round(pow(greatest(0, least(1, (v - 10) / 30)), 0.5), 6) as v from {_PIXELS}")
def _(df):
    return rounded(image.imadjust(_pixels(df), 10, 40, gamma=0.5), 6)


@query("image_cropped", "lineitem", f"select image, y - 2 as y, x - 3 as x, round(v, 5) as v from {_PIXELS} where y between 2 and 11 and x between 3 and 8")
def _(df):
    return rounded(image.crop(_pixels(df), 2, 3, 10, 6), 5)


@query("image_rot90", "lineitem", f"with p as {_PIXELS} select image, max(x) over (partition by image) - x as y, y as x, round(v, 5) as v from p")
def _(df):
    return rounded(image.rot90(_pixels(df)), 5)


@query("image_translated", "lineitem", f"""
    with p as {_PIXELS}, s as (select image, max(y) as h, max(x) as w from p group by 1), g as (select image, y, x from s, range(24) a(y), range(24) b(x) where y <= h and x <= w)
    select g.image, g.y, g.x, coalesce(round(v, 5), 0) as v from g left join p on g.image = p.image and p.y = g.y - 2 and p.x = g.x + 1""")
def _(df):
    return rounded(image.translate(_pixels(df), 2, -1), 5)


@query("image_resized", "lineitem", C.resized(_PIXELS, 10, 40))
def _(df):
    return rounded(image.resize(_pixels(df), 10, 40), 5)


def _bright(df):
    return _pixels(df).withColumn("v", F.when(F.col("v") > 28, 1.0).otherwise(0.0))


@query("image_regions", "lineitem")
def _(df):
    return rounded(image.region_props(image.label_blobs(_bright(df))), 6)


@query("image_without_small_blobs", "lineitem")
def _(df):
    return image.remove_small_blobs(_bright(df), 5)


@query("image_hit_miss", "lineitem", f"""
    with p as (select image, y, x, v > 28 as o from {_PIXELS}) select a.image, a.y, a.x, cast(a.o and coalesce(l.o, false) and not coalesce(r.o, false) as double) as v
    from p a left join p l on l.image = a.image and l.y = a.y and l.x = a.x - 1 left join p r on r.image = a.image and r.y = a.y and r.x = a.x + 1""")
def _(df):
    return image.hit_miss(_bright(df), [(0, 0), (0, -1)], [(0, 1)])


for _name, _kernel in (("distance", image.distance_transform), ("bilateral", image.bilateral), ("skeleton", image.skeleton), ("filled", image.fill_holes)):
    query(f"image_{_name}", "lineitem")(lambda df, k=_kernel: rounded(image.per_image(_bright(df) if k is not image.bilateral else _pixels(df), k), 6))
query("image_kapur", "lineitem", C.kapur(_PIXELS))(lambda df: image.kapur_threshold(_pixels(df).withColumn("v", F.floor("v"))))
query("image_multi_otsu", "lineitem")(lambda df: image.multi_otsu(_pixels(df).withColumn("v", F.floor("v"))))


@query("sparse_subtract_scale", "orders", f"select i, j, round(sum(v), 2) as v from (select i, j, v from {_ENTRIES} union all select i, j, -0.5 * v from {_ENTRIES}) group by 1, 2")
def _(df):
    e = _entries(df)
    return rounded(sparse.subtract(e, sparse.scale(e, 0.5)), 2)


@query("sparse_hadamard", "orders", f"select i, j, round(a.v * b.v, 2) as v from {_ENTRIES} a join (select j as i, i as j, v from {_ENTRIES}) b using (i, j)")
def _(df):
    e = _entries(df)
    return rounded(sparse.hadamard(e, sparse.transpose(e)), 2)


@query("sparse_measures", "orders", f"select count(*) as nnz, round(sum(v), 2) as sum, round(coalesce(sum(v) filter (where i = j), 0), 2) as trace, round(sqrt(sum(v * v)), 4) as frobenius, max(abs(i - j)) as bandwidth from {_ENTRIES} where v <> 0")
def _(df):
    m = sparse.measures(_entries(df))
    return m.select("nnz", F.round("sum", 2).alias("sum"), F.round("trace", 2).alias("trace"), F.round("frobenius", 4).alias("frobenius"), "bandwidth")


@query("sparse_kron", "nation", """
    with a as (select n_regionkey as i, n_nationkey as j, 1.0::double + n_nationkey as v from nation where n_nationkey < 5) select a.i * 5 + b.i as i, a.j * 5 + b.j as j, round(a.v * b.v, 6) as v from a, a b""")
def _(df):
    a = df.filter("n_nationkey < 5").select(F.col("n_regionkey").alias("i"), F.col("n_nationkey").alias("j"), (1.0 + F.col("n_nationkey")).alias("v"))
    return rounded(sparse.kron(a, a, 5, 5), 6)


@query("sparse_solve", "nation", "select n_nationkey as i, round(1.0::double + n_regionkey, 4) as x from nation")
def _(df):
    n = df.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("r"))
    a = n.select("i", F.col("i").alias("j"), F.lit(4.0).alias("v")).unionByName(n.filter("i < 24").select("i", (F.col("i") + 1).alias("j"), F.lit(-1.0).alias("v"))).unionByName(n.filter("i > 0").select("i", (F.col("i") - 1).alias("j"), F.lit(-1.0).alias("v")))
    b = sparse.apply(a, n.select(F.col("i").alias("j"), (1.0 + F.col("r")).alias("x")))
    return rounded(sparse.solve(a, b), 4)


@query("graph_components", "orders", "select node, node % 7 as root from (select distinct o_custkey as node from orders)")
def _(df):
    # each customer meets the next of its remainder by 7, so a class is a chain; the roots are shifted to the remainders
    c = df.select(F.col("o_custkey").alias("src")).distinct()
    out = sparse.components(c.select("src", (F.col("src") % 7 - 7).alias("dst")))
    return out.filter("node >= 0").select("node", (F.col("root") + 7).alias("root"))
