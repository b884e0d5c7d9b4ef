"""Every registered query of the library against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from metrolith import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert cols
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_zip_pairs_by_position(spark, duck, tmp_path):
    names = [(1, "a#b", "xIyIz"), (2, None, "xIy"), (3, "", None), (4, None, None), (5, "#", "")]
    spark.createDataFrame(names, "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    c = duckdb.connect()
    c.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    for d, con in ((DIR, duck), (str(tmp_path), c)):
        got = {r["c_custkey"]: r.asDict(recursive=True)["pairs"] for r in catalog.queries()["table_zip"](spark, d).collect()}
        assert got == {k: [list(p) for p in pairs] for k, pairs in con.execute(catalog.oracle_sql()["table_zip"]).fetchall()}


def test_otsu_of_plain_and_odd_images(spark, tmp_path):
    nan, inf = math.nan, math.inf
    images = {1: [25.2, 25.7, 25.0], 2: [25.0], 3: [1.0, nan, 9.0], 4: [None, 3.0, 8.0, 3.5], 5: [None], 6: [inf, 2.0], 7: [-inf, 2.0, 4.0], 8: [24.0, 25.0, 26.0], 9: [nan, nan], 10: [-1.5, -0.5, 7.0], None: [4.0, 5.0, 5.0]}
    rows = [(k, y, y, v) for k, values in images.items() for y, v in enumerate(values)]
    spark.createDataFrame(rows, "l_linenumber int, l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {r["image"]: plain(r["threshold"]) for r in catalog.queries()["image_otsu"](spark, str(tmp_path)).collect()}
    assert got == {k: plain(v) for k, v in c.execute(catalog.oracle_sql()["image_otsu"]).fetchall()}
    assert got[1] == got[2] == "25"


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_documents_of_odd_texts(spark, tmp_path, ansi):
    texts = [None, "", " ", "\n", "\r\n", "\n\n", "a\n", "a\r\nb", " the\n ththee ", "e\u0301 \U0001f600\0\u2028b\x85"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    r = c.execute(catalog.oracle_sql()["text_documents"])
    names, was = [d[0] for d in r.description], spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = catalog.queries()["text_documents"](spark, str(tmp_path)).select(names).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)
    assert sorted(map(tuple, got)) == sorted(r.fetchall())
