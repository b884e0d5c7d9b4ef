"""Workbooks, MAT files and text converters: whole files decoded on executors, values converted as Columns."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.sources.files import _decoded


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_cells(raw: bytes) -> dict[str, list]:
    """Cells of all sheets: sheet name, row and column from 0, text, number (None unless numeric)."""
    out: dict[str, list] = {k: [] for k in ("sheet", "row", "col", "text", "number")}
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in (e for e in book.iter() if tag(e) == "sheet"):
            target = links[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            for c in (e for e in root.iter() if tag(e) == "c"):
                kind, v = c.get("t", "n"), next((e.text for e in c if tag(e) == "v"), None)
                text = shared[int(v)] if kind == "s" else "".join(t.text or "" for t in c.iter() if tag(t) == "t") if kind == "inlineStr" else v
                if text is None:
                    continue
                ref = c.get("r")
                out["sheet"].append(s.get("name"))
                out["row"].append(int(re.search(r"\d+", ref).group()) - 1)
                out["col"].append(_column(ref))
                out["text"].append(text)
                out["number"].append(float(v) if kind == "n" else None)
    return out


def read_xlsx(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """Rows (path, sheet, row, col, text, number), one a filled cell."""
    return _decoded(spark, path, pattern, "sheet string, row bigint, col bigint, text string, number double", workbook_cells)


def write_xlsx(rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet with numbers and inline text."""
    from xml.sax.saxutils import escape

    def name(j: int) -> str:
        return name(j // 26 - 1) + chr(65 + j % 26) if j >= 26 else chr(65 + j)

    def cell(i: int, j: int, v) -> str:
        at = f'r="{name(j)}{i + 1}"'
        return f"<c {at}><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    main, rel, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


#: Element types of MAT version 5 as numpy types, and its numeric classes.
_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}
_MAT_NUMERIC = range(4, 16)


def mat_arrays(raw: bytes) -> list[tuple[str, tuple[int, ...], np.ndarray]]:
    """(name, shape, values in column order) of the numeric and text arrays of a version 5 file; the real part of complex ones."""
    order = "<" if raw[126:128] == b"IM" else ">"

    def elements(data: bytes):
        at = 0
        while at + 8 <= len(data):
            kind, size = struct.unpack_from(order + "II", data, at)
            if kind >> 16:  # type and size share the first word, the data is in the second
                kind, size, start, end = kind & 0xFFFF, kind >> 16, at + 4, at + 8
            else:
                start = at + 8
                end = start + size + (-size % 8 if kind != 15 else 0)
            yield kind, data[start : start + size]
            at = end

    out = []
    for kind, data in elements(raw[128:]):
        if kind == 15:
            kind, data = next(elements(zlib.decompress(data)))
        if kind != 14:
            continue
        parts = list(elements(data))
        if len(parts) < 4 or parts[0][1][0 if order == "<" else 3] not in _MAT_NUMERIC:
            continue
        shape = tuple(int(v) for v in np.frombuffer(parts[1][1], order + "i4"))
        out.append((parts[2][1].decode("latin-1"), shape, np.frombuffer(parts[3][1], order + _MAT_TYPES[parts[3][0]]).astype(float)))
    return out


def read_mat(spark: SparkSession, path: str, pattern: str = "*.mat") -> DataFrame:
    """Rows (path, name, rows, i, value): element i counts down the columns of an array with that many rows."""

    def decode(raw: bytes) -> dict:
        a = mat_arrays(raw)
        join = lambda f: np.concatenate([f(*x) for x in a]) if a else []
        return {"name": join(lambda n, s, v: np.full(len(v), n, object)), "rows": join(lambda n, s, v: np.full(len(v), s[0])), "i": join(lambda n, s, v: np.arange(len(v))), "value": join(lambda n, s, v: v)}

    return _decoded(spark, path, pattern, "name string, rows bigint, i bigint, value double", decode)


def to_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))


def json2csv(s: Column | str, schema: str) -> Column:
    return F.to_csv(F.from_json(s, schema))


def csv2json(s: Column | str, schema: str) -> Column:
    return F.to_json(F.from_csv(s, schema))


def json2xml(s: Column | str, schema: str, tag: str = "row") -> Column:
    return F.to_xml(F.from_json(s, schema), {"rowTag": tag})


def xml2json(s: Column | str, schema: str, tag: str = "row") -> Column:
    return F.to_json(F.from_xml(s, schema, {"rowTag": tag}))


def _edit(change) -> Column:
    import json

    import pandas as pd

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        tree = json.loads(text)
        change(tree)
        return json.dumps(tree, separators=(",", ":"), ensure_ascii=False)

    return F.pandas_udf(lambda s: pd.Series([one(t) for t in s], dtype=object), "string")


def _walk(tree, keys: list[str]):
    for k in keys:
        tree = tree[int(k)] if isinstance(tree, list) else tree.setdefault(k, {})
    return tree


def json_set(s: Column | str, path: str, value) -> Column:
    """The value at a dotted path; missing objects on the way are made."""
    *way, last = path.split(".")

    def change(tree) -> None:
        at = _walk(tree, way)
        at[int(last) if isinstance(at, list) else last] = value

    return _edit(change)(s)


def json_delete(s: Column | str, path: str) -> Column:
    """Without what is at a dotted path; nothing happens where it is absent."""
    *way, last = path.split(".")

    def change(tree) -> None:
        for k in way:
            tree = tree.get(k) if isinstance(tree, dict) else tree[int(k)] if isinstance(tree, list) and int(k) < len(tree) else None
        if isinstance(tree, dict):
            tree.pop(last, None)
        elif isinstance(tree, list) and int(last) < len(tree):
            del tree[int(last)]

    return _edit(change)(s)
