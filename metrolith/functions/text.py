"""String functions over Columns: positions from 0, lengths clamp, absent marks mean what the comments say."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(s: Column | str) -> Column:
    return F.col(s) if isinstance(s, str) else s


def substr(s, start: int, length: int | None = None) -> Column:
    return F.substring(_c(s), start + 1, 2**31 - 1 - start if length is None else max(0, length))


mid = substr


def left(s, n: int) -> Column:
    return F.substring(_c(s), 1, max(0, n))


def right(s, n: int) -> Column:
    s = _c(s)
    return F.when(F.lit(n) >= F.length(s), s).otherwise(F.right(s, F.lit(max(0, n))))


def index_of(s, sub: str) -> Column:
    """None where absent."""
    return F.nullif(F.instr(_c(s), sub), F.lit(0)) - 1


def last_index_of(s, sub: str) -> Column:
    s = _c(s)
    return F.when(F.instr(s, sub) > 0, F.length(s) - F.instr(F.reverse(s), sub[::-1]) - (len(sub) - 1))


def insert(s, i: int, text: str) -> Column:
    s = _c(s)
    return F.concat(F.substring(s, 1, i), F.lit(text), F.substring(s, i + 1, 2**31 - 1 - i))


def remove(s, text: str) -> Column:
    return F.replace(_c(s), F.lit(text), F.lit(""))


def pad_left(s, width: int, fill: str = " ") -> Column:
    s = _c(s)
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def pad_right(s, width: int, fill: str = " ") -> Column:
    s = _c(s)
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def trim(s, chars: str = " \t\r\n") -> Column:
    return F.btrim(_c(s), F.lit(chars))


def ltrim(s, chars: str = " \t\r\n") -> Column:
    return F.ltrim(_c(s), F.lit(chars))


def rtrim(s, chars: str = " \t\r\n") -> Column:
    return F.rtrim(_c(s), F.lit(chars))


def before(s, mark: str) -> Column:
    """The whole string where the mark is absent."""
    return F.substring_index(_c(s), mark, 1)


def after(s, mark: str) -> Column:
    s = _c(s)
    at = F.instr(s, mark)
    return F.when(at == 0, s).otherwise(F.substr(s, at + len(mark)))


def before_last(s, mark: str) -> Column:
    s = _c(s)
    at = last_index_of(s, mark)
    return F.when(at.isNull(), s).otherwise(F.substr(s, F.lit(1), at))


def after_last(s, mark: str) -> Column:
    return F.substring_index(_c(s), mark, -1)


def split(s, delim: str, limit: int = -1) -> Column:
    return F.split(_c(s), re.escape(delim), limit)


def lines(s) -> Column:
    """Either line ending; no empty last line."""
    parts = F.split(_c(s), r"\r?\n")
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def like(s, pattern: str) -> Column:
    """Wildcards * ? # and [...], anchored at both ends."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)", "#": "[0-9]"}.get(c, re.escape(c))
        i += 1
    return _c(s).rlike(f"^{out}\\z")


def count(s, sub: str) -> Column:
    """Non-overlapping occurrences."""
    s = _c(s)
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def regex_match(s, pattern: str) -> Column:
    return _c(s).rlike(pattern)


def regex_find(s, pattern: str) -> Column:
    """None without a match."""
    return F.regexp_substr(_c(s), F.lit(pattern))


def regex_find_all(s, pattern: str) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(pattern), F.lit(0))


def regex_groups(s, pattern: str) -> Column:
    """None without a match; '' for a group that took no part."""
    n = re.compile(pattern).groups
    return F.when(_c(s).rlike(pattern), F.array(*[F.regexp_extract(_c(s), pattern, k) for k in range(1, n + 1)]))


def regex_replace(s, pattern: str, repl: str) -> Column:
    return F.regexp_replace(_c(s), pattern, repl)


def regex_split(s, pattern: str) -> Column:
    return F.split(_c(s), pattern)


def regex_count(s, pattern: str) -> Column:
    return F.regexp_count(_c(s), F.lit(pattern))


def grep(s, pattern: str, invert: bool = False) -> Column:
    """Lines that match, or that don't."""
    return F.filter(lines(s), lambda x: ~x.rlike(pattern) if invert else x.rlike(pattern))


def capitalize(s) -> Column:
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 2)))


def proper(s) -> Column:
    return F.initcap(_c(s))


def compare(a, b, ignore_case: bool = False) -> Column:
    a, b = (F.lower(_c(x)) if ignore_case else _c(x) for x in (a, b))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def repeat_str(s, n: int) -> Column:
    return F.repeat(_c(s), max(0, n))


def reverse(s) -> Column:
    return F.reverse(_c(s))


def chars(s) -> Column:
    return F.filter(F.split(_c(s), ""), lambda x: x != "")


def ord_(s) -> Column:
    return F.ascii(_c(s))


def chr_(n) -> Column:
    return F.char(_c(n))


def starts_with(s, prefix: str) -> Column:
    return _c(s).startswith(prefix)


def ends_with(s, suffix: str) -> Column:
    return _c(s).endswith(suffix)


def contains(s, sub: str) -> Column:
    return _c(s).contains(sub)


def replace(s, old: str, new: str) -> Column:
    return F.replace(_c(s), F.lit(old), F.lit(new))


def upper(s) -> Column:
    return F.upper(_c(s))


def lower(s) -> Column:
    return F.lower(_c(s))


def dec2bin(n) -> Column:
    return F.bin(_c(n))


def dec2hex(n) -> Column:
    return F.hex(_c(n))


def bin2dec(s) -> Column:
    return F.conv(_c(s), 2, 10).cast("bigint")


def hex2dec(s) -> Column:
    return F.conv(_c(s), 16, 10).cast("bigint")


def crc32(s) -> Column:
    return F.crc32(_c(s).cast("binary"))


def to_int(s) -> Column:
    """Half away from zero; bad text is an error."""
    return F.round(_c(s).cast("double")).cast("bigint")


def to_float(s) -> Column:
    return _c(s).cast("double")


def to_bool(s) -> Column:
    return _c(s).cast("boolean")


def json_get(s, path: str) -> Column:
    return F.get_json_object(_c(s), "$." + path)
