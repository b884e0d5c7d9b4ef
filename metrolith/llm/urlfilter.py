"""URL filters with DataFrame functions only: prefix rules, and a Bloom filter cascade of listed domains.

The cascade knows the universe it is asked about, all domains (hosts and their parents) of the
pages. Level 1 encodes the listed ones; level 2 encodes those not listed that level 1 lets
through by mistake, level 3 the listed ones that level 2 lets through, and so on until no
mistake is left. A domain is listed exactly when the first level that lacks it is an even one (or
none lacks it and their number is odd), so no page needs a join.

Keys are dealt into shards by hash; a shard has a cascade of its own and all are made at once. The
levels are binary literals of the plan. Shards whose levels take too much for one plan are asked in
several narrow passes over the pages, so a list may have any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.llm._spark import cut, free

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits a key, hashes a key, listed keys of a shard, and bytes of bits that one pass over the pages takes along.
BITS, HASHES, SHARD_KEYS, PASS_BYTES = 10, 5, 1 << 18, 4 << 20


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? #, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and all its parents; none for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host, path) that fits; null if none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, F.lit(h + p)).otherwise(which), F.when(fits, F.lit(v)).otherwise(verdict)
    return which, verdict


def _places(key: Column, level: int, bits: int) -> list[Column]:
    a, b = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits - 1)) + 1
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(HASHES)]


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0), F.lit(shards)), F.lit(shards)).cast("int")


@dataclass
class Level:
    """One level of all shards of a cascade; each shard has `bits` bits."""

    number: int
    bits: int
    data: np.ndarray  # shards x bytes

    def has(self, key: Column, shard: Column, lo: int, hi: int) -> Column:
        """Whether the level holds a key of the shards from lo to hi."""
        data, start, out = F.lit(bytearray(self.data[lo:hi].tobytes())), (shard - lo) * self.data.shape[1], F.lit(True)
        for at in _places(key, self.number, self.bits):
            byte = F.conv(F.hex(F.substring(data, (start + F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            # a bit by a column needs SQL's operator
            out = out & (F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


class Cascade:
    def __init__(self, shards: int, levels: list[Level]):
        self.shards, self.levels = shards, levels

    def passes(self) -> list[tuple[int, int]]:
        """Ranges of shards of which all levels together have PASS_BYTES at most (or one shard)."""
        step = max(1, PASS_BYTES // max(1, sum(level.data.shape[1] for level in self.levels)))
        return [(lo, min(self.shards, lo + step)) for lo in range(0, self.shards, step)]

    def listed(self, key: Column, lo: int = 0, hi: int | None = None) -> Column:
        """Whether the key is listed and in a shard from lo to hi."""
        hi = self.shards if hi is None else hi
        shard, out = _shard(key, self.shards), F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.has(key, shard, lo, hi), F.lit(level.number % 2 == 0)).otherwise(out)
        return out if (lo, hi) == (0, self.shards) else F.when((shard >= lo) & (shard < hi), out).otherwise(False)


def _level(keys: DataFrame, most: int, number: int, shards: int) -> Level:
    size = 8 * max(1, -(-most * BITS // 64))
    at = keys.select(_shard(F.col("key"), shards).alias("s"), F.explode(F.array(*_places(F.col("key"), number, 8 * size))).alias("at"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
    got = at.groupBy("s", F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(mask).alias("m")).toArrow()
    out = np.zeros((shards, size // 8), "<i8")
    out[got.column("s").to_numpy(), got.column("w").to_numpy()] = got.column("m").to_numpy()
    return Level(number, 8 * size, out.view(np.uint8))


def cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """Levels that tell listed keys of the universe from all its others.

    Both have a column `key`. Their keys are told apart by one aggregation. All levels
    together take about 10 bits for a listed key of the universe and far less for the mistakes above
    it; these bits pass through the driver (2 MB for a million listed keys of the universe).
    """
    both = universe.select("key", F.lit(0).alias("l")).unionByName(listed.select("key", F.lit(1).alias("l"))).filter("key is not null")
    known = cut(both.groupBy("key").agg(F.min("l").alias("foreign"), F.max("l").alias("l")).filter("foreign = 0").select("key", (F.col("l") == 1).alias("l")))
    one, other, levels, shards = known.filter("l").select("key"), known.filter("not l").select("key"), [], 0
    while True:
        if not shards:
            shards = max(1, -(-one.count() // SHARD_KEYS))
        sizes = one.groupBy(_shard(F.col("key"), shards)).count().agg(F.max("count")).first()[0]
        if not sizes:
            return Cascade(shards, levels)
        level = _level(one, sizes, len(levels) + 1, shards)
        levels.append(level)
        asked, step, shard = other.select("key", F.lit(False).alias("in")), max(1, PASS_BYTES // level.data.shape[1]), _shard(F.col("key"), shards)
        for lo in range(0, shards, step):
            hi = min(shards, lo + step)
            asked = cut(asked.select("key", F.when((shard >= lo) & (shard < hi), level.has(F.col("key"), shard, lo, hi)).otherwise(F.col("in")).alias("in")))
        rows = asked.filter("in").select("key")
        one, other = rows, one


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict (allow or block) to every row.

    rules are (verdict, host, path); one fits its host and all subdomains if the path of the url
    starts with its path, and the longest host and path wins. Without one the verdict is block if
    the host or a parent of it is in `listed` (a column `key`), else allow.

    A null url, or one without ://, has an empty host and path, which no rule fits and no list
    holds: allow. Nulls and repeats in `listed` don't count. An empty table gives no rows; an older
    column of an added name is replaced.
    """
    host, path, block = (free(pages, c) for c in ("new host", "new path", "new block"))
    out = pages.withColumns({host: host_of(F.col(f"`{url}`")), path: path_of(F.col(f"`{url}`"))})
    which, verdict = rule(F.col(f"`{host}`"), F.col(f"`{path}`"), rules)
    universe = out.select(F.col(f"`{host}`").alias("h")).distinct().select(F.explode(domains(F.col("h"))).alias("key")).distinct()
    found = cascade(universe, listed)
    passes = found.passes()
    for k, (lo, hi) in enumerate(passes):
        here = F.exists(domains(F.col(f"`{host}`")), lambda d: found.listed(d, lo, hi))  # called at once
        out = out.withColumn(block, here if k == 0 else F.col(f"`{block}`") | here)
        if k + 1 < len(passes):
            out = cut(out)
    added = {"host": F.col(f"`{host}`"), "path": F.col(f"`{path}`"), "rule": which, "verdict": F.coalesce(verdict, F.when(F.col(f"`{block}`"), "block").otherwise("allow"))}
    keep = [f"`{c}`" for c in pages.columns if c.lower() not in added]
    return out.select(*keep, *[v.alias(n) for n, v in added.items()])


def listed_by_digest(pages: DataFrame, least: str = "1", url: str = "url") -> DataFrame:
    """Domains of the pages, of two labels or more, whose MD5 digest in hex lies below `least`: a list that no pattern tells."""
    key = F.col("key")
    return pages.select(host_of(F.col(url)).alias("h")).distinct().select(F.explode(domains(F.col("h"))).alias("key")).distinct().filter(key.contains(".") & (F.md5(key) < least))
