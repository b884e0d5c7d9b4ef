"""Exact removal of repeated passages by fingerprints of windows, in place of suffix subtrees.

A repeat of `window` words is an inner node of the suffix tree, of depth `window` or more, with
two leaves or more. No tree is built: only the nodes of depth `window` matter here, and those
are runs of equal fingerprints once the suffixes are sorted. They are dealt into groups that fit
in memory by a prefix:

* Of the first `window` words of a suffix, the `anchor`-word sequence with the least hash is
  its group prefix. Equal windows choose equal prefixes, and neighbouring windows mostly the same
  one, so a row stands for a run of suffixes: prefix, document, place, and a 64-bit
  fingerprint of the path of each suffix around the prefix.
* As many bits of the prefix hash are used as give groups of the wanted size. Prefixes are
  counted first; one of very many suffixes is lengthened to the whole window: its suffixes are
  dealt by prefix and path, which keeps equal windows together.
* Equal suffixes within 4 MB of text are one leaf (the earliest) already there; the others are
  known to be repeats and travel no further.
* A group is sorted by prefix and path; each run of equal paths is a node of depth `window`, and
  all its leaves but the earliest start a repeat.

Node labels are fingerprints: 64 bits of the prefix and 64 of the path, compared only together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.llm._spark import extended, filled_name, free, plus, total_chars
from metrolith.llm._text import SPACED, U, Words, chunks, gram, mix, strings, forget

ANCHOR = 8
#: Bytes of suffix rows in a group; with the arrays of its sort about six times that.
GROUP_BYTES = 4 << 20
_SUFFIX_BYTES = 10
#: Suffixes of one prefix from which on it is surely lengthened, as a share of a group.
_HOT_SHARE = 0.5
#: Bytes of text whose equal suffixes are merged before they travel.
_TASK_BYTES = 4 << 20
#: Documents without an id are told apart by their hash; this bit of a start marks them.
_NAMELESS = 31
_RUNS = np.dtype([("prefix", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("n", "<u2")])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each `width` consecutive values, the first of equals."""
    n = len(h) - width + 1
    best, at = h[:n].copy(), np.arange(n)
    for k in range(1, width):
        less = h[k : k + n] < best
        best[less] = h[k : k + n][less]
        at[less] += k - (at[less] - np.flatnonzero(less))
    return at


def _suffixes(w: Words, window: int, anchor: int):
    """(start, group prefix, path) of every suffix of `window` words or more."""
    if len(w) < window:
        z = np.zeros(0, U)
        return np.zeros(0, np.int64), z, z, np.zeros(0, np.int64)
    ok = np.flatnonzero(w.row[: len(w) - window + 1] == w.row[window - 1 :])
    short = gram(w.hash, anchor)
    at = _least(short, window - anchor + 1)[ok]
    path = mix(gram(w.hash, window)[ok] + (at - ok).astype(U))
    return ok, short[at], path, at


def _runs(starts, docs, texts) -> list[tuple]:
    """Runs of consecutive starts of the same document: (doc, text, start, count)."""
    if not len(starts):
        return []
    order = np.lexsort((starts, texts, docs))
    s, d, t = starts[order], docs[order], texts[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    b = np.flatnonzero(new)
    return d[b], t[b], s[b], np.diff(np.append(b, len(s)))


_PARTS = pa.schema([("g", pa.int64()), ("doc", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("rows", pa.binary())])


def _known(runs) -> pa.RecordBatch:
    d, t, s, n = runs
    k = len(d)
    return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(d, pa.int64()), pa.array(t.astype(np.int64)), pa.array(s.astype(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(k, pa.binary())], schema=_PARTS)


def _frequent(batches, least: int, window: int, anchor: int):
    """Prefixes of `least` suffixes or more of a few MB of text, and how many."""
    forget()
    for batch in batches:
        got, held = [], 0

        def counted(got=got):
            prefix, n = np.unique(np.concatenate(got), return_counts=True)
            often = n >= least
            return pa.RecordBatch.from_arrays([pa.array(prefix[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["p", "n"])

        for _, data, off in chunks(batch.column(0)):
            got.append(_suffixes(Words(data, off, SPACED), window, anchor)[1])
            held += len(data)
            if held >= _TASK_BYTES:
                yield counted()
                got.clear()
                held = 0
        if got:
            yield counted()


def hot_prefixes(docs: DataFrame, window: int, anchor: int, group_bytes: int, total: int, column: str = "text") -> np.ndarray:
    """Sorted prefixes to lengthen: surely those of `_HOT_SHARE` of a group, none of less than a third of that.

    A stretch of text reports a prefix from a count on that no more than two thirds of the wanted
    one can stay below in all stretches together.
    """
    wanted = max(3, int(_HOT_SHARE * group_bytes / _SUFFIX_BYTES))
    base = docs.select(F.col(column).cast("string"))
    if not total:
        return np.zeros(0, U)
    stretches = total / _TASK_BYTES + total / (1 << 20) / 4 + base.rdd.getNumPartitions()
    least = max(1, int(2 * wanted / 3 / stretches))
    counts = base.mapInArrow(lambda it: _frequent(it, least, window, anchor), "p bigint, n bigint")
    hot = counts.groupBy("p").agg(F.sum("n").alias("n")).filter(F.col("n") >= wanted // 3).select("p").toArrow()
    return np.sort(hot.column("p").to_numpy().astype(np.int64).view(U))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _split(batches, bits: int, window: int, anchor: int, hot):
    """Suffix rows by group, and repeats that some texts of a task show by themselves."""
    forget()
    for batch in batches:
        ids = np.asarray(batch.column(0))
        hashes = np.asarray(batch.column(1)).astype(np.int64).view(U) & U(0xFFFFFFFF)
        nameless = np.asarray(batch.column(2).cast(pa.int64())) << _NAMELESS
        got, held = [], 0
        for row, data, off in chunks(batch.column(3)):
            w = Words(data, off, SPACED)
            ok, prefix, path, at = _suffixes(w, window, anchor)
            doc = w.row[ok] + row
            got.append((prefix, path, doc, ok - w.first[w.row[ok]] + nameless[doc], at - w.first[w.row[ok]]))
            held += len(data)
            if held >= _TASK_BYTES:
                yield from _leaves(got, ids, hashes, bits, hot.value)
                got, held = [], 0
        if got:
            yield from _leaves(got, ids, hashes, bits, hot.value)


def _leaves(got, ids: np.ndarray, hashes: np.ndarray, bits: int, hot: np.ndarray):
    prefix, path, doc, start, at = (np.concatenate(x) for x in zip(*got, strict=True))
    got.clear()  # the joined arrays are enough
    if not len(prefix):
        return
    # equal suffixes of this batch: the earliest leaf stays
    key = mix(prefix) ^ (path * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    leaf = np.ones(len(prefix), bool)
    near = same.copy()
    near[:-1] |= same[1:]
    if near.any():
        o = order[near]
        o = o[np.lexsort((start[o], ids[doc[o]], start[o] >> _NAMELESS, path[o], prefix[o]))]
        new = np.ones(len(o), bool)
        new[1:] = (prefix[o][1:] != prefix[o][:-1]) | (path[o][1:] != path[o][:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        first = o[head]
        later = (ids[doc[o]] != ids[doc[first]]) | (start[o] != start[first])
        leaf[o[~new]] = False
        yield _known(_runs(start[o[later]], ids[doc[o[later]]], hashes[doc[o[later]]]))
    prefix, path, doc, start, at = prefix[leaf], path[leaf], doc[leaf], start[leaf], at[leaf]
    # runs of neighbouring suffixes with one prefix are one row; each suffix of a lengthened prefix is its own
    long = _among(prefix, hot)
    new = np.ones(len(prefix), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | long[1:]
    b = np.flatnonzero(new)
    size = np.diff(np.append(b, len(prefix)))
    # least hashes are small, so their own first bits would deal unevenly
    group = (mix(np.where(long[b], mix(prefix[b]) ^ path[b], prefix[b])) >> U(64 - bits)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    rows = np.zeros(len(b), _RUNS)
    rows["prefix"], rows["doc"], rows["text"], rows["start"], rows["n"] = prefix[b], ids[doc[b]], hashes[doc[b]], start[b], size
    rows, group = rows[order], group[order]
    # paths in the order of the rows
    far = np.repeat(b[order] - np.concatenate([[0], np.cumsum(size[order])[:-1]]), size[order]) + np.arange(len(prefix))
    paths = path[far].astype("<u8")
    ends = np.cumsum(size[order])
    cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(rows))
    out = []
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        lo = ends[x - 1] if x else 0
        out.append(np.int64(y - x).tobytes() + rows[x:y].tobytes() + paths[lo : ends[y - 1]].tobytes())
    z = pa.nulls(len(out), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(group[cut[:-1]], pa.int64()), z, z, z, z, pa.array(out, pa.binary())], schema=_PARTS)


_FOUND = "doc bigint, text bigint, start bigint, n bigint"


def _subtree(table: pa.Table) -> pa.Table:
    """All leaves but the earliest of every node of depth `window` in one group."""
    rows, paths = [], []
    for blob in table.column("rows").to_pylist():
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        r = np.frombuffer(blob, _RUNS, n, 8)
        rows.append(r)
        paths.append(np.frombuffer(blob, "<u8", -1, 8 + n * _RUNS.itemsize))
    r, path = np.concatenate(rows), np.concatenate(paths)
    size = r["n"].astype(np.int64)
    of = np.repeat(np.arange(len(r)), size)
    step = np.arange(len(path)) - np.repeat(np.cumsum(size) - size, size)
    key = mix(r["prefix"])[of] ^ (path * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    near = np.zeros(len(k), bool)
    near[1:] = k[1:] == k[:-1]
    near[:-1] |= near[1:]
    o = order[near]
    doc, start, pre = r["doc"][of[o]], r["start"][of[o]].astype(np.int64) + step[o], r["prefix"][of[o]]
    s = np.lexsort((start, doc, start >> _NAMELESS, path[o], pre))
    o, doc, start, pre = o[s], doc[s], start[s], pre[s]
    new = np.ones(len(o), bool)
    new[1:] = (pre[1:] != pre[:-1]) | (path[o][1:] != path[o][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0)) if len(o) else np.zeros(0, np.int64)
    later = (doc != doc[head]) | (start != start[head])
    runs = _runs(start[later], doc[later], r["text"][of[o[later]]])
    if not runs:
        runs = (np.zeros(0, np.int64),) * 4
    return pa.table({n: pa.array(x.astype(np.int64), pa.int64()) for n, x in zip(("doc", "text", "start", "n"), runs, strict=True)})


def repeats(docs: DataFrame, window: int = 20, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES, column: str = "text") -> DataFrame:
    """(doc, text, start, n): n windows from word `start` on that also start earlier.

    text is 32 bits of the text's hash. doc is that hash for a null id, and bit 31 of start is set.
    """
    if not 1 <= anchor <= window < 1 << 16:
        raise ValueError("a window has up to 65535 words, an anchor 1 to `window`")
    total = total_chars(docs, column)
    bits = max(4, int(np.ceil(np.log2(max(1, total) / 5 * _SUFFIX_BYTES / group_bytes + 1))))
    hot = docs.sparkSession.sparkContext.broadcast(hot_prefixes(docs, window, anchor, group_bytes, total, column))
    base = docs.select(*_identity(column), F.col(column).cast("string").alias("t"))
    parts = base.mapInArrow(lambda it: _split(it, bits, window, anchor, hot), "g bigint, doc bigint, text bigint, start bigint, n bigint, rows binary")
    groups = parts.filter("g is not null").select("g", "rows").groupBy("g").applyInArrow(_subtree, _FOUND)
    return groups, parts.filter("g is null").select("doc", "text", "start", "n")


def _identity(column: str) -> list[Column]:
    """doc, h and nameless, which tell documents apart and order them."""
    h = F.xxhash64(F.col(column).cast("string"))
    return [F.coalesce(F.col("doc_id").cast("bigint"), h).alias("doc"), h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"), F.col("doc_id").cast("bigint").isNull().alias("nameless")]


def _cleared(batches, runs: str, column: str, window: int):
    """The rows without the words of their runs, in batches of about CHUNK bytes of text: a whole one with its result is several times a batch."""
    forget()
    for batch in batches:
        known = batch.column(batch.schema.get_field_index(runs))
        rest = batch.select([n for n in batch.schema.names if n != runs])
        for row, data, off in chunks(batch.column(batch.schema.get_field_index(filled_name(batch, column)))):
            w = Words(data, off, SPACED, hashed=False)
            raws = strings(data, off)
            total, removed, left = np.diff(w.first), [], []
            for r, n in enumerate(total.tolist()):
                mine = known[row + r].as_py()
                if not mine:
                    removed.append(0)
                    left.append(raws[r])
                    continue
                a = w.first[r]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [m["start"] for m in mine], 1)
                np.add.at(edge, [m["start"] + m["n"] - 1 + window for m in mine], -1)
                stay = np.flatnonzero(np.cumsum(edge)[:-1] <= 0)
                removed.append(n - len(stay))
                s, e = (w.start[a + stay] - off[r]).tolist(), (w.end[a + stay] - off[r]).tolist()
                left.append(b" ".join([raws[r][x:y] for x, y in zip(s, e, strict=True)]))
            yield extended(rest.slice(row, len(raws)), n_words=pa.array(total, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept=pa.array(left, pa.binary()).cast(pa.string()))


def dedup_substrings(docs: DataFrame, window: int = 20, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES, column: str = "text") -> DataFrame:
    """Removes every word that a window of words covers which also starts earlier.

    Adds n_words and n_removed long and `kept` string: the kept words joined by one space, or the
    text itself where nothing is removed. Words are those of `[^\\x20\\x09-\\x0D]+`, unchanged.
    Earlier is a smaller doc_id, or the same one and an earlier word; windows are judged on the
    input. A null doc_id comes after all others; among these the hash of the text stands for it.

    Null, empty and short texts have no window and keep all they have (null: an empty text). Rows
    that repeat one doc_id and text stand at the same place, so neither is earlier. An empty table
    gives no rows. Columns that bear an added name are replaced.
    """
    groups, known = repeats(docs, window, anchor, group_bytes, column)
    marks = groups.unionByName(known).groupBy("doc", F.col("text").alias("h"), (F.shiftright("start", _NAMELESS) == 1).alias("nameless"))
    kept, key = free(docs, "runs"), free(docs, "identity")
    marks = marks.agg(F.collect_list(F.struct(F.col("start").bitwiseAND(F.lit((1 << _NAMELESS) - 1)).alias("start"), "n")).alias(kept))
    marks = marks.select(F.struct("doc", "h", "nameless").alias(key), kept)
    joined = docs.withColumn(key, F.struct(*_identity(column))).join(marks, key, "left").select(*[f"`{c}`" for c in docs.columns], kept)

    return joined.mapInArrow(lambda it: _cleared(it, kept, column, window), plus(docs.schema, "n_words bigint, n_removed bigint, kept string"))


def digests(out: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256: the digest of the kept words joined by one space.

    Worked out by Spark itself: a second step in Python would hold two more workers an executor, with their batches.
    """
    words = F.btrim(F.regexp_replace("kept", r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
