"""Quality rules: counts of each text, and the perplexity of a Kneser-Ney model of its words.

The model is an interpolated modified Kneser-Ney model of word pairs, counted over all documents in
three steps:

* Words, with their language tag, fall into `CLASSES` hash classes; Spark counts these by fold. The
  most frequent `VOCABULARY` classes are the words of the model, the others are `rare` words of their
  language, whose probability is shared out by the counts of their classes.
* Stretches of documents send the pairs of words that each text has to shards by a scrambled code of
  the pair. A shard merges them into one sorted array of codes with counts by fold; sums over the
  shards give counts, continuation counts and discounts of each word.
* Each shard looks up the pairs of its texts in its array by binary search and returns one partial
  sum a text.

No side of this is broadcast but tables of a fixed number of entries (classes and words). Texts are
dealt into folds by their hash, and a text is scored by the counts of the other folds, so neither it
nor a copy of it vouches for itself. A document is rejected when its bits a word lie outside the
band of its language, which is set by the median and the median deviation of the distinct texts of
that language that pass the base rules.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.llm._spark import cut, extended, filled_name, free, plus, total_chars
from metrolith.llm._text import ALNUM, LOWER, SPACED, U, Words, chunks, filled, forget, gram, mix, strings

MIN_WORDS = 50
#: Per cent of the words that may lie in repeated 3-word windows.
MAX_REPEATED = 50
#: Band: up to so many median deviations and bits a word above the median, and from this share of the
#: median up. A near copy of texts of the other folds costs a third of the median or more and stays.
BAND_MAD, BITS_ABOVE, SHARE_BELOW = 6.0, 1.0, 0.25
FOLDS = 2
#: Hash classes of words, words of the model, and ids of rare words (by language); ids take ID_BITS.
CLASSES, ID_BITS, RARE = 1 << 20, 15, 1 << 10
VOCABULARY = (1 << ID_BITS) - RARE
#: Bytes of text that a shard stands for, the most shards, and bytes and texts of a stretch.
SHARD_BYTES, MAX_SHARDS, STRETCH_BYTES, STRETCH_TEXTS = 64 << 20, 256, 8 << 20, 1 << 15
_CODE_BITS = 2 * ID_BITS
_ODD = 0x2545F491
_BACK = pow(_ODD, -1, 1 << _CODE_BITS)
_MASK = (1 << _CODE_BITS) - 1
_SLICE = 1 << 14
_BINS = 100  # a bit
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_TAG = re.compile(r"[a-z]{2,3}(?![a-z])")


def tag(lang: str | None) -> str:
    """The primary subtag of a language name, of two or three letters; `und` for anything else."""
    m = _TAG.match((lang or "").lower())
    return m[0] if m else "und"


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    rows = len(off) - 1
    w = Words(data, off, SPACED)
    n = np.diff(w.first)
    lead = SPACED[data] & ((data & 0xC0) != 0x80)

    def per_row(flags):
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[off[1:]] - c[off[:-1]]

    repeat = np.zeros(len(w), np.int64)
    g = gram(w.hash, 3)
    ok = np.flatnonzero(w.row[: len(g)] == w.row[2:][: len(g)])
    h, row = g[ok], w.row[ok]
    order = np.argsort(h)
    order = order[np.argsort(row[order], kind="stable")]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = ok[order[same[:-1] | same[1:]]]
    for k in range(3):
        repeat[twice + k] = 1
    c = np.concatenate([[0], np.cumsum(repeat)])
    dup = np.zeros(rows, np.int64)
    for r, raw in enumerate(strings(data, off)):
        if b"\n" in raw:
            lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup[r] = len(lines) - len(set(lines))
    return {"n_words": n, "word_chars": per_row(lead), "n_symbols": per_row(_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": c[w.first[1:]] - c[w.first[:-1]]}


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])


def _seeds(tags: list[str]) -> np.ndarray:
    """A number below 2**32 for each tag."""
    known = {t: zlib.crc32(t.encode()) for t in set(tags)}
    return np.array([known[t] for t in tags], np.int64)


def _keys(raws: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """A 64-bit key of text and tag; its last bit is the fold of the text."""
    a = np.array([zlib.crc32(x) | (zlib.adler32(x) ^ len(x) * 2654435761 & 0xFFFFFFFF) << 32 for x in raws], U)
    return (mix(mix(a) ^ seeds.astype(U)) & ~U(1)) | (a & U(1))


@dataclass
class Text:
    """A run of texts as the model sees them."""

    data: np.ndarray
    off: np.ndarray
    raws: list[bytes]
    keys: np.ndarray
    seeds: np.ndarray
    words: Words
    classes: np.ndarray

    @property
    def folds(self) -> np.ndarray:
        return (self.keys & U(1)).astype(np.int64)


def _texts(batch: pa.RecordBatch):
    """Runs of texts of a batch (text, lang)."""
    tags = [tag(x) for x in batch.column(1).to_pylist()]
    for first, data, off in chunks(batch.column(0)):
        raws, seeds = strings(data, off), _seeds(tags[first : first + len(off) - 1])
        w = Words(LOWER[data], off, ALNUM)
        classes = (mix(w.hash ^ mix(seeds.astype(U) + U(1))[w.row]) >> U(64 - CLASSES.bit_length() + 1)).astype(np.int64)
        yield Text(data, off, raws, _keys(raws, seeds), seeds, w, classes)


def _base(docs: DataFrame, column: str, lang: str) -> DataFrame:
    return docs.select(F.col(column).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, "<i8").tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<i8")


_PART = "k long, x binary"


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of packed arrays by key k. Keys and lengths are fixed, so what reaches the driver is bounded."""

    def run(batches):
        key, total = None, None
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([_packed(total)], pa.binary())], names=["k", "x"])
                    key, total = k, 0
                total = total + _unpacked(x.as_py())
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([_packed(total)], pa.binary())], names=["k", "x"])

    got = parts.repartition("k").sortWithinPartitions("k").mapInArrow(run, _PART).toArrow()
    return {k: _unpacked(x) for k, x in zip(got.column("k").to_pylist(), got.column("x").to_pylist(), strict=True)}


def count_classes(docs: DataFrame, column: str = "text", lang: str = "lang") -> np.ndarray:
    """Counts of word classes over all documents (folds x CLASSES)."""

    def run(batches):
        forget()
        total = np.zeros(FOLDS * CLASSES, np.int64)
        for batch in batches:
            for x in _texts(batch):
                total += np.bincount(x.classes + CLASSES * x.folds[x.words.row], minlength=FOLDS * CLASSES)
        for k in range(0, len(total), _SLICE):
            if total[k : k + _SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_packed(total[k : k + _SLICE])], pa.binary())], names=["k", "x"])

    out = np.zeros(FOLDS * CLASSES, np.int64)
    for k, x in _summed(_base(docs, column, lang).mapInArrow(run, _PART)).items():
        out[k : k + _SLICE] = x
    return out.reshape(FOLDS, CLASSES)


@dataclass
class Vocabulary:
    """ids: the id of each class, -1 for a rare one. rare: bits of a rare class among the rare words of each fold."""

    ids: np.ndarray
    rare: np.ndarray


def vocabulary(counts: np.ndarray) -> Vocabulary:
    total = counts.sum(0)
    often = np.argsort(-total, kind="stable")[:VOCABULARY]
    often = often[total[often] > 1]
    ids = np.full(CLASSES, -1, np.int32)
    ids[often] = np.arange(len(often))
    n = np.where(ids >= 0, 0, counts) + 0.5
    return Vocabulary(ids, -np.log2(n / n.sum(1)[:, None]).astype(np.float32))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The first `width` bytes of numbers, each plane compressed by itself, with their lengths."""
    raw = np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4)
    out = [zlib.compress(raw[:, k].tobytes(), 1) for k in range(width)]
    return b"".join(len(p).to_bytes(4, "little") + p for p in out)


def _numbers(blob: memoryview, at: int, width: int) -> tuple[np.ndarray, int]:
    out = None
    for k in range(width):
        n = int.from_bytes(blob[at : at + 4], "little")
        plane = np.frombuffer(zlib.decompress(blob[at + 4 : at + 4 + n]), np.uint8).astype(np.int64)
        at += 4 + n
        out = plane if out is None else out | plane << (8 * k)
    return out, at


def _entries(code: np.ndarray, text: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted (code, text, times) as one value: gaps of codes, texts of each code, times."""
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    b = np.flatnonzero(new)
    return _planes(np.diff(code[b], prepend=0), 4) + _planes(np.diff(np.append(b, len(code))), 2) + _planes(text, 2) + _planes(np.minimum(times, 65535), 2)


def _read(blob: bytes):
    """(codes, how many entries each has, text and times of each entry)."""
    blob = memoryview(blob)
    gaps, at = _numbers(blob, 0, 4)
    n, at = _numbers(blob, at, 2)
    text, at = _numbers(blob, at, 2)
    times, _ = _numbers(blob, at, 2)
    return np.cumsum(gaps), n, text, times


#: g: shard (-1: the texts of a stretch). x: entries, or keys. y: folds packed, or for texts their tags and sums.
_ENTRIES = "g long, block long, x binary, y binary"
_TEXTS = np.dtype([("key", "<u8"), ("bits", "<f4"), ("pairs", "<u4"), ("seed", "<u4"), ("ok", "u1")])


def _pairs(docs: DataFrame, words, shards: int, column: str, lang: str) -> DataFrame:
    """Rows of pairs by shard and stretch, and a row of the texts of each stretch."""
    shift = _CODE_BITS - shards.bit_length() + 1

    def flush(codes, texts, about):
        about = np.concatenate(about)
        block = int(mix(np.array([mix(about["key"] + np.arange(len(about), dtype=U)).sum(dtype=U)], U))[0].astype(np.int64))
        key = np.sort((np.concatenate(codes).astype(np.int64) << 16) | np.concatenate(texts))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        b = np.flatnonzero(new)
        times = np.diff(np.append(b, len(key)))
        code, text = key[b] >> 16, key[b] & 0xFFFF
        cuts = np.searchsorted(code >> shift, np.arange(shards + 1))
        folds = np.packbits((about["key"] & U(1)).astype(np.uint8)).tobytes()
        g, x = [], []
        for s in range(shards):
            lo, hi = cuts[s], cuts[s + 1]
            if hi > lo:
                g.append(s)
                x.append(_entries(code[lo:hi], text[lo:hi], times[lo:hi]))
        g.append(-1)
        x.append(about.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([block] * len(g), pa.int64()), pa.array(x, pa.binary()), pa.array([folds] * len(g), pa.binary())], names=["g", "block", "x", "y"])

    def run(batches):
        forget()
        v = words.value
        codes, texts, about, held, n = [], [], [], 0, 0
        for batch in batches:
            for t in _texts(batch):
                if n and (held > STRETCH_BYTES or n + len(t.raws) > STRETCH_TEXTS):
                    yield from flush(codes, texts, about)
                    codes, texts, about, held, n = [], [], [], 0, 0
                ids = v.ids[t.classes].astype(np.int64)
                rare = np.flatnonzero(ids < 0)
                ids[rare] = VOCABULARY + t.seeds[t.words.row[rare]] % RARE
                row = t.words.row
                at = np.flatnonzero(row[1:] == row[:-1])
                second = np.zeros(len(ids), bool)
                second[at + 1] = True
                rare = rare[second[rare]]
                a = np.zeros(len(t.raws), _TEXTS)
                a["key"], a["seed"] = t.keys, t.seeds
                a["bits"] = np.bincount(row[rare], v.rare[1 - t.folds[row[rare]], t.classes[rare]], len(a))
                a["pairs"] = np.bincount(row[at], minlength=len(a))
                a["ok"] = ~base_failed(base_counts(t.data, t.off))
                codes.append((ids[at] << ID_BITS | ids[at + 1]) * _ODD & _MASK)
                texts.append(row[at] + n)
                about.append(a)
                held += len(t.data)
                n += len(a)
        if n:
            yield from flush(codes, texts, about)

    return _base(docs, column, lang).mapInArrow(run, _ENTRIES)


class Counts:
    """Codes in a sorted array with counts by fold, merged from sorted runs."""

    def __init__(self):
        self.codes, self.n = np.zeros(0, np.int64), np.zeros((FOLDS, 0), np.int64)
        self.runs, self.held = [], 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.runs.append((codes, n))
        self.held += len(codes)
        if self.held > max(1 << 20, len(self.codes)):
            self.merge()

    def merge(self) -> None:
        if self.runs:
            runs = [(self.codes, self.n), *self.runs]
            self.codes, at = np.unique(np.concatenate([c for c, _ in runs]), return_inverse=True)
            self.n = np.stack([np.bincount(at, np.concatenate([n[f] for _, n in runs]), len(self.codes)) for f in range(FOLDS)]).astype(np.int64)
            self.runs, self.held = [], 0

    def of(self, codes: np.ndarray, fold: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[k] == codes, self.n[fold, k], 0)


def _run(x: bytes, y: bytes):
    """(codes, entries of each, text, times, folds of the texts)."""
    codes, n, text, times = _read(x)
    return codes, n, text, times, np.unpackbits(np.frombuffer(y, np.uint8)).astype(np.int64)


def _counted(x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes, n, text, times, folds = _run(x, y)
    at = np.repeat(np.arange(len(codes)), n)
    return codes, np.stack([np.bincount(at, times * (folds[text] == f), len(codes)) for f in range(FOLDS)]).astype(np.int64)


_IDS = 1 << ID_BITS


def _statistics(counts: Counts) -> list[tuple[int, np.ndarray]]:
    """For each fold: count, kinds seen once, twice, more often, and kinds before, by id; then pairs seen 1 to 4 times."""
    code = counts.codes * _BACK & _MASK
    u, v, out = code >> ID_BITS, code & (_IDS - 1), []
    for f in range(FOLDS):
        n = counts.n[f]
        per = lambda ids, w: np.bincount(ids, w, _IDS).astype(np.int64)
        out += [(8 * f, per(u, n)), *((8 * f + k, per(u, n == k)) for k in (1, 2)), (8 * f + 3, per(u, n > 2)), (8 * f + 4, per(v, n > 0)), (8 * f + 5, np.array([(n == k).sum() for k in (1, 2, 3, 4)]))]
    return out


def _shards(batches, each):
    """Calls each(shard, rows) for runs of rows of one shard, which come in order; rows: (block, x, y)."""
    now, rows = None, []
    for batch in batches:
        for r in zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            if r[0] != now:
                if rows:
                    yield from each(now, rows)
                now, rows = r[0], []
            rows.append(r[1:])
    if rows:
        yield from each(now, rows)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2, 3 and more, from how many have count 1 to 4; never 0, so that what was not counted has a probability."""
    if not all(n):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))], [0, 0.1, 0.1, 0.1], [0, 0.99, 1.99, 2.99])


@dataclass
class Model:
    """What a fold's pairs need besides their own count: discounts, and by id the count, the mass passed down, the lower probability."""

    cut: np.ndarray
    count: np.ndarray
    mass: np.ndarray
    lower: np.ndarray

    @classmethod
    def of(cls, count, once, twice, more, before, n, size: int):
        """size: ids that can occur."""
        d = discounts(n)
        mass = np.where(count > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(1, count), 1.0)
        e, total = discounts(np.array([(before == k).sum() for k in (1, 2, 3, 4)])), max(1, before.sum())
        off = e[np.minimum(before, 3)]
        lower = np.maximum(0, before - off) / total + (off.sum() / total if before.any() else 1.0) / size
        return cls(d, count, mass, lower)

    def bits(self, u: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log2 of the probability of id v after id u, a pair counted n times."""
        p = np.maximum(0, n - self.cut[np.minimum(n, 3)]) / np.maximum(1, self.count[u])
        return -np.log2(p + self.mass[u] * self.lower[v])


@dataclass
class Trained:
    words: Vocabulary
    pairs: DataFrame  # as _pairs gives them, by shard, on disk
    models: list[Model]


def train(docs: DataFrame, column: str = "text", lang: str = "lang") -> Trained:
    """Counts words and pairs of all documents. `pairs` is a checkpoint."""
    sc = docs.sparkSession.sparkContext
    words = vocabulary(count_classes(docs, column, lang))
    shards = 1 << int(np.clip(np.ceil(np.log2(max(1, total_chars(docs, column)) / SHARD_BYTES + 1e-9)), 3, MAX_SHARDS.bit_length() - 1))
    rows = _pairs(docs, sc.broadcast(words), shards, column, lang)
    rows = cut(rows.repartition("g", F.when(F.col("g") < 0, F.col("block"))).sortWithinPartitions("g"))

    def statistics(batches):
        def each(_, blobs):
            counts = Counts()
            for _, x, y in blobs:
                counts.add(*_counted(x, y))
            counts.merge()
            k, x = zip(*_statistics(counts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(map(_packed, x), pa.binary())], names=["k", "x"])

        forget()
        yield from _shards(batches, each)

    got = _summed(rows.filter("g >= 0").mapInArrow(statistics, _PART))
    zero = np.zeros(_IDS, np.int64)
    models = [Model.of(*(got.get(8 * f + k, zero) for k in range(5)), got.get(8 * f + 5, np.zeros(4, np.int64)), _IDS) for f in range(FOLDS)]
    return Trained(words, rows, models)


_SCORES = "key long, seed long, ok boolean, bits double"


def scores(model: Trained) -> DataFrame:
    """key, seed, ok and bits (a word, by the counts of the other folds) of every distinct text."""
    shared = model.pairs.sparkSession.sparkContext.broadcast(model.models)

    def sums(batches):
        models = shared.value

        def each(_, blobs):
            counts = Counts()
            for _, x, y in blobs:
                counts.add(*_counted(x, y))
            counts.merge()
            for block, x, y in blobs:
                codes, n, text, times, folds = _run(x, y)
                real = codes * _BACK & _MASK
                u, v, f = real >> ID_BITS, real & (_IDS - 1), folds[text]
                at, out = np.repeat(np.arange(len(codes)), n), np.zeros(len(text))
                for g in range(FOLDS):
                    bits = models[1 - g].bits(u, v, counts.of(codes, np.full(len(codes), 1 - g)))
                    out += np.where(f == g, bits[at] * times, 0)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.bincount(text, out, len(folds)).astype("<f4").tobytes()], pa.binary())], names=["block", "texts", "sums"])

        forget()
        yield from _shards(batches, each)

    parts = model.pairs.filter("g >= 0").mapInArrow(sums, "block long, texts binary, sums binary")
    about = model.pairs.filter("g < 0").select("block", F.col("x").alias("texts"), F.lit(None).cast("binary").alias("sums"))

    def together(batches):
        def done(about, total):
            n = len(about)
            bits = (about["bits"] + total[:n]) / np.maximum(1, about["pairs"])
            return pa.RecordBatch.from_arrays([pa.array(about["key"].astype(np.int64)), pa.array(about["seed"].astype(np.int64)), pa.array(about["ok"].astype(bool)), pa.array(np.where(about["pairs"] > 0, bits, 0.0).astype(float))], names=["key", "seed", "ok", "bits"])

        now, info, total = None, None, 0
        for batch in batches:
            for block, texts, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block != now:
                    if now is not None:
                        yield done(info, total)
                    now, info, total = block, None, 0
                if texts is not None:
                    info = np.frombuffer(texts, _TEXTS)
                    total = total + np.zeros(-(-len(info) // 8) * 8)
                else:
                    total = total + np.frombuffer(part, "<f4").astype(float)
        if now is not None:
            yield done(info, total)

    rows = about.unionByName(parts).repartition("block").sortWithinPartitions("block", F.col("texts").isNull()).mapInArrow(together, _SCORES)
    return rows.groupBy("key").agg(F.first("seed").alias("seed"), F.first("ok").alias("ok"), F.max("bits").alias("bits"))


def _middle(x: np.ndarray, n: np.ndarray) -> float:
    """Median of values that occur n times each."""
    order = np.argsort(x)
    c = np.cumsum(n[order])
    return float(x[order][np.searchsorted(c, c[-1] / 2)])


def bands_of(scored: DataFrame) -> dict[int, tuple[float, float]]:
    """Least and greatest bits a word by language seed, from a histogram of the distinct texts that pass the base rules."""
    found = scored.filter("ok").groupBy("seed", F.floor(F.col("bits") * _BINS).alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    out = {}
    for t in {r["seed"] for r in found}:
        b, n = (np.array([r[c] for r in found if r["seed"] == t]) for c in ("b", "n"))
        mid = _middle(b / _BINS, n)
        far = BAND_MAD * _middle(np.abs(b / _BINS - mid), n)
        out[t] = (SHARE_BELOW * mid, mid + far + BITS_ABOVE)
    return out


_ADDED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


def measured(docs: DataFrame, key: str, column: str = "text", lang: str = "lang") -> DataFrame:
    """Adds the base counts, base_failed and the key of text and language."""

    def run(batches):
        forget()
        for batch in batches:
            tags = [tag(x) for x in batch.column(batch.schema.get_field_index(filled_name(batch, lang))).to_pylist()]
            cols: dict[str, list] = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            failed, keys = [], []
            for first, data, off in chunks(batch.column(batch.schema.get_field_index(filled_name(batch, column)))):
                counts = base_counts(data, off)
                for name, v in counts.items():
                    cols[name].append(v)
                failed.append(base_failed(counts))
                keys.append(_keys(strings(data, off), _seeds(tags[first : first + len(off) - 1])).astype(np.int64))
            joined = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
            yield extended(batch, **{n: joined(v, np.int64) for n, v in cols.items()}, base_failed=joined(failed, bool), **{key: joined(keys, np.int64)})

    return docs.mapInArrow(run, plus(docs.schema, f"{_ADDED}, `{key}` bigint"))


def quality(docs: DataFrame, column: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Adds counts, base verdict, perplexity and the verdict of the method to every row.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed boolean,
    bits and perplexity double (of a word, under the model without the texts of its fold) and kept
    boolean: base_failed is false and the bits lie in the band of the language. `keep` names the
    columns that stay (all if not given): what is left out is not shuffled.

    The documents are read three times (words, pairs, counts of each). The pairs move once, in
    compressed sorted runs, and are held on disk; then narrow sums, and the columns that stay with
    the key of their text, on which the scores are joined (a left join, whose hot keys Spark splits).

    A null or empty text has no words: base_failed, not kept. A text of one word has 0 bits. A null
    or strange language is `und`, with a band of its own. Repeated rows count each time in the model
    of the other folds and once for the band. An empty table gives no rows. Columns that bear an
    added name are replaced.
    """
    key = free(docs, "key")
    out = measured(docs, key, column, lang)
    if keep is not None:
        new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", key]
        out = out.select(*[f"`{c}`" for c in keep if c.lower() not in new], *new)
    scored = cut(scores(train(docs, column, lang)))
    bands = bands_of(scored)
    inside = F.lit(False)
    for t, (low, high) in sorted(bands.items()):
        inside = F.when(F.col("seed") == t, F.col("bits").between(low, high)).otherwise(inside)
    verdict = scored.select(F.col("key").alias(key), F.struct("bits", inside.alias("inside")).alias("v"))
    v = free(out, "v")
    out = out.drop("bits", "perplexity", "kept").join(verdict.withColumnRenamed("v", v), key, "left")
    bits = F.col(f"`{v}`.bits")
    return out.withColumns({"bits": bits, "perplexity": F.pow(F.lit(2.0), bits), "kept": ~F.col("base_failed") & F.coalesce(F.col(f"`{v}`.inside"), F.lit(False))}).drop(key, v)
