"""Benchmark decontamination by suffix arrays over the training text.

Every Arrow batch of documents is a shard. Its suffix array holds the suffixes that begin with
the first words of some test window (a sparse suffix array; no other suffix can match one),
sorted word by word to the depth of a window, and every test window whose first words occur is
binary-searched in it (an item shorter than a window is one window; the last suffixes of longer
items are not searched). The locations found are then lengthened word by word, which gives the
longest verbatim match of a window or more.
The test set is broadcast in blocks of a fixed number of words; each block is one narrow pass, so
documents are never shuffled and a test set of any size fits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.llm._spark import extended, filled_name, free, plus
from metrolith.llm._text import ALNUM, LOWER, U, Words, chunks, gram, forget

#: Words that a suffix shares with a test window before it enters the suffix array.
LEAD = 4
#: Bytes of item text kept in sorted lists behind windows.
_REST_BYTES = 8 << 20


class Block:
    """Some test items: their words, and their distinct windows with the places they come from."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.words = np.concatenate([h for _, h in items] + [np.zeros(window, U)])
        sizes = np.array([len(h) for _, h in items], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.item_end = first[1:]
        at, item, size = [], [], []
        for i, n in enumerate(sizes.tolist()):
            k = min(n, window)
            s = np.arange(first[i], first[i] + max(1, n - window + 1)) if n else np.zeros(0, np.int64)
            at.append(s)
            item.append(np.full(len(s), i))
            size.append(np.full(len(s), k))
        self.at, self.item, self.size = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, item, size))
        self.rows = self._rows(self.words, self.at, self.size)
        # windows of the same words are searched once
        order = np.lexsort(self.rows.T[::-1]) if len(self.at) else np.zeros(0, np.int64)
        r, z = self.rows[order], self.size[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]).any(1) | (z[1:] != z[:-1])
        self.order, self.begin = order, np.append(np.flatnonzero(new), len(order))
        self.keys, self.sizes = r[new], z[new]
        self.rest: dict[int, list[bytes]] = {}
        self.rest_bytes = 0
        self.leads = {}
        for d in np.unique(np.minimum(self.sizes, LEAD)).tolist():
            mine = np.minimum(self.sizes, LEAD) == d
            g = gram(self.keys[mine, :d].reshape(-1), d)[::d] if d > 1 else self.keys[mine, 0]
            bits = np.zeros(1 << 22, bool)
            bits[(g >> U(42)).astype(np.int64)] = True
            self.leads[d] = (np.unique(g), bits)

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """The items that hold any of these windows."""
        return np.unique(np.concatenate([self.item[self.order[self.begin[q] : self.begin[q + 1]]] for q in windows.tolist()]))

    def after(self, q: int) -> list[bytes]:
        """What follows window q in the items that hold it: distinct, sorted."""
        if q not in self.rest:
            here = self.at[self.order[self.begin[q] : self.begin[q + 1]]]
            ends = self.item_end[np.searchsorted(self.item_end, here, "right")]
            if self.rest_bytes > _REST_BYTES:
                self.rest.clear()
                self.rest_bytes = 0
            self.rest[q] = sorted({self.words[a + self.sizes[q] : e].astype(">u8").tobytes() for a, e in zip(here.tolist(), ends.tolist(), strict=True)})
            self.rest_bytes += sum(map(len, self.rest[q]))
        return self.rest[q]

    def _rows(self, words, at, size):
        """The words of windows, one row each, 0 behind their end."""
        if not len(at):
            return np.zeros((0, self.window), U)
        j = np.arange(self.window)
        return np.where(j < size[:, None], words[np.minimum(at[:, None] + j, len(words) - 1)], U(0))


def _compare(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for each pair of rows, by their first `size` words."""
    out = np.zeros(len(a), np.int8)
    for j in range(a.shape[1]):
        open_ = (out == 0) & (j < size)
        if not open_.any():
            break
        out = np.where(open_, (a[:, j] > b[:, j]).astype(np.int8) - (a[:, j] < b[:, j]).astype(np.int8), out)
    return out


def _bounds(suffixes: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the sorted suffixes that begin with each key, by binary search of all keys at once."""
    out = []
    for side in (0, 1):
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(suffixes), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            c = _compare(suffixes[np.minimum(mid, len(suffixes) - 1)], keys, sizes)
            right = (lo < hi) & ((c < 0) | ((c == 0) & bool(side)))
            hi = np.where((lo < hi) & ~right, mid, hi)
            lo = np.where(right, mid + 1, lo)
        out.append(lo)
    return out[0], out[1]


class Found:
    """Places of windows in some texts: first word, size, number of the window, words of the longest match there."""

    def __init__(self, parts: list[tuple]):
        z = np.zeros(0, np.int64)
        self.place, self.size, self.window, self.longest = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (z, z, z, z)


def match(w: Words, block: Block) -> Found:
    n = len(w)
    if not n or not len(block.keys):
        return Found([])
    last = w.first[w.row + 1]  # end of the text of each word
    found, known = np.zeros(n, bool), np.zeros(len(block.keys), bool)
    for d, (leads, bits) in block.leads.items():
        g = gram(w.hash, d) if d > 1 else w.hash
        at = np.flatnonzero(bits[(g >> U(42)).astype(np.int64)])
        at = at[at + d <= last[at]]
        k = np.searchsorted(leads, g[at])
        at = at[leads[np.minimum(k, len(leads) - 1)] == g[at]]
        found[at] = True
        mine = np.flatnonzero(np.minimum(block.sizes, LEAD) == d)
        own = gram(block.keys[mine, :d].reshape(-1), d)[::d] if d > 1 else block.keys[mine, 0]
        known[mine[np.isin(own, g[at])]] = True
    at = np.flatnonzero(found)
    if not len(at):
        return Found([])
    j = np.arange(block.window)
    rows = np.where(at[:, None] + j < last[at][:, None], w.hash[np.minimum(at[:, None] + j, n - 1)], U(0))
    order = np.lexsort(rows.T[::-1])
    at, rows = at[order], rows[order]
    ask = np.flatnonzero(known)
    lo, hi = _bounds(rows, block.keys[ask], block.sizes[ask])
    hit = hi > lo
    ask, lo, hi = ask[hit], lo[hit], hi[hit]
    parts, big = [], w.hash.astype(">u8")  # whose bytes sort as the words do
    for q, a, b in zip(ask.tolist(), lo.tolist(), hi.tolist(), strict=True):
        place, size = at[a:b], block.sizes[q]
        place = place[place + size <= last[place]]
        parts.append((place, np.full(len(place), size), np.full(len(place), q), _longest(big, place, last[place], block, q)))
    return Found(parts)


def _longest(big, p, last, block: Block, q: int) -> np.ndarray:
    """How far the text at each place of window q goes on as an item does.

    What follows the window in the items is a sorted list; what follows a place agrees longest with one
    of the two neighbours of where it belongs in the list. One look a place, however many items.
    """
    size, after = int(block.sizes[q]), block.after(q)
    most, out = max(map(len, after)) // 8, np.full(len(p), size, np.int64)
    if not most:
        return out
    for k, (a, end) in enumerate(zip(p.tolist(), last.tolist(), strict=True)):
        mine = big[a + size : min(end, a + size + most)].tobytes()
        i = bisect_left(after, mine)
        out[k] += max(_common(mine, x) for x in after[max(0, i - 1) : i + 1])
    return out


def _common(a: bytes, b: bytes) -> int:
    """Words of 8 bytes that both begin with."""
    n = min(len(a), len(b)) // 8
    if a[: 8 * n] == b[: 8 * n]:
        return n
    differ = np.frombuffer(a, "u8", n) != np.frombuffer(b, "u8", n)
    return int(differ.argmax())


def blocks_of(benchmark: DataFrame, window: int, block_words: int):
    """The test items in blocks, read a piece at a time."""
    items, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        for _, data, off in chunks(pa.array([row["t"]], pa.string())):
            w = Words(LOWER[data], off, ALNUM)
            if len(w):
                items.append((row["i"] if row["i"] is not None else "null", w.hash))
                n += len(w)
        if n >= block_words:
            yield Block(items, window)
            items, n = [], 0
    if items:
        yield Block(items, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000, column: str = "text", spans: bool = False) -> DataFrame:
    """Marks the words of documents that lie in a verbatim test window.

    Adds n_words, n_hit, n_items long, items_sha256 string (of the sorted ids of the items found,
    comma-joined), contaminated boolean and longest long (words of the longest match of a window or more, else 0); with `spans`
    also hits array<bigint>, the bounds of the runs of hit words in turn. `benchmark` has item_id
    and text. Words are those of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z were lower-cased.
    A window is `window` words of an item; a shorter item is one window.

    Null and empty texts have no words and no hits. Items without words match nothing; an item
    without id goes by the name "null"; items of the same id count once. An empty test set or
    table gives no hits or no rows. Columns that bear an added name are replaced.
    """
    out, state = docs, False
    sc = docs.sparkSession.sparkContext
    held = {k: free(docs, f"{k} so far") for k in ("hits", "items", "longest")}

    def step(df: DataFrame, block, state: bool, final: bool) -> DataFrame:
        shared = sc.broadcast(block)

        def run(batches):
            forget()
            block = shared.value
            for batch in batches:
                cols = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "hits", "items")}
                old = {k: batch.column(batch.schema.get_field_index(v)).to_pylist() for k, v in held.items()} if state else None
                for row, data, off in chunks(batch.column(batch.schema.get_field_index(filled_name(batch, column)))):
                    w = Words(LOWER[data], off, ALNUM)
                    f = match(w, block) if block is not None else Found([])
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, f.place, 1)
                    np.add.at(edge, f.place + f.size, -1)
                    hit = np.cumsum(edge)[:-1] > 0
                    doc = w.row[f.place]
                    far = np.zeros(len(off) - 1, np.int64)
                    np.maximum.at(far, doc, f.longest)
                    names: dict[int, set] = {}
                    pairs = np.unique(np.stack([doc, f.window]), axis=1)  # each window of a text once
                    for r in np.unique(pairs[0]).tolist():
                        names[r] = {block.names[i] for i in block.items_of(pairs[1][pairs[0] == r]).tolist()}
                    for r in range(len(off) - 1):
                        h = hit[w.first[r] : w.first[r + 1]]
                        mine, most = names.get(r, set()), int(far[r])
                        if old:
                            for a, b in zip(*[iter(old["hits"][row + r])] * 2, strict=True):
                                h[a:b] = True
                            mine, most = mine | set(old["items"][row + r]), max(most, old["longest"][row + r])
                        cols["longest"].append(most)
                        if not final or spans:
                            e = np.flatnonzero(np.diff(np.concatenate([[False], h, [False]]).astype(np.int8)))
                            cols["hits"].append(e.tolist())
                        if final:
                            k = int(h.sum())
                            for name, v in (("n_words", len(h)), ("n_hit", k), ("n_items", len(mine)), ("items_sha256", hashlib.sha256(",".join(sorted(mine)).encode()).hexdigest()), ("contaminated", k > 0)):
                                cols[name].append(v)
                        else:
                            cols["items"].append(sorted(mine))
                long = lambda k: pa.array(cols[k], pa.int64())
                lists = lambda k, kind: pa.array(cols[k], pa.list_(kind))
                keep = batch.select([n for n in batch.schema.names if n not in held.values()])
                if final:
                    more = {"hits": lists("hits", pa.int64())} if spans else {}
                    yield extended(keep, n_words=long("n_words"), n_hit=long("n_hit"), n_items=long("n_items"), items_sha256=pa.array(cols["items_sha256"], pa.string()), contaminated=pa.array(cols["contaminated"], pa.bool_()), longest=long("longest"), **more)
                else:
                    yield extended(keep, **{held["hits"]: lists("hits", pa.int64()), held["items"]: lists("items", pa.string()), held["longest"]: long("longest")})

        schema = plus(docs.schema, "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint" + ", hits array<bigint>" * spans) if final else plus(docs.schema, f"`{held['hits']}` array<bigint>, `{held['items']}` array<string>, `{held['longest']}` bigint")
        return df.mapInArrow(run, schema)

    before = None
    for block in blocks_of(benchmark, window, block_words):
        if before is not None:
            out, state = step(out, before, state, False), True
        before = block
    return step(out, before, state, True)
