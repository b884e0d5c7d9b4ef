"""Near-duplicate groups: SuperMinHash, banding, exact verification, union-find.

Documents of the same shingle set form a class first, so copies cost nothing later. Class
signatures are banded; every bucket links its classes to its least one, and the components of
those links are candidate clusters: two classes that share any bucket lie in one cluster, so
all candidate pairs do, without being listed. The text of each class goes to its cluster once.
There all pairs are verified at once on their full shingle sets, as a product of the incidence
matrix with itself, and joined by union-find. A cluster too large for one task is dealt into
blocks by the size of the sets: sets whose sizes differ too much can't be linked, so only blocks of
one size class or of neighbouring ones meet, each pair of them in a task. A last component search
joins what they found, and the classes that share a doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.llm._spark import cut
from metrolith.llm.graph import components
from metrolith.llm._text import LOWER, SPACED, U, Words, chunks, gram, mix, forget

#: Components, and how many form a band: a pair at similarity 0.8 shares no band with probability 3e-6.
SIZE, BAND = 252, 6
#: Classes and text bytes of a cluster that one task verifies together.
BLOCK_DOCS, BLOCK_BYTES = 1024, 8 << 20
_SHIFT = U(48)


def shingles(w: Words, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct k-word shingles of each row, by row and hash; all words of a shorter text."""
    n = len(w)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    count = np.diff(w.first)
    g = gram(w.hash, k)
    ok = np.flatnonzero(w.row[: len(g)] == w.row[k - 1 :][: len(g)])
    h, row = [g[ok]], [w.row[ok]]
    for size in range(1, k):
        few = np.flatnonzero(count == size)
        if len(few):
            h.append(gram(w.hash, size)[w.first[few]] ^ U(0x5851F42D4C957F2D))
            row.append(few)
    h, row = np.concatenate(h), np.concatenate(row)
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def superminhash(h: np.ndarray, row: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """Signatures (rows x size) of sets given as (element hash, row).

    In round j every element draws a number j + r and the j-th place of its own random
    permutation of the components, so the ranks of an element are correlated and never equal. A
    set leaves once all its components lie below j: no later draw could lower one.
    """
    sig = np.full((rows, size), np.iinfo(np.uint64).max, U)
    flat = sig.reshape(-1)
    live, drawn, places = np.arange(len(h)), [], None
    seed = mix(h)
    for j in range(size):
        if not len(live):
            break
        r = mix(seed[live] + U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + ((r >> U(40)) % U(size - j)).astype(np.int64)
        if places is None:
            at = k.copy()
            for i in range(j - 1, -1, -1):
                at[drawn[i] == at] = i
            drawn.append(k)
        else:
            me = np.arange(len(live))
            at = places[me, k].astype(np.int64)
            places[me, k] = places[me, j]
            places[me, j] = at
        value = (U(j) << _SHIFT) | (mix(r) >> U(16))
        np.minimum.at(flat, row[live] * size + at, value)
        still = np.unique(row[live])
        open_ = np.zeros(rows, bool)
        open_[still] = (sig[still] >> _SHIFT).max(1) > U(j)
        keep = open_[row[live]]
        if not keep.all():
            live = live[keep]
            if places is None:
                drawn = [d[keep] for d in drawn]
            else:
                places = places[keep]
        if places is None and j >= 7:  # few sets go on: their permutations are kept whole
            places = np.broadcast_to(np.arange(size, dtype=np.uint16), (len(live), size)).copy()
            me = np.arange(len(live))
            for i, d in enumerate(drawn):
                x = places[me, d].copy()
                places[me, d] = places[me, i]
                places[me, i] = x
            drawn = []
    return sig


def band_hashes(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    out = np.zeros((len(sig), sig.shape[1] // band), U)
    for b in range(out.shape[1]):
        x = np.full(len(sig), (b + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), U)
        for c in range(b * band, (b + 1) * band):
            x = mix(x ^ sig[:, c])
        out[:, b] = x
    return out


def _names(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit name of each set, from sums of scrambled elements."""
    n = np.bincount(row, minlength=rows)
    e, out = np.cumsum(n), n.astype(U)
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
        c = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(salt)), dtype=U)])
        out = mix(out ^ (c[e] - c[e - n]))
    return out.view(np.int64)


def signatures(docs: DataFrame, k: int = 2, column: str = "text") -> DataFrame:
    """doc_id, key (of doc_id and text), n_shingles, node (which names the set) and bands array<bigint> (empty for no shingles) of each row."""

    def run(batches):
        forget()
        for batch in batches:
            cols = {n: [] for n in ("n", "node", "bands")}
            for _, data, off in chunks(batch.column(2), 1 << 20):
                rows = len(off) - 1
                h, row = shingles(Words(LOWER[data], off, SPACED), rows, k)
                n = np.bincount(row, minlength=rows)
                bands = band_hashes(superminhash(h, row, rows)).view(np.int64)
                full = n > 0
                ends = np.concatenate([[0], np.cumsum(full * bands.shape[1])]).astype(np.int32)
                cols["n"].append(n)
                cols["node"].append(_names(h, row, rows))
                cols["bands"].append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands[full].reshape(-1), pa.int64())))
            if not cols["n"]:
                continue
            flat = lambda x: pa.array(np.concatenate(cols[x]).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat("n"), flat("node"), pa.concat_arrays(cols["bands"])], names=["doc_id", "key", "n_shingles", "node", "bands"])

    return _keyed(docs, column).mapInArrow(run, "doc_id bigint, key bigint, n_shingles bigint, node bigint, bands array<bigint>")


def _keyed(docs: DataFrame, column: str) -> DataFrame:
    text = F.col(column).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("bigint"), text).alias("key"), text.alias("t"))


def links(h: np.ndarray, row: np.ndarray, rows: int, percent: int) -> np.ndarray:
    """Which sets have at least `percent` per cent of their union in common (rows x rows)."""
    n = np.bincount(row, minlength=rows).astype(np.int64)
    _, col, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    _, col = np.unique(col[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    common = np.zeros((rows, rows), np.float32)
    width = max(256, (16 << 20) // (4 * max(1, rows)))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        part = np.zeros((rows, width), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    out = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    out[n == 0, :] = False
    out[:, n == 0] = False
    return out


def union_find(linked: np.ndarray) -> np.ndarray:
    """The least index of the component of each row of a link matrix."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] >= 0:
            continue
        root[i] = i
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & (root < 0))
            root[front] = i
    return root


_TASK = 24 << 20


def _verified(batches, k: int, percent: int):
    """(u, v) links found within each task key; rows come sorted by key."""

    def solve(keys, ids, texts):
        keys, ids = np.array(keys), np.array(ids, np.int64)
        edges = [], []
        cut_ = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), len(keys))
        h, row = [], []
        for first, data, off in chunks(pa.array(texts, pa.large_string())):
            a, b = shingles(Words(LOWER[data], off, SPACED), len(off) - 1, k)
            h.append(a)
            row.append(b + first)
        h, row = np.concatenate(h), np.concatenate(row)
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        for a, b in zip(cut_[:-1].tolist(), cut_[1:].tolist(), strict=True):
            if b - a == 2:  # most clusters: two sets
                x, y = h[at[a] : at[a + 1]], h[at[a + 1] : at[b]]
                c = len(np.intersect1d(x, y, assume_unique=True))
                if c and 100 * c >= percent * (len(x) + len(y) - c):
                    edges[0].append(ids[a : a + 1])
                    edges[1].append(ids[a + 1 : b])
            elif b - a > 2:
                root = union_find(links(h[at[a] : at[b]], row[at[a] : at[b]] - a, b - a, percent))
                mine = np.flatnonzero(root != np.arange(b - a))
                edges[0].append(ids[a:b][mine])
                edges[1].append(ids[a:b][root[mine]])
        if edges[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e), pa.int64()) for e in edges], names=["u", "v"])

    forget()
    keys, ids, texts, held = [], [], [], 0
    for batch in batches:
        for key, i, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if held > _TASK and key != keys[-1]:
                yield from solve(keys, ids, texts)
                keys, ids, texts, held = [], [], [], 0
            keys.append(key)
            ids.append(i)
            texts.append(t)
            held += 8 * len(t)
    if keys:
        yield from solve(keys, ids, texts)


def _dealt(texts: DataFrame, percent: int, block_docs: int) -> DataFrame:
    """(key, node, t) of every task in which a text (node, root, n, t) is compared.

    A cluster of at most `block_docs` texts and BLOCK_BYTES is one task. A larger one is dealt into
    size classes, each a little wider than the ratio of sizes that a link allows, and these into blocks;
    a task is a pair of blocks of one size class or of neighbouring ones.
    """
    step = float(np.log(max(1.01, 100.0 / max(1, percent) * 1.0001)))
    rows = texts.withColumn("z", F.floor(F.log("n") / step))
    per = rows.groupBy("root", "z").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("t")).alias("bytes"))
    sizes = F.collect_list(F.struct("z", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("k")))
    whole = per.groupBy("root").agg((F.sum("docs") <= block_docs).alias("few"), (F.sum("bytes") <= BLOCK_BYTES).alias("short"), sizes.alias("sizes"))
    rows = rows.join(whole, "root")
    mine = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    own = F.filter("sizes", lambda x: x["z"] == F.col("z"))[0]["k"]
    rows = rows.withColumn("mine", mine(own))

    def tasks(x):
        other = F.sequence(F.lit(0), x["k"] - 1)
        less = x["z"] < F.col("z")
        same = x["z"] == F.col("z")
        a = lambda j: F.when(same, F.least(j, F.col("mine"))).when(less, j).otherwise(F.col("mine"))
        b = lambda j: F.when(same, F.greatest(j, F.col("mine"))).when(less, F.col("mine")).otherwise(j)
        return F.transform(other, lambda j: F.xxhash64("root", F.least(x["z"], F.col("z")), F.greatest(x["z"], F.col("z")), a(j), b(j)))

    near = F.filter("sizes", lambda x: F.abs(x["z"] - F.col("z")) <= 1)
    keys = F.when(F.col("few") & F.col("short"), F.array(F.xxhash64("root"))).otherwise(F.flatten(F.transform(near, tasks)))
    return rows.select(F.explode(keys).alias("key"), "node", "t")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, column: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, n_shingles long, component_id long, kept boolean of every row of `docs`.

    A document's set is its distinct k-word shingles of words `[^\\x20\\x09-\\x0D]+` after A-Z were
    lower-cased; all its words where they are fewer. Two documents are linked when 100 times the size
    of the intersection is at least `percent` times that of the union. component_id is the least
    doc_id reachable, itself included; kept is doc_id = component_id. The default of five words
    and 0.8 is for general use.

    Null and empty texts, and texts of white space alone, have no set, are linked with nothing and
    stay. Rows of equal doc_id are one document, whatever their texts, and links of any of these are
    its links. A row without doc_id can be linked; component_id is null where no member has an id, and
    kept is true for such rows only. Sets are named by 64 bits. An empty table gives no rows; other
    columns are not looked at.
    """
    rows = cut(signatures(docs, k, column))
    full = rows.filter("n_shingles > 0")
    sets = full.groupBy("node").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = sets.select(F.explode("bands").alias("b"), "node")
    buckets = banded.groupBy("b").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v <> last").select("b", "v")
    candidates = banded.join(buckets, "b").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
    clusters = cut(components(candidates))
    # rows without a set are classes of their own document
    place = F.when(F.col("n_shingles") > 0, F.col("node")).when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit("alone")))
    placed = rows.select("doc_id", "n_shingles", place.alias("node"))
    several = placed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v <> last").select("doc_id", "v")
    links_ = placed.join(several, "doc_id").filter("node <> v").select(F.col("node").alias("u"), "v")
    if not clusters.isEmpty():
        # each class sends the text of one of its rows to its cluster, or to the pairs of its blocks
        ask = sets.select("node", "key", "n").join(clusters, "node")
        texts = _keyed(docs, column).select("key", "t").join(ask, "key").groupBy("node", "root", "n").agg(F.first("t").alias("t"))
        dealt = _dealt(cut(texts), percent, block_docs)
        links_ = links_.unionByName(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _verified(it, k, percent), "u bigint, v bigint"))
    classes = placed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(components(links_), "node", "left")
    classes = classes.select("node", F.coalesce("root", "node").alias("root"), "least")
    of = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("node").alias("class"), "component_id")
    out = placed.join(of, F.col("node") == F.col("class"), "left").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
