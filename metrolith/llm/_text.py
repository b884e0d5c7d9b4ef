"""Array kernels over whole Arrow text columns: word bounds and 64-bit word hashes.

Texts are handled as UTF-8 bytes. Both word classes used here treat every byte of 0x80 and
above as part of a word, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

with contextlib.suppress(OSError, AttributeError):  # glibc: freed arrays of 1 MB and more go back to the system at once
    ctypes.CDLL(None).mallopt(-3, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer document makes a chunk of its own.
CHUNK = 1 << 20


def _table(separators) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: `[^\x20\x09-\x0D]+`
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z were lower-cased.
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_held: dict = {}


def held(name: str, key, make):
    """The one large object that a worker keeps between tasks; another operator's takes its place."""
    if _held.get("key") != (name, key):
        forget()
        _held.update(value=make(), key=(name, key))
    return _held["value"]


def forget() -> None:
    """Called by operators that keep nothing: workers outlive queries, and what others kept is memory."""
    _held.clear()
    _powers.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.ones(size, U)
            a[1:] = U(base)
            _powers[key] = np.cumprod(a, dtype=U)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def filled(column: pa.Array) -> pa.Array:
    """The column as strings without nulls (a null text is an empty one)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, bytes, offsets) of runs of rows with about `limit` bytes, whole texts each."""
    column = filled(column)
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of some texts: byte bounds, row of each, first word of each row, hashes."""

    __slots__ = ("start", "end", "row", "first", "hash")

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, hashed: bool = True):
        n = len(data)
        word = table[data]
        before = np.empty(n, bool)
        before[1:] = word[:-1]
        inner = off[:-1][off[:-1] < n]
        before[inner] = False
        start = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        after[:-1] = word[1:]
        after[inner[inner > 0] - 1] = False
        if n:
            after[-1] = False
        self.start, self.end = start, np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.hash = None
        if hashed:
            p, inv = _power(n + 1)
            c = np.empty(n + 1, U)
            c[0] = 0
            np.cumsum((data.astype(U) + U(1)) * p[:n], out=c[1:])
            self.hash = mix((c[self.end] - c[start]) * inv[start] + (self.end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def __len__(self) -> int:
        return len(self.start)


def gram(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values; len(h) - n + 1 of them, document bounds ignored."""
    if len(h) < n:
        return np.zeros(0, U)
    p, inv = _power(len(h) + 1)
    c = np.empty(len(h) + 1, U)
    c[0] = 0
    np.cumsum(h * p[: len(h)], out=c[1:])
    return mix((c[n:] - c[:-n]) * inv[: len(h) - n + 1] + U(n))


def within(w: Words, n: int) -> np.ndarray:
    """Where n consecutive words that start at a word stay in its text."""
    m = max(0, len(w) - n + 1)
    return w.row[:m] == w.row[n - 1 :][:m] if m else np.zeros(0, bool)


def strings(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
