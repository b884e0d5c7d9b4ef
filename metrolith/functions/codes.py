"""Entropy codes of binary columns: canonical Huffman and range coding by asymmetric numerals, a batch at a time."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_HUFFMAN = "struct<lengths: array<int>, bits: binary, bit_len: bigint, symbol_count: bigint>"
_RANS = "struct<freqs: array<int>, bytes: binary, state: bigint, symbol_count: bigint>"
_SCALE, _LOW = 12, 1 << 23


def lengths_of(counts: np.ndarray) -> np.ndarray:
    """Code length of each of 256 symbols, 0 for one that never occurs; a lone symbol has one bit."""
    out = np.zeros(256, np.int64)
    heap = [(int(n), s, [s]) for s, n in enumerate(counts) if n]
    if len(heap) == 1:
        out[heap[0][1]] = 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        both = a[2] + b[2]
        out[both] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), both))
    return out


def _canonical(lengths: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """(code by symbol, symbol by (length, code)): codes count up by length, then symbol."""
    codes, found, code, before = [0] * 256, {}, 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        n = int(lengths[s])
        code <<= n - before
        codes[s], found[n, code] = code, s
        code, before = code + 1, n
    return codes, found


def huffman(data: bytes) -> dict | None:
    if not data:
        return None
    x = np.frombuffer(data, np.uint8)
    lengths = lengths_of(np.bincount(x, minlength=256))
    codes = _canonical(lengths)[0]
    n = lengths[x]
    start = np.cumsum(n) - n
    bits = np.zeros(int(n.sum()), np.uint8)
    table = np.zeros((256, int(lengths.max())), np.uint8)
    for s in np.flatnonzero(lengths):
        k = int(lengths[s])
        table[s, :k] = [codes[s] >> (k - 1 - j) & 1 for j in range(k)]
    for j in range(table.shape[1]):
        here = n > j
        bits[start[here] + j] = table[x[here], j]
    return {"lengths": lengths.tolist(), "bits": np.packbits(bits).tobytes(), "bit_len": len(bits), "symbol_count": len(x)}


def unhuffman(lengths: np.ndarray, bits: bytes, bit_len: int) -> bytes:
    found, out, code, n = _canonical(lengths)[1], bytearray(), 0, 0
    for b in np.unpackbits(np.frombuffer(bits, np.uint8))[:bit_len].tolist():
        code, n = code << 1 | b, n + 1
        s = found.get((n, code))
        if s is not None:
            out.append(s)
            code = n = 0
    if n:
        raise ValueError("the bits end within a code")
    return bytes(out)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to 2**_SCALE in all, 1 at least where a symbol occurs."""
    f = np.where(counts > 0, np.maximum(1, counts * (1 << _SCALE) // counts.sum()), 0)
    while (rest := (1 << _SCALE) - int(f.sum())) != 0:
        top = int(f.argmax())
        f[top] += rest if rest > 0 else max(rest, 1 - int(f[top]))
    return f


def rans(data: bytes) -> dict | None:
    if not data:
        return None
    x = np.frombuffer(data, np.uint8)
    f = _shares(np.bincount(x, minlength=256).astype(np.int64))
    freq, start, state, out = f.tolist(), (np.cumsum(f) - f).tolist(), _LOW, bytearray()
    for s in x[::-1].tolist():
        n = freq[s]
        while state >= (_LOW >> _SCALE << 8) * n:
            out.append(state & 255)
            state >>= 8
        state = (state // n << _SCALE) + state % n + start[s]
    return {"freqs": freq, "bytes": bytes(out[::-1]), "state": state, "symbol_count": len(x)}


def unrans(freqs: np.ndarray, data: bytes, state: int, count: int) -> bytes:
    f = np.asarray(freqs, np.int64)
    freq, start, symbol = f.tolist(), (np.cumsum(f) - f).tolist(), np.repeat(np.arange(256), f).tolist()
    out, at, mask = bytearray(), 0, (1 << _SCALE) - 1
    for _ in range(count):
        low = state & mask
        s = symbol[low]
        out.append(s)
        state = freq[s] * (state >> _SCALE) + low - start[s]
        while state < _LOW and at < len(data):
            state = state << 8 | data[at]
            at += 1
    return bytes(out)


def _encoder(f, kind: str, x: Column) -> Column:
    names = [part.split(":")[0].strip() for part in kind[7:-1].split(",")]

    @pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(bytes(v)) or dict.fromkeys(names) if v is not None else dict.fromkeys(names) for v in s], columns=names).astype(object)

    return run(x.cast("binary"))


def huffman_encode(x: Column) -> Column:
    """(lengths by symbol, bits, bit_len, symbol_count); all null for null or empty data."""
    return _encoder(huffman, _HUFFMAN, x)


def rans_encode(x: Column) -> Column:
    """(freqs by symbol, bytes, state, symbol_count); all null for null or empty data."""
    return _encoder(rans, _RANS, x)


def huffman_decode(encoded: Column) -> Column:
    @pandas_udf("binary")
    def run(e: pd.DataFrame) -> pd.Series:
        rows = zip(e["lengths"], e["bits"], e["bit_len"], strict=True)
        return pd.Series([None if b is None else unhuffman(np.asarray(a), bytes(b), int(n)) for a, b, n in rows], dtype=object)

    return run(encoded)


def rans_decode(encoded: Column) -> Column:
    @pandas_udf("binary")
    def run(e: pd.DataFrame) -> pd.Series:
        rows = zip(e["freqs"], e["bytes"], e["state"], e["symbol_count"], strict=True)
        return pd.Series([None if b is None else unrans(np.asarray(a), bytes(b), int(s), int(n)) for a, b, s, n in rows], dtype=object)

    return run(encoded)
