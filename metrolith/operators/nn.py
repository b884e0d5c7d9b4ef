"""Layers and optimisers on batches of rows; a network runs over a vector column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Layer = Callable[[np.ndarray], np.ndarray]


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def softmax_rows(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def dense(w: np.ndarray, b: np.ndarray) -> Layer:
    return lambda x: x @ w + b


def layer_norm(x: np.ndarray, gain: float | np.ndarray = 1.0, bias: float | np.ndarray = 0.0, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * gain + bias


def dropout(x: np.ndarray, rate: float, seed: int = 0) -> np.ndarray:
    """Kept values are scaled up, so means stay."""
    return x * (np.random.default_rng(seed).random(x.shape) >= rate) / (1 - rate)


def conv1d(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray | float = 0.0) -> np.ndarray:
    """(length, channels) by (size, channels, out), no padding."""
    v = np.lib.stride_tricks.sliding_window_view(x, kernel.shape[0], 0)
    return np.einsum("tck,kco->to", v, kernel) + bias


def conv2d(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray | float = 0.0) -> np.ndarray:
    """(height, width, channels) by (h, w, channels, out), no padding."""
    v = np.lib.stride_tricks.sliding_window_view(x, kernel.shape[:2], (0, 1))
    return np.einsum("yxchw,hwco->yxo", v, kernel) + bias


def pool2d(x: np.ndarray, size: int = 2, how: str = "max") -> np.ndarray:
    h, w = x.shape[0] // size, x.shape[1] // size
    v = x[: h * size, : w * size].reshape(h, size, w, size, *x.shape[2:])
    return v.max((1, 3)) if how == "max" else v.mean((1, 3))


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, causal: bool = False) -> np.ndarray:
    s = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if causal:
        s = np.where(np.tril(np.ones(s.shape[-2:], bool)), s, -np.inf)
    return softmax_rows(s) @ v


def multi_head_attention(x: np.ndarray, wq: np.ndarray, wk: np.ndarray, wv: np.ndarray, wo: np.ndarray, heads: int, causal: bool = False) -> np.ndarray:
    cut = lambda m: (x @ m).reshape(len(x), heads, -1).swapaxes(0, 1)
    return attention(cut(wq), cut(wk), cut(wv), causal).swapaxes(0, 1).reshape(len(x), -1) @ wo


def transformer_block(x: np.ndarray, p: dict[str, np.ndarray], heads: int) -> np.ndarray:
    x = layer_norm(x + multi_head_attention(x, p["wq"], p["wk"], p["wv"], p["wo"], heads))
    return layer_norm(x + relu(x @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"])


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(steps, hidden); gates in, forget, cell, out side by side."""
    n = u.shape[0]
    h, c, out = np.zeros(n), np.zeros(n), np.empty((len(x), n))
    for t, v in enumerate(x):
        i, f, g, o = np.split(v @ w + h @ u + b, 4)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = out[t] = sigmoid(o) * np.tanh(c)
    return out


def gru(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(steps, hidden); gates update, reset, candidate side by side."""
    n = u.shape[0]
    h, out = np.zeros(n), np.empty((len(x), n))
    for t, v in enumerate(x):
        a, q = v @ w + b, h @ u
        z, r = sigmoid(a[:n] + q[:n]), sigmoid(a[n : 2 * n] + q[n : 2 * n])
        h = out[t] = (1 - z) * h + z * np.tanh(a[2 * n :] + r * q[2 * n :])
    return out


def sequential(*layers: Layer) -> Layer:
    def run(x: np.ndarray) -> np.ndarray:
        for f in layers:
            x = f(x)
        return x

    return run


def apply_network(df: DataFrame, network: Layer, vector: str, name: str = "output") -> DataFrame:
    """The network over a vector column, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = network(np.array(b[vector].tolist(), float)) if len(b) else np.empty((0, 0))
            yield b.assign(**{name: list(y)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name)
    return df.mapInPandas(run, f"{fields}, `{name}` array<double>")


def optimizer(kind: str, lr: float = 0.01, decay: float = 0.0, momentum: float = 0.9, rho: float = 0.9, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> Callable[[np.ndarray, np.ndarray, dict], np.ndarray]:
    """step(parameters, gradient, state): sgd, nesterov, adagrad, adadelta, rmsprop, adam, adamw, adamax or nadam."""

    def step(p: np.ndarray, g: np.ndarray, s: dict) -> np.ndarray:
        m, v = s.get("m", np.zeros_like(p)), s.get("v", np.zeros_like(p))
        t = s["t"] = s.get("t", 0) + 1
        if kind == "sgd":
            return p - lr * g
        if kind == "nesterov":
            s["m"] = momentum * m + g
            return p - lr * (g + momentum * s["m"])
        if kind == "adagrad":
            s["v"] = v + g * g
            return p - lr * g / (np.sqrt(s["v"]) + eps)
        if kind == "rmsprop":
            s["v"] = rho * v + (1 - rho) * g * g
            return p - lr * g / (np.sqrt(s["v"]) + eps)
        if kind == "adadelta":
            s["v"] = rho * v + (1 - rho) * g * g
            d = np.sqrt(m + 1e-6) / np.sqrt(s["v"] + 1e-6) * g
            s["m"] = rho * m + (1 - rho) * d * d
            return p - d
        s["m"] = b1 * m + (1 - b1) * g
        mean = s["m"] / (1 - b1**t)
        if kind == "adamax":
            s["v"] = np.maximum(b2 * v, np.abs(g))
            return p - lr * mean / (s["v"] + eps)
        s["v"] = b2 * v + (1 - b2) * g * g
        if kind == "nadam":
            mean = b1 * mean + (1 - b1) * g / (1 - b1**t)
        elif kind not in ("adam", "adamw"):
            raise ValueError(f"no optimizer {kind}")
        out = p - lr * mean / (np.sqrt(s["v"] / (1 - b2**t)) + eps)
        return out - lr * decay * p if kind == "adamw" else out

    return step


def train(df: DataFrame, x: list[str], y: str, gradient: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], p0: np.ndarray, steps: int = 50, kind: str = "adam", **options) -> np.ndarray:
    """Whole-table gradient steps: each partition sends one summed gradient and a count."""
    p, state, move = np.asarray(p0, float), {}, optimizer(kind, **options)
    data = df.select(*x, y)
    for _ in range(steps):

        def run(batches: Iterator[pd.DataFrame], p=p) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(len(p)), 0
            for b in batches:
                if len(b):
                    total = total + gradient(p, b[x].to_numpy(float), b[y].to_numpy(float))
                    n += len(b)
            yield pd.DataFrame({"i": np.arange(len(p)), "g": total, "n": n})

        got = data.mapInPandas(run, "i int, g double, n bigint").groupBy("i").sum("g", "n").toPandas().sort_values("i")
        p = move(p, got["sum(g)"].to_numpy() / max(1, int(got["sum(n)"].iloc[0])), state)
    return p
