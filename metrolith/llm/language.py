"""Language identification by a blended-spectrum presence kernel.

The kernel of two texts counts the byte sequences of 1 to 3 bytes that both hold, divided by the
root of the product of how many each holds; what a text holds is taken over the sequences of the
landmarks. Landmark texts give the Nystroem features K(x, L) W^(-1/2); a kernel ridge
regression for each language against the rest is solved on a bounded sample of labelled
texts, and all texts are scored as matrix products: presence (texts x sequences) times
landmarks times weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.llm._spark import extended, filled_name, plus
from metrolith.llm._text import LOWER, chunks, filled, strings, forget

#: Distinct labelled texts of each language that are learned from, their most bytes, and how many are landmarks.
SAMPLE, SAMPLE_BYTES, LANDMARKS = 300, 20_000, 32
RIDGE = 1e-2
_LETTER = regex.compile(r"\p{L}")


def _grams(data: np.ndarray, off: np.ndarray):
    """(code, row) of every sequence of 1, 2 and 3 bytes that stays in its text."""
    x = LOWER[data].astype(np.int32)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    code = x
    for n in (1, 2, 3):
        if n > 1:
            code = (code[:-1] << 8) | x[n - 1 :]
        k = len(code)
        ok = row[:k] == row[n - 1 :]
        yield n, code[ok], row[:k][ok]


class Kernel:
    """Presence of the landmarks' sequences in texts, and the weights learned."""

    def __init__(self, landmarks: list[bytes]):
        data, off = _joined(landmarks)
        self.tables = [np.full(256**n, -1, np.int32) for n in (1, 2, 3)]
        size = 0
        for n, code, _ in _grams(data, off):
            found = np.unique(code)
            self.tables[n - 1][found] = np.arange(size, size + len(found))
            size += len(found)
        self.size = size
        self.landmarks = self._unit(self.presence(data, off)).T.copy()
        self.weights = None

    def presence(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros((len(off) - 1) * self.size, np.float32)
        for n, code, row in _grams(data, off):
            at = self.tables[n - 1][code]
            ok = at >= 0
            out[row[ok].astype(np.int64) * self.size + at[ok]] = 1
        return out.reshape(len(off) - 1, self.size)

    def __getstate__(self):
        """Without the dense tables, which workers make anew."""
        codes = [np.flatnonzero(t >= 0) for t in self.tables]
        return {**self.__dict__, "tables": [(c.astype(np.int32), t[c]) for c, t in zip(codes, self.tables, strict=True)]}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.tables = [np.full(256**n, -1, np.int32) for n in (1, 2, 3)]
        for table, (codes, places) in zip(self.tables, state["tables"], strict=True):
            table[codes] = places

    @staticmethod
    def _unit(a: np.ndarray) -> np.ndarray:
        return a / np.sqrt(np.maximum(1, a.sum(1)))[:, None]

    def against(self, data, off) -> np.ndarray:
        return self._unit(self.presence(data, off)) @ self.landmarks

    def fit(self, texts: list[bytes], targets: np.ndarray) -> None:
        value, vector = np.linalg.eigh((self.landmarks.T @ self.landmarks).astype(float))
        good = value > 1e-6 * value.max()
        half = vector[:, good] / np.sqrt(value[good])
        x = np.concatenate([self.against(*_joined(texts[i : i + 256])) for i in range(0, len(texts), 256)]).astype(float) @ half
        x = np.column_stack([x, np.ones(len(x))])
        solved = np.linalg.solve(x.T @ x + RIDGE * np.eye(x.shape[1]), x.T @ targets)
        self.weights, self.bias = (half @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def score(self, data, off) -> np.ndarray:
        return self.against(data, off) @ self.weights + self.bias


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def sample(docs: DataFrame, column: str = "text", lang: str = "lang", size: int = SAMPLE) -> list[tuple[str, bytes]]:
    """At most `size` distinct labelled texts of each language, by least hash of the text.

    A language has texts of SAMPLE_BYTES at most, or, where it has none, the first SAMPLE_BYTES of longer ones.
    Rates are taken of distinct texts, so copies use none of it up.
    """
    base = docs.select(F.col(lang).cast("string").alias("l"), F.col(column).cast("string").alias("t")).filter((F.octet_length("t") > 0) & F.col("l").isNotNull())
    long, rank = F.octet_length("t") > SAMPLE_BYTES, F.pmod(F.xxhash64("t"), F.lit(1 << 30))
    texts = base.select("l", long.alias("long"), F.xxhash64("t").alias("h")).distinct()
    counts: dict[str, list[int]] = {}
    for r in texts.groupBy("l", "long").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        counts.setdefault(r["l"], [0, 0])[r["long"]] = r["n"]
    if not counts:
        return []
    part = F.lit(0.0)
    for name, (short, other) in counts.items():
        part = F.when((F.col("l") == name) & (long if not short else ~long), F.lit(min(1.0, 3.0 * size / (short or other)))).otherwise(part)
    head = F.substring(F.col("t").cast("binary"), 1, SAMPLE_BYTES)
    rows = base.filter(rank < part * (1 << 30)).select("l", head.alias("t"), rank.alias("r")).dropDuplicates(["l", "r", "t"]).collect()
    out = []
    for name in sorted(counts):
        mine = sorted((r["r"], bytes(r["t"])) for r in rows if r["l"] == name)[:size]
        out += [(name, t.decode("utf-8", "ignore").encode()) for _, t in mine]
    return out


def train(pairs: list[tuple[str, bytes]], landmarks: int = LANDMARKS) -> tuple[list[str], Kernel | None]:
    names = sorted({l for l, _ in pairs})
    if not names:
        return names, None
    kernel = Kernel([t for name in names for t in [t for l, t in pairs if l == name][:landmarks]])
    kernel.fit([t for _, t in pairs], np.array([[float(l == n) for n in names] for l, _ in pairs]))
    return names, kernel


def identify(docs: DataFrame, training: DataFrame, column: str = "text", lang: str = "lang") -> DataFrame:
    """Adds lang_pred string and score double (0 to 1) to every row of `docs`.

    `training` has texts and languages; rows of null language teach nothing. What is learned from
    is fitted once, on the driver, from a sample of SAMPLE distinct texts a language (up to SAMPLE_BYTES, longer ones cut only
    where a language has no others), which bounds the driver's
    share; languages are as many as the labels name. Prediction reads whole texts, in place.

    A text that is null or has no letter is `und` with score 0; so is every text where nothing
    could be learned. Ties go to the first language by name. An empty table gives no rows;
    columns that bear an added name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(training, column, lang)))  # bounded by the sample

    def run(batches):
        forget()
        names, kernel = shared.value
        for batch in batches:
            best, score = [], []
            for _, data, off in chunks(batch.column(batch.schema.get_field_index(filled_name(batch, column))), 1 << 20):
                raws = strings(data, off)
                letters = np.array([bool(_LETTER.search(r.decode("utf-8", "replace"))) for r in raws])
                if kernel is None:
                    best += ["und"] * len(raws)
                    score += [0.0] * len(raws)
                    continue
                for lo in range(0, len(raws), 512):
                    part = off[lo : lo + 513]
                    s = kernel.score(data[part[0] : part[-1]], part - part[0])
                    top = s.argmax(1)
                    ok = letters[lo : lo + 512]
                    best += [names[i] if k else "und" for i, k in zip(top.tolist(), ok.tolist(), strict=True)]
                    score += np.where(ok, np.clip(s[np.arange(len(s)), top], 0, 1), 0.0).astype(float).tolist()
            yield extended(batch, lang_pred=pa.array(best, pa.string()), score=pa.array(score, pa.float64()))

    return docs.mapInArrow(run, plus(docs.schema, "lang_pred string, score double"))
