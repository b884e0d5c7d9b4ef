"""Chat formatting in budgeted windows, streamed, and the way back.

A turn is `<turn:ROLE>TEXT</turn>` and a line break; `<ctx:ROLE>` instead marks a turn that an
earlier window has had. Backslash, < and > inside roles and texts get a backslash before
them, so no text can look like a mark and the way back is exact.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a window, and of the history repeated at its start.
BUDGET, HISTORY = 1024, 256
_TOKENS = re.compile(r"\w+|[^\w\s]")
_ESCAPE, _UNESCAPE = re.compile(r"[\\<>]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<(turn|ctx):((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)
WINDOWS = "conv_id bigint, window bigint, first_turn bigint, n_turns bigint, n_repeated bigint, n_tokens bigint, formatted string, loss_spans array<bigint>"


def escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


def count_tokens(s: str) -> int:
    return sum(1 for _ in _TOKENS.finditer(s))


class Windows:
    """Takes the turns of one conversation in order and gives its windows.

    `turns` holds what may still be repeated and then what no window has had; `sums` are the prefix sums of
    their tokens, in which the bounds of a window are found by binary search.
    """

    def __init__(self, conv: int | None, budget: int, history: int, count: Callable[[str], int], targets: str):
        self.conv, self.budget, self.history, self.count, self.targets = conv, budget, history, count, targets
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]
        self.done = 0  # turns at the front of `turns` that a window has had
        self.seen = self.number = 0

    def add(self, role: str, text: str):
        turn = role, text, self.count(role) + self.count(text) + 4
        if self.seen == 0 and role == "system":
            self.system = turn
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        self.seen += 1
        while self.end() < len(self.turns):
            yield self.window()

    def bounds(self) -> tuple[int, int]:
        """Tokens of the system turn to repeat, and the first turn to repeat, so that the next turn fits if it can.

        History goes first, its oldest turn before the others; then the system turn.
        """
        system = self.system[2] if self.system and self.number else 0
        need = self.sums[self.done + 1] - self.sums[self.done]
        if system + need > self.budget:
            system = 0
        room = min(self.history, max(0, self.budget - system - need))
        return system, min(self.done, bisect_left(self.sums, self.sums[self.done] - room))

    def end(self) -> int:
        """The end of the longest run of turns that fits; one turn at least."""
        system, first = self.bounds()
        return max(self.done + 1, bisect_right(self.sums, self.sums[first] + self.budget - system) - 1)

    def window(self, last: bool = False) -> tuple:
        system, first = self.bounds()
        end = len(self.turns) if last else self.end()
        lead = [self.system] * bool(system) + self.turns[first : self.done]
        fresh = self.turns[self.done : end]
        parts, spans, at = [], [], 0
        for k, (role, text, _) in enumerate(lead + fresh):
            old = k < len(lead)
            mark, body = f"<{'ctx' if old else 'turn'}:{escape(role)}>", escape(text)
            if role == self.targets and not old:
                spans += [at + len(mark), at + len(mark) + len(body)]
            parts.append(f"{mark}{body}</turn>\n")
            at += len(parts[-1])
        out = (self.conv, self.number, self.seen - len(self.turns) + self.done, len(fresh), len(lead), sum(x[2] for x in lead + fresh), "".join(parts), spans)
        # the system turn is no history; what can't be repeated any more goes
        keep = max(bisect_left(self.sums, self.sums[end] - self.history), 1 if self.turns[0] is self.system else 0)
        keep = min(keep, end)
        self.turns, self.done, self.number = self.turns[keep:], end - keep, self.number + 1
        self.sums = [x - self.sums[keep] for x in self.sums[keep:]]
        return out


def _batches(rows, schema: pa.Schema, size: int = 4 << 20):
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 200 + sum(len(x) for x in row if isinstance(x, str))
        if n > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_WINDOW_SCHEMA = pa.schema([(n, pa.int64()) for n in ("conv_id", "window", "first_turn", "n_turns", "n_repeated", "n_tokens")] + [("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = count_tokens, targets: str = "assistant") -> DataFrame:
    """One row per window of each conversation; windows of a conversation follow each other in its partition.

    `turns` has conv_id, turn, role and text. Prefix sums of turn tokens choose the longest run of
    whole turns that fits the budget behind what is repeated: the system turn (where the first turn
    is one) and the last turns within the history budget. Where the next turn would not fit behind
    these, the oldest turns of the history are given up first, then the rest of it, then the system turn.
    So only a turn that is too long by itself is a window over the budget, and alone in it. `count`
    gives the tokens of a string; a turn has 4 more for its marks. loss_spans holds start and end (code points of `formatted`) of
    each text of the target role, once: repeated turns bear no loss.

    Turns are ordered by turn, role, text (null first). Turns pass through as a sorted stream and
    only a window is held, so a conversation of any length takes bounded memory. A null text or role
    is empty; turns of null conv_id are one conversation; repeated rows are turns of their own; an
    empty table gives no rows; other columns are left out.
    """
    base = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        def rows():
            now = None
            for batch in batches:
                for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    if now is None or now.conv != conv:
                        if now is not None and now.done < len(now.turns):
                            yield now.window(last=True)
                        now = Windows(conv, budget, history, count, targets)
                    yield from now.add(role or "", text or "")
            if now is not None and now.done < len(now.turns):
                yield now.window(last=True)

        yield from _batches(rows(), _WINDOW_SCHEMA)

    return ordered.mapInArrow(run, WINDOWS)


def read_turns(formatted: str):
    """(repeated, role, text, start of the escaped text, its end) of each turn of a window."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield m[1] == "ctx", unescape(m[2]), unescape(m[3]), m.start(3), m.end(3)
        at = m.end()


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Takes the rows in the order `format_windows` leaves them. Conversations without turns don't exist.
    """

    def run(batches):
        def rows():
            now = None
            for batch in batches:
                for conv, formatted, spans in zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                    if now is None or now[0] != conv:
                        if now is not None:
                            yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]
                        now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for old, role, text, _, _ in read_turns(formatted):
                        if not old:
                            now[1] += 1
                            now[2].update(f"{role}\n{text}\n".encode())
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        s = unescape(formatted[a:b])
                        now[3] += len(s)
                        now[4].update(s.encode())
                    now[5] += len(formatted)
                    now[6] += 1
            if now is not None:
                yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]

        yield from _batches(rows(), _DIGESTS)

    return windows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
