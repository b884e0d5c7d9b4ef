"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

The encoder reads a piece byte by byte. Let last(q) be the last token of the encoding of the
bytes before position q; the encoding of every prefix is a prefix-closed chain through these.
A later token can only start at a position from which the bytes so far are the beginning of
some token, so only those positions are alive, and every token above the deepest common
ancestor of their chains is final. A state is the bytes after that ancestor with the tokens
that the alive chains use; the alphabet has 256 letters and the lookahead is at most the longest
token. States, transitions and pairs are made when first met; their bytes are counted and they are
dropped together at a fixed size, so memory is bounded.

Two adjacent tokens belong to one encoding when merging their joined bytes gives the two back;
that is seen from the merges that build each of them, which are worked out once for a token.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from metrolith.llm._spark import extended, filled_name, plus
from metrolith.llm._text import filled, held

#: Bytes of a rank file that are broadcast at most; a larger file is refused.
MAX_RANK_BYTES = 64 << 20


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The pairwise merging that defines the encoding; quadratic, for short inputs and tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


#: Bytes that states with their moves, and pieces met, may take at most in a worker. With half of that for states, two thirds
#: of the moves asked for were carried over from the older generation again.
TABLE_BYTES, PIECE_BYTES = 256 << 20, 96 << 20
#: Bytes of a state, a move and a piece besides their contents, from the growth of a worker.
_STATE, _MOVE, _PIECE = 150, 90, 110
_NEVER = 1 << 60


class Recent:
    """A table of two generations: what is not asked for while one fills up is forgotten, so its bytes are bounded."""

    def __init__(self, max_bytes: int):
        self.half, self.bytes, self.young, self.old = max_bytes // 2, 0, {}, {}

    def put(self, key, value, size: int) -> None:
        if self.bytes + size > self.half:
            self.old, self.young, self.bytes = self.young, {}, 0
        self.young[key] = value
        self.bytes += size


class Tables:
    """One generation of the states and transitions."""

    def __init__(self):
        #: (bytes after the ancestor, length of the last token at each position or 0 if dead, token before)
        self.states: list[tuple[bytes, tuple[int, ...], bytes]] = [(b"", (), b"")]
        self.ids = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.bytes = 0

    def id_of(self, state) -> int:
        if (k := self.ids.get(state)) is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            self.bytes += _STATE + 9 * len(state[0])
        return k


class Transducer:
    """Tables are made as they are met. When one generation is full, the next takes over from it what is asked for again."""

    def __init__(self, ranks: dict[bytes, int], max_bytes: int = TABLE_BYTES):
        self.ranks, self.half = ranks, max_bytes // 2
        self.starts = {t[:i] for t in ranks for i in range(1, len(t))}
        self.grown: dict[bytes, tuple] = {}  # of tokens met: no more than there are tokens
        self.now, self.old = Tables(), Tables()

    def growth(self, token: bytes) -> tuple:
        """Ranks of the merges that build a token alone, and its first and last part before and after each; all empty if they don't build it."""
        known = self.grown.get(token)
        if known is None:
            parts, steps = [token[i : i + 1] for i in range(len(token))], []
            first, last = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == _NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                steps.append(rank)
                first.append(parts[0])
                last.append(parts[-1])
            known = self.grown[token] = ((*steps, _NEVER), tuple(first), tuple(last)) if len(parts) == 1 else ()
        return known

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether merging the joined bytes gives the two tokens: no merge across the bound comes before those inside."""
        b = self.growth(right)
        if not left or not b:
            return bool(b)
        a = self.growth(left)
        if not a:
            return False
        get, i, j = self.ranks.get, 0, 0
        steps, others, ends, begins = a[0], b[0], a[2], b[1]
        while True:
            x, y, across = steps[i], others[j], get(ends[i] + begins[j], _NEVER)
            if across < x and across <= y:
                return False
            if x <= y:
                if x == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        now, old = self.now, self.old
        before = old.ids.get(now.states[state])
        known = old.moves.get(before << 8 | byte) if before is not None else None
        new, out = (old.states[known[0]], known[1]) if known else self.make(now.states[state], byte)
        step = now.moves[state << 8 | byte] = (now.id_of(new), out)
        now.bytes += _MOVE + 8 * len(out)
        return step

    def make(self, state, byte: int):
        """The state that follows and the ids that became final."""
        pending, last, before = state
        text = pending + bytes((byte,))
        n = len(text)
        size = [0, *last, 0]
        ranks, starts, front = self.ranks, self.starts, set()
        for q in range(n):
            if q and not size[q]:
                continue
            end = text[q:]
            if not size[n] and end in ranks and self.fits(text[q - size[q] : q] if q else before, end):
                size[n] = n - q
            if end in starts:
                front.add(q)
        if not size[n]:
            raise ValueError("no token ends here: the ranks lack a single byte or can't be built by merges")
        # every used position gets to its own ancestor, from the right, until all of them have met
        used = {*front, n}
        apart, a = len(used), n
        while apart > 1:
            if a in used:
                up = a - size[a]
                if up in used:
                    apart -= 1
                else:
                    used.add(up)
            a -= 1
        while a not in used:
            a -= 1
        out, q = [], a
        while q > 0:
            out.append(ranks[text[q - size[q] : q]])
            q -= size[q]
        # the token before matters only while one can still start right behind it
        left = (text[a - size[a] : a] if a else before) if a in front else b""
        return (text[a:], tuple([size[q] if q in used else 0 for q in range(a + 1, n + 1)]), left), tuple(reversed(out))

    def end(self, state: int) -> tuple[int, ...]:
        text, last, _ = self.now.states[state]
        out, q = [], len(text)
        while q > 0:
            out.append(self.ranks[text[q - last[q - 1] : q]])
            q -= last[q - 1]
        done = self.now.ends[state] = tuple(reversed(out))
        self.now.bytes += _MOVE + 8 * len(out)
        return done

    def encode(self, piece: bytes) -> tuple[int, ...]:
        state, out, moves = 0, [], self.now.moves
        for byte in piece:
            step = moves.get(state << 8 | byte)
            if step is None:
                step = self.move(state, byte)
                if self.now.bytes > self.half:
                    here = self.now.states[step[0]]
                    self.old, self.now = self.now, Tables()
                    step, moves = (self.now.id_of(here), step[1]), self.now.moves
            state = step[0]
            if step[1]:
                out += step[1]
        return tuple(out) + (self.now.ends.get(state) or self.end(state))


class _Pieces:
    """Ids of the pieces met lately."""

    def __init__(self, transducer: Transducer, max_bytes: int = PIECE_BYTES):
        self.transducer, self.known = transducer, Recent(max_bytes)

    def __call__(self, piece: str) -> tuple[int, ...]:
        ids = self.known.young.get(piece)
        if ids is None:
            ids = self.known.old.get(piece)
            if ids is None:
                raw = piece.encode()
                rank = self.transducer.ranks.get(raw)
                ids = (rank,) if rank is not None else self.transducer.encode(raw)
            if len(piece) <= 64:
                self.known.put(piece, ids, _PIECE + len(piece) + 8 * len(ids))
        return ids


def _machine() -> tuple[list[str], list[int]]:
    """The states of UTF-8 and where each byte leads: state * 256 + byte -> state, -1 for a byte that can't come there.

    State 0 is between characters; `rest n` waits for n more bytes; the others are lead bytes whose
    second byte is restricted (no overlong forms, surrogates, or code points above 10FFFF).
    """
    names = ["whole", "rest 1", "rest 2", "rest 3", "E0", "ED", "F0", "F4"]
    to = [-1] * (256 * len(names))
    lead = [(0x00, 0x7F, "whole"), (0xC2, 0xDF, "rest 1"), (0xE0, 0xE0, "E0"), (0xE1, 0xEC, "rest 2"), (0xED, 0xED, "ED"), (0xEE, 0xEF, "rest 2"), (0xF0, 0xF0, "F0"), (0xF1, 0xF3, "rest 3"), (0xF4, 0xF4, "F4")]
    then = {"rest 1": (0x80, 0xBF, "whole"), "rest 2": (0x80, 0xBF, "rest 1"), "rest 3": (0x80, 0xBF, "rest 2"), "E0": (0xA0, 0xBF, "rest 1"), "ED": (0x80, 0x9F, "rest 1"), "F0": (0x90, 0xBF, "rest 2"), "F4": (0x80, 0x8F, "rest 2")}
    for a, b, name in lead:
        to[a : b + 1] = [names.index(name)] * (b - a + 1)
    for state, (a, b, name) in then.items():
        k = 256 * names.index(state)
        to[k + a : k + b + 1] = [names.index(name)] * (b - a + 1)
    return names, to


UTF8_STATES, UTF8_MOVES = _machine()


class Utf8Stream:
    """Decodes bytes that come in any cuts, by the state machine of UTF-8.

    Every byte moves the machine. Runs of ASCII and whole characters between two cuts stay in state 0 at
    both ends and go through the built-in decoder, which is the same machine; the table is walked
    for the bytes of a character that a cut divides. A byte that can't come ends the character with one
    U+FFFD and is looked at again from state 0.
    """

    def __init__(self):
        self.state, self.held = 0, b""

    def _step(self, byte: int) -> str:
        to = UTF8_MOVES[self.state << 8 | byte]
        if to < 0:
            broken = "\ufffd"
            if self.state:  # the byte starts anew
                self.state, self.held = 0, b""
                return broken + self._step(byte)
            return broken
        self.state, self.held = to, self.held + bytes((byte,))
        if to:
            return ""
        done, self.held = self.held.decode(), b""
        return done

    def feed(self, raw: bytes) -> str:
        out, at = [], 0
        while self.state and at < len(raw):  # a character that the last cut divided
            out.append(self._step(raw[at]))
            at += 1
        last = len(raw)
        for back in range(1, min(3, last - at) + 1):  # the lead byte of a character that this cut divides
            b = raw[last - back]
            if b >= 0xC0:
                last -= back
                break
            if b < 0x80:
                break
        out.append(raw[at:last].decode("utf-8", "replace"))
        out += map(self._step, raw[last:])
        return "".join(out)

    def finish(self) -> str:
        left, self.state, self.held = self.state, 0, b""
        return "\ufffd" if left else ""


class Codec:
    """Encoding of whole texts and decoding of ids, for one worker."""

    def __init__(self, raw_ranks: bytes, pattern: str):
        ranks = load_ranks(raw_ranks)
        self.pieces = _Pieces(Transducer(ranks))
        self.split = regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.name_of = {v: str(v) for v in ranks.values()}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces, self.split(text))))

    def decode(self, ids: list[int], step: int = 1 << 16):
        """Pieces of the text whose ids these are."""
        stream, get = Utf8Stream(), self.bytes_of.__getitem__
        for i in range(0, len(ids), step):
            yield stream.feed(b"".join(map(get, ids[i : i + step])))
        yield stream.finish()


def _codec(raw: bytes, pattern: str) -> Codec:
    return held("bpe", (hashlib.sha256(raw).hexdigest(), pattern), lambda: Codec(raw, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, column: str = "text", digest: bool = False) -> DataFrame:
    """Adds the token ids of every whole text; with `digest`, replaces them by counts and digests.

    Adds n_tokens long and ids array<int>, or n_tokens, ids_sha256 and decoded_sha256 with
    `digest` (the ids are decoded again for the last). The rank file is read where the driver
    runs and broadcast; it is refused beyond MAX_RANK_BYTES. Rows are handled one by one in
    place: no shuffle. Null and empty text: no ids. Repeated rows give repeated results; an empty
    table an empty one; columns that bear an added name are replaced.
    """
    raw = Path(ranks_path).read_bytes()
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{ranks_path} has more than {MAX_RANK_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches):
        codec = _codec(shared.value, pattern)
        for batch in batches:
            counts, ids_of, sums, decoded = [], [], [], []
            for text in filled(batch.column(batch.schema.get_field_index(filled_name(batch, column)))):
                ids = codec.encode(text.as_py())
                counts.append(len(ids))
                if digest:
                    sums.append(hashlib.sha256(",".join(map(codec.name_of.__getitem__, ids)).encode()).hexdigest())
                    h = hashlib.sha256()
                    for part in codec.decode(ids):
                        h.update(part.encode())
                    decoded.append(h.hexdigest())
                else:
                    ids_of.append(np.array(ids, np.int32))
            n = pa.array(counts, pa.int64())
            if digest:
                yield extended(batch, n_tokens=n, ids_sha256=pa.array(sums, pa.string()), decoded_sha256=pa.array(decoded, pa.string()))
            else:
                yield extended(batch, n_tokens=n, ids=pa.array(ids_of, pa.list_(pa.int32())))

    added = "n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return docs.mapInArrow(run, plus(docs.schema, added))


def decode(tokens: DataFrame, ranks_path: str, column: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text of an array of ids. Null or no ids: empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches):
        codec = _codec(shared.value, "(?s).+")
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield extended(batch, **{into: pa.array(["".join(codec.decode(x or [])) for x in ids], pa.string())})

    return tokens.mapInArrow(run, plus(tokens.schema, f"`{into}` string"))


class TokenCounter:
    """Counts the tokens of a string; travels to workers as a broadcast of the ranks."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        raw = Path(ranks_path).read_bytes()
        self.shared, self.pattern, self.key = spark.sparkContext.broadcast(raw), pattern, hashlib.sha256(raw).hexdigest()

    def __call__(self, text: str) -> int:
        codec = held("bpe", (self.key, self.pattern), lambda: Codec(self.shared.value, self.pattern))
        return len(codec.encode(text)) if text else 0
