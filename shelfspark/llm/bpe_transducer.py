"""Byte-level BPE encoding and decoding.

Encoding runs a finite-state transducer over the bytes of each piece. A state holds, for every place at which the next token may have begun,
the node of the token trie reached since then and the token before it; reading a byte moves every node, and a node that ends a token t opens
a new place if t may follow the token before it, that is if the merges turn the bytes of both into just these two. For every prefix exactly
one token ends it so, hence at the end of a piece one path is left. Paths carry the tokens they do not share with all others; what all share
is emitted, at most one longest token behind the byte read. States and steps are made when first needed and remembered (bounded; they are
forgotten together and made anew).

Decoding feeds the bytes of ids, block by block, to an incremental UTF-8 state machine: a character may be split over ids and over blocks.
Ill-formed bytes become U+FFFD, one for each longest beginning of a character.

Defined cases: null text encodes as the empty text, to no id; null ids decode to the empty text; repeated rows give equal rows; other columns
pass through decode and are ignored by encode; an empty table gives no row. No shuffle; memory follows CHUNK bytes of text or one longest text.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

CHUNK = 4_000_000
STATES, PIECES = 150_000, 400_000  # remembered by a Python worker
BLOCK = 65_536  # ids decoded at once
LONG = 200_000  # longer texts are cut into pieces bit by bit
_NEVER = 1 << 40  # above every rank
_loaded: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: base64 of the bytes, and the rank, in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges by their definition: the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 1), i) for i in range(len(parts) - 1))
        if parts[i] + parts[i + 1] not in ranks:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """A state is a dict: a byte leads to (next state, ids emitted); _PATHS and _REST lead to its paths and to what the end emits."""

    _PATHS, _REST = -1, -2

    def __init__(self, ranks: dict[bytes, int], states: int = STATES) -> None:
        self.ranks, self.most = ranks, states
        self.bytes = {t: b for b, t in ranks.items()}
        # a trie of the tokens: node 0 is the root; _ends has the token of a node, or -1
        self._next: list[dict[int, int]] = [{}]
        self._ends = [-1]
        for piece, token in ranks.items():
            at = 0
            for b in piece:
                to = self._next[at].get(b)
                if to is None:
                    to = self._next[at][b] = len(self._next)
                    self._next.append({})
                    self._ends.append(-1)
                at = to
            self._ends[at] = token
        self._edges: dict[tuple[int, bool], list] = {}
        self._forget()

    def _forget(self) -> None:
        for state in getattr(self, "_known", {}).values():
            state.clear()  # states lead to each other: without this only the garbage collector would free them
        self._known: dict[tuple, dict] = {}
        self.start = self._state(((0, -1, ()),))

    def _state(self, paths: tuple) -> dict:
        state = self._known.get(paths)
        if state is None:
            state = self._known[paths] = {self._PATHS: paths, self._REST: paths[-1][2]}  # the path at the root is the last one
        return state

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at the right (left) end of a token's bytes while they merge, from the outermost byte on: each part with the rank of
        the merge that replaces it (none for the last one). At most one entry for each byte of a token, at most two lists for each token."""
        found = self._edges.get((token, right))
        if found is None:
            piece, parts = self.bytes[token], [self.bytes[token][i : i + 1] for i in range(len(self.bytes[token]))]
            end, found = (-1 if right else 0), []
            while True:
                rank, i = min(((self.ranks.get(x + y, _NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))), default=(_NEVER, 0))
                if i == (len(parts) - 2 if right else 0) or rank == _NEVER:
                    found.append((parts[end], rank))
                if rank == _NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if parts != [piece]:
                found = []  # the merges never make this token of its bytes
            self._edges[token, right] = found
        return found

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the merges turn the bytes of both into just these two: no merge across the border comes before those inside."""
        right = self._edge(token, False)
        if before < 0 or not right:
            return bool(right)
        left, i, j, rank_of = self._edge(before, True), 0, 0, self.ranks.get
        while True:
            (x, next_x), (y, next_y) = left[i], right[j]
            across = rank_of(x + y, _NEVER)
            # of equal ranks the leftmost pair merges first
            if across != _NEVER and across < next_x and across <= next_y:
                return False
            if next_x == next_y == _NEVER:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple]:
        paths, found, open_, nodes, ends = [], None, True, self._next, self._ends
        for node, before, rest in state[self._PATHS]:
            to = nodes[node].get(byte)
            if to is not None:
                if nodes[to]:
                    paths.append((to, before, rest))
                if open_ and ends[to] >= 0:  # one of them holds, so the last one needs no test
                    if found is not None and self.may_follow(found[0], found[1]):
                        open_ = False
                    else:
                        found = (before, ends[to], rest)
        before, token, rest = found
        paths.append((0, token, (*rest, token)))
        rests = [p[2] for p in paths]
        low, high, shared = min(rests), max(rests), 0  # what these two share, all share
        while shared < len(low) and low[shared] == high[shared]:
            shared += 1
        if len(self._known) >= self.most:
            self._forget()
        to = self._state(tuple([(node, before, rest[shared:]) for node, before, rest in paths] if shared else paths))
        step = state[byte] = (to, low[:shared])
        return step

    def _last(self, state: dict, byte: int) -> tuple:
        """What is emitted if the piece ends after this byte: the path that then is at the root. No state is made, as most would never be met
        again."""
        found = None
        for node, before, rest in state[self._PATHS]:
            to = self._next[node].get(byte)
            if to is not None and self._ends[to] >= 0:
                if found is not None and self.may_follow(found[0], found[1]):
                    break
                found = (before, self._ends[to], rest)
        return (*found[2], found[1])

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, last = self.start, [], len(piece) - 1
        for i, b in enumerate(piece):
            step = state.get(b)
            if step is None:
                if i == last:
                    out += self._last(state, b)
                    return out
                step = self._step(state, b)
            if step[1]:
                out += step[1]
            state = step[0]
        out += state[self._REST]
        return out


class _Pieces(dict):
    """The ids of pieces as little-endian bytes, remembered up to a bound."""

    def __init__(self, transducer: Transducer, most: int) -> None:
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = array("I", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str, pattern: str, states: int = STATES, pieces: int = PIECES) -> None:
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(Transducer(read_ranks(path), states), pieces)

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        found, out = self.pattern.finditer(text), []
        while some := [m.group() for m in islice(found, 50_000)]:
            out.append(b"".join(map(self.pieces.__getitem__, some)))
        return b"".join(out)


def _machine() -> tuple[np.ndarray, int]:
    """The UTF-8 state machine: a row for each state, a column for each byte. The well-formed byte sequences of Unicode."""
    names = ["start", "one more", "two more", "three more", "after E0", "after ED", "after F0", "after F4", "reject"]
    at = {n: i for i, n in enumerate(names)}
    table = np.full((len(names), 256), at["reject"])
    for state, low, high, to in [
        ("start", 0x00, 0x7F, "start"), ("start", 0xC2, 0xDF, "one more"), ("start", 0xE0, 0xE0, "after E0"), ("start", 0xE1, 0xEF, "two more"), ("start", 0xED, 0xED, "after ED"),
        ("start", 0xF0, 0xF0, "after F0"), ("start", 0xF1, 0xF3, "three more"), ("start", 0xF4, 0xF4, "after F4"), ("one more", 0x80, 0xBF, "start"), ("two more", 0x80, 0xBF, "one more"),
        ("three more", 0x80, 0xBF, "two more"), ("after E0", 0xA0, 0xBF, "one more"), ("after ED", 0x80, 0x9F, "one more"), ("after F0", 0x90, 0xBF, "two more"), ("after F4", 0x80, 0x8F, "two more"),
    ]:
        table[at[state], low : high + 1] = at[to]
    return table.tolist(), at["reject"]


_TABLE, _REJECT = _machine()
_WIDE = regex.compile(rb"[\x80-\xFF]+")


class Utf8Decoder:
    """Decodes bytes as they come. A character that is not complete waits for the next bytes; `bad` counts replaced sequences."""

    def __init__(self) -> None:
        self.state, self.held, self.bad = 0, b"", 0

    def feed(self, data: bytes, end: bool = False) -> str:
        if self.state == 0 and data.isascii():
            return data.decode("ascii")
        data = self.held + data
        good, out, state, done = 0, [], self.state, len(self.held)  # data[good:] is not given out yet; its well-formed part ends before `open_`
        open_ = 0
        for run in _WIDE.finditer(data):
            a, b = run.span()
            if b <= done:
                continue
            if a > done and state:  # an ASCII byte came before the character was complete
                out += [data[good:open_].decode(), "�"]
                good, state = done, 0
                self.bad += 1
            for i in range(max(a, done), b):
                to = _TABLE[state][data[i]]
                if to == _REJECT:
                    begun = state
                    out.append(data[good : open_ if begun else i].decode())
                    out.append("�")
                    self.bad += 1
                    # a byte that does not continue a character may begin one
                    state, good, open_ = 0, i, i
                    if begun:
                        state = _TABLE[0][data[i]]
                        if state == _REJECT:
                            out.append("�")
                            self.bad += 1
                            state = 0
                    if not state:
                        good = i + 1
                else:
                    if state == 0:
                        open_ = i
                    state = to
            done = b
        if state and done < len(data):
            out += [data[good:open_].decode(), "�"]
            good, state = done, 0
            self.bad += 1
        if state and not end:
            out.append(data[good:open_].decode())
            self.state, self.held = state, data[open_:]
        else:
            out.append(data[good : open_ if state else len(data)].decode())
            if state:
                out.append("�")
                self.bad += 1
            self.state, self.held = 0, b""
        return "".join(out)

    def finish(self) -> str:
        return self.feed(b"", end=True) if self.state else ""


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, token in ranks.items():
            tokens[token] = piece
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def bytes(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def text(self, ids: bytes, block: int = BLOCK) -> tuple[str, int]:
        """The text, and how many ill-formed sequences were replaced."""
        ids, machine = np.frombuffer(ids, "<u4"), Utf8Decoder()
        out = [machine.feed(self.bytes(ids[i : i + block])) for i in range(0, len(ids), block)]
        return "".join(out) + machine.finish(), machine.bad


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of docs (doc_id, text), by the ranks in a file that each executor reads."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded.get((ranks, pattern)) or _loaded.setdefault((ranks, pattern), Encoder(ranks, pattern))
        gc.disable()  # it would walk all remembered states again and again, and nothing here waits for it
        try:
            for batch in batches:
                for rows in slices(batch, 1, CHUNK):
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([encoder.ids(t or "") for t in rows.column(1).to_pylist()], pa.binary())], schema=schema)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """tokens with the columns decoded (string) and n_replaced (ill-formed sequences)."""
    place = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _loaded.get(ranks) or _loaded.setdefault(ranks, Decoder(read_ranks(ranks)))
        for batch in batches:
            for rows in slices(batch, place, CHUNK):
                found = [decoder.text(x or b"") for x in rows.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=[*rows.schema.names, "decoded", "n_replaced"])

    return tokens.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tokens.schema)}, decoded string, n_replaced long")


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    tokens = encode(docs, ranks, pattern).select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(tokens, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
