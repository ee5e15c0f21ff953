"""Byte-level BPE by a finite-state transducer, with streaming decode.

A sequence of tokens is the BPE encoding of its bytes exactly when each pair of
neighbours is the encoding of the pair's bytes.  The transducer reads bytes; a
configuration is the tokens not yet emitted and the trie node of the bytes
since.  Subsets of configurations are determinised when they are first met;
what all configurations of a subset agree on is emitted, after a lookahead
bounded by the longest token.  A register holds the last emitted token: it is
the neighbour of a configuration that holds no token, whose step is guarded by
the pair, so states don't multiply by the tokens before them.  One
configuration ends at the trie's root when the input ends.

Decoding joins token bytes in blocks and carries an unfinished UTF-8 sequence
from one block to the next by a state machine.

Defined results: null text counts as empty and gives no ids; rows with equal
ids are encoded each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sliced
from .units import Pieces, SpacedColumn, binaries, gathered

#: Determinised states, and memorised pairs, that a worker keeps; the tables start anew when full.
MAX_STATES, MAX_PAIRS = 120_000, 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class State:
    """A subset of configurations with its known steps: byte -> [guard, branches to (state, emitted tokens)]."""

    __slots__ = ("configs", "steps", "final")

    def __init__(self, configs):
        self.configs, self.steps, self.final = configs, {}, None


class Transducer:
    """BPE encoding of single pre-split matches."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}  # by first token << 32 | second
        self.states: dict[tuple, State] = {}
        self.root = self._node()
        for token, rank in ranks.items():
            if self.merged(token, rank) == [rank]:  # else no merges lead to it
                node = self.root
                for b in token:
                    if b not in node[0]:
                        node[0][b] = self._node()
                    node = node[0][b]
                node[1] = rank
        self._fresh()

    @staticmethod
    def _node() -> list:
        return [{}, None]  # children, token

    def _fresh(self) -> None:
        for state in self.states.values():  # states refer to each other
            state.steps.clear()
        self.states = {}
        self.start = self._state([(self.root, ())])

    def merged(self, text: bytes, whole: int | None = None) -> list[int]:
        """The definition: merges the pair of least rank, leftmost first, until none is left."""
        parts = [bytes([b]) for b in text]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if best == whole and len(parts) == 2:
                self.halves[whole] = ranks[parts[0]], ranks[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def joins(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Undoes merges on either side of the border, latest first, and looks for an earlier merge across it."""
        ranks, of, halves, before = self.ranks, self.bytes_of, self.halves, 1 << 60
        while True:
            across = ranks.get(of[a] + of[b])
            if across is not None and across < before:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def _state(self, configs) -> State:
        key = tuple([(id(node), pending) for node, pending in configs])
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(configs)
        return found

    def _branch(self, state: State, b: int, fits: bool):
        """Determinises one step, for a register that goes with the token of the guard or doesn't."""
        configs, root, pairs = [], self.root, self.pairs
        for node, pending in state.configs:
            child = node[0].get(b)
            if child is None:
                continue
            children, token = child
            if token is not None:
                if pending:
                    joins = pairs.get(pending[-1] << 32 | token)
                    if joins is None:
                        joins = self.joins(pending[-1], token)
                else:
                    joins = fits
                if joins:
                    configs.append((root, (*pending, token)))
            if children:
                configs.append((child, pending))
        first = last = configs[0][1]
        for _, pending in configs:
            if len(pending) < len(last):
                last = pending
        same = len(last)
        for _, pending in configs:
            while pending[:same] != last[:same]:
                same -= 1
        if same:
            configs = [(node, pending[same:]) for node, pending in configs]
        return self._state(configs), first[:same]

    def _step(self, state: State, b: int) -> list:
        """[guard, where the register goes with the guard's token, where it doesn't]; without a guard, the first."""
        guard = None
        for node, pending in state.configs:
            if not pending:
                child = node[0].get(b)
                guard = child[1] if child is not None else None
        step = state.steps[b] = [guard, None if guard is not None else self._branch(state, b, False), None]
        return step

    def encode(self, match: bytes) -> list[int]:
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._fresh()
        state, out, register, pairs = self.start, [], -1, self.pairs
        for b in match:
            step = state.steps.get(b) or self._step(state, b)
            guard = step[0]
            if guard is None:
                branch = step[1]
            else:
                if register < 0:
                    fits = True
                else:
                    fits = pairs.get(register << 32 | guard)
                    if fits is None:
                        fits = self.joins(register, guard)
                branch = step[1] if fits else step[2]
                if branch is None:
                    branch = step[1 if fits else 2] = self._branch(state, b, fits)
            state, emitted = branch
            if emitted:
                out += emitted
                register = emitted[-1]
        if state.final is None:
            state.final = next(pending for node, pending in state.configs if node is self.root)
        out += state.final
        return out


#: States of the UTF-8 machine: bytes still due, and the bounds of the next byte.
_LEADS = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}
_LEADS |= {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)} | {b: (3, 0x80, 0xBF) for b in (0xF1, 0xF2, 0xF3)}


class Utf8Stream:
    """Decodes blocks of bytes as they come; a character cut by a block's end waits for the next block."""

    def __init__(self):
        self.held = b""

    def feed(self, block: bytes) -> str:
        data = self.held + block
        cut = len(data)
        for back in range(1, min(3, cut) + 1):  # an unfinished character is three bytes at most
            lead = _LEADS.get(data[-back])
            if lead:
                due, low, high = lead
                for b in data[cut - back + 1 :]:
                    if not low <= b <= high:
                        break
                    due, low, high = due - 1, 0x80, 0xBF
                else:
                    cut -= back if due else 0
                break
            if data[-back] < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Encodes columns of texts to id bytes (little-endian, 32 bits) and decodes them in blocks."""

    BLOCK = 1 << 16

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.fst = Transducer(ranks)
        pieces = Pieces(regex.compile(pattern).findall, self._encode, "<u4")
        self.column = SpacedColumn(pieces, pieces)
        most = max(ranks.values(), default=-1)
        tokens = [self.fst.bytes_of.get(i, b"") for i in range(most + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array(list(map(len, tokens)), np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size

    def _encode(self, pieces: list[str]) -> pa.Array:
        gc.disable()  # states are many and live long; scanning them again and again would take most of the time
        try:
            ids = [self.fst.encode(piece.encode()) for piece in pieces]
        finally:
            gc.enable()
        return binaries(np.fromiter(chain.from_iterable(ids), "<u4"), np.array(list(map(len, ids)), np.int64))

    def encode(self, texts: pa.Array) -> pa.Array:
        return self.column(texts)

    def decode(self, ids: bytes) -> str:
        tokens, stream, out = np.frombuffer(ids, "<u4").astype(np.int64), Utf8Stream(), []
        for i in range(0, len(tokens), self.BLOCK):
            block = tokens[i : i + self.BLOCK]
            out.append(stream.feed(gathered(self.token_bytes, self.token_start[block], self.token_size[block]).tobytes()))
        out.append(stream.close())
        return "".join(out)


_codecs: dict = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
        gc.freeze()
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit ids) and decoded, the text that the ids decode to."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in sliced(batches):
            ids = c.encode(batch.column(1))
            decoded = [c.decode(x) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
