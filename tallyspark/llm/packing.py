"""Packing: harmonic packing of token streams into fixed-capacity sequences.

A length belongs to class k when k pieces of it fill a sequence: lengths in
(C/(k+1), C/k].  Each worker fills its classes' bins on its own, k pieces to a
bin, so there is no shuffle.  A document longer than C first gives whole
sequences; a rest that would leave more than TOLERANCE of its class's slot
empty is cut at the next class's slot.  What the bins of a worker still hold
at its end is joined end to end, and the last, partial sequence is cut at
powers of two, which need no padding.

Defined results: null text counts as empty, so its document is the end id
alone; rows with equal ids are packed each on their own; an empty table gives
an empty result; a worker's sequence ids start at its partition's number
times 2**33, so a task that is run again gives the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held, sliced
from .units import Column, SpacedColumn, library_column

CAPACITY = 2048
#: Largest part of a class's slot that a piece may leave empty, as 1 / TOLERANCE.
TOLERANCE = 64
END_ID = 1

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the pre-split of byte-level tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_encoder(path: str) -> Column:
    """The worker's encoder (column of texts -> little-endian 32-bit ids) for a byte-level tokenizer file of the tokenizers library."""
    return held(("byte encoder", path), lambda: library_column(SpacedColumn, path, PATTERN, lambda token: token.startswith("Ġ"), "<u4"))


class Bins:
    """Bins of one worker.  add() and finish() give (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, tolerance: int = TOLERANCE, first: int = 0):
        self.capacity, self.tolerance, self.next = capacity, tolerance, first
        self.open: dict[int, list] = {}

    def _close(self, pieces: list):
        offset = 0
        for doc, start, length in pieces:
            yield doc, start, length, self.next, offset
            offset += length
        self.next += 1

    def add(self, doc, length: int):
        start, c = 0, self.capacity
        while length - start >= c:
            yield from self._close([(doc, start, c)])
            start += c
        while start < length:
            rest = length - start
            k = c // rest
            slot = c // k
            if (slot - rest) * self.tolerance > slot and c // (k + 1) > 0:
                k += 1
                rest = c // k
            held = self.open.setdefault(k, [])
            held.append((doc, start, rest))
            start += rest
            if len(held) == k:
                yield from self._close(self.open.pop(k))

    def finish(self):
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total, c, room, held = sum(p[2] for p in left), self.capacity, 0, []
        sizes = [c] * (total // c) + [1 << b for b in reversed(range(c.bit_length())) if total % c >> b & 1]
        sizes = iter(sizes)
        for doc, start, length in left:
            while length:
                if not room:
                    room = next(sizes)
                take = min(room, length)
                held.append((doc, start, take))
                start, length, room = start + take, length - take, room - take
                if not room:
                    yield from self._close(held)
                    held = []
        self.open = {}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: its document, place, token ids (little-endian 32-bit) and sequence."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode = byte_encoder(tokenizer)
        bins = Bins(capacity, first=(TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        waiting: dict[int, tuple] = {}  # ids of documents with pieces in open bins
        n_doc = 0

        def emit(pieces):
            cols = [[] for _ in range(7)]
            for n, start, length, seq, offset in pieces:
                doc, ids, left = waiting[n]
                for col, v in zip(cols, (doc, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, seq, offset)):
                    col.append(v)
                left -= length
                if left:
                    waiting[n] = (doc, ids, left)
                else:
                    del waiting[n]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

        for batch in sliced(batches):
            pieces = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), end).to_pylist()):
                waiting[n_doc] = (doc, ids, len(ids) // 4)
                pieces += bins.add(n_doc, len(ids) // 4)
                n_doc += 1
            yield emit(pieces)
        yield emit(bins.finish())

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SCHEMA)
