"""Token ids in a binary file format: canonical length-limited Huffman codes.

Code lengths come from the counts of ids over the whole corpus (package-merge,
at most MAX_BITS bits), codes are canonical, so the lengths alone are stored.
Documents lie in ascending id order, in blocks that decode independently;
each block holds the bit offset of every CHECKPOINT-th id, from which all its
stretches are decoded side by side by one table.

Files: <path>/blocks, Parquet rows (part, part_start, doc_ids, doc_tokens,
checkpoints, payload), and <path>/code, rows (id, bits).

Defined results: null text counts as empty and gives the end id alone; rows
with equal ids are kept, in the order of their texts' hashes; null ids come
first; an empty table gives empty files, which read back as an empty result.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, removed, shared_dir, sliced, written
from .units import BareColumn, Column, library_column, values_of

MAX_BITS = 20
CHECKPOINT = 128
#: Ids after which a block ends with the document that reaches them.
BLOCK_IDS = 1 << 18
#: Bytes of text for one part of the files.
PART_BYTES = 32 << 20
END_ID = 2

#: Fixed value: the pre-split of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_TOKENS = pa.schema([
    ("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
    ("counted", pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))),
])
_encoders: dict = {}


def word_encoder(path: str) -> Column:
    """The worker's encoder for a tokenizer file that drops white space; ids are 16-bit."""
    if path not in _encoders:
        _encoders[path] = library_column(BareColumn, path, PATTERN, lambda token: token.endswith("</w>"), "<u2")
    return _encoders[path]


def ordered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) in parts of about PART_BYTES of text by ascending id, null first; rows of one id by their texts' hashes, so they may lie in several parts."""
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    by = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    return base.repartitionByRange(-(-size // PART_BYTES) or 1, *by).sortWithinPartitions(*by).select("doc_id", "text")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, text) in the order of parts to (part, before, doc_id, n_tokens, ids, counted).

    ids are little-endian 16-bit with the end id, before the ids of the part's
    rows before.  One more row for each part has no ids, but counted, how often
    each id occurs in the part.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches):
        encode, part, before = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        counts = np.zeros(1 << 16, np.int64)

        def batch_of(n: int, **columns):
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _TOKENS], schema=_TOKENS)

        for batch in sliced(batches):
            ids = encode(batch.column(1), end)
            values, ends = values_of(ids, np.dtype("<u2"))
            counts += np.bincount(values, minlength=len(counts))
            yield batch_of(
                len(ids),
                part=pa.array(np.full(len(ids), part, np.int32)),
                before=pa.array(before + ends[:-1]),
                doc_id=batch.column(0),
                n_tokens=pa.array(np.diff(ends)),
                ids=ids,
            )
            before += int(ends[-1])
        found = np.flatnonzero(counts)
        entries = pa.StructArray.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], ["id", "n"])
        yield batch_of(1, counted=pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), entries))

    schema = "part int, before long, doc_id long, n_tokens long, ids binary, counted array<struct<id:int,n:long>>"
    return docs.mapInArrow(run, schema)


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs; as many rows as the vocabulary has entries at most."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            entries = batch.column(0).flatten()
            np.add.at(total, entries.field("id").to_numpy(), entries.field("n").to_numpy())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["id", "n"])

    counts = tokens.where("counted IS NOT NULL").select("counted").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most max_bits, by package-merge."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n <= 1:
        return dict.fromkeys(symbols, 1)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need more than {max_bits} bits")
    weights = [counts[s] for s in symbols]
    levels, packages = [], []
    for _ in range(max_bits):
        merged = list(heapq.merge(((w, 1) for w in weights), ((w, 0) for w in packages)))
        levels.append([leaf for _, leaf in merged])
        packages = [merged[i][0] + merged[i + 1][0] for i in range(0, len(merged) - 1, 2)]
    lengths, take = [0] * n, 2 * n - 2
    for leaves in reversed(levels):
        chosen = sum(leaves[:take])
        for i in range(chosen):
            lengths[i] += 1
        take = 2 * (take - chosen)
    return dict(zip(symbols, lengths))


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by (length, symbol), their lengths, and their codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits = np.array([lengths[s] for s in order], dtype=np.uint64)
    codes, code, last = [], 0, 0
    for b in bits.tolist():
        code <<= b - last
        codes.append(code)
        code, last = code + 1, b
    return np.array(order, dtype=np.int64), bits, np.array(codes, dtype=np.uint64)


class Coder:
    """Encodes and decodes arrays of ids with a canonical code."""

    def __init__(self, lengths: dict[int, int]):
        self.symbols, self.bits, self.codes = canonical(lengths)
        self.most = int(self.bits.max()) if len(self.bits) else 1
        top = int(self.symbols.max()) + 1 if len(self.symbols) else 0
        self.code_of, self.bits_of = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.code_of[self.symbols], self.bits_of[self.symbols] = self.codes, self.bits
        self._table = None

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of every CHECKPOINT-th id, and the packed bits."""
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        total = int(ends[-1]) if len(ends) else 0
        word = (starts >> np.uint64(5)).astype(np.int64)
        at = (starts & np.uint64(31)) + bits  # end within a pair of 32-bit words
        pair = self.code_of[ids] << (np.uint64(64) - at)
        out = np.zeros(total // 32 + 3, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] += np.bitwise_or.reduceat(pair >> np.uint64(32), first)
            out[word[first] + 1] += np.bitwise_or.reduceat(pair & np.uint64(0xFFFFFFFF), first)
        return starts[::CHECKPOINT].astype("<u8"), out.astype(">u4").tobytes()

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            reps = np.left_shift(1, (self.most - self.bits).astype(np.int64))
            self._table = np.repeat(self.symbols, reps).astype("<u4"), np.repeat(self.bits, reps).astype(np.uint64)
        return self._table

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All n ids of a block; its stretches between checkpoints advance together."""
        symbols, lengths = self.table()
        words = np.frombuffer(payload, dtype=">u4").astype(np.uint64)
        out = np.zeros((len(checkpoints), CHECKPOINT), "<u4")
        at, shift = checkpoints.astype(np.uint64), np.uint64(64 - self.most)
        mask, last = np.uint64((1 << self.most) - 1), len(symbols) - 1
        for i in range(min(CHECKPOINT, n)):
            if (len(checkpoints) - 1) * CHECKPOINT + i == n:  # the last stretch is done
                at = at[:-1]
            w = (at >> np.uint64(5)).astype(np.int64)
            seen = ((words[w] << np.uint64(32) | words[w + 1]) >> (shift - (at & np.uint64(31)))) & mask
            seen = np.minimum(seen.astype(np.int64), last)
            out[: len(at), i] = symbols[seen]
            at = at + lengths[seen]
        return out.reshape(-1)[:n]


_BLOCKS = "part int, part_start long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, payload binary"


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Writes the rows of tokenize() as files of the format."""
    spark = tokens.sparkSession
    lengths = code_lengths(count_ids(tokens))
    code = [(int(s), int(b)) for s, b in lengths.items()]
    spark.createDataFrame(code, "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)  # as large as the vocabulary at most

    def run(batches):
        coder = Coder(shared.value)
        rows, held, n, part, start, due = [], [], 0, None, 0, None

        def close():
            nonlocal held, n
            checkpoints, payload = coder.encode(np.concatenate([np.frombuffer(x[1], dtype="<u2") for x in held]).astype(np.int64))
            rows.append((part, start, [x[0] for x in held], [len(x[1]) // 2 for x in held], checkpoints.tobytes(), payload))
            held, n = [], 0

        def batch_of():
            names = ["part", "part_start", "doc_ids", "doc_tokens", "checkpoints", "payload"]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for p, before, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (p, before) != due:  # another part, or another stretch of its file
                    close()
                if not held:
                    part, start = p, before
                held.append((doc, ids))
                n += len(ids) // 2
                due = p, before + len(ids) // 2
                if n >= BLOCK_IDS:
                    close()
            if rows:
                yield batch_of()
        if held:
            close()
        yield batch_of()

    tokens.where("ids IS NOT NULL").select("part", "before", "doc_id", "ids").mapInArrow(run, _BLOCKS).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, decoded from the files."""
    code = spark.read.schema("id long, bits int").parquet(f"{path}/code").collect()  # one row for each vocabulary entry at most
    shared = spark.sparkContext.broadcast({r["id"]: r["bits"] for r in code})
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, bases = 0, {}
    for r in sorted(totals.collect()):  # one row for each part
        bases[r["part"]] = before
        before += r["n"]

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["doc_tokens"]
                ids = coder.decode(row["payload"], np.frombuffer(row["checkpoints"], dtype="<u8"), sum(sizes))
                ends = np.cumsum(sizes)
                starts = (ends - sizes + (bases[row["part"]] + row["part_start"])).tolist()
                data = ids.tobytes()
                cuts = [0, *(4 * ends).tolist()]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Tokenizes documents, writes them as files of the format in the shared folder, and reads the files."""
    spark = docs.sparkSession
    tokens, kept = written(tokenize(ordered(docs), tokenizer, end_id), "ids", "zstd")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(tokens, path)
    removed(spark, kept)
    return read_tokens(spark, path)
