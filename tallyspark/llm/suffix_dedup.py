"""Suffix-array dedup: a run-length index of the passages that may repeat.

Every window of LENGTH bytes is named by its minimizer, the least hash of the
KMER-byte strings in it, which depends on the window alone.  Only windows
whose minimizer occurs in two documents can repeat.  Stretches of such windows
are grouped by minimizer, equal stretches are merged, and each block of groups
is indexed: a suffix array, its run-compressed Burrows-Wheeler transform with
samples at run ends, and for each interval of suffixes that agree in LENGTH
bytes the first document.  All stretches are streamed through the index
together, one LF step a byte; a stretch's matching statistics give, for each
window, the least document that holds it.

A group of one stretch needs no index: its windows are its owners' alone.
Groups with more than CROWDED different stretches would make one task large;
there each window is dealt by itself and grouped by its bytes' hash.

Defined results: null text counts as empty; a byte is removed when a window
that covers it starts in a document with a smaller id too; rows that share an
id don't remove each other's bytes; rows without an id are left whole; removed
runs that touch are one span; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, removed, small_batches, written

LENGTH = 50
KMER = 24
#: Different stretches of a group from which its windows are dealt one by one.
CROWDED = 20_000
#: Bytes of stretches indexed together.
BLOCK_BYTES = 2 << 20
SEPARATOR = 0xFF  # in no UTF-8 text

_M = np.uint64


def window_names(data: np.ndarray, length: int = LENGTH, k: int = KMER) -> np.ndarray:
    """The minimizer of each window: the least mixed hash of the k-byte strings inside."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h, have, base = None, 0, 0x9E3779B97F4A7C15
    part, size, bits = data.astype(np.uint64) + _M(1), 1, k
    while True:  # polynomial hashes of powers of two, joined to k
        if bits & 1:
            h = part if h is None else h[: len(data) - have - size + 1] * _M(base) + part[have : len(data) - size + 1]
            have += size
        bits >>= 1
        if not bits:
            break
        part = part[:-size] * _M(base) + part[size:]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        size *= 2
    h = (h ^ (h >> _M(32))) * _M(0xD6E8FEB86659FD93)
    h ^= h >> _M(29)
    width, n = length - k + 1, 1
    least = h
    while n * 2 <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    m = len(h) - width + 1
    return np.minimum(least[:m], least[width - n : width - n + m])


def _runs(names: np.ndarray) -> np.ndarray:
    """Where runs of one name start."""
    return np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)


def _directory(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the number of the run that it lies in."""
    return np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=n))


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of texts that are joined by separators.

    runs and heads are the transform, jump the LF value of each run's first
    row, samples the suffix array at run ends; starts and first give the rows
    at which the first `length` bytes change, and the least document there;
    run_at and interval_at find a row's run and interval.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray, length: int = LENGTH):
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = np.frombuffer(bytes([SEPARATOR]).join([*texts, b""]), np.uint8)
        order, by_half, half = self._sorted(joined, length)
        n, kind = len(joined), order.dtype
        self.length, self.sizes = length, sizes
        bwt = joined[order - 1]
        self.runs = _runs(bwt)
        self.run_at = _directory(self.runs, n)
        self.heads = bwt[self.runs]
        lengths = np.diff(self.runs, append=n)
        by_head = np.argsort(self.heads, kind="stable")
        self.jump = np.empty(len(self.runs), np.int64)
        self.jump[by_head] = np.cumsum(lengths[by_head]) - lengths[by_head]
        self.samples = order[self.runs + lengths - 1]
        changed = np.ones(n, bool)
        a = by_half[order]
        changed[1:] = a[1:] != a[:-1]
        a = by_half[np.minimum(order + kind.type(length - half), kind.type(n - 1))]
        changed[1:] |= a[1:] != a[:-1]
        del a, by_half
        self.starts = np.flatnonzero(changed)
        self.interval_at = _directory(self.starts, n)
        known, codes = np.unique(docs, return_inverse=True)
        owner = np.repeat(codes.astype(kind), sizes + 1)
        self.first = known[np.minimum.reduceat(owner[order], self.starts)]
        del owner
        row = np.empty(n, kind)
        row[order] = np.arange(n, dtype=kind)
        self.ends = row[np.cumsum(sizes + 1) - 1]  # the rows of the separators

    @staticmethod
    def _sorted(joined: np.ndarray, length: int):
        """The suffix array by prefix doubling, and ranks by the largest power of two up to length.

        A suffix's rank is the first place of those that agree with it so far;
        only suffixes that still agree with others are sorted again.  Places
        take 32 bits where they fit, and no array outlives its use.
        """
        n = len(joined)
        kind = np.int32 if n < 1 << 30 else np.int64
        padded = np.concatenate([joined, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key <<= _M(8)
            key |= padded[i : n + i]
        order = np.argsort(key).astype(kind)
        place, key = np.arange(n, dtype=kind), key[order]  # places of the suffixes in question, and their sorted keys
        rank, size, by_half, half = np.empty(n, kind), 8, None, 0
        while True:
            new = np.ones(len(place), bool)
            new[1:] = key[1:] != key[:-1]
            del key
            run = np.cumsum(new, dtype=kind)
            run -= 1
            rank[order[place]] = place[new][run]
            del run
            if size <= length:
                by_half, half = rank.copy(), size
            again = ~new  # in a run of more than one
            again[:-1] |= ~new[1:]
            place = place[again]
            if not len(place) and size * 2 > length:
                return order, by_half, half
            suffix = order[place]
            key = rank[suffix].astype(np.int64)
            key *= n + 1
            after = suffix + kind(size)
            inside = after < n
            key[inside] += rank[after[inside]]
            key[inside] += 1
            del after, inside
            by_key = np.argsort(key)
            key = key[by_key]
            order[place] = suffix[by_key]
            del by_key, suffix
            size *= 2

    def step(self, rows: np.ndarray) -> np.ndarray:
        """LF: from a suffix's row to that of the suffix one byte longer."""
        r = self.run_at[rows]
        return self.jump[r] + rows - self.runs[r]

    def stream(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the runs of windows with one least document: (documents, first window, last window)."""
        texts = np.argsort(-self.sizes, kind="stable")
        rows, sizes = self.ends[texts], self.sizes[texts]
        windows = np.maximum(self.sizes - self.length + 1, 0)
        starts = np.cumsum(windows) - windows  # all texts' windows lie end to end
        interval = np.empty(int(windows.sum()), np.int32)
        for t in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -t, "right"))
            rows = self.step(rows[:active])
            if t >= self.length:
                interval[starts[texts[:active]] + sizes[:active] - t] = self.interval_at[rows]
        doc = self.first[interval]
        cut = np.ones(len(doc), bool)
        cut[1:] = doc[1:] != doc[:-1]
        cut[starts[windows > 0]] = True
        begin = np.flatnonzero(cut)
        last = np.append(begin[1:], len(doc)) - 1
        bounds = np.searchsorted(begin, np.append(starts, len(doc)))
        return [(doc[begin[x:y]], begin[x:y] - s, last[x:y] - s) for s, x, y in zip(starts, bounds, bounds[1:])]


def _names(docs: DataFrame) -> DataFrame:
    """(h, doc, t): the distinct minimizers of each text t of a document."""

    def run(batches):
        freed()
        for batch in batches:
            hs, ids, ts, counts = [], [], [], []
            for i, t, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                names = window_names(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8))
                if len(names):
                    hs.append(np.unique(names[_runs(names)]).view(np.int64))
                    ids.append(i)
                    ts.append(t)
                    counts.append(len(hs[-1]))
            if hs:
                of_each = (pa.array(np.repeat(np.array(x, np.int64), counts)) for x in (ids, ts))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), *of_each], names=["h", "doc", "t"])

    return docs.mapInArrow(run, "h long, doc long, t long")


def _stretches(docs: DataFrame) -> DataFrame:
    """(h, s, data, doc, t, start): stretches of windows whose minimizer h is among the text's shared ones; s hashes the bytes."""

    def run(batches):
        import xxhash

        freed()
        for batch in batches:
            cols = [[] for _ in range(6)]
            for i, t, text, shared in zip(*(batch.column(k) for k in range(4))):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                names = window_names(np.frombuffer(raw, np.uint8))
                begin = _runs(names)
                named = names[begin]
                known = np.isin(named, shared.values.to_numpy(zero_copy_only=False).view(np.uint64))
                ends = np.append(begin[1:], len(names))
                i, t = i.as_py(), t.as_py()
                for h, a, b in zip(named[known].view(np.int64).tolist(), begin[known].tolist(), ends[known].tolist()):
                    data = raw[a : b + LENGTH - 1]
                    for col, v in zip(cols, (h, xxhash.xxh3_64_intdigest(data) - (1 << 63), data, i, t, a)):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "s", "data", "doc", "t", "start"])

    return docs.select("doc", "t", "text", "shared").mapInArrow(run, "h long, s long, data binary, doc long, t long, start long")


_FOUND = "h long, s long, docs array<long>, first array<int>, last array<int>"


def _indexed(distinct: DataFrame) -> DataFrame:
    """Rows (h, s, data, d), the groups of one h together, to (h, s, docs, first, last)."""

    def run(batches):
        freed()
        held, size, last = [], 0, None

        def block():
            index = RunLengthIndex([x[2] for x in held], np.array([x[3] for x in held], np.int64))
            found = index.stream()
            cols = [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64())]
            for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32())):
                offsets = np.cumsum([0, *(len(f[k]) for f in found)])
                values = np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind)))
            return pa.RecordBatch.from_arrays(cols, names=["h", "s", "docs", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= BLOCK_BYTES and row[0] != last:
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + 1
                last = row[0]
        if held:
            yield block()

    return distinct.select("h", "s", "data", "d").mapInArrow(run, _FOUND)


def _dealt(crowded: DataFrame) -> DataFrame:
    """The same for crowded groups: every window by itself, grouped by two hashes of its bytes."""
    windows = crowded.select("h", "s", "d", F.explode(F.sequence(F.lit(0), F.length("data") - LENGTH)).alias("w"), "data")
    data = F.substring("data", F.col("w") + 1, F.lit(LENGTH))
    windows = windows.select("h", "s", "d", "w", F.xxhash64(data).alias("x"), F.xxhash64(data, F.lit(1)).alias("y"))
    least = windows.groupBy("x", "y").agg(F.min("d").alias("least"))
    back = windows.join(least, ["x", "y"]).groupBy("h", "s").agg(F.sort_array(F.collect_list(F.struct("w", "least"))).alias("ws"))
    at = F.transform("ws", lambda x: x["w"])
    return back.select("h", "s", F.transform("ws", lambda x: x["least"]).alias("docs"), at.alias("first"), at.alias("last"))


def _cut(docs: DataFrame) -> DataFrame:
    """Applies spans: (doc_id, n_bytes, n_removed, spans, kept, rest)."""

    def run(batches):
        freed()
        for batch in batches:
            out = [[] for _ in range(5)]
            for i, text, copy, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = (text or "").encode("utf-8", "replace")
                if copy:
                    spans = [{"a": 0, "b": len(raw)}] if len(raw) >= LENGTH else []
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, end = [], 0
                for a, b in merged:
                    kept.append(raw[end:a])
                    end = b
                kept.append(raw[end:])
                data = b"".join(kept)
                for col, v in zip(out, (i, len(raw), len(raw) - len(data), merged, data)):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            cols = [*(pa.array(c, k) for c, k in zip(out, kinds)), batch.column(4)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "rest"])

    rest = docs.schema["rest"].dataType.simpleString()
    schema = f"doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, rest {rest}"
    return docs.select("doc_id", "text", "copy", "spans", "rest").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans ([first byte, end] of each maximal removed run), kept (the other bytes) and rest (carried columns)."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.struct(*(carry or [key])).alias("rest")).withColumn("t", F.xxhash64("text"))
    texts = base.where("doc IS NOT NULL AND text IS NOT NULL")
    same = texts.select("doc", "t", F.xxhash64("text", F.lit(1)).alias("u"), F.octet_length("text").alias("n")).where(F.col("n") >= LENGTH).distinct()
    same, same_at = written(same, "texts")
    owners = same.groupBy("t", "u", "n").agg(F.min("doc").alias("owner"))
    marked, marked_at = written(same.join(owners, ["t", "u", "n"]).select("doc", "t", (F.col("doc") > F.col("owner")).alias("copy")), "copies")
    removed(spark, same_at)

    # one text of each group of equal ones stands for all
    firsts = texts.join(marked.where("NOT copy").select("doc", "t"), ["doc", "t"], "left_semi")
    named = _names(firsts.select("doc", "t", "text")).withColumn("n", F.count("*").over(Window.partitionBy("h")))
    shared, shared_at = written(named.where("n > 1").select("h", "doc", "t"), "shared", "zstd")
    lists = shared.groupBy("doc", "t").agg(F.collect_list("h").alias("shared"))
    keyed = firsts.join(lists, ["doc", "t"])
    stretches, stretches_at = written(_stretches(keyed), "stretches", "zstd")
    removed(spark, shared_at)

    distinct = stretches.groupBy("h", "s").agg(F.min("doc").alias("d"), F.first("data").alias("data"))
    distinct, distinct_at = written(distinct.withColumn("n", F.count("*").over(Window.partitionBy("h"))), "distinct", "zstd")
    grouped = distinct.where(F.col("n").between(2, CROWDED)).repartition("h").sortWithinPartitions("h")
    last = (F.length("data") - LENGTH).cast("int")
    alone = distinct.where("n = 1").select("h", "s", F.array("d").alias("docs"), F.array(F.lit(0)).alias("first"), F.array(last).alias("last"))
    found = _indexed(grouped).unionByName(_dealt(distinct.where(F.col("n") > CROWDED))).unionByName(alone)
    placed = stretches.select("h", "s", "doc", "t", "start").join(found, ["h", "s"])
    parts = F.filter(F.arrays_zip("docs", "first", "last"), lambda x: x["docs"] < F.col("doc"))
    hits = placed.select("doc", "t", "start", F.explode(parts).alias("x"))
    spans = hits.groupBy("doc", "t").agg(
        F.collect_list(F.struct((F.col("start") + F.col("x.first")).alias("a"), (F.col("start") + F.col("x.last") + LENGTH).alias("b"))).alias("spans")
    )
    spans, _ = written(spans, "spans", "zstd")
    removed(spark, stretches_at, distinct_at)
    decided = marked.join(spans, ["doc", "t"], "left").withColumnRenamed("doc", "key").withColumnRenamed("t", "k")
    out = base.join(decided, (F.col("doc") == F.col("key")) & (F.col("t") == F.col("k")), "left")
    return _cut(out.select(F.col("doc").alias("doc_id"), "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans", "rest"))
