"""N-gram Jaccard join: exact, by a partition of the universe.

Sets are put in bands by size.  Two sets whose Jaccard reaches the threshold
differ in at most H elements, a bound that the larger set's band fixes.  A
hash deals all elements to m segments; by the pigeonhole principle two such
sets agree on a segment, or, where a segment's sets with one element deleted
are indexed too, differ there by one element at most.  How many segments of a
band get the one-deletion neighbourhood is chosen by cost: rows to emit
against pairs expected to meet by chance.  Candidates are verified exactly.

Equal sets are one class from the start.  A bucket's members are compared
with the most central one, whose segments most others share; members that are
connected by then need no comparison.  After STARS such rounds all members
still outside the centre's class are compared with the rest of their buckets,
so groups of near copies cost a few stars and no link is lost.  A pair whose
parity sketches differ in more cells than linked sets may have elements apart
can't be a link and is left out.  Only the documents of pairs that are left
have their sets made again, to be joined and compared exactly.

Defined results: words are runs other than ASCII white space, A-Z in lower
case; text of fewer words than a shingle is one shingle; null or wordless
text has an empty set, linked with nothing; rows that share an id are one
document in links; null ids are linked with nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, freed, removed, sliced, written
from .components import components
from .units import text_hashes

#: Rounds in which a bucket's most central member meets the others, before all that are still apart meet.
STARS = 3
#: Cells of a sketch for each element that linked sets of a band may differ in.
CELLS = 3
#: Words of a sketch at least and at most, as a row for each signature that meets another carries one.  Cells that more elements share still bound a difference from below.
LEAST_SKETCH, MAX_SKETCH = 4, 64
#: A pair that meets by chance costs as much as so many emitted rows, and as its sets' elements where a full sketch can't tell it from a link.
PAIR_COST = 4.0

_M = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles."""
    texts = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", " ")
    if pc.any(pc.match_substring_regex(texts, r"[\t-\r]")).as_py():
        texts = pc.replace_substring_regex(texts, r"[\t-\r]", " ")
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    full = (pc.binary_length(coded.dictionary).to_numpy() > 0)[codes]
    h = text_hashes(coded.dictionary)[0][codes[full]]
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]

    def hashed(h: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for i in range(n):
            total = (total ^ h[i : i + len(total)]) * _M(0x9E3779B97F4A7C15 + 2 * i) + _M(i + 1)
        return mix(total)

    every = hashed(h, width)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= width:
            s = np.sort(every[a : b - width + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        else:
            yield hashed(h[a:b], b - a)[: b - a]


class Band:
    """Sizes low to high; the first m1 of its m segments have one-deletion neighbourhoods."""

    def __init__(self, number: int, low: int, high: int, percent: int):
        self.number, self.low, self.high = number, low, high
        #: Most elements that two linked sets, the larger of this band, differ in.
        self.differ = 2 * high * (100 - percent) // (100 + percent)
        #: Segments above those that a difference can spoil, a neighbourhood counting twice.
        self.spare, self.m, self.m1 = 1, self.differ + 1, 0
        self.cells = 64 * min(MAX_SKETCH, max(LEAST_SKETCH, -(-CELLS * self.differ // 64)))

    def allocate(self, n_sets: int) -> None:
        """The cheapest m1 and spare: rows to emit against sets that must emit what they have empty, and meet by that."""
        best = None
        pair_cost = PAIR_COST + (self.high if 4 * self.differ > self.cells else 0)
        for spare in range(1, 12 + self.differ // 4):
            total = self.differ + spare
            for m1 in {0, *(total * k // 16 for k in range(1, 9))}:
                m = total - m1
                size = self.low / m
                empty = math.exp(-size)
                lost = (m - m1) * empty + 2 * m1 * (1 + size) * empty
                term = tail = math.exp(-lost)  # of a Poisson count, below spare
                for i in range(1, spare):
                    term *= lost / i
                    tail += term
                forced = n_sets * max(0.0, 1 - tail)
                rows = n_sets * ((m - m1) * (1 - empty) + m1 * (1 + size)) + forced * lost
                cost = rows + pair_cost * forced**2 / 2 * min(1.0, spare * spare / m)
                if best is None or cost < best:
                    best, self.spare, self.m, self.m1 = cost, spare, m, m1


def bands_for(sizes: dict[int, int], largest: int, percent: int) -> list[Band]:
    """Bands up to the largest size; sizes: sets by band number, for which segments are allocated."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        band = Band(len(out), low, high, percent)
        if sizes:
            band.allocate(sizes.get(len(out), 0) or 1)
        out.append(band)
        low = high + 1
    return out


def signatures(s: np.ndarray, band: Band) -> np.ndarray:
    """A set's signatures in a band: one for each segment, and one for each element left out of the first m1.

    Linked sets agree on segments worth spare at least, or differ there by an
    element where the neighbourhood is indexed.  A set with fewer empty ones
    than that agrees on one that isn't empty, so its empty ones are left out.
    """
    # fmt: off
    segment = (mix(s ^ _M(0x5851F42D4C957F2D)) % _M(band.m)).astype(np.int64)
    # fmt: on
    order = np.argsort(segment, kind="stable")
    segment, values = segment[order], mix(s[order] + _M(0x2545F4914F6CDD1D))
    sizes = np.bincount(segment, minlength=band.m)
    sums = np.zeros(band.m, np.uint64)
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    sums[segment[first]] = np.add.reduceat(values, first)
    tag = np.arange(band.m, dtype=np.uint64) + _M(band.number << 32)
    bare = int((sizes[band.m1 :] == 0).sum() + 2 * (sizes[: band.m1] <= 1).sum()) < band.spare
    out = mix(sums ^ mix(tag))
    if bare:
        out = out[sizes > 0]
    if band.m1:
        inside = (segment < band.m1) & ((sizes[segment] > 1) | (not bare))
        out = np.concatenate([out, mix((sums[segment[inside]] - values[inside]) ^ mix(tag[segment[inside]]))])
    return out


def sketch(s: np.ndarray, band: Band) -> np.ndarray:
    """Parities of the elements in each of some cells.  Cells whose parities differ bound the elements that differ from below."""
    odd = np.bincount((mix(s + _M(0x3C6EF372FE94F82B)) % _M(band.cells)).astype(np.int64), minlength=band.cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _keyed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, n, two hashes of each document's set, and its sketches in its own band and in the one after."""

    def run(batches):
        freed()
        bands = bands_for({}, 1000, percent)
        for batch in sliced(batches):
            cols = [[] for _ in range(5)]
            for s in shingles(batch.column(1), width):
                if bands[-2].high < len(s):
                    bands = bands_for({}, 2 * len(s), percent)
                k = next(i for i, band in enumerate(bands) if len(s) <= band.high)
                hashes = (int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (s, mix(s + _M(77))))
                for col, v in zip(cols, (len(s), *hashes, sketch(s, bands[k]), sketch(s, bands[k + 1]))):
                    col.append(v)
            kinds = (*[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n", "a", "b", "here", "next"])

    return docs.mapInArrow(run, "id long, n long, a long, b long, here array<long>, next array<long>")


def _signed(docs: DataFrame, bands: list[Band], width: int, percent: int) -> DataFrame:
    """(sig, id, n, own): signatures in a set's own band, and in the next one if a larger set there can be linked."""
    edges = np.array([b.low for b in bands])

    def run(batches):
        freed()
        for batch in sliced(batches):
            sigs, counts, ids, ns, own = [], [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingles(batch.column(1), width)):
                if not len(s):
                    continue
                k = int(np.searchsorted(edges, len(s), "right")) - 1
                for band in bands[k : k + 2]:
                    if band.differ and (band.number == k or len(s) * 100 >= band.low * percent):
                        x = signatures(s, band)
                        sigs.append(x)
                        counts.append(len(x))
                        ids.append(i)
                        ns.append(len(s))
                        own.append(band.number == k)
            if sigs:
                rep = lambda v, t: pa.array(np.repeat(np.array(v, t), counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), rep(ids, np.int64), rep(ns, np.int32), rep(own, bool)], names=["sig", "id", "n", "own"]
                )

    return docs.mapInArrow(run, "sig long, id long, n int, own boolean")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, s): a document's set."""

    def run(batches):
        freed()
        for batch in sliced(batches):
            found = [s.view(np.int64) for s in shingles(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def _linked(pairs: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents in base (id, text) whose sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets, sets_at = written(_sets(base.join(ids, "id", "left_semi"), width), "members")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    links, _ = written(both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b"), "links")
    removed(base.sparkSession, sets_at)
    return links


def near_duplicate_classes(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id: the least id that links of Jaccard >= percent / 100 lead to."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    keyed, keyed_at = written(_keyed(base, width, percent), "sets")
    whole = keyed.where("n > 0 AND id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("id").alias("rep"))
    classes, classes_at = written(whole, "classes")

    counts = {r["n"]: r["count"] for r in classes.groupBy("n").count().collect()}  # one row for each set size
    trial = bands_for({}, max(counts, default=0), percent)
    edges, per_band = np.array([b.low for b in trial]), {}
    for n, c in counts.items():
        k = int(np.searchsorted(edges, n, "right")) - 1
        per_band[k] = per_band.get(k, 0) + c
    bands = bands_for(per_band, max(counts, default=0), percent)

    reps = classes.select(F.col("rep").alias("id")).distinct()
    distinct = base.join(reps, "id", "left_semi")
    by_sig = Window.partitionBy("sig").orderBy(F.col("own").desc(), "id")
    met = _signed(distinct, bands, width, percent).withColumns({
        "before": F.lag("id").over(by_sig),
        "after": F.lead("id").over(by_sig),
        "led": F.first("own").over(by_sig),
    })
    buckets, buckets_at = written(met.where("led AND (before IS NOT NULL OR after IS NOT NULL)").select("sig", "id", "n", "own"), "buckets")

    # the member whose segments most others share stands at the centre of near copies
    sketches = keyed.where("n > 0 AND id IS NOT NULL").select("id", F.col("n").cast("int").alias("n"), "here", "next").distinct()
    central = buckets.join(buckets.groupBy("sig").agg(F.count("*").alias("met")), "sig").groupBy("id").agg(F.sum("met").alias("score"))
    ranked, old = buckets.join(central, "id").join(sketches, ["id", "n"]), buckets_at
    ranked = ranked.withColumn("sketch", F.when(F.col("own"), F.col("here")).otherwise(F.col("next"))).drop("here", "next")
    buckets, buckets_at = written(ranked, "buckets")
    removed(spark, old)
    # a bucket's most central member; ~id ranks the least id first
    head = F.max(F.struct("own", "score", F.bitwise_not("id").alias("rank"), "n", "c", "sketch"))

    def meets(side: str):
        """Whether a row may be linked with the member whose columns have the suffix, and isn't yet."""
        n, own, c, cells = (F.col(f"{x}_{side}") for x in ("n", "own", "c", "sketch"))
        apart = F.aggregate(F.zip_with("sketch", cells, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return (
            (F.col("c") != c)
            & (F.col("own") | own)
            & (F.greatest("n", n) * percent <= F.least("n", n) * 100)
            & (apart * (100 + percent) <= (F.col("n") + n) * (100 - percent))
        )

    links, found, found_at, turn = None, None, None, 0
    while True:
        last = turn >= STARS
        current = buckets.withColumn("c", F.col("id")) if found is None else buckets.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        heads = current.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), head.alias("h")).where("lo <> hi AND h.own")
        heads = heads.select("sig", F.bitwise_not("h.rank").alias("id_h"), *(F.col(f"h.{x}").alias(f"{x}_h") for x in ("n", "own", "c", "sketch")))
        met = current.join(heads, "sig")
        if last:  # whoever isn't of the centre's component meets all the others
            step, step_at = written(met.select(*current.columns, "c_h"), "round")
            apart = step.where("c <> c_h").select("sig", *(F.col(x).alias(f"{x}_o") for x in ("id", "n", "own", "c", "sketch")))
            pairs, other = step.join(apart, "sig").where(meets("o")), "id_o"
        else:
            centre = F.expr("id = id_h AND n = n_h AND sketch = sketch_h")
            step, step_at = written(met.select(*buckets.columns, "id_h", centre.alias("centre"), meets("h").alias("meets")), "round")
            pairs, other = step.where("meets"), "id_h"
        removed(spark, buckets_at)  # the round's table holds its rows
        pairs, pairs_at = written(pairs.select(F.least(other, "id").alias("a"), F.greatest(other, "id").alias("b")).distinct(), "pairs")
        new = _linked(pairs, base, width, percent)
        links = new if links is None else links.unionAll(new)
        old_found = found_at
        found, found_at = components(links)
        if not last:  # the leaders have met all others
            buckets, buckets_at = written(step.where("NOT centre").select(*buckets.columns), "buckets")
        removed(spark, pairs_at, step_at, *([old_found] if old_found else []))
        turn += 1
        if last or buckets.isEmpty():
            break

    comp = classes.select("n", "a", "b", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component_id"))
    out = keyed.join(comp, ["n", "a", "b"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
