"""A random forest whose trees are grown whole, each by one task, from binned rows.

Spark's own forest sums histograms of all open nodes of all trees over the
cluster and keeps the trees in the driver; with leaves of a few rows both grow
with rows times trees.  Here a row is a byte for each feature, equal rows are
counted, and a task that has them grows its share of the trees level by level.
Trees.java does so in the executors' JVMs, and scores; grow() and add_shares()
are the same in numpy, as plain forms.  Trees stay in the cluster.  Bootstrap (Poisson), splits
(Gini, at most maxBins bins, a sample of features for each node) and limits are
those of Spark's classifier; trees aren't pruned.
"""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import jvm

# Workers get this module by value where they can't import it.
_ROOT = os.path.realpath(os.path.join(os.path.dirname(__file__), "..", ".."))
if _ROOT not in {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 255
#: Distinct rows of a block, blocks of rows to score, rows and nodes that are worked on at once.
BLOCK_ROWS, SCORE_BLOCKS, SLICE, NODES = 50_000, 64, 1 << 16, 512
#: Groups of trees for each core: more even out the tasks, and each gets all rows.
GROUPS_PER_CORE = 4


# --- trees, in numpy --------------------------------------------------------


def _best_splits(x, y, m, sizes, total, feats, weights, min_rows, bins):
    """For each node its best (feature, bin, gain, left counts by class); rows lie in the order of their nodes."""
    nodes, width, per = len(sizes), x.shape[1], 2 * bins
    best_f, best_b, gain, left = np.zeros(nodes, np.uint8), np.zeros(nodes, np.uint8), np.zeros(nodes), np.zeros((nodes, 2))
    ends = np.cumsum(sizes)
    for a in range(0, nodes, NODES):
        b = min(a + NODES, nodes)
        first, last = ends[a] - sizes[a], ends[b - 1]
        hist = np.zeros((feats.shape[1], b - a, per))
        node = np.repeat(np.arange(b - a), sizes[a:b])
        for s in range(first, last, SLICE):
            e = min(s + SLICE, last)
            nd = node[s - first : e - first]
            lo, hi = nd[0], nd[-1] + 1
            base, at, flat = (nd - lo) * per + y[s:e], np.arange(e - s) * width, x[s:e].reshape(-1)
            for j in range(feats.shape[1]):
                found = flat[at + feats[a:b, j][nd]].astype(np.int64)
                found *= 2
                found += base
                hist[j, lo:hi] += np.bincount(found, m[s:e], (hi - lo) * per).reshape(hi - lo, per)
        below = hist.reshape(feats.shape[1], b - a, bins, 2).cumsum(axis=2)[:, :, :-1]
        l0, l1 = below[..., 0], below[..., 1]
        t0, t1 = (total[a:b, c][None, :, None] for c in (0, 1))
        n_left = l0 + l1
        ok = (n_left >= min_rows) & (t0 + t1 - n_left >= min_rows)
        a0, a1 = weights[0] * l0, weights[1] * l1
        r0, r1 = weights[0] * t0 - a0, weights[1] * t1 - a1
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(ok, (a0 * a0 + a1 * a1) / (a0 + a1) + (r0 * r0 + r1 * r1) / (r0 + r1), -1.0)
        score = score.transpose(1, 0, 2).reshape(b - a, -1)
        slot, cut = np.divmod(score.argmax(axis=1), bins - 1)
        i = np.arange(b - a)
        p = total[a:b] * weights
        w = p.sum(axis=1)
        gain[a:b] = score.max(axis=1) / w - (p * p).sum(axis=1) / (w * w)
        best_f[a:b], best_b[a:b], left[a:b] = feats[a:b][i, slot], cut, below[slot, i, cut]
    return best_f, best_b, gain, left


def _dealt(x, y, m, sizes, split, best_f, best_b, child_open):
    """The rows of the children that are open, in the order of these, and the children's numbers of rows; rows of a child keep their order."""
    node = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    right, flat, width = np.empty(len(node), bool), x.reshape(-1), x.shape[1]
    for s in range(0, len(node), SLICE):
        nd = node[s : s + SLICE]
        right[s : s + SLICE] = flat[np.arange(s, s + len(nd)) * width + best_f[nd]] > best_b[nd]
    place = np.full((2, len(sizes)), -1, np.int32)  # of each node's children among the open ones
    place[:, split] = np.where(child_open, np.cumsum(child_open) - 1, -1).reshape(-1, 2).T
    sides = []
    for side in (0, 1):
        mine = np.flatnonzero(right == side)
        at = place[side][node[mine]]
        sides.append((mine[at >= 0], at[at >= 0]))
    rows_of = sum(np.bincount(at, minlength=int(child_open.sum())) for _, at in sides)
    start = np.cumsum(rows_of) - rows_of
    order = np.empty(rows_of.sum(), np.int64)
    for mine, at in sides:
        n = np.bincount(at, minlength=len(rows_of))
        order[np.arange(len(mine)) + np.repeat(start - (np.cumsum(n) - n), n)] = mine
    rows = x.view(f"V{width}").reshape(-1).take(order)
    return rows.view(np.uint8).reshape(-1, width), y.take(order), m.take(order), rows_of


def grow(x, y, m, weights, rng, subset: int, max_depth: int, min_rows: int, bins: int):
    """One tree from rows x (bins of features), classes y, multiplicities m: (feature of each node, LEAF for leaves; bin; class 1's share of each leaf; importances).

    Nodes are in the order of levels, so the k-th node that splits (from 1) has the children 2k - 1 and 2k.
    """
    width, importance = x.shape[1], np.zeros(x.shape[1])
    out_f, out_b, out_p = [], [], []
    total = np.bincount(y, m, 2).reshape(1, 2)
    opens = lambda t, depth: (t.sum(axis=1) >= 2 * min_rows) & (t.min(axis=1) > 0) & (depth < max_depth)
    x, is_open, sizes, depth = np.ascontiguousarray(x), opens(total, 0), np.array([len(y)]), 0
    while len(total):
        f, b = np.full(len(total), LEAF, np.uint8), np.zeros(len(total), np.uint8)
        inside, children = total[is_open], np.empty((0, 2))
        if len(inside):
            feats = rng.random((len(inside), width)).argpartition(subset - 1, axis=1)[:, :subset]
            best_f, best_b, gain, left = _best_splits(x, y, m, sizes, inside, feats, weights, min_rows, bins)
            split = gain > 1e-12
            f[is_open], b[is_open] = np.where(split, best_f, LEAF), np.where(split, best_b, 0)
            importance += np.bincount(best_f[split], (gain * (inside * weights).sum(axis=1))[split], width)
            children = np.stack([left, inside - left], axis=1)[split].reshape(-1, 2)
        p = (total * weights)[f == LEAF]
        out_f.append(f)
        out_b.append(b)
        out_p.append(np.divide(p[:, 1], p.sum(axis=1), out=np.full(len(p), 0.5), where=p.sum(axis=1) > 0))
        depth += 1
        child_open = opens(children, depth)
        if child_open.any():
            x, y, m, sizes = _dealt(x, y, m, sizes, split, best_f, best_b, child_open)
        total, is_open = children, child_open
    return np.concatenate(out_f), np.concatenate(out_b), np.concatenate(out_p), importance


def add_shares(x, tree: tuple, out) -> None:
    """Adds class 1's share in the leaf of each row of x to out."""
    f, b, share = tree
    leaf = f == LEAF
    p, left = np.zeros(len(f)), 2 * np.cumsum(~leaf) - 1
    p[leaf] = share
    for s in range(0, len(x), 1 << 16):
        part = x[s : s + (1 << 16)]
        node, at = np.zeros(len(part), np.int64), np.arange(len(part)) if not leaf[0] else np.empty(0, np.int64)
        while len(at):
            now = node[at]
            now = left[now] + (part[at, f[now]] > b[now])
            node[at] = now
            at = at[~leaf[now]]
        out[s : s + (1 << 16)] += p[node]


# --- rows as bytes ----------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def cut_points(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """For each element of the array column x at most bins - 1 bounds (v <= bound is the lower side): midpoints of all distinct values where those are few, else quantiles."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            seen = [s if len(s) > bins else np.union1d(s, x[:, f]) for f, s in enumerate(seen)]
        yield pa.record_batch({"f": pa.array(range(width), pa.int32()), "v": pa.array([s[: bins + 1] for s in seen], pa.list_(pa.float64()))})

    seen = [np.empty(0)] * width
    for r in rows.select("x").mapInArrow(few, "f int, v array<double>").toLocalIterator():  # some numbers for each task
        if len(seen[r.f]) <= bins:
            seen[r.f] = np.union1d(seen[r.f], r.v)
    many = [f for f in range(width) if len(seen[f]) > bins]
    steps = [i / bins for i in range(1, bins)]
    quantiles = rows.agg(*(F.percentile_approx(F.col("x")[f], steps).alias(f"q{f}") for f in many)).first() if many else {}
    return [sorted(set(quantiles[f"q{f}"])) if f in many else ((s[1:] + s[:-1]) / 2).tolist() for f, s in enumerate(seen)]


def binned(x: Column, cuts: list[list[float]]) -> Column:
    """A byte for each element."""
    width = len(cuts)

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        m = _matrix(column, width)
        out = np.stack([np.searchsorted(c, m[:, f]).astype(np.uint8) for f, c in enumerate(cuts)], axis=1)
        ends = np.arange(0, (len(m) + 1) * width, width, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])

    return run(x)


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, k, y, c): rows (k, y, c) dealt by what they hold and sorted, so that a block is the same however they lay before."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k", "ascending"), ("y", "ascending")])
        data = [b"".join(t["k"].to_pylist()), t["y"].to_numpy().astype(np.uint8).tobytes(), t["c"].to_numpy().astype(np.uint32).tobytes()]
        return pa.table({"block": t["block"][:1].cast(pa.int64())} | {n: pa.array([d], pa.binary()) for n, d in zip("kyc", data)})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack, "block long, k binary, y binary, c binary")


# --- the estimator ----------------------------------------------------------


class Forest(RandomForestClassifier):
    """Spark's parameters (those of two classes, Gini, a bootstrap of the rows' number), fitted as the module says.  All rows of a class have one weight."""

    def _fit(self, dataset: DataFrame) -> ForestModel:
        label, weight = self.getLabelCol(), F.col(self.getWeightCol()) if self.isDefined("weightCol") and self.getWeightCol() else F.lit(1.0)
        bins, min_rows, max_depth, seed, trees = self.getMaxBins(), self.getMinInstancesPerNode(), self.getMaxDepth(), self.getSeed(), self.getNumTrees()
        if bins > LEAF or self.getImpurity() != "gini" or not self.getBootstrap() or self.getSubsamplingRate() != 1 or self.getMinInfoGain() or self.getMinWeightFractionPerNode():
            raise ValueError("not a forest that this estimator grows")
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(label).cast("int").alias("y"), weight.cast("double").alias("w"))
        rows, drop_rows = files.keep(rows)  # read four times
        classes = rows.groupBy("y").agg(F.count("*").alias("n"), F.min("w").alias("w"), F.max("w").alias("w_max"), F.max(F.size("x")).alias("width")).limit(3).collect()
        if not classes or {r.y for r in classes} - {0, 1} or any(r.w != r.w_max for r in classes):
            raise ValueError("there must be rows, of the classes 0 and 1, and one weight for each class")
        width, weights = classes[0].width, np.array([next((r.w for r in classes if r.y == c), 1.0) for c in (0, 1)])
        subset = {"auto": math.ceil(math.sqrt(width)) if trees > 1 else width, "sqrt": math.ceil(math.sqrt(width)), "all": width}[self.getFeatureSubsetStrategy()]
        cuts = cut_points(rows, width, bins)
        counted = rows.select(binned(F.col("x"), cuts).alias("k"), "y").groupBy("k", "y").agg(F.count("*").alias("c"))
        blocks = _blocks(counted, -(-sum(r.n for r in classes) // BLOCK_ROWS))
        groups = min(trees, GROUPS_PER_CORE * dataset.sparkSession.sparkContext.defaultParallelism)

        sent = blocks.crossJoin(F.broadcast(dataset.sparkSession.range(groups).select(F.col("id").cast("int").alias("g"))))
        sent = sent.repartitionById(groups, "g").select("g", "block", "k", "y", "c")
        grower = jvm.instance(dataset.sparkSession, "Trees.java", "tallyspark.Trees$Grower").set(width, *map(float, weights), subset, max_depth, min_rows, bins, seed, trees, groups)
        grown = jvm.map_partitions(sent, grower, "tree int, f binary, b binary, p binary, importance binary")
        grown, drop = files.keep(grown)
        drop_rows()
        each = [np.frombuffer(r.importance) for r in grown.select("tree", "importance").orderBy("tree").collect()]  # some numbers for each tree
        summed = sum(i / i.sum() for i in each if i.sum())
        model = ForestModel(grown.drop("importance"), cuts, trees, (summed / summed.sum()).tolist() if np.sum(summed) else [0.0] * width, drop)
        return model._set(**{n: self.getOrDefault(n) for n in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol")})


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """trees: (tree, f, b, p) as grow() returns them, a row for each; release() drops those of a model that was just fitted."""

    def __init__(self, trees: DataFrame | None = None, cuts: list[list[float]] = (), n: int = 0, importances: list[float] = (), drop: Callable[[], None] = lambda: None):
        super().__init__()
        self.trees, self.cuts, self.n, self.importances, self.release = trees, cuts, n, importances, drop

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return DenseVector(self.importances)

    def getNumTrees(self) -> int:  # noqa: N802
        return self.n

    def _transform(self, dataset: DataFrame) -> DataFrame:
        width, spark = len(self.cuts), dataset.sparkSession
        groups = min(self.n, GROUPS_PER_CORE * spark.sparkContext.defaultParallelism)
        keyed = dataset.withColumn("_bins", binned(vector_to_array(self.getFeaturesCol()), self.cuts))
        keys = keyed.select(F.col("_bins").alias("k"), F.lit(0).alias("y"), F.lit(1).alias("c")).distinct()

        def total(t: pa.Table) -> pa.Table:
            t = t.sort_by("g")
            s = sum(np.frombuffer(b, np.float64) for b in t["s"].to_pylist())
            k = t["k"][0].as_py()
            return pa.table({"_bins": pa.array([k[i : i + width] for i in range(0, len(k), width)], pa.binary()), "_ones": pa.array(s)})

        rows = _blocks(keys, SCORE_BLOCKS).crossJoin(F.broadcast(spark.range(groups).select(F.col("id").cast("int").alias("g"))))
        trees = self.trees.withColumn("g", F.col("tree") % groups)
        sent = trees.select("g", "tree", "f", "b", "p", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("k"))
        sent = sent.unionByName(rows.select("g", "block", "k"), allowMissingColumns=True)
        sent = sent.repartitionById(groups, "g").sortWithinPartitions(F.col("block").asc_nulls_first(), "tree")
        scorer = jvm.instance(spark, "Trees.java", "tallyspark.Trees$Scorer").set(width)
        scored = jvm.map_partitions(sent.select("g", "block", "k", "f", "b", "p"), scorer, "block long, g int, k binary, s binary")
        sums = scored.groupBy("block").applyInArrow(total, "_bins binary, _ones double")
        one = F.col("_ones")
        raw = F.array(F.lit(float(self.n)) - one, one)
        out = keyed.join(sums, "_bins").withColumns({self.getRawPredictionCol(): array_to_vector(raw), self.getProbabilityCol(): array_to_vector(F.transform(raw, lambda v: v / self.n)), self.getPredictionCol(): (one > self.n - one).cast("double")})
        return out.drop("_bins", "_ones")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"cuts": m.cuts, "trees": m.n, "importances": m.importances})
        m.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        said = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(self.sparkSession.read.parquet(f"{path}/trees"), said["cuts"], said["trees"], said["importances"])
        model._resetUid(said["uid"])
        DefaultParamsReader.getAndSetParams(model, said)
        return model
