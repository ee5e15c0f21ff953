"""The forest against a plain search for each split, its rows against their trees, and its cost against its depth."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tallyspark.operators import forest, model

WEIGHTS = np.array([0.7, 1.6])


def gini(t):
    p = t * WEIGHTS / (t * WEIGHTS).sum()
    return 1 - (p * p).sum()


def counts(y, m):
    return np.bincount(y, m, 2)


def gain_of(x, y, m, f, b):
    left = x[:, f] <= b
    whole, one, other = counts(y, m), counts(y[left], m[left]), counts(y[~left], m[~left])
    if min(one.sum(), other.sum()) < 10:
        return -1
    share = (one * WEIGHTS).sum() / (whole * WEIGHTS).sum()
    return gini(whole) - share * gini(one) - (1 - share) * gini(other)


@pytest.mark.parametrize("depth", [3, 30])
def test_every_split_is_the_best_one(depth, monkeypatch):
    monkeypatch.setattr(forest, "SLICE", 64)  # nodes span slices and chunks
    monkeypatch.setattr(forest, "NODES", 4)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 32, (700, 3)).astype(np.uint8)
    y = ((x[:, 0] > 10) ^ (rng.random(700) < 0.3)).astype(np.uint8)
    m = rng.integers(1, 4, 700).astype(float)
    f, b, p, importance = forest.grow(x, y, m, WEIGHTS, rng, 3, depth, 10, 32)
    inside, level, shares, expected = {0: np.arange(700)}, {0: 0}, iter(p), np.zeros(3)
    for node, (feature, cut) in enumerate(zip(f, b)):
        rows = inside[node]
        gains = [gain_of(x[rows], y[rows], m[rows], g, c) for g in range(3) for c in range(31)]
        if feature == forest.LEAF:
            assert max(gains) <= 1e-12 or level[node] == depth
            t = counts(y[rows], m[rows]) * WEIGHTS
            assert next(shares) == pytest.approx(t[1] / t.sum())
            continue
        found = gain_of(x[rows], y[rows], m[rows], feature, cut)
        assert found == pytest.approx(max(gains)) and level[node] < depth
        expected[feature] += found * (counts(y[rows], m[rows]) * WEIGHTS).sum()
        left = x[rows, feature] <= cut
        first = len(inside)
        inside |= {first: rows[left], first + 1: rows[~left]}
        level |= {first: level[node] + 1, first + 1: level[node] + 1}
    assert len(inside) == len(f) > 10 and importance == pytest.approx(expected)


def table(spark, n=3000):
    rng = np.random.default_rng(2)
    a, b, flag = rng.normal(size=n), rng.integers(0, 5, n), (rng.random(n) < 0.01)
    y = ((a > 0.3) ^ (rng.random(n) < 0.2) | flag).astype(float)
    rows = [(None if i % 50 == 0 else float(v), float(w), float(z), float(t)) for i, (v, w, z, t) in enumerate(zip(a, b, flag, y))]
    return model.with_weights(spark.createDataFrame(rows, "a double, b double, rare double, late double"), "late")


def small(trees=7, **more):
    made = model.forest(["a", "b", "rare"], "late", trees)
    made.getStages()[-1].setParams(**more)
    return made


def scores(fitted, df):
    return sorted((r.a or 0, r.b, r.rare, r.rawPrediction[1], r.probability[1], r.prediction) for r in fitted.transform(df).collect())


def test_scores_are_those_of_the_trees(spark, tmp_path):
    df = table(spark)
    fitted = small().fit(df)
    rf = fitted.stages[-1]
    assert len(rf.cuts[0]) == 31 and rf.cuts[1] == [0.5, 1.5, 2.5, 3.5] and rf.cuts[2] == [0.5]  # a rare value has its bound
    assert rf.getNumTrees() == rf.trees.count() == 7 and sum(rf.featureImportances) == pytest.approx(1)
    trees = [(np.frombuffer(r.f, np.uint8), np.frombuffer(r.b, np.uint8), iter(np.frombuffer(r.p))) for r in rf.trees.collect()]
    plain = []
    for f, b, p in trees:
        shares, k = [next(p) if g == forest.LEAF else None for g in f], np.cumsum(f != forest.LEAF)
        plain.append((f, b, shares, k))
    got = fitted.transform(df).select("raw", "rawPrediction", "probability", "prediction").collect()
    assert len(got) == 3000
    for r in got[::50]:
        total = 0.0
        for f, b, shares, k in plain:
            node = 0
            while f[node] != forest.LEAF:
                bound = rf.cuts[f[node]][b[node]]
                node = 2 * k[node] - (r.raw[int(f[node])] <= bound)
            total += shares[node]
        assert r.rawPrediction[1] == pytest.approx(total) and r.rawPrediction[0] == pytest.approx(7 - total)
        assert r.probability[1] == pytest.approx(total / 7) and r.prediction == float(total > 3.5)
    right = fitted.transform(df).where("late = prediction").count()
    assert right > 2200
    fitted.write().overwrite().save(f"file://{tmp_path}/rf")
    fitted.write().overwrite().save(f"file://{tmp_path}/rf")
    read = PipelineModel.load(f"file://{tmp_path}/rf")
    assert scores(read, df) == scores(fitted, df) and read.stages[-1].featureImportances == rf.featureImportances
    rf.release()


def test_order_and_placement_of_rows_change_nothing(spark):
    df = table(spark).where("a IS NOT NULL")  # the imputer's median is an approximate one
    one, other = small().fit(df), small().fit(df.repartition(7).sortWithinPartitions("b"))
    assert scores(one, df) == scores(other, df)


def test_jobs_do_not_grow_with_depth(spark):
    """Spark's own forest runs at least one job for each level, over all rows."""
    df, jobs = table(spark).persist(), []
    df.count()
    for depth in (1, 30):
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        small(20, maxDepth=depth).fit(df)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth {depth}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_what_it_cannot_grow_is_an_error(spark):
    df = table(spark, 100)
    with pytest.raises(ValueError, match="weight"):
        small().fit(df.withColumn("weight", F.col("b") + 1))
    with pytest.raises(ValueError, match="grows"):
        small(impurity="entropy").fit(df)
    with pytest.raises(ValueError, match="classes 0 and 1"):
        small().fit(df.withColumn("late", F.col("late") + 1))


def test_one_class(spark):
    df = table(spark, 100).where("late = 0")
    fitted = small().fit(df)
    assert fitted.transform(df).where("prediction = 0").count() == df.count()
    assert isinstance(small(), Pipeline) and list(fitted.stages[-1].featureImportances) == [0, 0, 0]


@pytest.mark.parametrize("width", [3, 11])
def test_every_split_of_a_compiled_tree_is_the_best_one(spark, width):
    """Each node sees all features; bins go up to 254, and rows span words."""
    rng = np.random.default_rng(4)
    for bins, depth in ((32, 30), (255, 4)):
        x = rng.integers(0, bins, (600, width)).astype(np.uint8)
        y = ((x[:, width - 1] > bins // 3) ^ (rng.random(600) < 0.3)).astype(np.uint8)
        m = rng.integers(1, 4, 600)
        made = forest.jvm.instance(spark, "Trees.java", "tallyspark.Trees$Grower").set(width, *map(float, WEIGHTS), width, depth, 10, bins, 42, 1, 1)
        f, b, p, importance = map(bytes, made.grown(*(bytearray(a.tobytes()) for a in (x, y, m.astype(np.int32))), 7))
        inside, level, shares, expected = [np.arange(600)], [0], iter(np.frombuffer(p)), np.zeros(width)
        for node, (feature, cut) in enumerate(zip(f, b)):
            rows, at = inside[node], level[node]
            t = counts(y[rows], m[rows])
            best = max(gain_of(x[rows], y[rows], m[rows], g, c) for g in range(width) for c in range(bins - 1))
            if feature == forest.LEAF:
                assert best <= 1e-12 or at == depth
                assert next(shares) == pytest.approx((t * WEIGHTS)[1] / (t * WEIGHTS).sum())
                continue
            assert gain_of(x[rows], y[rows], m[rows], feature, cut) == pytest.approx(best) and at < depth
            expected[feature] += best * (t * WEIGHTS).sum()
            left = x[rows, feature] <= cut
            inside += [rows[left], rows[~left]]
            level += [at + 1, at + 1]
        assert len(inside) == len(f) > 10 and next(shares, None) is None
        assert np.frombuffer(importance) == pytest.approx(expected)


@pytest.mark.parametrize("mean", [1, 3, 100])
def test_bootstrap_is_poisson(spark, mean):
    poisson, rng = forest.jvm.instance(spark, "Trees.java", "tallyspark.Trees$Poisson"), spark._jvm.java.util.SplittableRandom(5)
    n = np.array([poisson.draw(rng, mean) for _ in range(3000)])
    assert n.mean() == pytest.approx(mean, rel=0.08) and n.var() == pytest.approx(mean, rel=0.15)


def test_trees_are_grown_without_python_rows(spark, monkeypatch):
    """A numpy tree over a 1 GB table's rows takes many times as long as the compiled one."""
    monkeypatch.setattr(forest, "grow", None)
    monkeypatch.setattr(forest, "add_shares", None)
    df = table(spark, 300)
    fitted = small(3).fit(df)
    assert fitted.transform(df).count() == 300 and fitted.stages[-1].trees.count() == 3
