"""Point-in-time joins against their literal form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import features, model, pit

START = datetime(2024, 1, 1)


def rows(seed, n=160):
    rng = random.Random(seed)
    when = lambda: START + timedelta(hours=rng.randint(0, 400))
    return [(i, rng.choice("ab"), when(), when() if rng.random() > 0.1 else None, rng.choice([None, float(rng.randint(-5, 9))])) for i in range(n)]


SCHEMA = "k long, g string, eta timestamp_ntz, atd timestamp_ntz, v double"


@pytest.mark.parametrize("seed", [1, 2])
def test_newest_before(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    mean = {r.k: r.rolling_mean for r in pit.rolling_mean(df, df, "g", "k", "eta", "atd", "v", 10).collect()}
    last = {r.k: r.most_recent for r in pit.most_recent(df, df, "g", "k", "eta", "atd", "v").collect()}
    for k, g, eta, _, _ in data:
        past = sorted((p for p in data if p[1] == g and p[3] and p[3] < eta and p[0] != k), key=lambda p: (-(p[3] - START).total_seconds(), p[0]))[:10]
        known = [p[4] for p in past if p[4] is not None]
        assert (k in mean) == (k in last) == bool(past)
        assert mean.get(k) == (pytest.approx(sum(known) / len(known)) if known else None)
        assert last.get(k) == (past[0][4] if past else None)


def test_look_back(spark):
    data = rows(3)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.k: r.n_past for r in pit.look_back(df.select("k", "g", "eta"), df.select("k", "g", "atd", "v"), "g", "k", "eta", "atd", 3).collect()}
    for k, g, eta, _, _ in data:
        assert got.get(k, 0) == sum(1 for p in data if p[1] == g and p[0] != k and p[3] and eta - timedelta(days=3) <= p[3] < eta)


def test_stabbing(spark):
    data = [(k, g, e, (e + timedelta(hours=(k * 7) % 30 - 3)) if k % 9 else None, v) for k, g, e, _, v in rows(4)]
    got = {r.k: r.n for r in pit.stabbing_count(spark.createDataFrame(data, SCHEMA), "g", "k", "eta", "atd").collect()}
    for k, g, eta, _, _ in data:
        assert got[k] == sum(1 for o in data if o[1] == g and o[0] != k and o[3] and o[3] >= o[2] and o[2] <= eta <= o[3])


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_time_split(spark, share):
    df = spark.createDataFrame(rows(5), SCHEMA)
    train, test, info = model.time_split(df, "eta", "k", share)
    a, b = [(r.eta, r.k) for r in train.collect()], [(r.eta, r.k) for r in test.collect()]
    assert len(a) == info["n_train"] == int(160 * (1 - share)) and len(a) + len(b) == 160 and max(a) < min(b)


def test_no_feature_tells_the_outcome():
    assert not {"ata", "atd", "delay_hours", "arrival_delay_minutes", "actual_teu", "call_id", "is_delayed"} & set(features.FEATURES)


def test_target(spark):
    df = spark.createDataFrame([(119.0,), (120.0,), (121.0,), (None,), (-30.0,)], "arrival_delay_minutes double")
    assert [r.is_delayed for r in features.target(df).collect()] == [0.0, 0.0, 1.0, None, 0.0]


def test_running_totals_across_bins(spark):
    day = 86400 * 1_000_000
    rows = [("a", t * 17 * day, t % 2, 1.0 + t) for t in range(12)] + [("b", 5 * day, 0, 7.0)]
    df = spark.createDataFrame(rows, "g string, t long, tie int, v double")
    got = {(r.g, r.t): r.v for r in pit.running(df, "g", "t", "tie", "v").collect()}
    total = 0.0
    for _, t, _, v in rows[:12]:
        total += v
        assert got["a", t] == total
    assert got["b", 5 * day] == 7.0


def test_look_back_takes_itself_off(spark):
    calls = spark.sql(
        """SELECT * FROM VALUES (1, 'a', TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-02', 3D), (2, 'a', TIMESTAMP_NTZ'2024-02-01', TIMESTAMP_NTZ'2024-01-15', 5D),
        (3, 'a', TIMESTAMP_NTZ'2024-04-01', TIMESTAMP_NTZ'2024-04-03', NULL), (4, 'b', TIMESTAMP_NTZ'2024-02-01', TIMESTAMP_NTZ'2024-02-02', 1D) AS t(k, g, at, done, v)"""
    )
    got = {r.k: (r.n_past, r.v, r.v_n) for r in pit.look_back(calls, calls, "g", "k", "at", "done", 90, v=F.col("v")).collect()}
    assert got == {2: (1, 3.0, 1), 3: (2, 8.0, 2)}


def test_newest_across_runs(spark, monkeypatch):
    monkeypatch.setattr(pit, "RUN", 12)
    test_newest_before(spark, 3)


def test_newest_does_not_multiply_candidates(spark):
    df = spark.createDataFrame(rows(1), SCHEMA)
    plan = pit.rolling_mean(df, df, "g", "k", "eta", "atd", "v", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan  # a row for each of the last ten


def test_split_ranks_one_day_only(spark):
    df = spark.createDataFrame(rows(5), SCHEMA)
    for part in model.time_split(df, "eta", "k")[:2]:
        lines = part._jdf.queryExecution().optimizedPlan().toString().split("\n")
        at = next(i for i, line in enumerate(lines) if "Window" in line)
        assert any("Filter" in line and " = " in line for line in lines[at:])
