from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalar, timing
from tallyspark.operators import checks, gold, silver

T = "call_id string, eta timestamp_ntz, ata timestamp_ntz, etd timestamp_ntz, atd timestamp_ntz, delay_hours double, created_at timestamp_ntz"


def at(day, hour, minute=0):
    return D(2024, 6, day, hour, minute)


def call(i="VC001", eta=at(1, 8), ata=at(1, 10), etd=at(2, 8), atd=at(2, 10), delay=2.0, created=at(1, 6)):
    return (i, eta, ata, etd, atd, delay, created)


@pytest.mark.parametrize(("ata", "minutes"), [(at(1, 9, 30), 90.0), (at(1, 7, 30), -30.0), (at(1, 8), 0.0), (None, None)])
def test_delays(spark, ata, minutes):
    assert silver.with_delays(spark.createDataFrame([call(ata=ata)], T)).first()["arrival_delay_minutes"] == minutes


def test_newest_record_survives(spark):
    df = spark.createDataFrame([call(delay=1.0), call(delay=9.0, created=at(1, 12)), call("VC002", created=None), call("VC002", delay=3.0)], T)
    assert {r.call_id: r.delay_hours for r in silver.latest_record(df, "call_id", "created_at").collect()} == {"VC001": 9.0, "VC002": 3.0}


def test_call_flags(spark):
    rows = [call("a", eta=None), call("b", ata=None), call("c", ata=at(3, 0)), call("d", etd=at(1, 7)), call("e", delay=500.0), call("f", delay=None)]
    got = {r.call_id: r for r in silver.with_call_flags(spark.createDataFrame(rows, T)).collect()}
    assert got["a"].missing_eta_flag and got["b"].missing_ata_flag and got["c"].invalid_arrival_sequence_flag
    assert got["d"].invalid_departure_sequence_flag and got["e"].large_delay_outlier_flag
    assert not any(got["f"][f] for f in silver.CALL_FLAGS)


def test_fence_without_positive_values_is_24(spark):
    assert silver.tukey_fence(spark.createDataFrame([(-1.0,), (None,)], "v double"), "v").first()["fence"] == 24.0


@pytest.mark.parametrize(
    ("spans", "flags"),
    [
        ([("c", 8, 16), ("c", 12, 20)], [True, True]),
        ([("c", 8, 16), ("c", 16, 20)], [False, False]),
        ([("c", 8, 16), ("d", 12, 20)], [False, False]),
        ([("c", 1, 20), ("c", 2, 3), ("c", 15, 22)], [True, True, True]),
        ([("c", 8, 16), ("c", 12, 9), (None, 8, 20), (None, 9, 20), ("c", None, 9)], [False] * 5),
    ],
)
def test_overlaps(spark, spans, flags):
    rows = [(k, c, s if s is None else at(1, s), e if e is None else at(1, e)) for k, (c, s, e) in enumerate(spans)]
    df = spark.createDataFrame(rows, "k long, c string, s timestamp_ntz, e timestamp_ntz")
    got = silver.overlaps(df, "c", "s", "e", "k").orderBy("k").collect()
    assert [r.crane_overlap_flag for r in got] == flags and "_valid" not in got[0].asDict()


def test_clean_moves(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (5.0, 1.0), (-3.0, 1.0), (0.0, 2.0), (None, 1.0)], "actual_minutes double, planned_minutes double")
    assert [(r.actual_minutes, r.variance_minutes) for r in silver.clean_moves(df).collect()] == [(None, None), (5.0, 4.0), (None, None), (0.0, -2.0), (None, None)]


def test_bins_and_codes(spark):
    df = spark.createDataFrame([(-30.0, "b"), (30.0, "x"), (120.0, None), (360.0, "a"), (361.0, "a"), (None, "a")], "x double, k string")
    got = df.select(scalar.binned(F.col("x"), gold.DELAY_EDGES, gold.DELAY_LABELS).alias("b"), scalar.ordinal(F.col("k"), ["a", "b"]).alias("c")).collect()
    assert [r.b for r in got] == ["early", "on_time", "minor_delay", "moderate_delay", "major_delay", None]
    assert [r.c for r in got] == [1, -1, -1, 0, 0, 0]


def test_boundaries_count_borders(spark):
    df = spark.createDataFrame([(at(1, 7, 59), at(1, 8, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(timing.boundaries("hour", F.col("a"), F.col("b")).alias("n")).first()["n"] == 1


def test_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(scalar.safe_divide(F.col("a"), F.col("b"))).collect()] == [None, 0.5, None]


@pytest.mark.parametrize(("n_bad", "status"), [(0, "PASS"), (5, "PASS"), (6, "WARN"), (15, "WARN"), (16, "FAIL")])
def test_grades_are_strict(spark, n_bad, status):
    df = spark.range(100).withColumn("bad", F.col("id") < n_bad)
    r = checks.rate_checks(df, [("x", F.col("bad"), 5, 15, True)]).first()
    assert (r.n, r.status) == (n_bad, status)


def test_duplicates_and_orphans_fail(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    assert checks.duplicate_check(df, "d", "k").first()["status"] == "FAIL"
    assert checks.duplicate_check(df.distinct(), "d", "k").first()["status"] == "PASS"
    assert checks.orphan_check(df, df.where("k = 2"), "o", "k").first()["n"] == 2
    doc = checks.report_document(checks.report(checks.duplicate_check(df, "d", "k"), checks.orphan_check(df, df, "o", "k")))
    assert doc["overall_status"] == "FAIL" and doc["summary"] == {"total_checks": 2, "passed": 1, "warned": 0, "failed": 1}
