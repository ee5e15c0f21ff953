"""Cleaning: latest record wins, delays, flags that mark and never drop, interval overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import true_or_false
from ..functions.timing import hours, minutes

#: The least outlier fence in hours, and the fence's factor.
LEAST_FENCE_HOURS, FENCE_FACTOR = 24.0, 1.5


def latest_record(df: DataFrame, key: str, *newest_first: str) -> DataFrame:
    """One row for each key: the greatest by the given columns, NULLs last."""
    order = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in newest_first))
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def duplicate_audit(df: DataFrame, key: str, created: str) -> DataFrame:
    """Keys that occur more than once, with the lag between their records."""
    found = df.groupBy(key).agg(F.count("*").alias("n_records"), F.min(created).alias("first_created"), F.max(created).alias("last_created")).where("n_records > 1")
    lag = hours(F.col("first_created"), F.col("last_created"))
    kind = F.when(lag == 0, "exact").when(lag <= 24, "retransmission").otherwise("late_update")
    return found.withColumn("lag_hours", lag).withColumn("duplicate_class", kind)


def with_delays(df: DataFrame) -> DataFrame:
    return df.withColumns({"arrival_delay_minutes": minutes(F.col("eta"), F.col("ata")), "departure_delay_minutes": minutes(F.col("etd"), F.col("atd"))})


def tukey_fence(df: DataFrame, value: str) -> DataFrame:
    """One row, `fence`: Q3 + 1.5 IQR of the positive values, 24 at least, 24 if there are none."""
    q = F.percentile(F.when(F.col(value) > 0, F.col(value)), F.array(F.lit(0.25), F.lit(0.75)))
    return df.agg(q.alias("q")).select(F.greatest(F.lit(LEAST_FENCE_HOURS), F.get("q", 1) + FENCE_FACTOR * (F.get("q", 1) - F.get("q", 0))).alias("fence"))


def with_call_flags(df: DataFrame) -> DataFrame:
    flags = {
        "missing_eta_flag": F.col("eta").isNull(),
        "missing_ata_flag": F.col("ata").isNull(),
        "invalid_arrival_sequence_flag": true_or_false(F.col("ata") > F.col("atd")),
        "invalid_departure_sequence_flag": true_or_false(F.col("etd") < F.col("eta")),
        "large_delay_outlier_flag": true_or_false(F.col("delay_hours") > F.col("fence")),
    }
    return df.crossJoin(F.broadcast(tukey_fence(df, "delay_hours"))).withColumns(flags).drop("fence")  # the fence is one row


CALL_FLAGS = ("missing_eta_flag", "missing_ata_flag", "invalid_arrival_sequence_flag", "invalid_departure_sequence_flag", "large_delay_outlier_flag")
CRANE_FLAGS = ("missing_crane_id_flag", "invalid_crane_time_flag", "crane_overlap_flag")


def silver_calls(bronze: DataFrame) -> DataFrame:
    return with_call_flags(with_delays(latest_record(bronze, "call_id", "created_at")))


def invalid_interval(start: Column, end: Column) -> Column:
    return start.isNull() | end.isNull() | (end < start)


def overlaps(df: DataFrame, group: str, start: str, end: str, key: str) -> DataFrame:
    """Adds crane_overlap_flag: a valid interval that meets another of its group in more than an end point.

    An interval overlaps when it starts before the running greatest end of all
    earlier ones, or ends after the next one starts; one sort a group.
    Intervals that aren't valid, or without a group, are never flagged.
    """
    valid = ~invalid_interval(F.col(start), F.col(end)) & F.col(group).isNotNull()
    # rows that can't overlap are spread by key, not sent to one task
    spread = F.when(valid, F.col(group)).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64(key), F.lit(997)).cast("string")))
    named = df.withColumn("_valid", valid).withColumn("_group", spread)
    order = Window.partitionBy("_group", "_valid").orderBy(start, end, key)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(start).over(order)
    flag = F.col("_valid") & (true_or_false(F.col(start) < before) | true_or_false(F.col(end) > after))
    return named.withColumn("crane_overlap_flag", flag).drop("_valid", "_group")


def silver_cranes(cranes: DataFrame) -> DataFrame:
    out = cranes.withColumn("actual_hours", hours(F.col("actual_start"), F.col("actual_end")))
    out = out.withColumns({"missing_crane_id_flag": F.col("crane_id").isNull(), "invalid_crane_time_flag": invalid_interval(F.col("actual_start"), F.col("actual_end"))})
    return overlaps(out, "crane_id", "actual_start", "actual_end", "assignment_id")


def clean_moves(moves: DataFrame) -> DataFrame:
    """Negative durations become NULL, zero stays; the variance is taken after that."""
    out = moves.withColumn("actual_minutes", F.when(F.col("actual_minutes") >= 0, F.col("actual_minutes")))
    return out.withColumn("variance_minutes", F.col("actual_minutes") - F.col("planned_minutes"))
