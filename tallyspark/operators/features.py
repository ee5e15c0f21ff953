"""Feature table for the delay model: only what is known before a call arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import iso_weekday, ordinal, safe_divide, true_or_false
from ..functions.timing import minutes, night
from . import pit

#: Vocabularies in the order of their codes, and the label's threshold in minutes.
TERMINALS = ["T0", "T1", "T2", "T3", "T4"]
CARRIERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DELAYED_MINUTES = 120

FEATURES = [
    "planned_cranes", "planned_crane_hours", "planned_moves", "vessel_capacity", "day_of_week", "month", "is_weekend", "storm_flag",
    "avg_previous_10_terminal", "avg_previous_10_service", "previous_vessel_delay", "congestion_score", "terminal_code", "carrier_code",
]


Hold = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


def candidates(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("eta").isNotNull() & ~F.col("invalid_arrival_sequence_flag"))


def planned_scope(df: DataFrame, cranes: DataFrame, moves: DataFrame) -> DataFrame:
    scope = cranes.groupBy("call_id").agg(F.count_distinct("crane_id").alias("planned_cranes"), F.sum("planned_hours").alias("planned_crane_hours"))
    planned = moves.groupBy("call_id").agg(F.count("*").alias("planned_moves"))
    out = df.join(scope, "call_id", "left").join(planned, "call_id", "left").fillna(0, ["planned_moves"]).withColumn("vessel_capacity", F.col("planned_teu").cast("double"))
    return out.withColumn("planned_cranes", F.coalesce("planned_cranes", F.lit(0)).cast("long")).withColumn("planned_crane_hours", F.coalesce("planned_crane_hours", F.lit(0.0)))


def temporal(df: DataFrame) -> DataFrame:
    return df.withColumns({"day_of_week": F.weekday("eta"), "month": F.month("eta"), "is_weekend": (F.weekday("eta") >= 5).cast("int")})


def storm(df: DataFrame, weather: DataFrame) -> DataFrame:
    day = weather.select("terminal_id", F.date_trunc("day", "weather_date").alias("_day"), "severity")
    out = df.withColumn("_day", F.date_trunc("day", "eta")).join(day, ["terminal_id", "_day"], "left")
    return out.withColumn("storm_flag", true_or_false(F.col("severity") > 0.5).cast("int")).drop("_day", "severity")


def history(df: DataFrame, calls: DataFrame, hold: Hold = as_is) -> DataFrame:
    past = calls.where(F.col("atd").isNotNull() & (F.col("status") == "completed"))
    args = ("call_id", "eta", "atd", "delay_hours")
    df = hold(df.join(pit.rolling_mean(df, past, "terminal_id", *args).withColumnRenamed("rolling_mean", "avg_previous_10_terminal"), "call_id", "left"))
    df = hold(df.join(pit.rolling_mean(df, past, "carrier", *args).withColumnRenamed("rolling_mean", "avg_previous_10_service"), "call_id", "left"))
    return hold(df.join(pit.most_recent(df, past, "vessel_id", *args).withColumnRenamed("most_recent", "previous_vessel_delay"), "call_id", "left"))


def congestion(df: DataFrame, calls: DataFrame) -> DataFrame:
    n = pit.stabbing_count(calls, "terminal_id", "call_id", "eta", "etd").withColumnRenamed("n", "congestion_score")
    return df.join(n, "call_id", "left").withColumn("congestion_score", F.coalesce("congestion_score", F.lit(0)).cast("long"))


def encoded(df: DataFrame) -> DataFrame:
    return df.withColumns({"terminal_code": ordinal(F.col("terminal_id"), TERMINALS), "carrier_code": ordinal(F.col("carrier"), CARRIERS)})


def target(df: DataFrame) -> DataFrame:
    late = F.col("arrival_delay_minutes") > DELAYED_MINUTES
    return df.withColumn("is_delayed", F.when(F.col("arrival_delay_minutes").isNotNull(), late.cast("double")))


def feature_table(calls: DataFrame, cranes: DataFrame, moves: DataFrame, weather: DataFrame, hold: Hold = as_is) -> DataFrame:
    """hold gets the table as it grows, and may write it and read it again to keep plans small."""
    out = hold(storm(temporal(planned_scope(candidates(calls), cranes, moves)), weather))
    out = target(encoded(congestion(history(out, calls, hold), calls)))
    return out.select("call_id", "eta", "terminal_id", "carrier", *FEATURES, "is_delayed")


def described(df: DataFrame) -> DataFrame:
    """Count, mean and deviation of every feature, from one aggregate."""
    stats = lambda f: F.struct(F.lit(f).alias("feature"), F.count(f).alias("n"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("std"))
    return df.agg(F.array(*map(stats, FEATURES)).alias("rows")).select(F.inline("rows"))


#: More days than any history spans.
ALL_DAYS = 36_500
LATE_HOURS = 0.5


def past_rates(df: DataFrame, past: DataFrame, group: str, days: int, name: str) -> DataFrame:
    """For each call with history: how many calls of its group departed in the days before its eta, the share of late ones, mean delay and mean stay."""
    late = F.when(F.col("delay_hours") > LATE_HOURS, 1.0).otherwise(0.0)
    values = {"late": late, "delay": F.col("delay_hours"), "stay": minutes(F.col("ata"), F.col("atd"))}
    found = pit.look_back(df, past, group, "call_id", "eta", "atd", days, **values)
    return found.select(
        "call_id",
        F.col("n_past").alias(f"{name}_calls"),
        (F.col("late") / F.col("n_past")).alias(f"{name}_delay_rate"),
        safe_divide(F.col("delay"), F.col("delay_n")).alias(f"{name}_avg_delay_h"),
        (safe_divide(F.col("stay"), F.col("stay_n")) / 60).alias(f"{name}_avg_turnaround_h"),
    )


def history_table(calls: DataFrame, weather: DataFrame) -> DataFrame:
    """The second feature table: rates of the vessel's whole history and of the terminal's last 90 days, other calls in port, weather, calendar, label.

    Where history lacks, counts and rates are 0 and a stay is the planned one.
    """
    df, past = candidates(calls), calls.where(F.col("atd").isNotNull())
    in_port = pit.stabbing_count(calls, "terminal_id", "call_id", "eta", "atd").withColumnRenamed("n", "concurrent_calls")
    day = weather.select("terminal_id", F.date_trunc("day", "weather_date").alias("_day"), F.col("severity").alias("weather_severity"))
    out = df.withColumn("_day", F.date_trunc("day", "eta")).join(day, ["terminal_id", "_day"], "left").drop("_day")
    for more in (past_rates(df, past, "vessel_id", ALL_DAYS, "vessel"), past_rates(df, past, "terminal_id", 90, "terminal"), in_port):
        out = out.join(more, "call_id", "left")
    zero = ["vessel_calls", "vessel_delay_rate", "vessel_avg_delay_h", "terminal_calls", "terminal_delay_rate", "concurrent_calls", "weather_severity"]
    out = out.fillna(0, zero).withColumns({f"{g}_avg_turnaround_h": F.coalesce(f"{g}_avg_turnaround_h", "planned_turnaround_hours") for g in ("vessel", "terminal")})
    eta, late = F.col("eta"), F.col("delay_hours") > LATE_HOURS
    return out.select(
        "call_id", "eta", "vessel_class", "carrier", "planned_turnaround_hours", *zero[:3], "vessel_avg_turnaround_h", *zero[3:5], "terminal_avg_turnaround_h", *zero[5:],
        (F.col("weather_severity") > 0.5).cast("int").alias("storm_at_eta"), F.month(eta).alias("eta_month"), iso_weekday(eta).alias("eta_dow"), F.hour(eta).alias("eta_hour"),
        (F.weekday(eta) >= 5).cast("int").alias("is_weekend"), night(eta).cast("int").alias("is_night_arrival"), F.when(F.col("atd").isNotNull(), true_or_false(late).cast("int")).alias("is_delayed"),
    )


def severity_before(calls: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather at each call's eta, and the severity in the row before it among its terminal's joined rows by (day, call).

    That row is another call of the same day, or else of the last day with a
    call, so a window within the day and one over the days take the place of
    one over all rows of the terminal.
    """
    day = weather.select("terminal_id", F.date_trunc("day", "weather_date").alias("day"), "severity")
    met = candidates(calls).withColumn("day", F.date_trunc("day", "eta")).join(day, ["terminal_id", "day"], "left")
    days = met.groupBy("terminal_id", "day").agg(F.max("severity").alias("s")).where(F.col("s").isNotNull())
    days = days.select("terminal_id", "day", F.lag("s").over(Window.partitionBy("terminal_id").orderBy("day")).alias("last_day"))
    nth = F.row_number().over(Window.partitionBy("terminal_id", "day").orderBy("call_id"))
    before = F.when(F.col("nth") > 1, F.col("severity")).otherwise(F.col("last_day"))
    out = met.withColumn("nth", nth).join(days, ["terminal_id", "day"], "left")
    return out.select("call_id", "severity", (F.col("severity") > 0.5).alias("storm_at_eta"), before.alias("previous_severity"))
