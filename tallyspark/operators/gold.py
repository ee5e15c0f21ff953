"""Star-join KPIs: facts are aggregated to the call before they are joined, so no join fans out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import binned, clamp_low, flag_sum, safe_divide, true_or_false
from .silver import CALL_FLAGS, CRANE_FLAGS

#: Delay bins in minutes, and the severity above which a day is a storm.
DELAY_EDGES, DELAY_LABELS = [-30, 30, 120, 360], ["early", "on_time", "minor_delay", "moderate_delay", "major_delay"]
STORM_SEVERITY = 0.5


def cranes_per_call(cranes: DataFrame) -> DataFrame:
    rows = cranes.withColumn("hours", clamp_low(F.col("actual_hours"))).withColumn("dq", flag_sum(*CRANE_FLAGS))
    return rows.groupBy("call_id").agg(
        F.sum("hours").alias("total_crane_hours"),
        F.sum(F.when(~F.col("invalid_crane_time_flag"), F.col("hours")).otherwise(0.0)).alias("valid_crane_hours"),
        F.count_distinct("crane_id").alias("cranes_deployed"),
        F.sum("dq").alias("crane_dq_flags"),
    )


def moves_per_call(moves: DataFrame) -> DataFrame:
    return moves.groupBy("call_id").agg(F.count("*").alias("planned_moves"), F.count_if(F.col("move_status") == "completed").alias("actual_moves"))


def enrich(calls: DataFrame, cranes: DataFrame, moves: DataFrame, weather: DataFrame, terminals: DataFrame) -> DataFrame:
    day = weather.select("terminal_id", F.date_trunc("day", "weather_date").alias("operation_date"), "severity")
    out = (
        calls.withColumn("operation_date", F.date_trunc("day", F.coalesce("ata", "eta")))
        .join(cranes_per_call(cranes), "call_id", "left")
        .join(moves_per_call(moves), "call_id", "left")
        .join(terminals.select("terminal_id", "terminal_name", "crane_count"), "terminal_id", "left")
        .join(day, ["terminal_id", "operation_date"], "left")
    )
    counts = ("crane_dq_flags", "planned_moves", "actual_moves", "cranes_deployed")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})
    return out.withColumns({
        "service_code": F.col("carrier"),
        "storm_flag": true_or_false(F.col("severity") > STORM_SEVERITY),
        "delay_category": binned(F.col("arrival_delay_minutes"), DELAY_EDGES, DELAY_LABELS),
        "moves_per_crane_hour": safe_divide(F.col("actual_moves"), F.col("valid_crane_hours")),
        "total_dq_flags": (flag_sum(*CALL_FLAGS) + F.col("crane_dq_flags")).cast("long"),
    })


def daily_kpis(enriched: DataFrame) -> DataFrame:
    delayed = F.col("arrival_delay_minutes") > 30
    return enriched.dropna(subset=["operation_date"]).groupBy("terminal_id", "operation_date").agg(
        F.max("terminal_name").alias("terminal_name"),
        F.count("*").alias("vessel_calls"),
        F.avg("arrival_delay_minutes").alias("avg_arrival_delay_minutes"),
        F.avg("departure_delay_minutes").alias("avg_departure_delay_minutes"),
        F.count_if(delayed).alias("delayed_calls"),
        (100.0 * F.count_if(delayed) / F.count("*")).alias("pct_delayed"),
        F.sum("actual_moves").alias("total_moves"),
        F.sum("total_crane_hours").alias("total_crane_hours"),
        F.sum("valid_crane_hours").alias("crane_hours"),
        safe_divide(F.sum("actual_moves"), F.sum("valid_crane_hours")).alias("moves_per_crane_hour"),
        F.max(F.col("storm_flag").cast("int")).alias("storm_day"),
        F.sum("total_dq_flags").alias("dq_flags"),
    )


def kpi_contract(kpis: DataFrame) -> DataFrame:
    """The daily KPIs under their published names, in their order and rounded."""
    return kpis.select(
        "operation_date",
        "terminal_id",
        "terminal_name",
        "vessel_calls",
        F.round("avg_arrival_delay_minutes", 1).alias("avg_arrival_delay_minutes"),
        F.round("avg_departure_delay_minutes", 1).alias("avg_departure_delay_minutes"),
        F.round("pct_delayed", 2).alias("delayed_vessel_percentage"),
        F.col("total_moves").alias("total_container_moves"),
        F.round("total_crane_hours", 2).alias("total_crane_hours"),
        F.round("moves_per_crane_hour", 2).alias("avg_moves_per_crane_hour"),
        F.round("crane_hours", 2).alias("crane_utilization_hours"),
        F.col("dq_flags").alias("data_quality_issue_count"),
        F.col("storm_day").alias("storm_days_count"),
    )


SUMMARY = [
    "call_id", "vessel_id", "terminal_id", "terminal_name", "service_code", "vessel_class", "operation_date", "arrival_delay_minutes",
    "departure_delay_minutes", "delay_category", "planned_moves", "actual_moves", "total_crane_hours", "cranes_deployed", "storm_flag", "total_dq_flags",
]


def call_summary(enriched: DataFrame) -> DataFrame:
    return enriched.select(*SUMMARY)
