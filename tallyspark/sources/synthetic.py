"""Raw tables of a port, made up from a seed, with the dirt that ingestion and cleaning must handle.

Every value is a function of the seed and its row's number, by hashes, so a
table is the same however its rows are dealt, and grows without a driver loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .bronze import SCHEMAS

#: Shares of rows with each kind of dirt.
DIRT = {
    "no_eta": 0.015, "no_ata": 0.010, "ata_after_atd": 0.005, "duplicate": 0.010, "late_update": 0.008,
    "crane_overlap": 0.020, "no_crane_times": 0.015, "crane_inverted": 0.005, "no_move_time": 0.020, "negative_duration": 0.003,
}

#: Class, capacity in TEU and planned stay in hours, both from and to.
CLASSES = [("small", 300, 1000, 8, 18), ("medium", 1000, 5000, 16, 36), ("large", 5000, 15_000, 28, 60), ("giant", 15_000, 24_000, 40, 90)]
#: Id, berths, cranes, the greatest class, moves of a crane in an hour, how much likelier a delay is, share of the traffic.
TERMINALS = [("T0", 6, 12, 3, 28.0, 0.10, 0.35), ("T1", 4, 8, 2, 24.0, 0.05, 0.25), ("T2", 3, 5, 1, 20.0, 0.15, 0.15), ("T3", 3, 4, 1, 18.0, 0.20, 0.10), ("T4", 4, 7, 2, 22.0, 0.08, 0.15)]
CARRIERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REASONS = [("weather", 0.15), ("equipment", 0.30), ("documentation", 0.20), ("congestion", 0.35)]


class Draw:
    """Random columns from a seed, by what they are for and the row's keys."""

    def __init__(self, seed: int):
        self.seed = seed

    def uniform(self, what: str, *keys: str, low: float = 0.0, high: float = 1.0) -> Column:
        share = (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(what), *keys), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return share * (high - low) + low

    def normal(self, what: str, *keys: str, mean: float = 0.0, sd: float = 1.0) -> Column:
        radius = F.sqrt(-2 * F.log(self.uniform(f"{what} radius", *keys)))
        return radius * F.cos(2 * math.pi * self.uniform(f"{what} angle", *keys)) * sd + mean

    def exponential(self, what: str, *keys: str, mean: float = 1.0) -> Column:
        return -F.log(self.uniform(what, *keys)) * mean

    def dirty(self, what: str, *keys: str) -> Column:
        return self.uniform(what, *keys) < DIRT[what]

    def chosen(self, what: str, *keys: str, of: list[tuple]) -> Column:
        """One of the values by their shares."""
        u, total, out = self.uniform(what, *keys), 0.0, F
        for value, share in of[:-1]:
            total += share
            out = out.when(u < total, F.lit(value))
        return out.otherwise(F.lit(of[-1][0]))


def later(at: Column, hours: Column | float) -> Column:
    return F.timestamp_add("SECOND", F.round((hours if isinstance(hours, Column) else F.lit(hours)) * 3600).cast("long"), at)


def _typed(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in the order and types of its contract."""
    return df.select(*(F.col(s.name).cast(s.type).alias(s.name) for s in SCHEMAS[name]))


def terminals(spark: SparkSession) -> DataFrame:
    rows = [(i, f"Terminal {i[1:]}", berths, cranes, CLASSES[top][0], rate, bias, 51.0 + n / 100, n / 100) for n, (i, berths, cranes, top, rate, bias, _) in enumerate(TERMINALS)]
    return spark.createDataFrame(rows, ", ".join(f"{s.name} {s.type}" for s in SCHEMAS["terminal_metadata"]))


def weather(spark: SparkSession, start: str, end: str, seed: int = 42) -> DataFrame:
    """A row for each terminal and day: a yearly wave with its top in January, and storms."""
    draw, keys = Draw(seed), ("terminal_id", "weather_date")
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    df = terminals(spark).select("terminal_id", days.alias("day")).withColumn("weather_date", F.col("day").cast("timestamp_ntz"))
    winter = 1 + 0.5 * F.cos(math.pi / 6 * (F.month("day") - 1))
    storm = F.when(draw.uniform("storm", *keys) < 0.05, draw.uniform("gale", *keys, low=2.0, high=3.5)).otherwise(1.0)
    df = df.withColumn("wind_speed_knots", F.least(draw.uniform("wind", *keys, low=5, high=15) * winter * storm, F.lit(65.0)))
    df = df.withColumns({
        "visibility_nm": F.greatest(draw.uniform("visibility", *keys, low=3, high=12) / winter, F.lit(0.5)),
        "wave_height_m": F.greatest(F.col("wind_speed_knots") * draw.uniform("wave", *keys, low=0.05, high=0.12), F.lit(0.1)),
        "precipitation_mm": F.greatest(draw.normal("rain", *keys, mean=2, sd=3) * winter, F.lit(0.0)),
    })
    rough = 0.45 * F.col("wind_speed_knots") / 65 + 0.3 * (1 - F.least("visibility_nm", F.lit(10.0)) / 10) + 0.25 * F.least("wave_height_m", F.lit(6.0)) / 6
    df = df.withColumn("severity_index", F.round(F.least(rough, F.lit(1.0)), 4))
    return _typed(df.withColumn("weather_impact_factor", F.round(1 + F.col("severity_index") * draw.uniform("impact", *keys, low=0.5, high=1.5), 4)), "weather_daily")


def vessel_calls(spark: SparkSession, sky: DataFrame, start: str, end: str, n: int = 2000, vessels: int = 100, seed: int = 42) -> DataFrame:
    """Calls with missing and reversed times, records sent twice, and late updates."""
    draw, i, v = Draw(seed), "id", "vessel"
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    per_terminal = lambda k: F.element_at(F.create_map(*(F.lit(x) for t in TERMINALS for x in (t[0], t[k]))), F.col("terminal_id"))
    per_class = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in CLASSES)), F.col("kind") + 1)
    df = spark.range(n).withColumn("terminal_id", draw.chosen("terminal", i, of=[(t[0], t[6]) for t in TERMINALS]))
    # vessels are numbered so that the remainder by the number of classes is the class
    df = df.withColumn("kind", F.floor(draw.uniform("kind", i) * (per_terminal(3) + 1)).cast("int"))
    df = df.withColumn(v, F.floor(draw.uniform("vessel", i) * max(vessels // len(CLASSES), 1)).cast("int") * len(CLASSES) + F.col("kind"))
    quarter_hours = F.floor(draw.uniform("eta", i) * days * 96)
    df = df.withColumn("eta", later(F.lit(start).cast("timestamp_ntz"), quarter_hours / 4))
    df = df.join(sky.select("terminal_id", F.to_date("weather_date").alias("day"), "weather_impact_factor"), [df.terminal_id == sky.terminal_id, F.to_date("eta") == F.col("day")], "left").drop(sky.terminal_id)
    impact = F.coalesce("weather_impact_factor", F.lit(1.0))
    likely = F.least(0.3 + per_terminal(5) + 0.4 * F.greatest(impact - 1.3, F.lit(0.0)), F.lit(0.9))
    delayed = draw.uniform("delayed", i) < likely
    reason = F.when(draw.uniform("stormy", i) < F.greatest(impact - 1.3, F.lit(0.0)), "weather").otherwise(draw.chosen("reason", i, of=REASONS))
    df = df.withColumns({
        "weather_impact_factor": impact,
        "delay_reason": F.when(delayed, reason).otherwise("none"),
        "planned_turnaround_hours": F.round(per_class(3) + draw.uniform("stay", i) * (per_class(4) - per_class(3)), 2),
        "ata": later(F.col("eta"), draw.normal("arrival", i, mean=0.5, sd=2.5)),
        "capacity": F.floor(per_class(1) + draw.uniform("capacity", v) * (per_class(2) - per_class(1))),
    })
    hours = 0.5 + draw.exponential("delay", i, mean=4.0) * F.when(F.col("delay_reason") == "weather", impact).otherwise(1.0)
    df = df.withColumn("delay_hours", F.when(F.col("delay_reason") == "none", 0.0).otherwise(F.round(hours, 2)))
    df = df.withColumn("actual_turnaround_hours", F.round(F.col("planned_turnaround_hours") + F.col("delay_hours"), 2))
    df = df.withColumn("planned_cargo_teu", F.floor(F.col("capacity") * draw.uniform("fill", i, low=0.55, high=0.98)))
    gone = draw.dirty("no_ata", i)
    atd = later(F.col("ata"), F.col("actual_turnaround_hours"))
    df = df.withColumns({
        "vessel_call_id": F.format_string("VC%06d", F.col("id") + 1), "vessel_id": F.format_string("V%05d", v), "vessel_name": F.format_string("Vessel %d", v),
        "vessel_class": per_class(0), "carrier_code": draw.chosen("carrier", v, of=[(c, 1 / len(CARRIERS)) for c in CARRIERS]),
        "berth_id": F.format_string("%s-B%02d", "terminal_id", F.floor(draw.uniform("berth", i) * per_terminal(1)).cast("int") + 1),
        "etd": later(F.col("eta"), F.col("planned_turnaround_hours")), "atd": F.when(~gone, atd), "actual_cargo_teu": F.floor(F.col("planned_cargo_teu") * draw.uniform("loaded", i, low=0.92, high=1.05)),
        "status": F.when(gone, "in_progress").otherwise("completed"),
        "record_created_at": F.when(draw.dirty("late_update", i) & ~gone, later(atd, draw.uniform("updated", i, low=24, high=72))).otherwise(later(F.col("ata"), draw.uniform("created", i, high=2))),
    })
    df = df.withColumns({
        "ata": F.when(~gone, F.when(draw.dirty("ata_after_atd", i), later(F.col("atd"), 1)).otherwise(F.col("ata"))),
        "eta": F.when(~draw.dirty("no_eta", i), F.col("eta")),
    })
    again = df.where(draw.dirty("duplicate", i)).withColumn("record_created_at", later(F.col("record_created_at"), draw.uniform("again", i, low=1, high=48)))
    return _typed(df.unionByName(again), "vessel_calls")


def crane_assignments(calls: DataFrame, seed: int = 42, most: int = 7) -> DataFrame:
    """One to `most` assignments for each record of a call that arrived, with shifted, missing and reversed times."""
    draw, keys = Draw(seed), ("vessel_call_id", "record_created_at", "k")
    cranes = F.element_at(F.create_map(*(F.lit(x) for t in TERMINALS for x in (t[0], t[2]))), F.col("terminal_id"))
    rate = F.element_at(F.create_map(*(F.lit(x) for t in TERMINALS for x in (t[0], t[4]))), F.col("terminal_id"))
    n = F.floor(draw.uniform("cranes", *keys[:2]) * F.least(F.lit(most), cranes)).cast("int") + 1
    df = calls.where("ata IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    stay = F.greatest(F.timestamp_diff("SECOND", F.col("ata"), F.coalesce("atd", later(F.col("ata"), 24))) / 3600, F.lit(0.5))
    df = df.withColumn("planned_start", later(F.col("ata"), draw.uniform("start", *keys) * stay * 0.5)).withColumn("planned_hours", F.round(2 + draw.uniform("hours", *keys) * F.least(stay / 2, F.lit(10.0)), 2))
    df = df.withColumn("actual_hours", F.round(F.col("planned_hours") * draw.uniform("pace", *keys, low=0.85, high=1.2), 2))
    begun = later(F.col("planned_start"), draw.normal("begun", *keys, mean=0.2, sd=0.5))
    df = df.withColumn("begun", begun).withColumn("ended", later(F.col("begun"), F.col("actual_hours")))
    df = df.withColumn("begun", F.when(draw.dirty("crane_overlap", *keys), later(F.col("begun"), -2)).otherwise(F.col("begun")))
    known = ~draw.dirty("no_crane_times", *keys)
    return _typed(df.withColumns({
        "assignment_id": F.concat(F.lit("CA-"), F.lower(F.hex(F.xxhash64(*keys)))),
        "crane_id": F.format_string("%s-C%02d", "terminal_id", F.floor(draw.uniform("crane", *keys) * cranes).cast("int") + 1),
        "planned_end": later(F.col("planned_start"), F.col("planned_hours")),
        "actual_start": F.when(known, F.col("begun")),
        "actual_end": F.when(known, F.when(draw.dirty("crane_inverted", *keys), later(F.col("begun"), -1)).otherwise(F.col("ended"))),
        "productivity_moves_per_hour": F.round(rate * draw.uniform("rate", *keys, low=0.8, high=1.15), 1),
        "status": F.lit("completed"),
    }), "crane_assignments")


def container_moves(assignments: DataFrame, seed: int = 42, mean: int = 13) -> DataFrame:
    """About `mean` moves for each assignment that began, some cancelled or put off, with missing times and negative durations."""
    draw, keys = Draw(seed), ("assignment_id", "k")
    df = assignments.where("actual_start IS NOT NULL").withColumn("n", F.floor(draw.uniform("moves", "assignment_id") * 11).cast("int") + max(mean - 5, 1))
    df = df.withColumn("done", F.floor(F.col("n") * draw.uniform("scope", "assignment_id", low=0.9, high=1.08))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    span = F.greatest(F.timestamp_diff("SECOND", F.col("actual_start"), F.col("actual_end")), F.lit(60)) / 3600
    df = df.withColumn("container_type", draw.chosen("type", *keys, of=[("dry", 0.75), ("reefer", 0.15), ("hazmat", 0.07), ("oog", 0.03)]))
    df = df.withColumn("at", F.col("k") * span / F.col("n"))
    slow = F.when(F.col("container_type") == "hazmat", 1.5).when(F.col("container_type") == "oog", 2.0).otherwise(1.0)
    df = df.withColumn("planned_duration_minutes", F.round(draw.uniform("planned", *keys, low=2, high=6) * slow, 2))
    status = F.when(F.col("k") >= F.col("done"), "cancelled").when(draw.uniform("deferred", *keys) < 0.02, "deferred").otherwise("completed")
    took = F.round(F.col("planned_duration_minutes") * draw.uniform("took", *keys, low=0.8, high=1.3), 2)
    took = F.when(draw.dirty("negative_duration", *keys), -F.col("planned_duration_minutes")).otherwise(took)
    df = df.withColumn("move_status", status)
    known = (F.col("move_status") != "cancelled") & ~((F.col("move_status") == "completed") & draw.dirty("no_move_time", *keys))
    return _typed(df.withColumns({
        "move_id": F.concat(F.lit("MV-"), F.lower(F.hex(F.xxhash64(*keys)))),
        "move_type": draw.chosen("move", *keys, of=[("discharge", 0.45), ("load", 0.45), ("shift", 0.10)]),
        "container_size": draw.chosen("size", *keys, of=[("20ft", 0.4), ("40ft", 0.6)]),
        "planned_move_time": later(F.col("actual_start"), F.col("at")),
        "actual_move_time": F.when(known, later(F.col("actual_start"), F.greatest(F.col("at") + draw.normal("lag", *keys, sd=120) / 3600, F.lit(0.0)))),
        "actual_duration_minutes": F.when(known, took),
    }), "container_moves")


def tables(spark: SparkSession, n_calls: int = 2000, start: str = "2023-01-01", end: str = "2024-12-31", seed: int = 42) -> dict[str, DataFrame]:
    """The five sources by name; nothing runs yet."""
    sky = weather(spark, start, end, seed)
    calls = vessel_calls(spark, sky, start, end, n_calls, seed=seed)
    cranes = crane_assignments(calls, seed)
    return {"terminal_metadata": terminals(spark), "weather_daily": sky, "vessel_calls": calls, "crane_assignments": cranes, "container_moves": container_moves(cranes, seed)}


def write_raw(spark: SparkSession, folder: str, **options) -> None:
    """The sources as CSV folders, as ingestion reads them."""
    for name, df in tables(spark, **options).items():
        files.write_csv(df, f"{folder}/{name}.csv") if name == "terminal_metadata" else df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
