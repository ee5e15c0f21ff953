"""Queries by name, and the SQL that each is checked against.

Names start with the inventory ids of the operators that a query shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, timing
from ..operators import checks, features, gold, model, pit, silver
from ..sources import files
from . import medallion, port_tables
from .port_tables import with_tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: The oracle's silver and gold layers, as CTEs over the derived tables.
_LAYERS = {
    "latest": ("bronze_calls", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY created_at DESC NULLS LAST) AS rn FROM bronze_calls) WHERE rn = 1"),
    "fence": ("latest", "SELECT greatest(24, quantile_cont(delay_hours, 0.75) + 1.5 * (quantile_cont(delay_hours, 0.75) - quantile_cont(delay_hours, 0.25))) AS fence FROM latest WHERE delay_hours > 0"),
    "sc": ("fence", """SELECT latest.*, date_diff('microsecond', eta, ata) / 6e7 AS arrival_delay_minutes, date_diff('microsecond', etd, atd) / 6e7 AS departure_delay_minutes,
  eta IS NULL AS missing_eta_flag, ata IS NULL AS missing_ata_flag, coalesce(ata > atd, false) AS invalid_arrival_sequence_flag,
  coalesce(etd < eta, false) AS invalid_departure_sequence_flag, coalesce(delay_hours > fence, false) AS large_delay_outlier_flag FROM latest, fence"""),
    "ok_cranes": ("cranes", """SELECT assignment_id, coalesce(actual_start < max(actual_end) OVER (PARTITION BY crane_id ORDER BY actual_start, actual_end, assignment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  OR coalesce(actual_end > lead(actual_start) OVER (PARTITION BY crane_id ORDER BY actual_start, actual_end, assignment_id), false) AS overlap
  FROM cranes WHERE crane_id IS NOT NULL AND actual_start IS NOT NULL AND actual_end >= actual_start"""),
    "sa": ("ok_cranes", """SELECT c.*, date_diff('microsecond', actual_start, actual_end) / 3.6e9 AS actual_hours, crane_id IS NULL AS missing_crane_id_flag,
  actual_start IS NULL OR actual_end IS NULL OR actual_end < actual_start AS invalid_crane_time_flag, coalesce(o.overlap, false) AS crane_overlap_flag
  FROM cranes c LEFT JOIN ok_cranes o USING (assignment_id)"""),
    "crane_agg": ("sa", """SELECT call_id, sum(CASE WHEN actual_hours < 0 THEN 0 ELSE actual_hours END) AS total_crane_hours,
  sum(CASE WHEN invalid_crane_time_flag THEN 0 ELSE actual_hours END) AS valid_crane_hours, count(DISTINCT crane_id) AS cranes_deployed,
  sum(missing_crane_id_flag::INT + invalid_crane_time_flag::INT + crane_overlap_flag::INT) AS crane_dq_flags FROM sa GROUP BY call_id"""),
    "move_agg": ("moves", "SELECT call_id, count(*) AS planned_moves, count(*) FILTER (move_status = 'completed') AS actual_moves FROM moves GROUP BY call_id"),
    "en": ("sc crane_agg move_agg terminals weather", """SELECT sc.*, date_trunc('day', coalesce(ata, eta)) AS operation_date, total_crane_hours, valid_crane_hours,
  coalesce(cranes_deployed, 0) AS cranes_deployed, coalesce(crane_dq_flags, 0) AS crane_dq_flags, coalesce(planned_moves, 0) AS planned_moves, coalesce(actual_moves, 0) AS actual_moves,
  terminal_name, crane_count, severity, coalesce(severity > 0.5, false) AS storm_flag,
  CASE WHEN arrival_delay_minutes <= -30 THEN 'early' WHEN arrival_delay_minutes <= 30 THEN 'on_time' WHEN arrival_delay_minutes <= 120 THEN 'minor_delay'
    WHEN arrival_delay_minutes <= 360 THEN 'moderate_delay' WHEN arrival_delay_minutes IS NOT NULL THEN 'major_delay' END AS delay_category,
  coalesce(crane_dq_flags, 0) + missing_eta_flag::INT + missing_ata_flag::INT + invalid_arrival_sequence_flag::INT + invalid_departure_sequence_flag::INT + large_delay_outlier_flag::INT AS total_dq_flags
  FROM sc LEFT JOIN crane_agg USING (call_id) LEFT JOIN move_agg USING (call_id) LEFT JOIN terminals USING (terminal_id)
  LEFT JOIN weather w ON w.terminal_id = sc.terminal_id AND w.weather_date = date_trunc('day', coalesce(ata, eta))"""),
    "kpi": ("en", """SELECT terminal_id, operation_date, max(terminal_name) AS terminal_name, count(*) AS vessel_calls, avg(arrival_delay_minutes) AS avg_arrival_delay_minutes,
  avg(departure_delay_minutes) AS avg_departure_delay_minutes, count(*) FILTER (arrival_delay_minutes > 30) AS delayed_calls,
  100.0 * count(*) FILTER (arrival_delay_minutes > 30) / count(*) AS pct_delayed, sum(actual_moves)::BIGINT AS total_moves, sum(total_crane_hours) AS total_crane_hours, sum(valid_crane_hours) AS crane_hours,
  sum(actual_moves) / nullif(sum(valid_crane_hours), 0) AS moves_per_crane_hour, max(storm_flag::INT) AS storm_day, sum(total_dq_flags)::BIGINT AS dq_flags
  FROM en WHERE operation_date IS NOT NULL GROUP BY terminal_id, operation_date"""),
    "past": ("sc", "SELECT * FROM sc WHERE atd IS NOT NULL AND status = 'completed'"),
    "cand": ("past", "SELECT * FROM sc WHERE eta IS NOT NULL AND NOT invalid_arrival_sequence_flag"),
}


def _oracle(layers: str, sql: str) -> str:
    """SQL with the layers, and the tables that they need, before it."""
    found: list[str] = []

    def need(names: str) -> None:
        for n in names.split():
            if n in _LAYERS and n not in found:
                need(_LAYERS[n][0])
                found.append(n)

    need(layers)
    tables = dict.fromkeys(t for n in [*found, *layers.split()] for t in ([n] if n in port_tables.TABLES else _LAYERS[n][0].split()) if t in port_tables.TABLES)
    ctes = ",\n".join(f"{n} AS ({_LAYERS[n][1]})" for n in found)
    sql = sql.strip()
    body = sql[4:].lstrip() if sql.upper().startswith("WITH") else None
    if not ctes:
        return with_tables(" ".join(tables), sql)
    return with_tables(" ".join(tables), f"WITH {ctes}" + (f",\n{body}" if body else f"\n{sql}"))


def query(layers: str = "", sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and SQL over layers if given."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _oracle(layers, sql) if layers else sql
        return f

    return add


def report(name: str, stages: str, layers: str, sql: str, oracle: str | None = None) -> None:
    """Registers a Spark SQL report over stages and derived tables, whose views have the layers' names."""
    views = dict(x.split("=") for x in stages.split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = [s for s in views.values() if s not in port_tables.TABLES]
        frames = dict(zip(made, medallion.from_benchmark(spark, sf_dir, *made))) if made else {}
        plain = [s for s in views.values() if s in port_tables.TABLES]
        frames |= dict(zip(plain, port_tables.load(spark, sf_dir, *plain)))
        for view, source in views.items():
            frames[source].createOrReplaceTempView(view)
        return spark.sql(sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = _oracle(layers, oracle or sql)


# --- silver -----------------------------------------------------------------


@query("bronze_calls", "SELECT call_id, count(*) AS n_records, min(created_at) AS first_created, max(created_at) AS last_created, date_diff('microsecond', min(created_at), max(created_at)) / 3.6e9 AS lag_hours, CASE WHEN max(created_at) = min(created_at) THEN 'exact' WHEN date_diff('microsecond', min(created_at), max(created_at)) / 3.6e9 <= 24 THEN 'retransmission' ELSE 'late_update' END AS duplicate_class FROM bronze_calls GROUP BY call_id HAVING count(*) > 1")
def a9_a10_duplicate_audit(spark, sf_dir):
    return silver.duplicate_audit(*port_tables.load(spark, sf_dir, "bronze_calls"), "call_id", "created_at")


@query("latest", "SELECT call_id, created_at, delay_hours FROM latest")
def w1_latest_record(spark, sf_dir):
    return silver.latest_record(*port_tables.load(spark, sf_dir, "bronze_calls"), "call_id", "created_at").select("call_id", "created_at", "delay_hours")


_CALL_COLUMNS = "call_id, arrival_delay_minutes, departure_delay_minutes, missing_eta_flag, missing_ata_flag, invalid_arrival_sequence_flag, invalid_departure_sequence_flag, large_delay_outlier_flag"


@query("sc", f"SELECT {_CALL_COLUMNS} FROM sc")
def p1_p2_p3_p5_silver_calls(spark, sf_dir):
    return medallion.from_benchmark(spark, sf_dir, "silver_calls")[0].select(*_CALL_COLUMNS.split(", "))


@query("fence", "SELECT fence FROM fence")
def a5_tukey_fence(spark, sf_dir):
    (bronze,) = port_tables.load(spark, sf_dir, "bronze_calls")
    return silver.tukey_fence(silver.latest_record(bronze, "call_id", "created_at"), "delay_hours")


@query("sa", "SELECT assignment_id, actual_hours, missing_crane_id_flag, invalid_crane_time_flag, crane_overlap_flag FROM sa")
def w2_w3_w4_p4_p6_crane_overlaps(spark, sf_dir):
    return medallion.from_benchmark(spark, sf_dir, "silver_cranes")[0].select("assignment_id", "actual_hours", "missing_crane_id_flag", "invalid_crane_time_flag", "crane_overlap_flag")


@query("moves", "SELECT move_id, CASE WHEN actual_minutes >= 0 THEN actual_minutes END AS actual_minutes, CASE WHEN actual_minutes >= 0 THEN actual_minutes END - planned_minutes AS variance_minutes FROM moves")
def p7_clean_moves(spark, sf_dir):
    return medallion.from_benchmark(spark, sf_dir, "silver_moves")[0].select("move_id", "actual_minutes", "variance_minutes")


@query("vessel_calls", """SELECT call_id, date_diff('second', eta, ata) / 60.0 AS delay_minutes, date_diff('hour', eta, etd) AS hours, date_diff('day', eta, atd) AS days,
  coalesce(date_diff('hour', ata, atd) > 30, false) AS excessive_turnaround, coalesce(atd < ata, false) AS atd_before_ata FROM vessel_calls""")
def p1b_p26_f1_boundary_differences(spark, sf_dir):
    (calls,) = port_tables.load(spark, sf_dir, "vessel_calls")
    c = F.col
    return calls.select(
        "call_id",
        (timing.boundaries("second", c("eta"), c("ata")) / 60.0).alias("delay_minutes"),
        timing.boundaries("hour", c("eta"), c("etd")).alias("hours"),
        timing.boundaries("day", c("eta"), c("atd")).alias("days"),
        scalar.true_or_false(timing.boundaries("hour", c("ata"), c("atd")) > 30).alias("excessive_turnaround"),
        scalar.true_or_false(c("atd") < c("ata")).alias("atd_before_ata"),
    )


# --- gold -------------------------------------------------------------------


@query("crane_agg", "SELECT call_id, total_crane_hours, valid_crane_hours, cranes_deployed, crane_dq_flags::BIGINT AS crane_dq_flags FROM crane_agg")
def a1_p10_p13_p14_cranes_per_call(spark, sf_dir):
    return gold.cranes_per_call(*medallion.from_benchmark(spark, sf_dir, "silver_cranes"))


@query("move_agg", "SELECT * FROM move_agg")
def a2_j15_moves_per_call(spark, sf_dir):
    return gold.moves_per_call(*medallion.from_benchmark(spark, sf_dir, "silver_moves"))


@query("kpi", "SELECT * FROM kpi")
def a3_daily_kpis(spark, sf_dir):
    return medallion.from_benchmark(spark, sf_dir, "daily_kpis")[0]


@query("kpi", """SELECT operation_date, terminal_id, terminal_name, vessel_calls, round(avg_arrival_delay_minutes, 1) AS avg_arrival_delay_minutes, round(avg_departure_delay_minutes, 1) AS avg_departure_delay_minutes,
  round(pct_delayed, 2) AS delayed_vessel_percentage, total_moves AS total_container_moves, round(total_crane_hours, 2) AS total_crane_hours, round(moves_per_crane_hour, 2) AS avg_moves_per_crane_hour,
  round(crane_hours, 2) AS crane_utilization_hours, dq_flags AS data_quality_issue_count, storm_day AS storm_days_count FROM kpi""")
def a3_p15_p16_kpi_contract(spark, sf_dir):
    return gold.kpi_contract(medallion.from_benchmark(spark, sf_dir, "daily_kpis")[0])


@query("en", """SELECT call_id, vessel_id, terminal_id, terminal_name, carrier AS service_code, vessel_class, operation_date, arrival_delay_minutes, departure_delay_minutes, delay_category,
  planned_moves, actual_moves, total_crane_hours, cranes_deployed, storm_flag, total_dq_flags::BIGINT AS total_dq_flags FROM en""")
def j1_j2_j3_j4_p8_p12_p16_call_summary(spark, sf_dir):
    return medallion.from_benchmark(spark, sf_dir, "call_summary")[0]


report("a31_value_counts", "en=enriched", "en", "SELECT coalesce(delay_category, 'unknown') AS delay_category, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM en GROUP BY 1")
report("o4_top_calls", "kpi=daily_kpis", "kpi", "SELECT terminal_id, operation_date, vessel_calls FROM kpi ORDER BY vessel_calls DESC, terminal_id, operation_date LIMIT 10")
report("o5_head_sample", "kpi=daily_kpis", "kpi", "SELECT terminal_id, operation_date, vessel_calls, delayed_calls FROM kpi ORDER BY operation_date, terminal_id LIMIT 60")
report("w5_rolling_7_day", "kpi=daily_kpis", "kpi", """SELECT terminal_id, operation_date,
  avg(avg_arrival_delay_minutes) OVER (PARTITION BY terminal_id ORDER BY operation_date RANGE BETWEEN INTERVAL '6' DAY PRECEDING AND CURRENT ROW) AS delay_7d,
  avg(pct_delayed) OVER (PARTITION BY terminal_id ORDER BY operation_date RANGE BETWEEN INTERVAL '6' DAY PRECEDING AND CURRENT ROW) AS pct_7d FROM kpi""")
report("a33_w6_terminal_ranking", "kpi=daily_kpis", "kpi", """WITH period AS (SELECT terminal_id, sum(vessel_calls) AS calls, avg(avg_arrival_delay_minutes) AS delay, sum(total_moves) AS moves FROM kpi GROUP BY terminal_id)
SELECT terminal_id, CAST(calls AS BIGINT) AS calls, delay, CAST(moves AS BIGINT) AS moves, rank() OVER (ORDER BY delay) AS delay_rank, dense_rank() OVER (ORDER BY moves DESC) AS moves_rank FROM period""")
report("a14_grouping_sets", "kpi=daily_kpis", "kpi", """SELECT CASE WHEN grouping(terminal_id) = 1 THEN 'FLEET' ELSE terminal_id END AS terminal, CAST(sum(vessel_calls) AS BIGINT) AS calls,
  CAST(sum(delayed_calls) AS BIGINT) AS delayed, CAST(grouping(terminal_id) AS INT) AS is_total FROM kpi GROUP BY GROUPING SETS ((terminal_id), ())""")


@query("vessel_calls cranes moves", """WITH f AS (SELECT 'vessel_calls' AS source, max(created_at) AS newest, count(*) AS n FROM vessel_calls UNION ALL BY NAME
  SELECT 'cranes' AS source, count(*) AS n, max(actual_end) AS newest FROM cranes UNION ALL BY NAME SELECT 'moves' AS source, max(moved_at) AS newest, count(*) AS n FROM moves)
SELECT source, newest, n, date_diff('hour', newest, TIMESTAMP '2024-02-01 00:00:00') AS lag_hours,
  CASE WHEN date_diff('hour', newest, TIMESTAMP '2024-02-01 00:00:00') > 48 THEN 'STALE' ELSE 'FRESH' END AS freshness FROM f""")
def a21_u2_source_freshness(spark, sf_dir):
    frames = zip(("vessel_calls", "cranes", "moves"), ("created_at", "actual_end", "moved_at"), port_tables.load(spark, sf_dir, "vessel_calls", "cranes", "moves"))
    rows = [df.agg(F.max(c).alias("newest"), F.count("*").alias("n")).withColumn("source", F.lit(name)) for name, c, df in frames]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    lag = timing.boundaries("hour", F.col("newest"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return both.withColumn("lag_hours", lag).withColumn("freshness", F.when(F.col("lag_hours") > 48, "STALE").otherwise("FRESH"))


# --- data quality -----------------------------------------------------------

_AUDITED = {"call_id": True, "vessel_id": True, "terminal_id": True, "eta": False, "ata": False, "etd": False, "atd": False, "delay_reason": False, "planned_teu": False}
_NULLS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS field, {str(must).lower()} AS mandatory, count(*) - count({c}) AS nulls, count(*) AS n FROM vessel_calls" for c, must in _AUDITED.items())


@query("vessel_calls", f"""SELECT *, 100.0 * nulls / n AS pct, CASE WHEN mandatory THEN 'FAIL' ELSE 'WARN' END AS verdict FROM ({_NULLS_SQL}) x WHERE nulls > 0""")
def a17_null_audit(spark, sf_dir):
    """One pass over the table, in place of a scan for each column."""
    (calls,) = port_tables.load(spark, sf_dir, "vessel_calls")
    return checks.null_audit(calls, _AUDITED)


@query("sc sa", " UNION ALL ".join(f"""SELECT '{name}' AS name, (SELECT count(DISTINCT {key}) FROM {rows}) AS affected,
  coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT DISTINCT {key}::VARCHAR AS id FROM {rows} AND {key} IS NOT NULL ORDER BY id LIMIT 10)), '') AS sample""" for name, key, rows in (
    ("duplicate_calls", "call_id", "sc WHERE call_id IN (SELECT call_id FROM sc GROUP BY call_id HAVING count(*) > 1)"),
    ("invalid_arrival_sequence", "call_id", "sc WHERE invalid_arrival_sequence_flag"),
    ("large_delay_outliers", "call_id", "sc WHERE large_delay_outlier_flag"),
    ("crane_overlaps", "crane_id", "sa WHERE crane_overlap_flag"),
    ("orphan_crane_assignments", "call_id", "sa WHERE call_id NOT IN (SELECT call_id FROM sc)"),
)))
def d8_d9_o6_check_samples(spark, sf_dir):
    return checks.details(*medallion.from_benchmark(spark, sf_dir, "silver_calls", "silver_cranes"))


@query("sc fence", """SELECT call_id, terminal_id, delay_reason, delay_hours, (SELECT fence FROM fence) AS outlier_threshold_hours, large_delay_outlier_flag AS flagged_in_silver
  FROM sc WHERE delay_hours > (SELECT fence FROM fence)""")
def d17_outlier_recompute(spark, sf_dir):
    (calls,) = medallion.from_benchmark(spark, sf_dir, "silver_calls")
    fenced = calls.crossJoin(F.broadcast(silver.tukey_fence(calls, "delay_hours"))).where("delay_hours > fence")  # the fence is one row
    return fenced.select("call_id", "terminal_id", "delay_reason", "delay_hours", F.col("fence").alias("outlier_threshold_hours"), F.col("large_delay_outlier_flag").alias("flagged_in_silver"))


@query("cranes vessel_calls", "SELECT c.assignment_id, c.call_id FROM cranes c LEFT JOIN vessel_calls v USING (call_id) WHERE v.call_id IS NULL")
def j11_orphans(spark, sf_dir):
    cranes, calls = port_tables.load(spark, sf_dir, "cranes", "vessel_calls")
    return cranes.join(calls, "call_id", "left_anti").select("assignment_id", "call_id")


report("j12_orphan_rate", "cranes=cranes vessel_calls=vessel_calls", "cranes vessel_calls", "SELECT count(*) AS n, count(*) FILTER (WHERE v.call_id IS NULL) AS orphans, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE v.call_id IS NULL) / count(*) AS pct FROM cranes c LEFT JOIN vessel_calls v ON c.call_id = v.call_id")
report("d17_flag_cross_check", "sc=silver_calls", "sc", "SELECT count(*) FILTER (WHERE invalid_arrival_sequence_flag) AS flagged, count(*) FILTER (WHERE ata > atd) AS recomputed, count(*) FILTER (WHERE missing_eta_flag <> (eta IS NULL)) AS mismatched FROM sc")
_TURNAROUND = """SELECT call_id, round(hours, 1) AS turnaround_hours, CASE WHEN hours < 1 THEN 'too_short' ELSE 'too_long' END AS violation
FROM (SELECT call_id, {0} AS hours FROM vessel_calls) x WHERE hours < 1 OR hours > 168"""
report("p18_turnaround_bounds", "vessel_calls=vessel_calls", "vessel_calls", _TURNAROUND.format("timestampdiff(MICROSECOND, ata, atd) / CAST(3600000000 AS DOUBLE)"), _TURNAROUND.format("date_diff('microsecond', ata, atd) / 3.6e9"))
report("p18_cargo_bounds", "vessel_calls=vessel_calls", "vessel_calls", "SELECT call_id, CASE WHEN actual_teu < 100 THEN 'too_small' ELSE 'too_large' END AS violation FROM vessel_calls WHERE actual_teu < 100 OR actual_teu > 3000")
report("p18_p15_cargo_anomalies", "vessel_calls=vessel_calls", "vessel_calls", "SELECT call_id, CAST(actual_teu AS DOUBLE) / nullif(planned_teu, 0) AS ratio FROM vessel_calls WHERE actual_teu > CAST(1.1 AS DOUBLE) * planned_teu")
report("w10_o3_overlap_partners", "sa=silver_cranes", "sa", """SELECT assignment_id, crane_id, lag(assignment_id) OVER (PARTITION BY crane_id ORDER BY actual_start, actual_end, assignment_id) AS previous_id,
  lag(actual_end) OVER (PARTITION BY crane_id ORDER BY actual_start, actual_end, assignment_id) AS previous_end FROM sa WHERE crane_overlap_flag ORDER BY crane_id, actual_start, actual_end, assignment_id LIMIT 20""")
report("a19_status_consistency", "moves=moves", "moves", "SELECT move_status, count(*) AS n, count(*) FILTER (WHERE actual_minutes IS NULL) AS nulls, count(*) FILTER (WHERE actual_minutes < 0) AS negatives FROM moves GROUP BY move_status")
report("a20_layer_reconciliation", "bronze_calls=bronze_calls sc=silver_calls en=enriched", "sc en", """SELECT 'bronze' AS layer, count(*) AS n, count(DISTINCT call_id) AS ids FROM bronze_calls
  UNION ALL SELECT 'silver', count(*), count(DISTINCT call_id) FROM sc UNION ALL SELECT 'gold', count(*), count(DISTINCT call_id) FROM en""")
report("a18_scorecard", "sc=silver_calls sa=silver_cranes", "sc sa", """SELECT 'calls' AS t, count(*) AS n, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE missing_eta_flag) / count(*) AS pct_missing,
  CAST(100 AS DOUBLE) * count(*) FILTER (WHERE NOT (missing_eta_flag OR missing_ata_flag OR invalid_arrival_sequence_flag OR large_delay_outlier_flag)) / count(*) AS pct_clean, CAST(NULL AS DOUBLE) AS pct_overlap FROM sc
UNION ALL SELECT 'cranes', count(*), CAST(100 AS DOUBLE) * count(*) FILTER (WHERE missing_crane_id_flag) / count(*), CAST(100 AS DOUBLE) * count(*) FILTER (WHERE NOT (missing_crane_id_flag OR invalid_crane_time_flag OR crane_overlap_flag)) / count(*),
  CAST(100 AS DOUBLE) * count(*) FILTER (WHERE crane_overlap_flag) / count(*) FROM sa""")


def _rate(name: str, table: str, flag: str, warn: float, fail: float | None, percent: bool = True) -> str:
    value = f"round(100.0 * count(*) FILTER ({flag}) / count(*), 2)" if percent else f"count(*) FILTER ({flag})::DOUBLE"
    status = f"CASE WHEN {value} > {fail} THEN 'FAIL' " if fail is not None else "CASE "
    return f"SELECT '{name}' AS name, count(*) FILTER ({flag}) AS n, {value}::DOUBLE AS value, {status}WHEN {value} > {warn} THEN 'WARN' ELSE 'PASS' END AS status FROM {table}"


_CHECKS_SQL = " UNION ALL ".join([
    "SELECT 'duplicate_calls' AS name, count(*) - count(DISTINCT call_id) AS n, (count(*) - count(DISTINCT call_id))::DOUBLE AS value, CASE WHEN count(*) > count(DISTINCT call_id) THEN 'FAIL' ELSE 'PASS' END AS status FROM sc",
    _rate("missing_eta", "sc", "missing_eta_flag", 5, 15), _rate("missing_ata", "sc", "missing_ata_flag", 10, 25),
    _rate("invalid_arrival_sequence", "sc", "invalid_arrival_sequence_flag", 0, None, False), _rate("invalid_departure_sequence", "sc", "invalid_departure_sequence_flag", 0, None, False),
    _rate("large_delay_outliers", "sc", "large_delay_outlier_flag", 1, 5),
    _rate("crane_end_before_start", "sa", "invalid_crane_time_flag", 2, 10), _rate("crane_overlaps", "sa", "crane_overlap_flag", 5, 15),
    "SELECT 'orphan_crane_assignments', count(*), count(*)::DOUBLE, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM sa WHERE call_id NOT IN (SELECT call_id FROM sc)",
])


@query("sc sa", _CHECKS_SQL)
def d1_d9_silver_checks(spark, sf_dir):
    calls, cranes = medallion.from_benchmark(spark, sf_dir, "silver_calls", "silver_cranes")
    return checks.report(
        checks.duplicate_check(calls, "duplicate_calls", "call_id"), checks.call_checks(calls), checks.crane_checks(cranes),
        checks.orphan_check(cranes, calls, "orphan_crane_assignments", "call_id"),
    )


@query()
def d10_d15_quality_report(spark, sf_dir):
    return medallion.quality_report(*medallion.from_benchmark(spark, sf_dir, "silver_calls", "silver_cranes", "call_summary", "daily_kpis", "features"))


# --- features ---------------------------------------------------------------


def _pit_sql(group: str, n: int, value: str) -> str:
    return f"""SELECT call_id, {value} AS v FROM (SELECT c.call_id, p.delay_hours, row_number() OVER (PARTITION BY c.call_id ORDER BY p.atd DESC, p.call_id) AS rn
  FROM cand c JOIN past p ON p.{group} = c.{group} AND p.atd < c.eta AND p.call_id <> c.call_id) WHERE rn <= {n} GROUP BY call_id"""


def _history(spark, sf_dir):
    calls = medallion.from_benchmark(spark, sf_dir, "silver_calls")[0]
    return features.candidates(calls), calls.where(F.col("atd").isNotNull() & (F.col("status") == "completed")), calls


@query("cand", _pit_sql("terminal_id", 10, "avg(delay_hours)").replace("AS v", "AS rolling_mean"))
def j5_w13_pit_rolling_mean(spark, sf_dir):
    cand, past, _ = _history(spark, sf_dir)
    return pit.rolling_mean(cand, past, "terminal_id", "call_id", "eta", "atd", "delay_hours")


@query("cand", _pit_sql("vessel_id", 1, "max(delay_hours)").replace("AS v", "AS most_recent"))
def j6_pit_most_recent(spark, sf_dir):
    cand, past, _ = _history(spark, sf_dir)
    return pit.most_recent(cand, past, "vessel_id", "call_id", "eta", "atd", "delay_hours")


@query("cand", """SELECT c.call_id, count(*) AS n_past, avg(p.delay_hours) AS avg_delay, avg(CASE WHEN p.delay_hours > 0.5 THEN 1.0 ELSE 0.0 END) AS late_rate
  FROM cand c JOIN past p ON p.terminal_id = c.terminal_id AND p.atd < c.eta AND p.atd >= c.eta - INTERVAL 90 DAY AND p.call_id <> c.call_id GROUP BY c.call_id""")
def j8_a12_look_back_90_days(spark, sf_dir):
    cand, past, _ = _history(spark, sf_dir)
    late = F.when(F.col("delay_hours") > 0.5, 1.0).otherwise(0.0)
    found = pit.look_back(cand, past, "terminal_id", "call_id", "eta", "atd", 90, delay=F.col("delay_hours"), late=late)
    return found.select("call_id", "n_past", scalar.safe_divide(F.col("delay"), F.col("delay_n")).alias("avg_delay"), (F.col("late") / F.col("n_past")).alias("late_rate"))


@query("cand", """SELECT c.call_id, count(p.call_id) AS n_past, avg(p.delay_hours) AS avg_delay, stddev_samp(p.delay_hours) AS std_delay, max(p.atd) AS last_departure
  FROM cand c LEFT JOIN past p ON p.vessel_id = c.vessel_id AND p.atd < c.eta AND p.call_id <> c.call_id GROUP BY c.call_id""")
def j7_a11_w14_vessel_history(spark, sf_dir):
    cand, past, _ = _history(spark, sf_dir)
    sums = pit.look_back(cand, past, "vessel_id", "call_id", "eta", "atd", features.ALL_DAYS, delay=F.col("delay_hours"), square=F.col("delay_hours") * F.col("delay_hours"))
    last = pit.most_recent(cand, past, "vessel_id", "call_id", "eta", "atd", "atd").withColumnRenamed("most_recent", "last_departure")
    n, total, square = F.col("delay_n"), F.col("delay"), F.col("square")
    spread = F.sqrt(F.greatest(square - total * total / n, F.lit(0.0)) / F.when(n > 1, n - 1))
    out = cand.select("call_id").join(sums, "call_id", "left").join(last, "call_id", "left")
    return out.select("call_id", F.coalesce("n_past", F.lit(0)).cast("long").alias("n_past"), scalar.safe_divide(total, n).alias("avg_delay"), F.when(n > 0, spread).alias("std_delay"), "last_departure")


@query("sc", """SELECT c.call_id, count(o.call_id) AS n FROM sc c LEFT JOIN sc o ON o.terminal_id = c.terminal_id AND o.call_id <> c.call_id AND o.eta <= c.eta AND o.etd >= c.eta
  WHERE c.eta IS NOT NULL AND (o.etd >= o.eta OR o.call_id IS NULL) GROUP BY c.call_id""")
def j9_congestion(spark, sf_dir):
    calls = medallion.from_benchmark(spark, sf_dir, "silver_calls")[0]
    return pit.stabbing_count(calls, "terminal_id", "call_id", "eta", "etd")


@query("vessel_calls", """SELECT call_id, month(eta) AS month, isodow(eta) AS iso_weekday, isodow(eta) - 1 AS day_of_week, isodow(eta) >= 6 AS is_weekend, hour(eta) >= 20 OR hour(eta) < 6 AS night_arrival,
  'Q' || quarter(eta) AS quarter, strftime(eta, '%Y-%m') AS year_month, strftime(eta, '%b') AS month_name FROM vessel_calls WHERE eta IS NOT NULL""")
def f2_f8_temporal(spark, sf_dir):
    (calls,) = port_tables.load(spark, sf_dir, "vessel_calls")
    eta = F.col("eta")
    return calls.where(eta.isNotNull()).select(
        "call_id", F.month(eta).alias("month"), scalar.iso_weekday(eta).alias("iso_weekday"), F.weekday(eta).alias("day_of_week"), (F.weekday(eta) >= 5).alias("is_weekend"),
        timing.night(eta).alias("night_arrival"), timing.quarter_name(eta).alias("quarter"), F.date_format(eta, "yyyy-MM").alias("year_month"), F.date_format(eta, "MMM").alias("month_name"),
    )


@query("vessel_calls", """SELECT call_id, coalesce(list_position(['T0','T1','T2','T3','T4'], terminal_id), 0) - 1 AS terminal_code,
  coalesce(list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], carrier), 0) - 1 AS carrier_code FROM vessel_calls""")
def f14_encode(spark, sf_dir):
    (calls,) = port_tables.load(spark, sf_dir, "vessel_calls")
    return features.encoded(calls).select("call_id", "terminal_code", "carrier_code")


_FEATURE_SQL = f"""WITH scope AS (SELECT call_id, count(DISTINCT crane_id) AS pc, sum(planned_hours) AS ph FROM sa GROUP BY call_id),
t AS ({_pit_sql("terminal_id", 10, "avg(delay_hours)")}), s AS ({_pit_sql("carrier", 10, "avg(delay_hours)")}), v AS ({_pit_sql("vessel_id", 1, "max(delay_hours)")}),
g AS (SELECT c.call_id, count(*) AS n FROM cand c JOIN sc o ON o.terminal_id = c.terminal_id AND o.call_id <> c.call_id AND o.eta <= c.eta AND o.etd >= c.eta GROUP BY c.call_id)
SELECT c.call_id, c.eta, c.terminal_id, c.carrier, coalesce(pc, 0) AS planned_cranes, coalesce(ph, 0) AS planned_crane_hours, coalesce(planned_moves, 0) AS planned_moves, planned_teu::DOUBLE AS vessel_capacity,
  isodow(c.eta) - 1 AS day_of_week, month(c.eta) AS month, (isodow(c.eta) >= 6)::INT AS is_weekend, coalesce(severity > 0.5, false)::INT AS storm_flag,
  t.v AS avg_previous_10_terminal, s.v AS avg_previous_10_service, v.v AS previous_vessel_delay, coalesce(g.n, 0) AS congestion_score,
  right(c.terminal_id, 1)::INT AS terminal_code, left(c.carrier, 1)::INT - 1 AS carrier_code, CASE WHEN arrival_delay_minutes > 120 THEN 1.0 WHEN arrival_delay_minutes IS NOT NULL THEN 0.0 END AS is_delayed
FROM cand c LEFT JOIN scope USING (call_id) LEFT JOIN move_agg USING (call_id) LEFT JOIN t USING (call_id) LEFT JOIN s USING (call_id) LEFT JOIN v USING (call_id) LEFT JOIN g USING (call_id)
LEFT JOIN weather w ON w.terminal_id = c.terminal_id AND w.weather_date = date_trunc('day', c.eta)"""


@query("cand sa move_agg weather", _FEATURE_SQL)
def m1_m9_feature_table(spark, sf_dir):
    return medallion.from_benchmark(spark, sf_dir, "features")[0]


@query("vessel_calls", """WITH r AS (SELECT call_id, eta, row_number() OVER (ORDER BY eta, call_id) AS rn, count(*) OVER () AS n FROM vessel_calls WHERE eta IS NOT NULL)
SELECT call_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r""")
def w15_m11_time_split(spark, sf_dir):
    (calls,) = port_tables.load(spark, sf_dir, "vessel_calls")
    train, test, _ = model.time_split(calls.where(F.col("eta").isNotNull()).select("call_id", "eta"), "eta", "call_id")
    return train.select("call_id", F.lit("train").alias("part")).unionAll(test.select("call_id", F.lit("test").alias("part")))


@query()
def m12_m15_models(spark, sf_dir):
    layers = medallion.from_benchmark(spark, sf_dir, "silver_calls", "silver_cranes", "silver_moves", "weather")
    calls, drop_calls = files.keep(layers[0])  # the features read it ten times
    hold, drop_held = files.holder()
    found = model.train(features.feature_table(calls, *layers[1:], hold), features.FEATURES, "is_delayed", "eta", "call_id")
    for drop in (drop_calls, drop_held, lambda: model.release(found)):
        drop()
    rows = [(name, k, float(v)) for name, m in found["metrics"].items() for k, v in m.items() if k != "confusion_matrix"]
    rows += [(name, k, float(v)) for name, m in found["metrics"].items() for k, v in zip(("tn", "fp", "fn", "tp"), sum(m["confusion_matrix"], []))]
    for r in found["importances"].collect():  # one row for each feature
        rows += [("logistic_regression", f"coefficient_{r.feature}", r.lr_coefficient), ("logistic_regression", f"importance_{r.feature}", r.lr_importance)]
        rows.append(("random_forest", f"importance_{r.feature}", r.rf_importance))
    return spark.createDataFrame(rows, "model string, metric string, value double")


_DESCRIBED = " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, avg({f}) AS mean, stddev_samp({f}) AS std FROM ft" for f in features.FEATURES)


@query("cand sa move_agg weather", f"WITH ft AS MATERIALIZED ({_FEATURE_SQL}) {_DESCRIBED}")
def a32_describe(spark, sf_dir):
    """Every feature in one pass."""
    return features.described(medallion.from_benchmark(spark, sf_dir, "features")[0])


_RATES = "count(*) AS n, avg(CASE WHEN p.delay_hours > 0.5 THEN 1.0 ELSE 0.0 END) AS rate, avg(p.delay_hours) AS delay, avg(date_diff('microsecond', p.ata, p.atd) / 6e7) / 60 AS stay"


@query("cand weather", f"""WITH vf AS (SELECT c.call_id, {_RATES} FROM cand c JOIN sc p ON p.vessel_id = c.vessel_id AND p.atd < c.eta AND p.call_id <> c.call_id GROUP BY c.call_id),
tf AS (SELECT c.call_id, {_RATES} FROM cand c JOIN sc p ON p.terminal_id = c.terminal_id AND p.atd < c.eta AND p.atd >= c.eta - INTERVAL 90 DAY AND p.call_id <> c.call_id GROUP BY c.call_id),
bf AS (SELECT c.call_id, count(*) AS n FROM cand c JOIN sc o ON o.terminal_id = c.terminal_id AND o.call_id <> c.call_id AND o.eta <= c.eta AND o.atd >= c.eta GROUP BY c.call_id)
SELECT c.call_id, c.eta, c.vessel_class, c.carrier, c.planned_turnaround_hours, coalesce(vf.n, 0) AS vessel_calls, coalesce(vf.rate, 0) AS vessel_delay_rate, coalesce(vf.delay, 0) AS vessel_avg_delay_h,
  coalesce(vf.stay, c.planned_turnaround_hours) AS vessel_avg_turnaround_h, coalesce(tf.n, 0) AS terminal_calls, coalesce(tf.rate, 0) AS terminal_delay_rate,
  coalesce(tf.stay, c.planned_turnaround_hours) AS terminal_avg_turnaround_h, coalesce(bf.n, 0) AS concurrent_calls, coalesce(w.severity, 0) AS weather_severity, coalesce(w.severity > 0.5, false)::INT AS storm_at_eta,
  month(c.eta) AS eta_month, isodow(c.eta) AS eta_dow, hour(c.eta) AS eta_hour, (isodow(c.eta) >= 6)::INT AS is_weekend, (hour(c.eta) >= 20 OR hour(c.eta) < 6)::INT AS is_night_arrival,
  CASE WHEN c.atd IS NULL THEN NULL WHEN c.delay_hours > 0.5 THEN 1 ELSE 0 END AS is_delayed
FROM cand c LEFT JOIN vf USING (call_id) LEFT JOIN tf USING (call_id) LEFT JOIN bf USING (call_id) LEFT JOIN weather w ON w.terminal_id = c.terminal_id AND w.weather_date = date_trunc('day', c.eta)""")
def m10_j17_history_table(spark, sf_dir):
    return features.history_table(*medallion.from_benchmark(spark, sf_dir, "silver_calls", "weather"))


@query("cand weather", """SELECT c.call_id, severity, severity > 0.5 AS storm_at_eta, lag(severity) OVER (PARTITION BY w.terminal_id ORDER BY w.weather_date, c.call_id) AS previous_severity
FROM cand c LEFT JOIN weather w ON w.terminal_id = c.terminal_id AND date_trunc('day', w.weather_date) = date_trunc('day', c.eta)""")
def w11_severity_lag_of_joined_rows(spark, sf_dir):
    return features.severity_before(*medallion.from_benchmark(spark, sf_dir, "silver_calls", "weather"))


report("j18_w14_fan_out_window", "sc=silver_calls", "sc", """WITH met AS (SELECT c.call_id, c.vessel_id, c.eta, p.call_id AS past_id, p.atd AS past_atd FROM sc c LEFT JOIN sc p ON p.vessel_id = c.vessel_id AND p.atd < c.eta
  WHERE c.eta IS NOT NULL AND NOT c.invalid_arrival_sequence_flag)
SELECT call_id, past_id, max(past_atd) OVER (PARTITION BY vessel_id ORDER BY eta, call_id, past_atd, past_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_departure FROM met""")
report("p24_all_but", "sc=silver_calls", "sc", "SELECT * EXCEPT (delay_hours, actual_teu, planned_teu) FROM sc WHERE large_delay_outlier_flag", "SELECT * EXCLUDE (delay_hours, actual_teu, planned_teu) FROM sc WHERE large_delay_outlier_flag")

# --- business reports -------------------------------------------------------

_MONTH = ("date_format(operation_date, 'yyyy-MM')", "strftime(operation_date, '%Y-%m')")
_MOM = """WITH m AS (SELECT terminal_id, {0} AS year_month, count(*) AS calls, avg(arrival_delay_minutes) AS delay FROM en WHERE operation_date IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, lag(calls) OVER (PARTITION BY terminal_id ORDER BY year_month) AS prev_calls, lag(delay) OVER (PARTITION BY terminal_id ORDER BY year_month) AS prev_delay FROM m)
SELECT terminal_id, year_month, calls, delay, calls - prev_calls AS calls_change, delay - prev_delay AS delay_change,
  CASE WHEN prev_delay IS NULL THEN 'first' WHEN delay < prev_delay THEN 'improving' WHEN delay > prev_delay THEN 'worsening' ELSE 'stable' END AS trend FROM l"""
report("a22_w8_month_over_month", "en=enriched", "en", _MOM.format(_MONTH[0]), _MOM.format(_MONTH[1]))

_CAUSE = """SELECT terminal_id, delay_reason, count(*) AS n, CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY terminal_id) AS share,
  avg(arrival_delay_minutes) AS mean, {0}, {1} AS carriers FROM en WHERE arrival_delay_minutes > 30 GROUP BY terminal_id, delay_reason"""
report("a23_a6_a15_w9_root_cause", "en=enriched", "en",
       _CAUSE.format("percentile(arrival_delay_minutes, 0.5) AS median, percentile(arrival_delay_minutes, 0.95) AS p95", "listagg(DISTINCT CASE WHEN total_dq_flags = 0 THEN carrier END, ',') WITHIN GROUP (ORDER BY CASE WHEN total_dq_flags = 0 THEN carrier END)"),
       _CAUSE.format("quantile_cont(arrival_delay_minutes, 0.5) AS median, quantile_cont(arrival_delay_minutes, 0.95) AS p95", "string_agg(DISTINCT carrier, ',' ORDER BY carrier) FILTER (total_dq_flags = 0)"))
report("a24_storm_or_clear", "en=enriched", "en", "SELECT terminal_id, CASE WHEN storm_flag THEN 'storm' ELSE 'clear' END AS sky, count(*) AS n, avg(arrival_delay_minutes) AS delay FROM en GROUP BY terminal_id, CASE WHEN storm_flag THEN 'storm' ELSE 'clear' END")
report("a24_fleet_storm_or_clear", "en=enriched", "en", "SELECT storm_flag, count(*) AS n, avg(arrival_delay_minutes) AS delay, avg(actual_moves) AS moves FROM en GROUP BY storm_flag")
_CARRIER = """WITH c AS (SELECT carrier, vessel_class, count(*) AS n, avg(arrival_delay_minutes) AS delay, {0} AS median, CAST(count(*) FILTER (WHERE arrival_delay_minutes <= 30) AS DOUBLE) / count(*) AS on_time
  FROM en GROUP BY carrier, vessel_class)
SELECT carrier, vessel_class, n, delay, median, on_time, rank() OVER (ORDER BY on_time DESC) AS punctuality_rank, rank() OVER (ORDER BY delay) AS delay_rank, rank() OVER (ORDER BY n DESC) AS volume_rank FROM c WHERE n >= 5"""
report("a25_w7_carrier_scorecard", "en=enriched", "en", _CARRIER.format("percentile(arrival_delay_minutes, 0.5)"), _CARRIER.format("quantile_cont(arrival_delay_minutes, 0.5)"))
report("a26_a16_p22_class_throughput", "en=enriched", "en", """SELECT vessel_class, count(*) AS n, CAST(sum(actual_moves) AS DOUBLE) / nullif(sum(valid_crane_hours), 0) AS pooled_rate, count(DISTINCT vessel_id) AS vessels
  FROM en GROUP BY vessel_class ORDER BY CASE vessel_class WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END""")
_BERTH = """WITH span AS (SELECT {0} + 1 AS days FROM en), used AS (SELECT terminal_id, berth_id, count(*) AS n, sum(planned_turnaround_hours) AS hours FROM en GROUP BY terminal_id, berth_id)
SELECT terminal_id, berth_id, n, hours / (days * 24 * CAST(0.85 AS DOUBLE)) AS utilisation, CASE WHEN hours / (days * 24 * CAST(0.85 AS DOUBLE)) > 1 THEN 'OVER' WHEN hours / (days * 24 * CAST(0.85 AS DOUBLE)) > 0.8 THEN 'HIGH' ELSE 'OK' END AS alert
FROM used CROSS JOIN span JOIN terminals USING (terminal_id)"""
report("a27_j13_j14_berth_utilisation", "en=enriched terminals=terminals", "en terminals", _BERTH.format("datediff(max(operation_date), min(operation_date))"), _BERTH.format("date_diff('day', min(operation_date), max(operation_date))"))
report("p23_o3_worst_days", "kpi=daily_kpis", "kpi", """SELECT terminal_id, operation_date, CAST(0.4 AS DOUBLE) * coalesce(avg_arrival_delay_minutes, 0) + 2 * pct_delayed + 5 * dq_flags + 10 * storm_day AS score
  FROM kpi ORDER BY score DESC, terminal_id, operation_date LIMIT 20""")
_HEAT = "SELECT {0} AS month, {1} AS weekday, count(*) AS n, avg(arrival_delay_minutes) AS delay, count(DISTINCT operation_date) AS days FROM en WHERE operation_date IS NOT NULL GROUP BY 1, 2"
report("a28_f3_f5_seasonal_heatmap", "en=enriched", "en", _HEAT.format("date_format(operation_date, 'MMM')", "extract(dow_iso FROM operation_date)"), _HEAT.format("strftime(operation_date, '%b')", "isodow(operation_date)"))
report("a29_crane_outliers", "sa=silver_cranes", "sa", """WITH c AS (SELECT terminal_id, crane_id, count(*) AS n, avg(moves_per_hour) AS rate FROM sa WHERE crane_id IS NOT NULL AND NOT invalid_crane_time_flag GROUP BY terminal_id, crane_id),
b AS (SELECT terminal_id, avg(rate) AS mean, stddev_samp(rate) AS sd FROM c GROUP BY terminal_id)
SELECT terminal_id, crane_id, n, rate, (rate - mean) / nullif(sd, 0) AS z, CASE WHEN (rate - mean) / nullif(sd, 0) < -1.5 THEN 'LOW' WHEN (rate - mean) / nullif(sd, 0) > 1.5 THEN 'HIGH' ELSE 'NORMAL' END AS performance_flag FROM c JOIN b USING (terminal_id)""")
report("a13_w12_recent_trend", "sc=silver_calls", "sc", """WITH r AS (SELECT vessel_id, delay_hours, row_number() OVER (PARTITION BY vessel_id ORDER BY atd DESC, call_id) AS rn FROM sc WHERE atd IS NOT NULL)
SELECT vessel_id, count(*) AS n, avg(delay_hours) FILTER (WHERE rn <= 3) - avg(delay_hours) AS trend FROM r GROUP BY vessel_id""")
report("w11_severity_lag", "weather=weather", "weather", "SELECT terminal_id, weather_date, severity, severity - lag(severity) OVER (PARTITION BY terminal_id ORDER BY weather_date) AS change FROM weather")
_BERTHS_AT = """SELECT c.call_id, count(o.call_id) AS concurrent_calls, count(o.call_id) FILTER (WHERE o.vessel_class = c.vessel_class) AS same_class
FROM sc c LEFT JOIN sc o ON o.terminal_id = c.terminal_id AND o.berth_id = c.berth_id AND o.call_id <> c.call_id AND o.eta <= c.eta AND o.atd >= c.eta
WHERE c.eta IS NOT NULL GROUP BY c.call_id"""


@query("sc", _BERTHS_AT)
def j9b_j10_concurrent_calls(spark, sf_dir):
    (calls,) = medallion.from_benchmark(spark, sf_dir, "silver_calls")
    out = calls.where(F.col("eta").isNotNull()).select("call_id")
    for name, by in (("concurrent_calls", ("terminal_id", "berth_id")), ("same_class", ("terminal_id", "berth_id", "vessel_class"))):
        grouped = calls.dropna(subset=list(by)).withColumn("g", F.struct(*by))
        out = out.join(pit.stabbing_count(grouped, "g", "call_id", "eta", "atd").withColumnRenamed("n", name), "call_id", "left")
    return out.fillna(0, ["concurrent_calls", "same_class"])


report("p25_sql_label", "sc=silver_calls", "sc", "SELECT call_id, CASE WHEN atd IS NULL THEN NULL WHEN delay_hours > 0.5 THEN 1 ELSE 0 END AS label FROM sc")
report("p11_null_keeping_flag", "en=enriched", "en", "SELECT call_id, severity > 0.5 AS storm_or_null, greatest(coalesce(arrival_delay_minutes, 0), 0) AS clamped FROM en")
