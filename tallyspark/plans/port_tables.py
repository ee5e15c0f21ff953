"""Container-terminal tables derived from the benchmark tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MIN = "INTERVAL '1' MINUTE * CAST({} AS INT)"

_CALLS = f"""
SELECT o_orderkey AS call_id, o_custkey AS vessel_id, o_orderpriority AS carrier,
  concat('T', CAST(o_custkey % 5 AS STRING)) AS terminal_id, concat('B', CAST(o_custkey % 3 AS STRING)) AS berth_id,
  o_orderstatus AS vessel_class,
  CASE WHEN o_orderkey % 67 <> 0 THEN o_orderdate + {_MIN.format("o_orderkey % 1440")} END AS eta,
  CASE WHEN o_orderkey % 53 <> 0 THEN o_orderdate + {_MIN.format("o_orderkey % 1440 + o_orderkey * 37 % 601 - 120")} END AS ata,
  CASE WHEN o_orderkey % 67 <> 0 THEN o_orderdate + {_MIN.format("o_orderkey % 1440 + 1440 - CASE WHEN o_orderkey % 89 = 0 THEN 1500 ELSE 0 END")} END AS etd,
  CASE WHEN o_orderkey % 71 <> 0 THEN o_orderdate + {_MIN.format("o_orderkey % 1440 + o_orderkey * 37 % 601 - 120 + CASE WHEN o_orderkey % 83 = 0 THEN -60 ELSE 900 + o_orderkey * 11 % 1500 END")} END AS atd,
  CAST(o_orderkey * 37 % 601 - 120 AS DOUBLE) / 64 + CASE WHEN o_orderkey % 401 = 0 THEN 60 ELSE 0 END AS delay_hours,
  CAST(24 AS DOUBLE) AS planned_turnaround_hours, CAST(o_orderkey % 3000 AS BIGINT) AS planned_teu, CAST(o_orderkey * 7 % 3100 AS BIGINT) AS actual_teu,
  CASE o_orderkey % 4 WHEN 0 THEN 'weather' WHEN 1 THEN 'congestion' WHEN 2 THEN 'mechanical' ELSE 'none' END AS delay_reason,
  CASE WHEN o_orderkey % 17 = 0 THEN 'in_progress' ELSE 'completed' END AS status, o_orderdate AS created_at
FROM orders"""

#: Name to SQL over the benchmark tables; later ones use earlier ones.
TABLES = {
    "terminals": """
SELECT concat('T', CAST(r_regionkey AS STRING)) AS terminal_id, r_name AS terminal_name, CAST(r_regionkey + 2 AS BIGINT) AS berth_count,
  CAST(r_regionkey * 2 + 4 AS BIGINT) AS crane_count FROM region""",
    "vessel_calls": _CALLS,
    "bronze_calls": """
SELECT * FROM vessel_calls UNION ALL
SELECT call_id, vessel_id, carrier, terminal_id, berth_id, vessel_class, eta, ata, etd, atd, delay_hours + 1 AS delay_hours, planned_turnaround_hours,
  planned_teu, actual_teu, delay_reason, status, created_at + INTERVAL '6' HOUR AS created_at FROM vessel_calls WHERE call_id % 97 = 0""",
    "cranes": f"""
SELECT l_orderkey * 10 + l_linenumber AS assignment_id, l_orderkey + CASE WHEN max(l_partkey) % 501 = 0 THEN 100000000 ELSE 0 END AS call_id,
  concat('T', CAST(l_orderkey % 5 AS STRING)) AS terminal_id,
  CASE WHEN max(l_partkey) % 61 <> 0 THEN concat('C', CAST(l_orderkey % 5 AS STRING), '-', CAST(max(l_partkey) % 9 AS STRING)) END AS crane_id,
  CASE WHEN max(l_partkey) % 97 <> 0 THEN max(l_shipdate) + {_MIN.format("max(l_partkey) % 1440")} END AS actual_start,
  CASE WHEN max(l_partkey) % 103 <> 0 THEN max(l_shipdate) + {_MIN.format("max(l_partkey) % 1440 + max(l_quantity) * 9 - CASE WHEN max(l_partkey) % 50 = 0 THEN 600 ELSE 0 END")} END AS actual_end,
  max(l_quantity) / 5 AS planned_hours, 20 + max(l_quantity) / 4 AS moves_per_hour
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "moves": """
SELECT event_id AS move_id, user_id AS call_id, CASE event_type WHEN 'error' THEN 'cancelled' WHEN 'signup' THEN 'deferred' ELSE 'completed' END AS move_status,
  CASE WHEN event_id % 41 = 0 THEN -value WHEN event_id % 43 = 0 THEN NULL ELSE value END AS actual_minutes, CAST(event_id % 50 AS DOUBLE) AS planned_minutes, ts AS moved_at
FROM events""",
    "weather": """
SELECT t.terminal_id, d.day AS weather_date,
  CAST((extract(day FROM d.day) * 7 + extract(month FROM d.day) * 13 + t.berth_count * 29) % 100 AS DOUBLE) / 100 AS severity
FROM terminals t CROSS JOIN (SELECT DISTINCT date_trunc('day', coalesce(ata, eta)) AS day FROM vessel_calls) d
WHERE d.day IS NOT NULL AND extract(day FROM d.day) <> 31""",
}

_NEEDS = {"vessel_calls": ["orders"], "terminals": ["region"], "bronze_calls": ["vessel_calls"], "cranes": ["lineitem"], "moves": ["events"], "weather": ["terminals", "vessel_calls"]}


def _order(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for need in [*_order([x for x in _NEEDS[n] if x in TABLES]), n]:
            if need not in out:
                out.append(need)
    return out


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The derived tables as DataFrames; views carry the names."""
    for n in _order(names):
        for raw in _NEEDS[n]:
            if raw not in TABLES:
                spark.read.parquet(f"{sf_dir}/{raw}.parquet").createOrReplaceTempView(raw)
        spark.sql(TABLES[n]).createOrReplaceTempView(n)
    return [spark.table(n) for n in names]


def with_tables(names: str, sql: str) -> str:
    """SQL for the oracle: the derived tables as CTEs before a query, whose own CTEs follow them."""
    ctes = ",\n".join(f"{n} AS ({TABLES[n]})" for n in _order(names.split()))
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        raise ValueError("not needed here")
    return f"WITH {ctes},\n{sql[4:].lstrip()}" if sql.upper().startswith("WITH") else f"WITH {ctes}\n{sql}"
