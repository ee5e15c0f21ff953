"""Ingestion of CSV under a declared column contract: coerce and count, quarantine, stamp."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str  # a Spark SQL type name
    nullable: bool = True
    is_key: bool = False

    def field(self) -> T.StructField:
        return T.StructField(self.name, T._parse_datatype_string(self.type), self.nullable, {"is_key": self.is_key})


def _specs(text: str) -> list[ColumnSpec]:
    """name:type, with * after a key's and ! after a required column's type."""
    kinds = {"s": "string", "l": "bigint", "d": "double", "t": "timestamp_ntz"}
    out = []
    for part in text.split():
        name, kind = part.split(":")
        out.append(ColumnSpec(name, kinds[kind[0]], kind[1:] not in ("*", "!"), kind[1:] == "*"))
    return out


#: The columns of the five sources, parents first.
SCHEMAS = {
    "terminal_metadata": _specs("terminal_id:s* terminal_name:s! berth_count:l! crane_count:l! max_vessel_class:s base_productivity_mph:d delay_bias:d latitude:d longitude:d"),
    "weather_daily": _specs("weather_date:t* terminal_id:s* wind_speed_knots:d wave_height_m:d visibility_nm:d precipitation_mm:d severity_index:d weather_impact_factor:d"),
    "vessel_calls": _specs(
        "vessel_call_id:s* vessel_id:s* vessel_name:s vessel_class:s carrier_code:s terminal_id:s* berth_id:s eta:t ata:t etd:t atd:t planned_turnaround_hours:d "
        "actual_turnaround_hours:d delay_hours:d delay_reason:s planned_cargo_teu:l actual_cargo_teu:l weather_impact_factor:d status:s record_created_at:t"
    ),
    "crane_assignments": _specs(
        "assignment_id:s* vessel_call_id:s* terminal_id:s* crane_id:s! planned_start:t planned_end:t actual_start:t actual_end:t planned_hours:d actual_hours:d "
        "productivity_moves_per_hour:d status:s"
    ),
    "container_moves": _specs(
        "move_id:s* assignment_id:s* vessel_call_id:s* terminal_id:s* crane_id:s move_type:s container_size:s container_type:s planned_move_time:t actual_move_time:t "
        "planned_duration_minutes:d actual_duration_minutes:d move_status:s"
    ),
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; the header names them."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def reconcile(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Missing columns are added as NULL, others are carried."""
    return df.withColumns({s.name: F.lit(None).cast("string") for s in specs if s.name not in df.columns})


def coerce(df: DataFrame, specs: list[ColumnSpec]) -> tuple[DataFrame, DataFrame]:
    """The typed rows, and one row that counts for each column the values that became NULL."""
    counts = df.agg(*(F.count_if(F.col(s.name).isNotNull() & F.col(s.name).try_cast(s.type).isNull()).alias(s.name) for s in specs))
    return df.withColumns({s.name: F.col(s.name).try_cast(s.type) for s in specs}), counts


def not_null_audit(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(s.name).isNull()).alias(s.name) for s in specs if not s.nullable))


def split_on_keys(df: DataFrame, specs: list[ColumnSpec]) -> tuple[DataFrame, DataFrame]:
    """Rows with all keys, and rows without."""
    bad = F.lit(False)
    for s in specs:
        if s.is_key:
            bad = bad | F.col(s.name).isNull()
    return df.where(~bad), df.where(bad)


def stamp(df: DataFrame, batch_id: str, at: datetime.datetime, system: str, file: str) -> DataFrame:
    return df.withColumns({"_ingestion_ts": F.lit(at), "_source_system": F.lit(system), "_batch_id": F.lit(batch_id), "_source_file": F.lit(file)})


def ingest(spark: SparkSession, name: str, raw: str, bronze: str, quarantine: str, specs: list[ColumnSpec] | None = None, system: str = "port_ops_raw", batch_id: str | None = None) -> dict:
    """One table from CSV to Parquet; returns its counts.  A missing file is skipped, not an error."""
    specs, batch_id = specs or SCHEMAS[name], batch_id or uuid.uuid4().hex
    path = f"{raw}/{name}.csv"
    if not exists(spark, path):
        return {"table": name, "status": "skipped", "rows_read": 0, "rows_written": 0, "rows_quarantined": 0}
    typed, coerced = coerce(reconcile(read_csv(spark, path), specs), specs)
    typed = stamp(typed, batch_id, datetime.datetime.now(datetime.UTC), system, f"{name}.csv")
    ok, bad = split_on_keys(typed, specs)
    ok.write.mode("overwrite").parquet(f"{bronze}/{name}")
    n_bad = bad.count()
    if n_bad:
        bad.withColumn("_quarantine_reason", F.lit("null_key_column")).write.mode("overwrite").parquet(f"{quarantine}/{name}_{batch_id[:8]}")
    n_ok = spark.read.parquet(f"{bronze}/{name}").count()
    return {
        "table": name, "status": "ok", "rows_read": n_ok + n_bad, "rows_written": n_ok, "rows_quarantined": n_bad,
        "coerced": {k: v for k, v in coerced.first().asDict().items() if v}, "nulls": {k: v for k, v in not_null_audit(ok, specs).first().asDict().items() if v},
    }


def ingest_all(spark: SparkSession, raw: str, bronze: str, quarantine: str) -> list[dict]:
    batch = uuid.uuid4().hex
    return [ingest(spark, name, raw, bronze, quarantine, batch_id=batch) for name in SCHEMAS]


def summary(spark: SparkSession, results: list[dict]) -> DataFrame:
    """The counts as rows, with a total."""
    rows = [(r["table"], r["status"], r["rows_read"], r["rows_written"], r["rows_quarantined"]) for r in results]
    df = spark.createDataFrame(rows, "table string, status string, rows_read long, rows_written long, rows_quarantined long")
    total = df.agg(F.lit("TOTAL").alias("table"), F.lit("").alias("status"), *(F.sum(c).alias(c) for c in df.columns[2:]))
    return df.unionByName(total)
