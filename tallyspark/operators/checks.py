"""Graded data-quality checks: one aggregate for each table, graded as rows."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grade(value: Column, warn: float | None, fail: float | None) -> Column:
    """Strictly above fail: FAIL; strictly above warn: WARN; else PASS."""
    out = F
    if fail is not None:
        out = out.when(value > fail, "FAIL")
    if warn is not None:
        out = out.when(value > warn, "WARN")
    return out.otherwise("PASS")


def worst(status: Column) -> Column:
    rank = F.max(F.when(status == "FAIL", 2).when(status == "WARN", 1).otherwise(0))
    return F.when(rank == 2, "FAIL").when(rank == 1, "WARN").otherwise("PASS")


def rate_checks(df: DataFrame, checks: list[tuple[str, Column, float | None, float | None, bool]]) -> DataFrame:
    """(name, n, value, status) for each (name, condition, warn, fail, as percent); a percentage is rounded before it is graded."""
    counted = df.agg(F.count("*").alias("_n"), *(F.count_if(c).alias(f"_{i}") for i, (_, c, *_) in enumerate(checks)))
    rows = []
    for i, (name, _, warn, fail, percent) in enumerate(checks):
        n = F.col(f"_{i}")
        value = F.coalesce(F.round(100.0 * n / F.when(F.col("_n") > 0, F.col("_n")), 2), F.lit(0.0)) if percent else n.cast("double")
        rows.append(F.struct(F.lit(name).alias("name"), n.alias("n"), value.alias("value"), grade(value, warn, fail).alias("status")))
    return counted.select(F.inline(F.array(*rows)))


def null_audit(df: DataFrame, mandatory: dict[str, bool]) -> DataFrame:
    """A row for each column that holds nulls, worst first; nulls of a mandatory column fail, others warn."""
    counted = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in mandatory))
    rows = F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(must).alias("mandatory"), F.col(f"_{c}").alias("nulls"), "n") for c, must in mandatory.items())))
    found = counted.select(rows).where("nulls > 0").withColumn("pct", 100.0 * F.col("nulls") / F.col("n"))
    return found.withColumn("verdict", F.when(F.col("mandatory"), "FAIL").otherwise("WARN")).orderBy(F.desc("mandatory"), F.desc("pct"), "field")


def duplicate_check(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows in groups that share the keys; any fails."""
    n = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("n"))
    return n.select(F.lit(name).alias("name"), "n", F.col("n").cast("double").alias("value"), grade(F.col("n"), None, 0).alias("status"))


def orphan_check(child: DataFrame, parent: DataFrame, name: str, key: str) -> DataFrame:
    n = child.join(parent.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))
    return n.select(F.lit(name).alias("name"), "n", F.col("n").cast("double").alias("value"), grade(F.col("n"), None, 0).alias("status"))


def call_checks(calls: DataFrame) -> DataFrame:
    c = F.col
    return rate_checks(calls, [
        ("missing_eta", c("missing_eta_flag"), 5, 15, True),
        ("missing_ata", c("missing_ata_flag"), 10, 25, True),
        ("invalid_arrival_sequence", c("invalid_arrival_sequence_flag"), 0, None, False),
        ("invalid_departure_sequence", c("invalid_departure_sequence_flag"), 0, None, False),
        ("large_delay_outliers", c("large_delay_outlier_flag"), 1, 5, True),
    ])


def crane_checks(cranes: DataFrame) -> DataFrame:
    return rate_checks(cranes, [("crane_end_before_start", F.col("invalid_crane_time_flag"), 2, 10, True), ("crane_overlaps", F.col("crane_overlap_flag"), 5, 15, True)])


def feature_checks(features: DataFrame, static: list[str], historical: list[str]) -> DataFrame:
    """Null rates: static features 0 and 5 percent, historical 15 and 50."""
    checks = [(f"nulls_{f}", F.col(f).isNull(), 0, 5, True) for f in static] + [(f"nulls_{f}", F.col(f).isNull(), 15, 50, True) for f in historical]
    return rate_checks(features, checks)


def target_check(features: DataFrame, label: str) -> DataFrame:
    known = features.where(F.col(label).isNotNull())
    value = F.round(100.0 * F.avg(label), 2)
    out = known.agg(F.count_if(F.col(label) == 1).alias("n"), value.alias("value"))
    status = F.when(F.col("value") > 95, "FAIL").when((F.col("value") > 60) | (F.col("value") < 5), "WARN").otherwise("PASS")
    return out.select(F.lit("target_distribution").alias("name"), "n", "value", status.alias("status"))


def layer_check(silver: DataFrame, gold: DataFrame, features: DataFrame, key: str) -> DataFrame:
    n = lambda df, name: df.agg(F.count_distinct(key).alias(name))
    counts = n(silver, "silver").crossJoin(n(gold, "gold")).crossJoin(n(features, "features"))  # one row each
    status = F.when(F.col("features") > F.col("silver"), "FAIL").when(F.col("gold") != F.col("silver"), "WARN").otherwise("PASS")
    gap = F.abs(F.col("silver") - F.col("gold"))
    return counts.select(F.lit("cross_layer_counts").alias("name"), gap.alias("n"), gap.cast("double").alias("value"), status.alias("status"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


#: What each check looks at, and its bounds, strictly above which it warns or fails.
RULES = {
    "duplicate_calls": ("Rows of the silver calls that share an id", {"fail_rows": 0}),
    "missing_eta": ("Calls without an estimated arrival", {"warn_pct": 5, "fail_pct": 15}),
    "missing_ata": ("Calls without an actual arrival", {"warn_pct": 10, "fail_pct": 25}),
    "invalid_arrival_sequence": ("Calls that depart before they arrive", {"warn_rows": 0}),
    "invalid_departure_sequence": ("Calls planned to depart before they arrive", {"warn_rows": 0}),
    "large_delay_outliers": ("Calls whose delay is beyond the outlier fence", {"warn_pct": 1, "fail_pct": 5}),
    "crane_end_before_start": ("Crane assignments that end before they start or lack a time", {"warn_pct": 2, "fail_pct": 10}),
    "crane_overlaps": ("Crane assignments that meet another of the same crane", {"warn_pct": 5, "fail_pct": 15}),
    "orphan_crane_assignments": ("Crane assignments of calls that silver doesn't have", {"fail_rows": 0}),
    "call_summary_grain": ("Rows of the call summary that share a call", {"fail_rows": 0}),
    "terminal_kpi_grain": ("Rows of the daily KPIs that share a terminal and a day", {"fail_rows": 0}),
    "ml_feature_nulls": ("Null values of the model's features", {"static": {"warn_pct": 0, "fail_pct": 5}, "historical": {"warn_pct": 15, "fail_pct": 50}}),
    "target_distribution": ("Share of delayed calls among labelled ones", {"warn_below_pct": 5, "warn_pct": 60, "fail_pct": 95}),
    "cross_layer_counts": ("Distinct calls of silver, gold and features", {"warn": "gold differs from silver", "fail": "features exceed silver"}),
}


def sampled(rows: DataFrame, name: str, key: str, most: int = 10) -> DataFrame:
    """One row: the check's name, how many distinct keys its rows have, and the least ten of them; null keys don't count."""
    ids = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id")).distinct()
    first = ids.orderBy("id").limit(most).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample"))
    return ids.agg(F.count("*").alias("affected")).crossJoin(first).select(F.lit(name).alias("name"), "affected", "sample")  # one row each


def details(calls: DataFrame, cranes: DataFrame) -> DataFrame:
    """Sample keys of the checks that point at rows; for overlaps the cranes, for orphans the calls."""
    shared = calls.groupBy("call_id").count().where("count > 1")
    return report(
        sampled(shared, "duplicate_calls", "call_id"),
        sampled(calls.where("invalid_arrival_sequence_flag"), "invalid_arrival_sequence", "call_id"),
        sampled(calls.where("large_delay_outlier_flag"), "large_delay_outliers", "call_id"),
        sampled(cranes.where("crane_overlap_flag"), "crane_overlaps", "crane_id"),
        sampled(cranes.join(calls.select("call_id").distinct(), "call_id", "left_anti"), "orphan_crane_assignments", "call_id"),
    )


def report_document(checks: DataFrame, details: DataFrame | None = None, columns: DataFrame | None = None) -> dict:
    """The report as a document: one row for each check comes to the driver, and one for each detail or feature column."""
    rows = checks.collect()
    found = {r["name"]: {"affected": r["affected"], "sample": [x for x in r["sample"].split(",") if x]} for r in (details.collect() if details is not None else [])}
    if columns is not None:
        found["ml_feature_nulls"] = {"per_column": {r["name"]: {"n": r["n"], "rate_pct": r["value"], "status": r["status"]} for r in columns.collect()}}
    statuses = [r["status"] for r in rows]
    overall = next((s for s in ("FAIL", "WARN") if s in statuses), "PASS")
    counts = {"total_checks": len(rows)} | {k: statuses.count(s) for k, s in (("passed", "PASS"), ("warned", "WARN"), ("failed", "FAIL"))}
    out = {"run_timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "overall_status": overall, "summary": counts, "checks": {}}
    for r in rows:
        description, threshold = RULES.get(r["name"], ("", None))
        out["checks"][r["name"]] = {
            "status": r["status"], "description": description, "value": r["value"], "threshold": threshold, "detail": {"n": r["n"]} | found.get(r["name"], {}),
        }
    return out


def rendered(document: dict) -> str:
    """The report for a console: a line for each check, then what is known of those that didn't pass."""
    n = document["summary"]
    lines = [f"Overall {document['overall_status']}: {n['total_checks']} checks, {n['passed']} passed, {n['warned']} warned, {n['failed']} failed", ""]
    for name, c in document["checks"].items():
        rate = isinstance(c["threshold"], dict) and any("pct" in k for k in c["threshold"])
        value = f"{c['detail']['n']} rows ({c['value']} %)" if rate else f"{c['detail']['n']} rows"
        lines.append(f"{name.replace('_', ' '):<30}  {c['status']:<4}  {value}")
    for name, c in document["checks"].items():
        if c["status"] == "PASS":
            continue
        lines += ["", f"[{c['status']}] {name}: {c['description']}"]
        detail = c["detail"]
        if detail.get("sample"):
            lines.append(f"  {detail['affected']} affected, such as {', '.join(detail['sample'])}")
        lines += [f"  {k}: {v['n']} nulls ({v['rate_pct']} %) {v['status']}" for k, v in detail.get("per_column", {}).items() if v["status"] != "PASS"]
    return "\n".join(lines)
