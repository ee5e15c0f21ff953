"""The layers in order: bronze, silver, gold, features, checks.  python -m tallyspark.plans.medallion TABLES OUT [STAGE...] [--again] writes them."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import checks, features, gold, model, silver
from ..sources import files
from ..sources.bronze import exists
from . import port_tables


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


STAGES = [
    Stage("silver_calls", ("bronze_calls",), silver.silver_calls),
    Stage("silver_cranes", ("cranes",), silver.silver_cranes),
    Stage("silver_moves", ("moves",), silver.clean_moves),
    Stage("enriched", ("silver_calls", "silver_cranes", "silver_moves", "weather", "terminals"), gold.enrich),
    Stage("daily_kpis", ("enriched",), gold.daily_kpis),
    Stage("call_summary", ("enriched",), gold.call_summary),
    Stage("features", ("silver_calls", "silver_cranes", "silver_moves", "weather"), features.feature_table),
]


def build(tables: dict[str, DataFrame], *wanted: str) -> dict[str, DataFrame]:
    """Adds the wanted stages, and what they need, to the given tables; nothing runs yet."""
    out = dict(tables)
    by_name = {s.name: s for s in STAGES}

    def need(name: str) -> DataFrame:
        if name not in out:
            stage = by_name[name]
            out[name] = stage.build(*(need(n) for n in stage.needs))
        return out[name]

    for name in wanted:
        need(name)
    return out


def from_benchmark(spark: SparkSession, sf_dir: str, *wanted: str) -> list[DataFrame]:
    """Stages over the tables derived from the benchmark's."""
    names = list(port_tables.TABLES)
    tables = dict(zip(names, port_tables.load(spark, sf_dir, *names)))
    made = build(tables, *wanted)
    return [made[w] for w in wanted]


def feature_nulls(feats: DataFrame) -> DataFrame:
    """The null checks of each feature; history may be short."""
    historical = ["avg_previous_10_terminal", "avg_previous_10_service", "previous_vessel_delay"]
    return checks.feature_checks(feats, [f for f in features.FEATURES if f not in historical], historical)


def quality_report(calls: DataFrame, cranes: DataFrame, summary: DataFrame, kpis: DataFrame, feats: DataFrame) -> DataFrame:
    """The fourteen checks as rows."""
    nulls = feature_nulls(feats)
    worst = nulls.groupBy().agg(checks.F.sum("n").alias("n"), checks.F.max("value").alias("value"), checks.worst(checks.F.col("status")).alias("status"))
    return checks.report(
        checks.duplicate_check(calls, "duplicate_calls", "call_id"),
        checks.call_checks(calls),
        checks.crane_checks(cranes),
        checks.orphan_check(cranes, calls, "orphan_crane_assignments", "call_id"),
        checks.duplicate_check(summary, "call_summary_grain", "call_id"),
        checks.duplicate_check(kpis, "terminal_kpi_grain", "terminal_id", "operation_date"),
        worst.select(checks.F.lit("ml_feature_nulls").alias("name"), "n", "value", "status"),
        checks.target_check(feats, "is_delayed"),
        checks.layer_check(calls, summary, feats, "call_id"),
    )


#: The time that a layer's files were written, which its readers leave out.
STAMP = "_written_ts"


def run(spark: SparkSession, tables: dict[str, DataFrame], folder: str, *wanted: str, again: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Writes the wanted stages, and what they need, as Parquet under a folder; returns the tables, and "made" or "kept" for each stage.

    A stage whose files are complete is kept, unless one that it needs was made
    in this run or again is set.
    """
    out, said = dict(tables), {}
    by_name = {s.name: s for s in STAGES}

    def need(name: str) -> None:
        if name in out:
            return
        stage, path = by_name[name], f"{folder}/{name}"
        for n in stage.needs:
            need(n)
        kept = not again and exists(spark, f"{path}/_SUCCESS") and "made" not in {said.get(n) for n in stage.needs}
        if not kept:
            files.write_layer(stage.build(*(out[n] for n in stage.needs)), path, STAMP)
        out[name], said[name] = spark.read.parquet(path).drop(STAMP), "kept" if kept else "made"

    for name in wanted or by_name:
        need(name)
    return out, said


def write_outputs(spark: SparkSession, made: dict[str, DataFrame], folder: str, trees: int = 300) -> dict:
    """The KPI sample, the report on quality and the model's outputs, from all stages; returns the report."""
    kpis = gold.kpi_contract(made["daily_kpis"])
    files.write_csv_sample(kpis, f"{folder}/terminal_kpi_sample", ["operation_date", "terminal_id"])
    calls, cranes, feats = made["silver_calls"], made["silver_cranes"], made["features"]
    rows = quality_report(calls, cranes, made["call_summary"], made["daily_kpis"], feats)
    document = checks.report_document(rows, checks.details(calls, cranes), feature_nulls(feats))
    files.write_json(spark, document, f"{folder}/data_quality_report")
    found = model.train(feats, features.FEATURES, "is_delayed", "eta", "call_id", trees)
    model.save_outputs(found, folder)
    model.release(found)
    return document


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("tables", help="folder of the benchmark's tables")
    parser.add_argument("out")
    parser.add_argument("stages", nargs="*", help="all, and the outputs, where none is named")
    parser.add_argument("--again", action="store_true", help="make stages whose files are complete, too")
    parser.add_argument("--trees", type=int, default=300)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    names = list(port_tables.TABLES)
    made, said = run(spark, dict(zip(names, port_tables.load(spark, args.tables, *names))), args.out, *args.stages, again=args.again)
    for name, how in said.items():
        print(f"{name}: {how}")
    if not args.stages:
        print(checks.rendered(write_outputs(spark, made, f"{args.out}/outputs", args.trees)))


if __name__ == "__main__":
    main()
