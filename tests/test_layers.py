"""Writing the layers and their outputs, and reports on quality."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tallyspark.operators import checks, features
from tallyspark.plans import medallion, port_tables, registry
from tallyspark.sources import files

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('layers')}"
    names = list(port_tables.TABLES)
    tables = dict(zip(names, port_tables.load(spark, TABLES, *names)))
    return tables, folder, *medallion.run(spark, tables, folder)


def test_stages_are_made_once(spark, written):
    tables, folder, made, said = written
    assert set(said) == {s.name for s in medallion.STAGES} and set(said.values()) == {"made"}
    assert medallion.run(spark, tables, folder)[1] == dict.fromkeys(said, "kept")
    assert medallion.STAMP in spark.read.parquet(f"{folder}/features").columns and medallion.STAMP not in made["features"].columns
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/silver_moves/_SUCCESS"), False)  # as a run that ended early leaves it
    made, later = medallion.run(spark, tables, folder)
    assert {n for n, how in later.items() if how == "made"} == {"silver_moves", "enriched", "daily_kpis", "call_summary", "features"}
    rounded = lambda df: df.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes))  # noqa: E731  sums in any order
    assert rounded(made["features"]).exceptAll(rounded(registry.QUERIES["m1_m9_feature_table"](spark, TABLES))).isEmpty()


def test_outputs(spark, written):
    tables, folder, *_ = written
    made, _ = medallion.run(spark, tables, folder)
    document = medallion.write_outputs(spark, made, f"{folder}/outputs", trees=3)
    assert document["summary"]["total_checks"] == 14 and set(document["checks"]) == set(checks.RULES)
    kept = files.read_json(spark, f"{folder}/outputs/data_quality_report")
    assert kept == document
    overlaps = document["checks"]["crane_overlaps"]
    assert overlaps["threshold"] == {"warn_pct": 5, "fail_pct": 15} and overlaps["detail"]["affected"] >= len(overlaps["detail"]["sample"]) > 0
    said = checks.rendered(document)
    assert all(name.replace("_", " ") in said for name in checks.RULES) and said.startswith(f"Overall {document['overall_status']}")
    assert all(f"] {n}:" in said for n, c in document["checks"].items() if c["status"] != "PASS")
    metrics = files.read_json(spark, f"{folder}/outputs/model_metrics")
    assert set(metrics["metrics"]) == {"logistic_regression", "random_forest"} and metrics["split"]["n_test"] > 0
    importance = spark.read.option("header", True).csv(f"{folder}/outputs/feature_importance").collect()
    assert {r.feature for r in importance} == set(features.FEATURES)
    assert spark.read.option("header", True).csv(f"{folder}/outputs/terminal_kpi_sample").count() == 60
    assert len(PipelineModel.load(f"{folder}/outputs/models/random_forest").stages) == 3
