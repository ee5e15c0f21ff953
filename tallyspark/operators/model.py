"""The delay model on Spark ML: chronological split, two classifiers, metrics, importances."""

from __future__ import annotations

import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from .forest import Forest, ForestModel


def labelled(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull())


def time_split(df: DataFrame, at: str, key: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame, dict]:
    """The earliest int(n * (1 - share)) rows train, the rest test; ties by key.

    The border is found by exact ranks within the day it falls in, after a
    count for each day, so no task sorts all rows and no other day is sorted.
    """
    n = df.count()
    n_train = int(n * (1 - test_share))
    day = F.date_trunc("day", at)
    days = df.groupBy(day.alias("d")).count().orderBy("d").collect()  # one row for each day
    before, border = 0, None
    for r in days:
        if before + r["count"] > n_train:
            border = r["d"]
            break
        before += r["count"]
    if border is None:
        return df, df.limit(0), {"n_train": n, "n_test": 0, "cutoff": None}
    last = df.where(day == F.lit(border)).withColumn("_r", F.row_number().over(Window.partitionBy(day).orderBy(at, key)))
    inside = F.col("_r") <= n_train - before
    train = df.where(day < F.lit(border)).unionByName(last.where(inside).drop("_r"))
    test = df.where(day > F.lit(border)).unionByName(last.where(~inside).drop("_r"))
    return train, test, {"n_train": n_train, "n_test": n - n_train, "cutoff": str(test.agg(F.min(at)).first()[0])}


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights: n / (2 * n of the class)."""
    n, pos = df.agg(F.count("*"), F.sum(label)).first()
    pos = pos or 0
    return df.withColumn("weight", F.when(F.col(label) == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(n - pos, 1))))


def _prepared(features: list[str]) -> list:
    filled = [f"{f}_filled" for f in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw")]


def logistic(features: list[str], label: str, n_train: int, c: float = 0.5) -> Pipeline:
    lr = LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", standardization=False, regParam=1 / (c * max(n_train, 1)), maxIter=100)
    return Pipeline(stages=[*_prepared(features), StandardScaler(inputCol="raw", outputCol="x", withMean=True), lr])


def forest(features: list[str], label: str, trees: int = 300, seed: int = 42) -> Pipeline:
    rf = Forest(featuresCol="raw", labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=10, maxDepth=30, seed=seed)
    return Pipeline(stages=[*_prepared(features), rf])


def as_doubles(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in features})


def evaluate(model: PipelineModel, test: DataFrame, label: str) -> dict:
    """Accuracy, precision, recall, F1 (0 where undefined), ROC-AUC, confusion [[TN, FP], [FN, TP]], four digits."""
    scored = model.transform(test).select(label, "prediction", "rawPrediction").persist()
    cell = {(r[label], r["prediction"]): r["count"] for r in scored.groupBy(label, "prediction").count().collect()}
    tn, fp, fn, tp = (cell.get(k, 0) for k in ((0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)))
    div = lambda a, b: a / b if b else 0.0
    precision, recall = div(tp, tp + fp), div(tp, tp + fn)
    auc = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0).evaluate(scored) if (tn + fp) and (tp + fn) else 0.0
    scored.unpersist()
    out = {"accuracy": div(tn + tp, tn + fp + fn + tp), "precision": precision, "recall": recall, "f1": div(2 * precision * recall, precision + recall), "roc_auc": auc}
    return {k: round(v, 4) for k, v in out.items()} | {"confusion_matrix": [[tn, fp], [fn, tp]]}


def importances(spark: SparkSession, features: list[str], lr: PipelineModel, rf: PipelineModel) -> DataFrame:
    weights = lr.stages[-1].coefficients.toArray().tolist()
    total = sum(map(abs, weights)) or 1.0
    rows = [(f, w, abs(w) / total, g) for f, w, g in zip(features, weights, rf.stages[-1].featureImportances.toArray().tolist())]
    return spark.createDataFrame(rows, "feature string, lr_coefficient double, lr_importance double, rf_importance double").orderBy(F.col("rf_importance").desc())


def train(df: DataFrame, features: list[str], label: str, at: str, key: str, trees: int = 300) -> dict:
    """Split, both fitted models, their metrics, and importances."""
    known, drop = files.keep(as_doubles(labelled(df, label), features))
    first, test, info = time_split(known, at, key)
    weighted = with_weights(first, label)
    models = {"logistic_regression": logistic(features, label, info["n_train"]).fit(weighted), "random_forest": forest(features, label, trees).fit(weighted)}
    metrics = {name: evaluate(m, test, label) for name, m in models.items()}
    drop()
    return {"split": info, "models": models, "metrics": metrics, "importances": importances(df.sparkSession, features, models["logistic_regression"], models["random_forest"])}


def release(found: dict) -> None:
    """Frees what the models of train() keep in the cluster."""
    for fitted in found["models"].values():
        for stage in fitted.stages:
            if isinstance(stage, ForestModel):
                stage.release()


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def save_outputs(found: dict, folder: str) -> None:
    """Writes what train() returns: metrics as a document, importances as CSV, both models."""
    table = found["importances"]
    now = datetime.datetime.now(datetime.UTC).isoformat()
    files.write_json(table.sparkSession, {"run_timestamp": now, "split": found["split"], "metrics": found["metrics"]}, f"{folder}/model_metrics")
    files.write_csv(table, f"{folder}/feature_importance")
    for name, fitted in found["models"].items():
        save(fitted, f"{folder}/models/{name}")
