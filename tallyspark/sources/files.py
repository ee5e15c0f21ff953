"""Readers and sinks for tables and small documents."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bronze import exists


def read_tables(spark: SparkSession, folder: str, names: list[str], hint: str = "run the stage before") -> dict[str, DataFrame]:
    missing = [n for n in names if not exists(spark, f"{folder}/{n}")]
    if missing:
        raise FileNotFoundError(f"{', '.join(missing)} not in {folder}: {hint}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_layer(df: DataFrame, path: str, stamp: str) -> None:
    """Snappy Parquet in place of what was there, with the layer's time."""
    df.withColumn(stamp, F.current_timestamp()).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv_sample(df: DataFrame, path: str, order: list[str], n: int = 60) -> None:
    write_csv(df.orderBy(*order).limit(n), path)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """A small document as one text file, by Spark's file systems."""
    spark.createDataFrame([(json.dumps(document, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


#: Deletes a query's shuffle files when it ends; what it wrote doesn't need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as Parquet in spark.checkpoint.dir, so that later queries don't carry its plan, or persisted where that is unset; and what drops it again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        kept = df.persist()
        return kept, lambda: kept.unpersist() and None
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)

    def drop() -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return spark.read.schema(df.schema).parquet(path), drop


def holder() -> tuple[Callable[[DataFrame], DataFrame], Callable[[], None]]:
    """A function that keeps a table and drops the one that it kept before, which the new one was made from; and what drops the last."""
    drops: list[Callable[[], None]] = []

    def drop() -> None:
        while drops:
            drops.pop()()

    def hold(df: DataFrame) -> DataFrame:
        kept, drop_it = keep(df)
        drop()
        drops.append(drop_it)
        return kept

    return hold, drop
