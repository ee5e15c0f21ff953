"""Helpers shared by the operators: inputs, written intermediates, column binding."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and RE2 character class body.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch sent to Python, so that long texts don't add up."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


#: Text bytes of a batch that Python works on at once; a single text may be longer.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch sent to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches where their texts, in column number `text`, reach so many bytes."""
    for batch in batches:
        if batch.column(text).nbytes <= limit:
            yield batch
            continue
        at, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if i > at and held + n > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


#: What a Python worker keeps for later tasks of one operator.
_held: dict[Hashable, Any] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)  # of glibc


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's object of that name, made where there is none; what it kept for other operators goes."""
    if name not in _held:
        freed()
        _held[name] = make()
    return _held[name]


def freed() -> None:
    """Gives back what a worker keeps, and unused memory: Spark uses a worker for later stages too, where it would add up."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    _trim(0)


#: Deletes a query's shuffle files when it ends; what it wrote doesn't need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it again.  Returns it and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes written intermediates that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that columns of df have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")
