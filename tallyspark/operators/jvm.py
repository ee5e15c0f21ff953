"""Java that runs in the executors: compiled by the Janino that Spark ships, sent to them as a jar."""

from __future__ import annotations

import os
import uuid
import zipfile

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: For an application and source: the loader of its classes.
_loaded: dict[tuple[str, str], JavaObject] = {}


def instance(spark: SparkSession, source: str, name: str) -> JavaObject:
    """A new object of the class of that name in the Java file beside this module."""
    sc = spark.sparkContext
    key = (sc.applicationId, source)
    if key not in _loaded:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), source), encoding="utf-8") as f:
            compiler.cook(f.read())
        jar = os.path.join(sc._temp_dir, f"{source}-{uuid.uuid4().hex}.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for found, code in dict(compiler.getBytecodes()).items():
                z.writestr(found.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(f"file://{jar}")
        _loaded[key] = compiler.getClassLoader()
    return _loaded[key].loadClass(name).newInstance()


def map_partitions(df: DataFrame, function: JavaObject, schema: str) -> DataFrame:
    """Rows of Spark's MapPartitionsFunction over df."""
    sql = df.sparkSession._jvm.org.apache.spark.sql
    return DataFrame(df._jdf.mapPartitions(function, sql.Encoders.row(sql.types.StructType.fromDDL(schema))), df.sparkSession)
