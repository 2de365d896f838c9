"""The inner loops of boosters and forests, in the JVM next to the blocks they read.

Kernels.java is translated by the compiler that Spark carries for its own generated code, so a cluster needs nothing
besides Spark; its classes go to the executors as a jar of the application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SOURCE = Path(__file__).with_name("Kernels.java")
_LOADED: dict[str, object] = {}  # by application


def load(spark: SparkSession):
    """The compiled kernels, whose jar has been added to the application."""
    context = spark.sparkContext
    if context.applicationId not in _LOADED:
        jvm = context._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(_SOURCE.name, _SOURCE.read_text())
        jar = os.path.join(tempfile.mkdtemp(prefix="churnspark-kernels-"), "kernels.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in compiler.getBytecodes().items():
                out.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(jar)
        made = compiler.getClassLoader().loadClass("churnspark.Kernels").getDeclaredConstructor(context._gateway.new_array(jvm.java.lang.Class, 0))
        _LOADED[context.applicationId] = made.newInstance(context._gateway.new_array(jvm.java.lang.Object, 0))
    return _LOADED[context.applicationId]


def packed(values: Sequence | np.ndarray, kind: type = np.int32) -> bytes:
    return np.ascontiguousarray(values, np.dtype(kind).newbyteorder("<")).tobytes()


ints, doubles = packed, partial(packed, kind=np.float64)


def rows_of(table: DataFrame):
    """Rows of a table for the kernels."""
    return table._jdf.javaRDD()


def frame(spark: SparkSession, rows, schema: StructType | str) -> DataFrame:
    """Rows that kernels made as a DataFrame."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return DataFrame(spark._jsparkSession.createDataFrame(rows, spark._jsparkSession.parseDataType(kind.json())), spark)


def on_disk(spark: SparkSession, rows) -> bool:
    """Whether blocks of persisted rows did not fit in memory."""
    infos = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    mine = [i for i in infos if i.id() == rows.id()]
    return not mine or any(i.diskSize() > 0 or i.numCachedPartitions() < i.numPartitions() for i in mine)
