"""Searches inside the executors' JVM: ``Searches.java`` is compiled on the driver by the compiler that Spark brings for its
own generated code, and sent to the executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: By function: its class and the row that it returns.
FUNCTIONS = {
    "cardlake_solve": ("cardlake.Solve", "verdict string, nodes bigint, length bigint"),
    "cardlake_beam": ("cardlake.Beam", "solved boolean, explored bigint, length int, level int"),
}
_sent: set[str] = set()


def _send(spark: SparkSession) -> None:
    """Compiles the classes and adds their jar to the application."""
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(Path(__file__).with_name("Searches.java").read_text(encoding="utf-8"))
    path = os.path.join(tempfile.mkdtemp(prefix="cardlake-jar-"), "searches.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for name, code in compiler.getBytecodes().items():
            jar.writestr(name.replace(".", "/") + ".class", bytes(code))
    spark.sql(f"ADD JAR '{path}'")


def inlined(spark: SparkSession, name: str, *args: Column) -> Column:
    """The columns of a function's row. It comes as an array of one and is inlined, as a generator runs once a row however
    often its columns are named later."""
    if (app := spark.sparkContext.applicationId) not in _sent:
        _send(spark)
        _sent.add(app)
    cls, row = FUNCTIONS[name]
    session = spark._jsparkSession
    made = session.sharedState().jarClassLoader().loadClass(cls).newInstance()
    session.udf().register(name, made, session.parseDataType(T.ArrayType(T.StructType.fromDDL(row)).json()))
    return F.inline(F.call_udf(name, *args))
