"""Places and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: set[str] = set()
_relieved = {"at": 0.0}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session.

    Only where the session names none and is local (tests) is one made and set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trovewise-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


def batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Let Arrow batches of the session's further plans have so many rows and bytes at most: executor and worker both hold one.

    Descriptions of plans, of which the driver keeps a thousand, end at 20,000 characters and name no fields: they repeat
    literal tables whole. That length ends only the text of a plan, not the descriptions of its nodes, which are kept and logged too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.maxPlanStringLength", 20_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 0)


def _trim(spark: SparkSession) -> bool:
    """Let the JVM give back the native memory that it has freed; False where it has no such command."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    name = jvm.java.lang.Class.forName
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for k, kind in enumerate(kinds):
        types[k] = name(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # The server's class is not exported, so its method is that of the interface.
        name("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        return False
    return True


def relieve(spark: SparkSession, every: float = 10) -> None:
    """Give the driver's unused memory back, at most once in so many seconds: garbage once its heap has grown to half of its limit, and freed native memory.

    A session of many short executions leaves garbage of plans and what their compilation freed. The heap grows with the
    first rather than to be collected, and native memory stays with the process, until neither fits beside the other.
    """
    if time.monotonic() - _relieved["at"] < every:
        return
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark.sparkContext._jvm.java.lang.System.gc()
    _trim(spark)
    _relieved["at"] = time.monotonic()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trovewise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    relieve(spark)
    return back


def rows(table: DataFrame) -> int:
    """The number of rows of a table of written(), counted once."""
    if not hasattr(table, "written_rows"):
        table.written_rows = table.count()
    return table.written_rows


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _written.discard(name)


def release(*tables: DataFrame) -> None:
    """Delete tables of written() of which nothing that is still to run reads any more."""
    _delete(tables[0].sparkSession, [t.written_path for t in tables])


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """written(build()), after which the tables that build wrote on the way are deleted."""
    before = set(_written)
    out = written(build(), name)
    _delete(out.sparkSession, [p for p in _written - before if p != out.written_path])
    return out


def clear(spark: SparkSession) -> None:
    """Delete all tables that written() made in this process; results that still read them become unusable."""
    _delete(spark, list(_written))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64-bit identity of a document row. Rows that agree in id and text are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text).isNull(), F.col(text))
