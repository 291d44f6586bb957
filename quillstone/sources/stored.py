"""Tables that a query stores in the cluster's shared folder between its steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where each table that shared_table returned lies.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Every folder that was written and not deleted yet.
_WRITTEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one under the warehouse.

    A warehouse on a machine's own disk will do only where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.sparkContext.master
    local = master.startswith("local") and not master.startswith("local-cluster")
    if not local and (warehouse.startswith(("file:", "/")) or ":" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_quillstone"


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs one reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    _WRITTEN.add(path)
    return out


def shared_result(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Store what `make` returns, then delete the tables that it stored on the way."""
    spark, before = SparkSession.active(), set(_WRITTEN)
    out = shared_table(make(), tag)
    for path in sorted(_WRITTEN - before - {_PLACES[out]}):
        _WRITTEN.discard(path)
        delete(spark, path)
    return out


def drop_table(table: DataFrame) -> None:
    """Delete a table of shared_table that no later step reads; any other DataFrame is left alone."""
    path = _PLACES.pop(table, None)
    if path:
        _WRITTEN.discard(path)
        delete(table.sparkSession, path)


def drop_shared_tables(spark: SparkSession) -> None:
    """Delete what shared_table wrote in this application; call it once the results are stored."""
    delete(spark, f"{shared_folder(spark)}/*-{spark.sparkContext.applicationId}-*")
    _PLACES.clear()
    _WRITTEN.clear()


def delete(spark: SparkSession, pattern: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(path) or []:
        fs.delete(found.getPath(), True)
