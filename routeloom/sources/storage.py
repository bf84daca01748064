"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (local tests), a temporary one for the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="routeloom-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; all of an application's are in one folder, which ``clear`` deletes."""
    return f"{shared_dir(spark)}/routeloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, and a lost executor costs no recompute."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` returned and that nothing reads any more, such as those of an earlier round."""
    for table in tables:
        _delete(table.sparkSession, table._settled_at)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has settled; to be called when no result is read any more."""
    _delete(spark, f"{shared_dir(spark)}/routeloom-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
