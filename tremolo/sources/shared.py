from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder for a local session that names none.
LOCAL: dict[str, str] = {}
#: Tables that written() made and sweep() has not deleted, by application.
WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for state shared by its machines, in spark.checkpoint.dir. Without one, a
    temporary folder serves a local master; on a cluster, where machines would not see each other's, it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    name = spark.sparkContext.applicationId
    if name not in LOCAL:
        LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return LOCAL[name]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what reads it does not run df again, and a lost executor costs reading again
    only. It stays until sweep(), as lazy results read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tremolo-{name}-{uuid.uuid4().hex}"
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    fs, target = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder by Spark's own file systems; False if it was not there."""
    fs, target = _at(spark, path)
    return fs.delete(target, True)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that written() made in this application, and tell how many. Call it when the results that read
    them are themselves written or collected."""
    paths = WRITTEN.pop(spark.sparkContext.applicationId, [])
    return sum(remove(spark, path) for path in paths)
