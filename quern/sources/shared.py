"""Tables written on the way to a result, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for any path that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset, as in tests on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written and read again: the lineage is cut, and what it took isn't taken twice."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def written_by(df: DataFrame, by: str, n: int, name: str = "table") -> DataFrame:
    """df, dealt to n partitions by the hash of a column, written as n buckets and read again: what is grouped or joined by that column afterwards isn't shuffled."""
    spark, path, table = df.sparkSession, new_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files lie outside the warehouse
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        fs, path = hadoop_path(df.sparkSession, df.written_at)
        fs.delete(path, True)
