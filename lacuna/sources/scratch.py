"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session that is one process gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        found = f"file://{tempfile.mkdtemp(prefix='lacuna-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str = "tables") -> str:
    """A path, not made yet, below the shared folder; drop_tables() takes all of an application."""
    return f"{shared_dir(spark)}/{kind}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def store(df: DataFrame) -> str:
    """The path below the shared folder where df was written as Parquet."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that JVM and Python workers hold little at a time. Every operator asks for the same sizes; kernels slice what they get (small_slices), so results and their memory don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that new_folder() named, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession, kind: str = "tables") -> None:
    """Delete all that materialise() wrote in this application. For use once results are written: DataFrames that rest on such tables can't be read any more."""
    drop_folder(spark, f"{shared_dir(spark)}/{kind}/{spark.sparkContext.applicationId}")
