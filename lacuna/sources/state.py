"""What earlier runs have seen: hash sets and counters as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEEN, COUNTERS = "hash string", "media string, last_id bigint"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table; an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def load_seen(spark: SparkSession, folder: str, kind: str = "sha256") -> DataFrame:
    """Hashes of a kind; none before the first run."""
    return read_if_there(spark, f"{folder}/seen_{kind}", SEEN)


def load_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The last id of each media type."""
    return read_if_there(spark, f"{folder}/counters", COUNTERS)


def save(files: DataFrame, folder: str, hash_col: str = "sha256", kind: str = "sha256") -> None:
    """Append the hashes of new files."""
    files.select(F.col(hash_col).alias("hash")).where("hash IS NOT NULL").distinct().write.mode("append").parquet(f"{folder}/seen_{kind}")


def save_counters(counters: DataFrame, folder: str) -> None:
    """Replace the counters; rows are read first, so that they may come from the table itself."""
    rows = counters.select("media", "last_id").collect()  # one row a media type
    counters.sparkSession.createDataFrame(rows, COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters")


def reset(spark: SparkSession, folder: str) -> None:
    """Forget everything."""
    for kind in ("sha256", "md5"):
        spark.createDataFrame([], SEEN).write.mode("overwrite").parquet(f"{folder}/seen_{kind}")
    spark.createDataFrame([], COUNTERS).write.mode("overwrite").parquet(f"{folder}/counters")
