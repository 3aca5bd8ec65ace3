"""First-occurrence deduplication, dense ids, seen-state, last-wins lookups, top-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import BUCKET_ROWS, number_rows


def flag_first(df: DataFrame, key: Column, seq: str, name: str = "is_first") -> DataFrame:
    """df with name: whether the row has the least seq of its key. The least is aggregated (one row a key and task), then joined
    back, so that a key with very many rows isn't sorted in one task."""
    at = df.withColumn("_key", key)
    least = at.groupBy("_key").agg(F.min(seq).alias("_least")).withColumnRenamed("_key", "_of")
    joined = at.join(least, at["_key"].eqNullSafe(least["_of"]))
    return joined.withColumn(name, F.col(seq).eqNullSafe(F.col("_least"))).select(*df.columns, name)


def first_of(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The rows of least seq of each key."""
    return flag_first(df, key, seq, "_first").where("_first").drop("_first")


def assign_ids(df: DataFrame, media: list[str], seq: str, base: int = 0, name: str = "id", rows: int = BUCKET_ROWS) -> DataFrame:
    """Sequential ids per media type over all attempts (duplicates take one too, so kept rows may show gaps)."""
    return number_rows(df, media, [seq], name, base, rows)


def not_seen(df: DataFrame, state: DataFrame, key: Column, state_key: str) -> DataFrame:
    """Rows whose key no earlier run has recorded."""
    seen = state.select(F.col(state_key).alias("_seen")).distinct()
    return df.join(seen, key == seen["_seen"], "left_anti")


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: that of greatest seq."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def top_one(df: DataFrame, score: Column, *ties: Column) -> DataFrame:
    """The row of greatest score, ties by the given order."""
    return df.orderBy(score.desc(), *ties).limit(1)


def limit_or_all(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; all of them if n is 0."""
    return df.limit(n) if n else df
