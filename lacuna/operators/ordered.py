"""Running aggregates in the order of a column, without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of the ordering column should hold.
BUCKET_ROWS = 200_000
#: Buckets that the ordering column is cut into at most.
MOST_BUCKETS = 4096


def with_buckets(df: DataFrame, order: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """df with _bucket: the ordering column cut at quantiles into ranges of about `rows` rows (MOST_BUCKETS at most), ascending; null where it is null.

    The quantiles come from one mergeable sketch, so rows that crowd in a small part of the range are spread like any others; only rows of one and the same value stay together.
    """
    return _bucketed(df, order, cuts(df, order, rows) or [])


def cuts(df: DataFrame, order: str, rows: int = BUCKET_ROWS) -> list | None:
    """The places at which with_buckets() cuts the ordering column; None where all rows are one bucket."""
    n, every = df.agg(F.count(order), F.count(F.lit(1))).first()
    wanted = min(MOST_BUCKETS, n // rows + 1)
    if wanted == 1:
        return None if n == every else []
    return sorted(set(df.agg(F.percentile_approx(order, [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0]))


def _bucketed(df: DataFrame, order: str, splits: list) -> DataFrame:
    return df.withColumn("_bucket", F.when(F.col(order).isNotNull(), reached(splits, F.col(order))))


def reached(splits: list, at: Column) -> Column:
    """How many of the ascending splits are at most `at`, by halving."""
    if not splits:
        return F.lit(0)
    all_ = F.array(*map(F.lit, splits))

    def halve(range_: Column, _: Column) -> Column:
        lo, hi = range_["lo"], range_["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        above = F.get(all_, mid) <= at
        return F.struct(F.when((lo < hi) & above, mid + 1).otherwise(lo).alias("lo"), F.when((lo < hi) & ~above, mid).otherwise(hi).alias("hi"))

    steps = F.array(*[F.lit(i) for i in range(len(splits).bit_length())])
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi")), halve, lambda r: r["lo"])


def running_before(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Column, str]], rows: int = BUCKET_ROWS, known: tuple[list | None] | None = None) -> DataFrame:
    """df with a column per value: its aggregate over the rows of the same keys that stand before, in `order`.

    A value is (column, kind): 'max', 'sum' (0 at the start) or 'last' (the latest not null). Aggregates run within
    buckets of the first ordering column; bucket totals, one small row each, carry over. Rows equal in all of `order` count in some order: give a
    unique one. Null orders come first, in a bucket of their own. Where all rows are one bucket, nothing has to be carried over. known: a tuple of cuts(), where they are known already.
    """
    (splits,) = known or (cuts(df, order[0], rows),)
    if splits is None:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        plain = {"max": lambda c: F.max(c).over(window), "sum": lambda c: F.coalesce(F.sum(c).over(window), F.lit(0)), "last": lambda c: F.last(c, ignorenulls=True).over(window)}
        return df.select(*df.columns, *[plain[kind](c).alias(n) for n, (c, kind) in values.items()])
    at = _bucketed(df, order[0], splits)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    seq = F.struct(*order)
    one = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    whole = {"max": F.max, "sum": F.sum, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), seq))}
    totals = at.groupBy(*keys, "_bucket").agg(*[whole[kind](c).alias(f"_t_{n}") for n, (c, kind) in values.items()])
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), *[one[kind](F.col(f"_t_{n}")).over(outer).alias(f"_p_{n}") for n, (_, kind) in values.items()])
    at = at.withColumns({f"_l_{n}": one[kind](c).over(inner) for n, (c, kind) in values.items()})
    same = at["_bucket"].eqNullSafe(totals["_b"])
    for k in keys:
        same = same & at[k].eqNullSafe(totals[f"_k_{k}"])
    at = at.join(totals, same, "left")
    both = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "last": F.coalesce}
    at = at.withColumns({n: both[kind](F.col(f"_l_{n}"), F.col(f"_p_{n}")) for n, (_, kind) in values.items()})
    return at.select(*df.columns, *values)


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, base: int = 0, rows: int = BUCKET_ROWS) -> DataFrame:
    """df with name: 1, 2, ... within each key in the given order, plus base; as row_number(), but over buckets."""
    return running_before(df, keys, order, {name: (F.lit(1).cast("long"), "sum")}, rows).withColumn(name, F.col(name) + 1 + base)
