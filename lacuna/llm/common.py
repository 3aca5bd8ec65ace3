"""What the training-data operators share: tables, durable intermediate results, byte-level text kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop_tables, materialise, shared_dir, small_batches, store  # noqa: F401  (for the operators)

#: Text bytes that one kernel call handles at a time (a longer text is handled alone).
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids and labels that are sent to every task at most (some MB, which the driver holds for each join); more are joined by a shuffle.
SENT_ROWS = 200_000


def join_narrow(texts: DataFrame, narrow: DataFrame, on: str, how: str = "inner", sent_rows: int = SENT_ROWS, salts: int = 16) -> DataFrame:
    """texts joined with a narrow table, which is counted first: up to sent_rows rows are broadcast, so that texts stay where they are.

    Beyond that both are shuffled by the key and the number of the texts' partition modulo `salts`, so that the rows of one frequent key are many tasks' work.
    """
    if narrow.count() <= sent_rows:
        return texts.join(F.broadcast(narrow), on, how)
    dealt = narrow.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return texts.withColumn("_salt_", F.pmod(F.spark_partition_id(), F.lit(salts))).join(dealt, [on, "_salt_"], how).drop("_salt_")


#: A key with more than this part of all rows is hot; there are HOT_SHARE of them at most, however many rows there are.
HOT_SHARE = 1000


#: Narrow rows that one task can take, whatever their keys.
TASK_ROWS = 1_000_000


def join_hot(rows: DataFrame, total: int, keyed: DataFrame, on: str, n: str, task_rows: int = 0) -> DataFrame:
    """rows (`total` of them) joined with keyed, which has one row a key and, in column n, how many of rows have it.

    The rows of hot keys (at most HOT_SHARE keys) meet theirs in a broadcast, all others in a shuffle, so that no task gets a hot key whole. Null keys join nothing. Up to task_rows rows there is
    no need for that: any key's rows are few enough for a task.
    """
    if total <= task_rows:
        return rows.join(keyed.drop(n), on)
    hot, rest = keyed.where(F.col(n) > F.lit(total // HOT_SHARE)), keyed.where(F.col(n) <= F.lit(total // HOT_SHARE))
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(cold).drop(n)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, such that df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def small_slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows` rows and about `size` bytes, so that what a kernel turns into Python objects stays small at any session setting."""
    for batch in batches:
        step = max(1, min(rows, len(batch) * size // max(1, batch.nbytes)))
        for lo in range(0, len(batch), step):
            yield batch.slice(lo, step)


def least_hash_part(df: DataFrame, id_col: str, rows: int, seed: int) -> DataFrame:
    """About `rows` rows of df, all those below some hash of the id; all of df if it has no more than twice as many."""
    total = df.count()
    return df if total <= 2 * rows else df.where(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)) < int(-(2**63) + 2**64 * (rows / total)))


def least_hash_rows(df: DataFrame, id_col: str, rows: int, seed: int, *ties: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[Row]:
    """At most `rows` rows of df, those of least hash of the id (then by `ties`): the same at every partitioning.

    df is counted first, so that tasks pass on about twice the rows asked for, however many tasks there are.
    `then` (which keeps the id) turns the rows that may be chosen into those returned.
    """
    df, order = least_hash_part(df, id_col, 2 * rows, seed), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    return then(df).withColumn("_order", order).orderBy("_order", *ties).drop("_order").limit(rows).collect()


def filter_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.RecordBatch, int], np.ndarray]]) -> DataFrame:
    """The rows of df, all columns as they are, for which a function of (batch, place of the text column) is true; `make` gives one to each task."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in small_slices(batches):
            yield batch.filter(pa.array(keep(batch, at)))

    return df.mapInArrow(run, df.schema)


def text_slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batch of about limit text bytes: (rows, bytes of the column, offsets into them). Null is empty."""
    col = batch.column(column)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def byte_class(pattern_bytes) -> np.ndarray:
    """A table of 256 booleans, true for the given bytes."""
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Bytes of words that only ASCII white space (space, tab to carriage return) ends.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each text (and the end) the index of its first word."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
