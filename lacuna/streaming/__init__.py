"""Streaming forms: resumable deduplication and ids, manifest and request streams, periodic refresh, and (by analogy) sessions and tumbling windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import manifest as M


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier row of the stream had. State never expires: a key stays known across restarts from one checkpoint."""
    return stream.dropDuplicates([key])


def with_running_ids(stream: DataFrame, media: str, order: str, name: str = "id", lanes: int = 1) -> DataFrame:
    """stream with name: 1, 2, ... per media type in order of arrival, by `order` within a batch; the counters are state.

    One media type is one state key. With lanes > 1 a type is dealt into that many lanes, whose ids are interleaved (lane, lane + lanes, ...): unique, and dense per
    lane, so that a type with most of the rows isn't one task's work.
    """
    lane = F.pmod(F.xxhash64(order), F.lit(lanes))
    schema = stream.schema.simpleString()[len("struct<") : -1]

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(order)
        rows[name] = (n + pd.RangeIndex(len(rows))) * lanes + key[1] + 1
        state.update((n + len(rows),))
        yield rows.drop(columns=["_lane"])

    dealt = stream.withColumn("_lane", lane)
    return dealt.groupBy(media, "_lane").applyInPandasWithState(number, f"{schema},{name}:bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def manifest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Valid rows of the JSON-lines files that appear in a folder."""
    return M.parse_manifest(M.lines(spark, folder, stream=True)).where("kind = 'valid'").drop("kind", "line")


def request_stream(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects) of a folder of line-delimited JSON requests; lines that are no objects are rejects."""
    rows = M.lines(spark, folder, stream=True)
    kind = M.kind_of(F.col("line"))
    fields = F.from_json("line", "jsonrpc string, id string, method string, params string")
    return rows.where(kind == "valid").select("line", fields.alias("r")).select("r.*"), rows.where(kind == "invalid").select("line")


def reply_code(method, known: tuple[str, ...]) -> F.Column:
    """0 for a known method, -32600 without one, -32601 for others."""
    return F.when(method.isNull() | (method == ""), -32600).when(method.isin(*known), 0).otherwise(-32601)


def tumbling_bands(stream: DataFrame, time: str, value: str, width: str, delay: str) -> DataFrame:
    """Counts and the mean of value per tumbling window (the time analogue of strided blocks), for rows at most `delay` late."""
    at = stream.withWatermark(time, delay).groupBy(F.window(time, width))
    return at.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select("window.start", "window.end", "n", "mean")


def sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Runs per key whose rows lie less than `gap` apart (the time analogue of gap-merged regions), for rows at most `delay` late."""
    at = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key)
    return at.agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last")).select(key, F.col("session_window.start").alias("start"), "last", "n")


def refreshed_join(stream: DataFrame, load, on: str, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Joins each batch with what load() returns then (a table that changes), appending Parquet to sink; every: '30 seconds', or once over all there is."""

    def batch(df: DataFrame, _: int) -> None:
        df.join(load(), on, "left").write.mode("append").parquet(sink)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is now, into Parquet; the sink's rows. Running it again goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(sink)
