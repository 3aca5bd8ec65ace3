"""Interval operators: containment and overlap semi-joins, as-of lookup, gap merging, greedy choice, burst clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..sources.scratch import materialise
from .ordered import BUCKET_ROWS, cuts, number_rows, running_before


def _width(spans: DataFrame, start: str, end: str) -> int:
    """A bucket width of about two mean spans, so that a span falls into few buckets."""
    mean = spans.agg(F.avg(F.col(end) - F.col(start))).first()[0]
    return max(1, int(2 * (mean or 0)))


def _keyed(spans: DataFrame, keys: list[str], low: Column, high: Column, width: int) -> DataFrame:
    """One row per bucket from low to high (both included) that a span reaches; keys and columns get the prefix _s_."""
    renamed = spans.select(*[F.col(c).alias(f"_s_{c}") for c in spans.columns], F.floor(low / width).alias("_lo"), F.floor(high / width).alias("_hi"))
    return renamed.where("_lo <= _hi").withColumn("_s_bucket", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def _match(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, width: int) -> Column:
    same = F.floor(rows[at] / width) == spans["_s_bucket"]
    for k in keys:
        same = same & (rows[k] == spans[f"_s_{k}"])
    return same


def inside_spans(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None, outside: bool = False, extra=None, pairs: bool = False) -> DataFrame:
    """Points with start <= at < end of some span (of equal keys), or with outside=True those without; with pairs=True a row for each such span, whose columns follow.

    Spans are dealt into buckets of the axis, so the range test becomes an equality join with a residual, which Spark can hash, sort, split
    and broadcast, instead of a nested loop. extra(rows, spans) may add a condition; span columns carry the prefix _s_. Empty spans (end <= start)
    and null bounds hold nothing; null points are outside.
    """
    keys = keys or []
    spans = spans.where(F.col(end) > F.col(start))
    width = _width(spans, start, end)
    dealt = _keyed(spans, keys, F.col(start), F.col(end) - 1, width)
    same = _match(points, dealt, keys, at, width) & (points[at] >= dealt[f"_s_{start}"]) & (points[at] < dealt[f"_s_{end}"])
    if extra is not None:
        same = same & extra(points, dealt)
    return points.join(dealt, same, "inner" if pairs else "left_anti" if outside else "left_semi")


def overlapping_spans(blocks: DataFrame, spans: DataFrame, at: str, length: str, start: str, end: str, keys: list[str] | None = None, outside: bool = False) -> DataFrame:
    """Blocks [at, at + length) that overlap some span [start, end), or with outside=True those that don't.

    A block is looked up in the bucket of its start alone; spans reach so many buckets further down as the longest block is.
    """
    keys = keys or []
    spans = spans.where(F.col(end) > F.col(start))
    longest = blocks.agg(F.max(length)).first()[0] or 0
    width = max(_width(spans, start, end), longest)
    dealt = _keyed(spans, keys, F.col(start) - longest, F.col(end) - 1, width)
    same = _match(blocks, dealt, keys, at, width) & (blocks[at] < dealt[f"_s_{end}"]) & (blocks[at] + blocks[length] > dealt[f"_s_{start}"])
    return blocks.join(dealt, same, "left_anti" if outside else "left_semi")


def asof_previous(df: DataFrame, keys: list[str], order: list[str], is_anchor: Column, at: str, name: str, tolerance: int | None = None, rows: int = BUCKET_ROWS) -> DataFrame:
    """df with name: `at` of the latest earlier row that is an anchor; null if there is none, or none within 0..tolerance of the row's own `at`."""
    out = running_before(df, keys, order, {name: (F.when(is_anchor, F.col(at)), "last")}, rows)
    if tolerance is None:
        return out
    return out.withColumn(name, F.when((F.col(at) - F.col(name)).between(0, tolerance), F.col(name)))


def gap_regions(df: DataFrame, keys: list[str], start: str, end: str | None, gap: int, name: str = "region", ties: list[str] | None = None, rows: int = BUCKET_ROWS) -> DataFrame:
    """df with name: the number (from 1, per key) of the run it is in. A run ends where the next start is over `gap` beyond all ends so far.

    Without `end`, each row's start is its end too (the previous row counts, as starts are in order).
    """
    order = [start, *(ties or [])]
    reach, known = F.col(end or start), (cuts(df, start, rows),)  # the same rows are put in order twice
    before = running_before(df, keys, order, {"_reach": (reach, "max")}, rows, known)
    fresh = F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap), 1).otherwise(0).cast("long")
    out = running_before(before.withColumn("_fresh", fresh), keys, order, {name: (F.col("_fresh"), "sum")}, rows, known)
    return out.withColumn(name, F.col(name) + F.col("_fresh")).drop("_reach", "_fresh")


def _greedy(n_keys: int, start: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, until = None, 0
        for batch in batches:
            keep = []
            rows = zip(*(batch.column(i).to_pylist() for i in [*range(n_keys), start, end]), strict=True)
            for *key, a, b in rows:
                if key != group:
                    group, until = key, a
                keep.append(a >= until)
                if keep[-1]:
                    until = max(until, b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


#: Rows of a cluster that one task streams at most, and of a block of a longer one.
CHAIN_ROWS, BLOCK_ROWS = 1_000_000, 100_000


def greedy_nonoverlap(df: DataFrame, keys: list[str], start: str, end: str, ties: list[str] | None = None, rows: int = BUCKET_ROWS, chain_rows: int = CHAIN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows that a scan from low to high start accepts: each that starts at or after the end of the last accepted one.

    The choice is sequential, but never reaches over a place that no candidate spans: rows are first cut into clusters there (gap_regions), and
    clusters, not keys, are dealt to tasks, which stream their sorted rows. A cluster of over chain_rows rows is followed by pointers (_follow), in blocks of block_rows.
    Rows with null bounds are dropped; equal starts go by `ties`.
    """
    at = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    many = at.count() > chain_rows
    at = gap_regions(at, keys, start, end, 0, "_cluster", ties, rows)
    group, long = [*keys, "_cluster"], None
    if many:
        at = materialise(at)
        large = at.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chain_rows).drop("_n")
        large = materialise(large.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.monotonically_increasing_id().alias("_c")))
        same = F.lit(True)
        for c in group:
            same = same & at[c].eqNullSafe(large[f"_g_{c}"])
        long = at.join(F.broadcast(large), same).select(*df.columns, "_c")  # fewer than a row in chain_rows
        at = at.join(F.broadcast(large), same, "left_anti")
    order = at.select(*group, *[c for c in at.columns if c not in group])
    dealt = order.repartition(*group).sortWithinPartitions(*group, start, *(ties or []))
    out = dealt.mapInArrow(_greedy(len(group), order.columns.index(start), order.columns.index(end)), dealt.schema).select(*df.columns)
    return out if long is None or long.isEmpty() else out.unionByName(_follow(long, start, end, ties or [], rows, block_rows).select(*df.columns))


def _exits(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (_c, _block, _p, next) in order: (_c, _p, to), where the walk that enters a block at _p leaves it."""

    def leave(key: tuple[int, int], first: int, nexts: list[int]) -> pa.RecordBatch:
        stop, out = (key[1] + 1) * block_rows, list(nexts)
        for i in range(len(out) - 1, -1, -1):
            if out[i] <= stop and out[i] - first < len(out):
                out[i] = out[out[i] - first]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.int64()), pa.array(range(first, first + len(out)), pa.int64()), pa.array(out, pa.int64())], ["_c", "_p", "to"])

    now, first, nexts = None, 0, []
    for batch in batches:
        for c, block, p, after in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (c, block) != now:
                if now is not None:
                    yield leave(now, first, nexts)
                now, first, nexts = (c, block), p, []
            nexts.append(after)
    if now is not None:
        yield leave(now, first, nexts)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_c, _block, _p, next, enters) in order: those (_c, _p) that the walk meets in each block, from where it enters."""
    now, want = None, None
    for batch in batches:
        keep = []
        for c, block, p, after, enters in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (c, block) != now:
                now, want = (c, block), None
            if enters:
                want = p
            keep.append(p == want)
            if keep[-1]:
                want = after
        yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))


def _follow(at: DataFrame, start: str, end: str, ties: list[str], rows: int, block_rows: int) -> DataFrame:
    """greedy_nonoverlap() of long clusters (_c), each spread over many tasks.

    A row's pointer leads to the first row that may follow it; that is the row after, or the first that doesn't start before its end (a running count of starts). Blocks of rows tell, for every
    row, where a walk that enters there leaves the block. These longer pointers are doubled, so that after k rounds the blocks' entries among the first 2**k are known; within its block, each walk
    is then followed from its entry.
    """
    at = materialise(number_rows(at, ["_c"], [start, *ties], "_p", rows=rows))
    reach = F.greatest(F.col(start), F.col(end))
    marks = at.select("_c", F.col(start).alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("_p")).unionByName(at.select("_c", reach.alias("v"), F.lit(0).alias("kind"), "_p"))
    counted = running_before(marks, ["_c"], ["v", "kind"], {"before": (F.col("kind").cast("long"), "sum")}, rows).where("kind = 0")
    block = F.floor((F.col("_p") - 1) / block_rows).alias("_block")
    jumps = materialise(counted.select("_c", block, "_p", F.greatest(F.col("_p"), F.col("before")).alias("_q")).select("_c", "_block", "_p", (F.col("_q") + 1).alias("next")))
    dealt = jumps.repartition("_c", "_block").sortWithinPartitions("_c", "_block", "_p")
    leads = materialise(dealt.mapInArrow(lambda b: _exits(b, block_rows), "_c long, _p long, to long"))
    entries = materialise(at.select("_c").distinct().withColumn("_p", F.lit(1).cast("long")))
    known = 0
    while (n := entries.count()) > known:
        known = n
        entries = materialise(entries.unionByName(entries.join(leads, ["_c", "_p"]).select("_c", F.col("to").alias("_p"))).distinct())
        leads = materialise(leads.join(leads.select("_c", F.col("_p").alias("to"), F.col("to").alias("_to")), ["_c", "to"]).select("_c", "_p", F.col("_to").alias("to")))
    entering = jumps.join(entries.withColumn("enters", F.lit(True)), ["_c", "_p"], "left").select("_c", "_block", "_p", "next", F.coalesce("enters", F.lit(False)).alias("enters"))
    met = entering.repartition("_c", "_block").sortWithinPartitions("_c", "_block", "_p").mapInArrow(_walk, "_c long, _p long")
    return at.join(met, ["_c", "_p"], "left_semi")


def burst_members(df: DataFrame, keys: list[str], order: list[str], at: str, size: Column, window: int = dims.BURST_WINDOW, least: int = dims.BURST_COUNT, step: int = dims.BURST_STEP, memory: int = dims.BURST_MEMORY, rows: int = BUCKET_ROWS) -> DataFrame:
    """df with burst: the row and its latest predecessors of equal size, within `window` and each at most `step` from the next, are `least` or more.

    Only the last `memory` rows of any size are remembered. Of the remembered rows within the window that have the row's size, the chain counts only if all
    their steps (and that to the row) are small. A key of over `rows` rows is cut into blocks of so many (`memory` at least), each of which also gets the last `memory` rows of the
    block before, so that no task sorts a whole key.
    """
    rows, out, group = max(rows, memory), df.withColumn("_size", size), keys
    if df.count() > rows:
        out = number_rows(out, keys, order, "_nr", rows=rows).withColumn("_own", F.floor((F.col("_nr") - 1) / rows))
        halo = F.col("_nr") > (F.col("_own") + 1) * rows - memory
        out, group = out.withColumn("_block", F.explode(F.when(halo, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))), [*keys, "_block"]
    past = Window.partitionBy(*group).orderBy(*order).rowsBetween(-memory, -1)
    seen = F.collect_list(F.struct(F.col(at).alias("at"), F.col("_size").alias("size"))).over(past)
    out = out.withColumn("_seen", seen)
    if group != keys:
        out = out.where("_own = _block").drop("_nr", "_own", "_block")
    mine = F.array_sort(F.transform(F.filter("_seen", lambda x: (x["size"] == F.col("_size")) & (x["at"] >= F.col(at) - window) & (x["at"] <= F.col(at))), lambda x: x["at"]))
    out = out.withColumn("_chain", F.concat(mine, F.array(F.col(at))))
    steps = F.zip_with(F.slice("_chain", 2, F.size("_chain")), F.slice("_chain", F.lit(1), F.greatest(F.size("_chain") - 1, F.lit(0))), lambda b, a: b - a)
    return out.withColumn("burst", (F.size("_chain") >= least) & F.forall(F.filter(steps, lambda s: s.isNotNull()), lambda s: s <= step)).drop("_size", "_seen", "_chain")
