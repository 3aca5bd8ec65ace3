"""Ranked lexical search by sort-based accumulation.

Every task concatenates the (item, document, impact) triples of the terms that its documents share with items, sorts their packed keys by radix, adds up equal keys
with reduceat and keeps the best documents of each item on a heap. Items whose terms are too many to be sent to every task meet the postings in a join instead; the triples are
then range-partitioned by item and document, and summed and chosen from in the same way.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_class, join_hot, materialise, small_batches, small_slices, table, text_slices, word_spans

#: Bytes of terms: ASCII letters and digits and all of UTF-8's longer characters.
TERM_BYTE = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: The same, as a pattern of characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weight of length, in hundredths; saturation, in eighths.
LENGTH_SHARE, STEP = 90, 8
#: (item, term) pairs and bytes of terms that are sent to every task at most.
SENT_PAIRS, SENT_BYTES = 200_000, 16 << 20
#: Triples that a task sums at a time.
TRIPLES = 1 << 20
#: Postings of a term that one task joins with that term's items.
TERM_ROWS = 100_000


def terms(text: Column) -> Column:
    """The distinct terms of a text, only A-Z lower-cased; null has none."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWERED), F.lit(TERM), F.lit(0)))


def slice_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the terms of all texts, the number of each text's terms)."""
    starts, ends, first = word_spans(data, offsets, TERM_BYTE)
    joined = LOWER[data[TERM_BYTE[data]]]
    places = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(joined)]), np.diff(first)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of whole numbers below 2**bits: 16 bits at a time from the lowest on (numpy sorts 16-bit numbers by radix)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def summed(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, sum of impacts) of each pair that occurs, in order: packed keys are sorted by radix, runs added up."""
    if not len(item):
        return item, doc, impact
    low = max(1, int(n_docs - 1).bit_length())
    keys = item.astype(np.int64) << low | doc
    order = radix_order(keys, low + int(item.max()).bit_length())
    keys = keys[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[cuts] >> low, keys[cuts] & ((1 << low) - 1), np.add.reduceat(impact[order], cuts)


class Best:
    """The k best (score, id) of each item: greatest score, then least id (null last)."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def add(self, item: np.ndarray, score: np.ndarray, place: np.ndarray, ids: pa.Array) -> None:
        """Rows, place being that of the id in ids. Those that can't be among the k best of this call alone, or fall below the worst one kept, never become Python objects."""
        if not len(item):
            return
        order = np.lexsort((-score, item))
        item, score = item[order], score[order]
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        sizes = np.diff(np.append(starts, len(item)))
        worst = score[starts + np.minimum(sizes, self.k) - 1]
        known = np.array([self.kept[i][-1][0] * -1 if len(self.kept.get(i, ())) == self.k else 0 for i in item[starts].tolist()])
        stays = (score > 0) & (score >= np.repeat(np.maximum(worst, known), sizes))
        new: dict[int, list] = {}
        for i, s, x in zip(item[stays].tolist(), score[stays].tolist(), ids.take(pa.array(place[order[stays]])).to_pylist(), strict=True):
            new.setdefault(i, []).append((-s, x is None, x))
        for i, rows in new.items():
            self.kept[i] = heapq.nsmallest(self.k, [*self.kept.get(i, ()), *rows], key=lambda x: x[:2] if x[1] else x)

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        rows = [(i, x, -s) for i, kept in self.kept.items() for s, _, x in kept]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["item", "id", "score"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _count(vocabulary: list[bytes]):
    """mapInArrow over (id, text): (id, n: terms of the text, terms: indexes of those in the vocabulary, tfs: how often each occurs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v = pa.array(vocabulary, pa.large_binary()), max(1, len(vocabulary))
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                words, n = slice_terms(data, offsets)
                at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, tf = np.unique((np.repeat(np.arange(len(n)), n) * v + at)[at >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * v).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % v, tf)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), *lists], ["id", "n", "terms", "tfs"])

    return run


def _accumulate(starts: np.ndarray, items: np.ndarray, weights: np.ndarray, n_docs: int, length: int, k: int):
    """mapInArrow over the counted documents: each task's k best (item, id, score) of every item. items[starts[t]:starts[t + 1]] hold term t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(k), None
        for batch in small_slices(batches):
            kind = batch.schema.types[0]
            if not len(batch):
                continue
            n, (t, tf) = batch.column(1).to_numpy(zero_copy_only=False), (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            per_doc = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(batch)), per_doc)
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // length if length else n
            impact = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + STEP * m[doc]))
            reach = starts[t + 1] - starts[t]
            upto, ends = np.concatenate(([0], np.cumsum(reach))), np.concatenate(([0], np.cumsum(per_doc)))
            lo = 0
            while lo < len(batch):  # whole documents, about TRIPLES triples at a time
                hi = max(lo + 1, int(np.searchsorted(upto[ends], upto[ends[lo]] + TRIPLES, "right")) - 1)
                part = slice(ends[lo], ends[hi])
                r = reach[part]
                posting = np.repeat(np.arange(len(r)), r)
                ordinal = np.arange(len(posting)) - np.repeat(np.cumsum(r) - r, r)
                found, local, score = summed(items[starts[t[part]][posting] + ordinal], doc[part][posting] - lo, impact[part][posting], hi - lo)
                best.add(found, score, local + lo, batch.column(0))
                lo = hi
        if best.kept:
            yield best.batch(kind)

    return run


def _count_all():
    """mapInArrow over (id, text, row): a row (id, row, n, null, 0) of each text, and one (id, row, n, term, tf) for each of its terms."""
    names = ["id", "row", "n", "term", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            for rows, data, offsets in text_slices(batch, 1):
                words, n = slice_terms(data, offsets)
                counts = [Counter(x.to_pylist()) for x in (words.slice(a, b) for a, b in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True))]
                size = [len(c) for c in counts]
                length, each = pa.array(n.astype(np.int64)), pa.array(np.repeat(np.arange(len(n)), size))
                known = [rows.column(0), rows.column(2), length]
                found = pa.array([w.decode() for c in counts for w in c], pa.string())
                yield pa.RecordBatch.from_arrays([*known, pa.nulls(len(n), pa.string()), pa.array(np.zeros(len(n), np.int64))], names)
                yield pa.RecordBatch.from_arrays([*(c.take(each) for c in known), found, pa.array([x for c in counts for x in c.values()], pa.int64())], names)

    return run


def _choose(k: int):
    """mapInArrow over triples (item, row, id, impact) sorted by item and row, all of a pair in one task: the task's k best of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, tail, kind = Best(k), None, None
        for batch in batches:
            kind = batch.schema.types[2]
            if not len(batch):
                continue
            at = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks().to_batches()[0]
            item, row, impact = (at.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            cuts = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            best.add(item[cuts[:-1]], np.add.reduceat(impact, cuts)[:-1], cuts[:-1], at.column(2))
            tail = at.slice(int(cuts[-1]))  # the last pair may go on
        if tail is not None:
            best.add(tail.column(0).to_numpy(zero_copy_only=False)[:1], np.array([pc.sum(tail.column(3)).as_py()]), np.zeros(1, np.int64), tail.column(2))
        if best.kept:
            yield best.batch(kind)

    return run


def _ranked(found: DataFrame, k: int, items: int) -> DataFrame:
    """(item, id, score, rank) of the k best of each item, of what tasks have kept: first within groups of tasks, then among those, so that no task reads what all tasks kept."""
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    found = materialise(found)
    groups = max(1, math.isqrt(found.count() // max(1, k * items)))
    at = found.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    at = at.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_group").orderBy(*order))).where(F.col("rank") <= k)
    return at.drop("_group").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, k: int = 10, sent_pairs: int = SENT_PAIRS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(item, rank, id, score): the k rows of df of greatest score above 0 for each item, equal scores by ascending id (null last).

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A term's weight is floor(1000 ln((2N+2)/(2df+1))), its impact on a text the
    weight times (10**9 tf) div (1000 tf + 8m), with m = 10 + (90 n N) div L; N texts have a term, L is the number of all their terms, n that of the text's. Null and
    empty texts have no terms, count for nothing and are never found; an item without terms finds nothing. Rows of df with equal ids are texts of their own; rows of items with equal ids are one item with
    all their terms. Empty tables give no rows.

    Texts are read once; counts of the items' terms are kept as a table. Up to sent_pairs (item, term) pairs are sent to every task, more are joined.
    """
    spark = df.sparkSession
    small_batches(spark)
    wanted = materialise(items.select(F.col(item_col).alias("item_id"), F.explode(terms(F.col(item_text_col))).alias("term")).distinct())
    size = wanted.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    if size.pairs <= sent_pairs and size.bytes <= sent_bytes:
        return _search_sent(src, kind, wanted, k)
    return _search_joined(src, kind, wanted, k)


def _search_sent(src: DataFrame, kind: str, wanted: DataFrame, k: int) -> DataFrame:
    spark, pairs = src.sparkSession, wanted.collect()  # at most sent_pairs
    vocabulary = sorted({r.term.encode() for r in pairs})
    of_term, names = {t: i for i, t in enumerate(vocabulary)}, list(dict.fromkeys(r.item_id for r in pairs))
    of_item = {x: i for i, x in enumerate(names)}
    both = np.array([(of_term[r.term.encode()], of_item[r.item_id]) for r in pairs], np.int64).reshape(-1, 2)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    starts = np.searchsorted(both[:, 0], np.arange(len(vocabulary) + 1))
    counted = materialise(src.mapInArrow(_count(vocabulary), f"id {kind}, n long, terms array<int>, tfs array<int>"))
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    holding = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the items
    weights = np.array([weight(total.docs, holding.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    best = counted.mapInArrow(_accumulate(starts, both[:, 1], weights, total.docs, total.length, k), f"item long, id {kind}, score long")
    named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {wanted.schema['item_id'].dataType.simpleString()}")
    return _ranked(best, k, len(names)).join(F.broadcast(named), "item").select(F.col("item_id").alias("item"), "rank", "id", "score")


def _search_joined(src: DataFrame, kind: str, wanted: DataFrame, k: int) -> DataFrame:
    src = src.withColumn("row", F.monotonically_increasing_id())
    counted = materialise(src.mapInArrow(_count_all(), f"id {kind}, row long, n long, term string, tf long"))
    total = counted.where("term IS NULL").agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"), F.count(F.lit(1)).alias("rows")).first()
    names = materialise(wanted.select(F.col("item_id").alias("name")).distinct().withColumn("item", F.monotonically_increasing_id()))
    postings = counted.where("term IS NOT NULL")
    known = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    holding = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(known, "term")
    w = F.floor(1000 * F.ln((2 * F.lit(total.docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    holding = materialise(holding.select("term", "df", w.cast("long").alias("w"), (F.ceil(F.col("df") / TERM_ROWS)).cast("int").alias("salts")))
    kept = join_hot(postings, postings.count(), holding.withColumn("_n", F.col("df")), "term", "_n")
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {total.docs}L) div {max(1, total.length)}L")
    kept = kept.withColumn("m", m).withColumn("impact", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + {STEP} * m))"))
    kept = kept.select("term", F.pmod("row", "salts").cast("int").alias("salt"), "row", "id", "impact")
    asked = wanted.join(names, wanted["item_id"].eqNullSafe(names["name"])).select("term", "item").join(holding.select("term", "salts"), "term")
    asked = asked.select("term", "item", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    triples = kept.join(asked, ["term", "salt"]).select("item", "row", "id", "impact")
    dealt = triples.repartitionByRange("item", "row").sortWithinPartitions("item", "row")
    best = _ranked(dealt.mapInArrow(_choose(k), f"item long, id {kind}, score long"), k, names.count())
    return best.join(names, "item").select(F.col("name").alias("item"), "rank", "id", "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best rows of documents for every item of benchmark."""
    found = search(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{TERM}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{TERM}')) AS t FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY r, t),
i AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS v FROM p, s GROUP BY t),
m AS (SELECT d.r, doc_id, {100 - LENGTH_SHARE} + ({LENGTH_SHARE} * len(w) * nn) // l AS m FROM d, s WHERE len(w) > 0),
z AS (SELECT item_id, doc_id, r, CAST(sum(v * ((1000000000 * tf) // (1000 * tf + {STEP} * m))) AS BIGINT) AS score FROM p JOIN b USING (t) JOIN i USING (t) JOIN m USING (r) GROUP BY item_id, doc_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM z WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
