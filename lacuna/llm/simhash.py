"""SimHash near-duplicates: pigeonhole blocks, then a check of the Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, free_name, join_hot, materialise, small_batches, table, text_slices, word_spans
from .components import connected_components

BITS = 64


def simhash_bytes(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """Fingerprints (uint64) of the texts in data."""
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    n_words = np.diff(first)
    out = np.zeros(len(n_words), np.uint64)
    if not len(starts):
        return out
    # the words of all texts joined by single spaces: a word moves to the sum of the lengths before it
    lengths = ends - starts
    to = np.concatenate(([0], np.cumsum(lengths + 1)))
    joined = np.full(to[-1], 0x20, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    joined[inside] = LOWER[data[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]]
    text = joined.tobytes()
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    ids = np.repeat(np.arange(len(n_words)), n_shingles)
    ordinal = np.arange(len(ids)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    lo = first[ids] + ordinal
    hi = np.minimum(lo + shingle, first[ids + 1])
    digest = xxhash.xxh64_intdigest
    sums = np.zeros((len(n_words), BITS), np.int64)
    for at in range(0, len(ids), 1 << 17):
        part = slice(at, at + (1 << 17))
        h = np.array([digest(text[a:b], seed) for a, b in zip(to[lo[part]].tolist(), (to[hi[part]] - 1).tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        new = np.flatnonzero(np.diff(ids[part], prepend=-1))
        sums[ids[part][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n_shingles[:, None], axis=1).view(">u8").astype(np.uint64)[:, 0]


def simhash(df: DataFrame, id_col: str, text_col: str, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row's whole text, as a signed long.

    A-Z are lower-cased; words are runs without ASCII white space; each shingle of `shingle` words,
    repeats included, is joined by spaces and hashed by XXH64; a bit is set if over half the hashes
    set it. A shorter text is one shingle of all its words; null, empty and blank texts give 0.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                fp = simhash_bytes(data, offsets, shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp)], ["id", "fp"])

    return src.mapInArrow(run, f"id {kind}, fp long")


def block_masks(n: int, distance: int) -> list[int]:
    """Masks such that any two fingerprints within distance agree under one at least.

    The bits are cut into m blocks, of which at least m - distance are untouched by any `distance`
    bits; each choice of m - distance blocks is one mask. m grows until the masks keep
    log2(n) + 2 bits, so that chance companions in a bucket stay few at any input size.
    """
    m = distance + 1
    while (m - distance) * (BITS // m) < math.log2(max(n, 2)) + 2 and m < 2 * distance + 4:
        m += 1
    edges = [BITS * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, m - distance)]


def inner_masks(mask: int, distance: int, blocks: int) -> list[int]:
    """Masks of the bits that `mask` leaves out, such that two fingerprints which agree under mask and lie within distance agree under one of them at least: those bits are cut into
    `blocks` blocks, of which blocks - distance are chosen.
    """
    bits = [i for i in range(BITS) if not mask >> i & 1]
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    cut = [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(cut, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of differing bits (bitwise_count takes the absolute value of signed numbers, hence the view)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def near_stars(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the components of distinct fps under Hamming distance; none for singles.

    A breadth-first walk that compares each newly reached fingerprint with those not yet reached,
    so memory is linear and every link of the bucket takes effect without being listed.
    """
    left, out = np.sort(fps), ([], [])
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 64):
                hit |= (differing(frontier[at : at + 64, None], left[None, :]) <= distance).any(0)
            frontier, left = left[hit], left[~hit]
            out[0].append(frontier)
            out[1].append(np.full(len(frontier), root))
    empty = np.zeros(0, fps.dtype)
    return np.concatenate([empty, *out[0]]), np.concatenate([empty, *out[1]])


def _bucket_edges(distance: int):
    """mapInArrow over rows (bucket, fp) sorted by bucket: the star edges of each bucket."""

    def edges(fp: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        near = two[differing(fp[two], fp[two + 1]) <= distance]
        found = [(np.maximum(fp[near], fp[near + 1]), np.minimum(fp[near], fp[near + 1]))]
        for k in np.flatnonzero(sizes > 2):
            found.append(near_stars(fp[cuts[k] : cuts[k + 1]], distance))
        u, v = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([t, batch.column(i).to_numpy(zero_copy_only=False)]) for i, t in enumerate(tail)]
            if not len(now[0]):
                continue
            new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            cuts = np.concatenate(([0], new))
            if len(cuts) > 1:
                yield edges(now[2][: cuts[-1]], cuts)
            tail = [x[cuts[-1] :] for x in now]
        if len(tail[0]):
            yield edges(tail[2], np.array([0, len(tail[0])]))

    return run


def near_duplicate_components(fingerprints: DataFrame, distance: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most `distance` bits.

    fingerprints has columns id and fp. Equal fingerprints are one node, whatever their number. Distinct ones
    meet in pigeonhole buckets (block_masks). In a bucket of over bucket_rows fingerprints the bits that aren't its own are cut into blocks once more (inner_masks), so that it falls into many smaller
    ones. Where those are still as large, which takes fingerprints that are alike in nearly all bits, they are dealt into
    cells, and each pair of cells is one group. So no task gathers a bucket whole and no link is lost; a group
    returns a star per local component, never all pairs. Null ids belong to their fingerprint's
    component and never name it; a component of null ids alone has a null name.
    """
    nodes = materialise(fingerprints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    size = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    masks = block_masks(size.nodes, distance)
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))
    keyed = nodes.select("fp", key.alias("b")).select(F.xxhash64("b.i", "b.k").alias("bucket"), F.col("b.i").alias("i"), "fp")
    larger = lambda df: materialise(df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows))
    large = larger(keyed)
    if large.isEmpty():
        dealt = keyed.select("bucket", F.lit(0).cast("long").alias("cell"), "fp")
    else:
        inner = F.array(*[F.array(*[F.lit(_signed(x)) for x in inner_masks(m, distance, distance + 2)]) for m in masks])
        mask = F.posexplode(F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.get(inner, F.col("i")))).alias("j", "mask")
        split = keyed.join(large, "bucket", "left").select("bucket", "fp", "n", mask)
        split = split.select(F.when(F.col("n").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "j", F.col("fp").bitwiseAND(F.col("mask")))).alias("bucket"), F.col("n").isNotNull().alias("dense"), "fp")
        cells = F.ceil(F.col("n") / bucket_rows)
        mine = F.pmod(F.xxhash64("fp", F.lit(7)), "cells")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
        pair = F.least("mine", "other") * F.col("cells") + F.greatest("mine", "other")
        dealt = split.drop("dense").join(larger(split.where("dense")), "bucket", "left").withColumn("cells", F.coalesce(cells, F.lit(1)).cast("long"))
        dealt = dealt.withColumn("mine", mine).withColumn("other", other).select("bucket", pair.alias("cell"), "fp")
    dealt = dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    edges = dealt.mapInArrow(_bucket_edges(distance), "u long, v long")
    linked = materialise(connected_components(edges).withColumnRenamed("node", "fp").join(nodes.select("fp", "least"), "fp"))
    names = linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    linked = join_hot(linked, linked.count(), names, "root", "members").select("fp", "component")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "n")
    return join_hot(fingerprints, size.rows, materialise(named), "fp", "n").select("id", "fp", "component")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, shingle: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """simhash() and near_duplicate_components() of df: (id, fp, component), one row per row of df."""
    return near_duplicate_components(materialise(simhash(df, id_col, text_col, shingle, seed)), distance)


def keep_one_per_group(df: DataFrame, id_col: str, text_col: str, shingle: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """The rows of df that stand for their component: one each, of the least id (then text hash), all columns as they are.

    Rows are told apart by id and text, so repeated and null ids do no harm; of rows equal in both one stays.
    """
    key = F.struct(F.col(id_col).alias("a"), F.xxhash64(F.col(text_col)).alias("b"))
    found = materialise(near_duplicates(df.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", shingle, seed, distance))
    stays = found.where("id = component").select(F.col("id.a").alias("_a"), F.col("id.b").alias("_b"))
    keys = stays.distinct()
    out = df.join(keys, df[id_col].eqNullSafe(keys["_a"]) & (F.xxhash64(df[text_col]) == keys["_b"]), "left_semi")
    if stays.count() == keys.count():
        return out
    digest = free_name(df, "_digest")
    return out.withColumn(digest, F.xxhash64(text_col)).dropDuplicates([id_col, digest]).drop(digest)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents; null, empty and blank texts have fingerprint zero and are linked like any other, repeated rows stay."""
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
