"""N-gram Jaccard join by a blocked sparse matrix product of documents by n-grams.

Rows of the incidence matrix are distinct sets of n-grams. Pairs that can reach the bound are so alike that, with the space of n-grams cut into more cells than the two may differ in
(which follows from their sizes), they agree in a whole cell; sets that agree in a cell belong to one block of rows. Each block's product with its own transpose
is accumulated row by row, rare n-grams first, one block of columns after the other; a pair is given up as soon as its count and what is left can't reach the bound of its sizes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, TASK_ROWS, join_hot, join_narrow, materialise, small_batches, small_slices, table, text_slices, word_spans
from .components import connected_components

#: N-grams of a block of rows; larger blocks are dealt into cells, each pair of which is a task's work.
BLOCK_NGRAMS = 1 << 17
#: Entries of the product that are accumulated at a time.
ENTRIES = 1 << 22
#: N-grams of a cell that is too small to tell much.
WEAK = 2
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers whose output bits all hang on all input bits."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: Bytes of words that are hashed at a time, and of a word that is hashed on its own.
HASHED, LONG_WORD = 1 << 20, 512
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    n = HASHED + LONG_WORD
    return tuple(np.concatenate((np.ones(1, _U), np.cumprod(np.full(n, x % (1 << 64), _U)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[places[i]:places[i + 1]]: a polynomial of the bytes, from sums over all of them at once, and the length, mixed. Words beyond LONG_WORD bytes, of which there are few, are
    hashed by XXH3, as polynomials modulo a power of two have known collisions among long texts.
    """
    up, down = _powers()
    length = np.diff(places)
    out = np.empty(len(length), _U)
    lo = 0
    while lo < len(length):
        hi = max(lo + 1, int(np.searchsorted(places, places[lo] + HASHED, "right")) - 1)
        a, b = int(places[lo]), int(places[hi])
        if b - a <= HASHED:
            sums = np.concatenate((np.zeros(1, _U), np.cumsum((data[a:b].astype(_U) + _U(1)) * up[: b - a])))
            at = places[lo : hi + 1] - a
            out[lo:hi] = (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]
        lo = hi
    out = mixed(out + mixed(length.astype(_U)))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[places[i] : places[i + 1]].tobytes())
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts, text after text, ascending in each; where each text's begin, and the end)."""
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    n_words = np.diff(first)
    hashed = word_hashes(LOWER[data[NOT_SPACE[data]]], np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64))))
    out, last = np.full(len(hashed), size, _U), np.repeat(first[1:], n_words)
    for k in range(size):  # a shingle that its text ends takes nothing in for the words that aren't there
        word = np.append(hashed[k:], np.zeros(min(k, len(hashed)), _U)) + _U(_BASE)
        word[np.arange(len(hashed)) + k >= last] = 0
        out = mixed(out + word)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    keep = np.arange(len(hashed)) < np.repeat(first[:-1] + n, n_words)
    out, cuts = out[keep], np.concatenate(([0], np.cumsum(n)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[cuts[:-1][n > 0]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[cuts]


def band_starts(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Least sizes of bands such that two sizes which may link lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1))
    return np.array(out)


def most_differing(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The most n-grams in which a set of `sizes` or fewer n-grams and one that isn't smaller may differ and still link."""
    return (sizes + 100 * sizes // percent) * (100 - percent) // (100 + percent)


def cell_signatures(hashes: np.ndarray, cuts: np.ndarray, scheme: np.ndarray, differing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, how many each set has) of sets (as shingle_sets() gives them) under a scheme each; a scheme of no differing n-grams has none, as equal sets are one.

    The space is cut into more cells than n-grams may differ, so at least 1 + spare of them agree. Signatures of cells of up to WEAK n-grams are left out where a set has no more
    than `spare` of these; otherwise the set gives them all.
    """
    spare = np.where(differing >= 8, 1 + differing // 32, 0)
    cells = np.where(differing > 0, differing + 1 + spare, 0)
    sizes = np.diff(cuts)
    upto = np.concatenate(([0], np.cumsum(cells)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    used = cells[owner] > 0
    owner, h = owner[used], hashes[used]
    cell = upto[owner] + (((h >> _U(32)) * cells[owner].astype(_U)) >> _U(32)).astype(np.int64)
    new = np.flatnonzero(np.diff(cell, prepend=-1))
    count, total = np.zeros(upto[-1], np.int64), np.zeros(upto[-1], _U)
    if len(new):
        count[cell[new]] = np.diff(np.append(new, len(cell)))
        total[cell[new]] = np.add.reduceat(mixed(h), new)
    of = np.repeat(np.arange(len(sizes)), cells)
    ordinal = np.arange(len(of)) - upto[of]
    signature = mixed(total + mixed(scheme[of].astype(_U) << _U(40) | ordinal.astype(_U)))
    weak = count <= WEAK
    n_weak = np.bincount(of[weak], minlength=len(sizes))
    stays = ~weak | (n_weak > spare)[of]
    return signature[stays].view(np.int64), np.bincount(of[stays], minlength=len(sizes))


def _describe(size: int, percent: int):
    """mapInArrow over (id, row, text): n, the set's digest (null if empty), the digest's low half and, for the first of equal sets in a task, its signatures under the schemes of its own band of sizes and the band below."""
    starts = band_starts(percent)
    differing = np.append(most_differing(starts[1:] - 1, percent), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 2):
                hashes, cuts = shingle_sets(data, offsets, size)
                n = np.diff(cuts)
                raw = hashes.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if a < b else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                fresh = np.array([d is not None and d not in seen and not seen.add(d) for d in digests], bool)
                band = np.searchsorted(starts, n, "right") - 1
                own, below = (cell_signatures(hashes, cuts, b, np.where(fresh & (b >= 0), differing[b], 0)) for b in (band, band - 1))
                ends = [np.concatenate(([0], np.cumsum(x[1]))) for x in (own, below)]
                lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(x[0])) for e, x in zip(ends, (own, below), strict=True)]
                node = pa.array([None if d is None else int.from_bytes(d[8:], "big", signed=True) for d in digests], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(digests, pa.binary()), node, *lists], ["id", "row", "n", "digest", "node", "own", "below"])

    return run


def _sets(size: int):
    """mapInArrow over (text, uid, block, cells, digest): (uid, block, cells, set) of the texts that have the digest, each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 0):
                hashes, cuts = shingle_sets(data, offsets, size)
                raw = hashes.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                stays = pa.array([xxhash.xxh3_128_digest(s) == d and u not in seen and not seen.add(u) for s, d, u in zip(sets, rows.column(4).to_pylist(), rows.column(1).to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([*rows.columns[1:4], pa.array(sets, pa.binary())], ["uid", "block", "cells", "set"])
                yield out.filter(stays)

    return run


class Product:
    """The product of a block of sets with its own transpose, a row at a time."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, np.array([len(s) for s in sets], np.int64)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(column)
        self.cuts = np.concatenate(([0], np.cumsum(self.size)))
        self.column = column
        self.often = often
        rows = np.repeat(np.arange(len(sets)), self.size)
        self.postings = rows[np.argsort(column, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(often)))

    def links(self, i: int, left: np.ndarray) -> np.ndarray:
        """The rows, of those left, that link with row i."""
        p, a = self.percent, self.size[i]
        alive = np.flatnonzero(left & (p * self.size <= 100 * a) & (p * a <= 100 * self.size))
        if not len(alive):
            return alive
        need = -(-p * (a + self.size[alive]) // (100 + p))
        columns = self.column[self.cuts[i] : self.cuts[i + 1]]
        columns = columns[np.argsort(self.often[columns], kind="stable")]  # rare ones first
        reach = self.often[columns]
        upto = np.cumsum(reach)
        # overlap is at least need.min(): of so many columns from the rarest on, a pair has one in common
        done, ahead, counts = 0, int(a - need.min() + 1), np.zeros(len(self.size), np.int64)
        while done < len(columns) and len(alive):
            behind = upto[done - 1] if done else 0
            stop = min(len(columns), max(done + 1, int(np.searchsorted(upto, behind + ENTRIES, "right"))), ahead if done < ahead else len(columns))
            r = reach[done:stop]
            ordinal = np.arange(upto[stop - 1] - behind) - np.repeat(np.cumsum(r) - r, r)
            counts += np.bincount(self.postings[np.repeat(self.starts[columns[done:stop]], r) + ordinal], minlength=len(counts))
            done = stop
            can = counts[alive] + (len(columns) - done) >= need
            if done <= ahead:
                can &= counts[alive] > 0 if done == ahead else True
            alive, need = alive[can], need[can]
        return alive


def linked_rows(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Edges (row, first row) of the components of rows under the bound; none for rows that link with nothing. Each row is multiplied once at most, with the rows that aren't reached yet."""
    product, left, out = Product(sets, percent), np.ones(len(sets), bool), ([], [])
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], frontier = False, [root]
        while frontier and left.any():
            hit = product.links(frontier.pop(), left)
            left[hit] = False
            out[0].extend(hit.tolist())
            out[1].extend([root] * len(hit))
            frontier.extend(hit.tolist())
    return out


def _block_edges(percent: int):
    """mapInArrow over rows (block, cell, uid, set) sorted by block and cell: star edges between uids."""

    def edges(rows: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        uid = rows.column(2).to_numpy(zero_copy_only=False)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                u, v = linked_rows([np.frombuffer(s.as_buffer(), _U) for s in rows.column(3).slice(a, b - a)], percent)
                yield pa.RecordBatch.from_arrays([pa.array(uid[a:b][u]), pa.array(uid[a:b][v])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group at hand
        group = None
        for batch in batches:
            if not len(batch):
                continue
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)) + 1))
            if group is not None and group != (key[0][0], key[1][0]):
                yield from edges(_one(held), np.array([0, sum(map(len, held))]))
                held = []
            if len(cuts) > 1:
                yield from edges(_one([*held, batch.slice(0, int(cuts[1]))]), np.array([0, sum(map(len, held)) + cuts[1]]))
                yield from edges(batch, cuts[1:])
                held = []
            held.append(batch.slice(int(cuts[-1])))
            group = key[0][-1], key[1][-1]
        if held:
            yield from edges(_one(held), np.array([0, sum(map(len, held))]))

    return run


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def jaccard_components(df: DataFrame, id_col: str, text_col: str, size: int = 3, percent: int = 90, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """(id, n, component) of every row: n distinct shingles of `size` words, and the smallest id reachable over links. Two rows link if 100 * shared >= percent * united shingles.

    A-Z are lower-cased; words are runs without ASCII white space; a text of fewer words is one shingle of them all. Texts without words, and null, have no
    shingle and link with nothing; their component is their own id. Repeated rows link as any equal sets do. Null ids belong to their set's component and never name it. An empty table gives no rows.
    Shingles are compared as 64-bit hashes, whole sets as 128-bit ones.

    Equal sets are one row of the matrix. Texts of rows that share a block with another are read again for their sets, so what is kept of a text in between is about a tenth of its shingles'
    number of signatures, twice. Blocks of over block_ngrams are dealt into cells; every pair of cells is one task's work, so all links count; a task returns stars, never pairs.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.select("id", F.xxhash64("id", "text").alias("row"), "text")
    kind = src.schema["id"].dataType.simpleString()
    docs = materialise(src.mapInArrow(_describe(size, percent), f"id {kind}, row long, n long, digest binary, node long, own array<long>, below array<long>"))
    sets = docs.where("n > 0").groupBy("digest", "node", "n").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    sets = materialise(sets.withColumn("uid", F.monotonically_increasing_id()))
    keyed = docs.select("node", F.explode(F.concat("own", "below")).alias("sig"))
    hubs = keyed.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count(F.lit(1)).alias("sharing"))
    hubs = materialise(hubs.where("hub < far").drop("far"))
    total = docs.agg(F.coalesce(F.sum(F.size("own") + F.size("below")), F.lit(0))).first()[0]
    stars = join_hot(keyed, total, hubs, "sig", "sharing").select("node", "hub").where("node <> hub").distinct()
    blocks = connected_components(stars).withColumnRenamed("root", "block")
    members = materialise(sets.join(blocks, "node").select("uid", "row", "digest", "n", "block"))
    weight = members.groupBy("block").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("members"))
    weight = materialise(weight.select("block", F.ceil(F.col("weight") / block_ngrams).alias("cells"), "members"))
    wanted = join_hot(members, members.count(), weight, "block", "members", TASK_ROWS).select("row", "uid", "block", "cells", "digest")
    found = join_narrow(src.select("row", "text"), materialise(wanted), "row").select("text", "uid", "block", "cells", "digest")
    found = found.mapInArrow(_sets(size), "uid long, block long, cells long, set binary")
    mine, other = F.pmod(F.xxhash64("uid"), "cells"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    cell = F.least("mine", "other") * F.col("cells") + F.greatest("mine", "other")
    dealt = found.withColumn("mine", mine).withColumn("other", other).select("block", cell.alias("cell"), "uid", "set")
    edges = dealt.repartition("block", "cell").sortWithinPartitions("block", "cell").mapInArrow(_block_edges(percent), "u long, v long")
    linked = materialise(connected_components(edges).withColumnRenamed("node", "uid").join(sets.select("uid", "least"), "uid"))
    names = materialise(linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members")))
    linked = join_hot(linked, linked.count(), names, "root", "members", TASK_ROWS).select("uid", "component")
    named = materialise(sets.join(linked, "uid", "left").select("digest", F.coalesce("component", "least").alias("component"), "copies"))
    rows = docs.select("id", "n", "digest")
    out = join_hot(rows.where("n > 0"), named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0], named, "digest", "copies", TASK_ROWS)
    return out.select("id", "n", "component").unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))


def op13_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents."""
    found = jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
