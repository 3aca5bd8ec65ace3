"""Benchmark decontamination by winnowing: minimum k-gram hash of every window, joined, then extended."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_class, filter_texts, free_name, join_narrow, materialise, small_batches, small_slices, table, text_slices, word_spans

#: Words are runs of digits, letters and non-ASCII characters (after A-Z are lower-cased).
WORD_BYTES = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a window, and of the k-grams that are hashed; each window holds SPAN - GRAM + 1 of them.
SPAN, GRAM = 13, 8
#: Benchmarks of up to so many bytes of text are indexed once and sent to every task; larger ones are joined by shuffles.
INDEX_BYTES = 16 << 20

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base modulo 2^64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased bytes, wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    value = np.where(WORD_BYTES[data], LOWER[data], 0).astype(np.uint64)
    return _mixed(np.add.reduceat(value * up, starts) * down[starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n if len(out) else 0):
        out = out * _STEP + words[j : j + len(out)]
    return _mixed(out)


def window_minima(grams: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive hashes."""
    out = grams[: max(0, len(grams) - n + 1)].copy()
    for j in range(1, n if len(out) else 0):
        np.minimum(out, grams[j : j + len(out)], out=out)
    return out


def minimum_places(grams: np.ndarray, n: int) -> np.ndarray:
    """Where the least of every n consecutive hashes stands, the last one of equals: a window of a text and the same window of an item choose the same place."""
    count = max(0, len(grams) - n + 1)
    at, least = np.arange(count), grams[:count].copy()
    for j in range(1, n if count else 0):
        fits = grams[j : j + count] <= least
        at[fits] = np.flatnonzero(fits) + j
        least = np.minimum(least, grams[j : j + count])
    return at


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """The half-open spans that windows (starts in order) cover, without overlaps."""
    out: list[list[int]] = []
    for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


class Index:
    """The fingerprints of some items, and the spans that texts share with them.

    Items of `span` words or more are found by winnowing: the minima of a shared window are the same on both
    sides, so every shared run of `span` words yields a common fingerprint. A fingerprint keeps the distinct surroundings (the words that any
    window around it could hold) in which items have it, each with its items: passages that repeat themselves, or that many items share, are one entry.
    Shorter items have one window, all their words, fingerprinted whole by length.
    """

    def __init__(self, items: list[tuple[str, str | None]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        self.names: list[str] = []
        #: fingerprint -> {(words around it, place of the fingerprint among them): items}
        self.places: dict[int, dict[tuple[bytes, int], set[int]]] = defaultdict(dict)
        self.short: dict[int, dict[int, dict[tuple[bytes, int], set[int]]]] = defaultdict(lambda: defaultdict(dict))
        for name, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h = word_hashes(raw, word_spans(raw, np.array([0, len(raw)]), WORD_BYTES)[0])
            if not len(h):
                continue
            k, words = len(self.names), WORD.findall(LOWER[raw].tobytes())
            self.names.append(name)
            if len(h) < span:
                self.short[len(h)][int(gram_hashes(h, len(h))[0])].setdefault((b" ".join(words), 0), set()).add(k)
                continue
            g = gram_hashes(h, gram)
            for at in np.unique(minimum_places(g, span - gram + 1)).tolist():
                lo = max(0, at + gram - span)
                self.places[int(g[at])].setdefault((b" ".join(words[lo : at + span]), at - lo), set()).add(k)
        self.tables = {n: self._table(keys) for n, keys in [(span, self.places), *self.short.items()] if keys}

    @staticmethod
    def _table(keys) -> tuple[np.ndarray, np.ndarray]:
        found = np.sort(np.fromiter(keys, np.uint64, len(keys)))
        bits = np.zeros(1 << 20, bool)
        bits[found >> np.uint64(44)] = True
        return bits, found

    def _known(self, n: int, h: np.ndarray) -> np.ndarray:
        bits, found = self.tables[n]
        at = np.flatnonzero(bits[h >> np.uint64(44)])
        return at[found[np.minimum(np.searchsorted(found, h[at]), len(found) - 1)] == h[at]]

    def _items(self, n: int, key: int, window: list[bytes], offset: int) -> set[int]:
        """The items that hold a window (its words) which has the fingerprint `key` at `offset`."""
        out: set[int] = set()
        for (around, at), items in (self.places if n == self.span else self.short[n])[key].items():
            words = around.split(b" ")
            if at >= offset and words[at - offset : at - offset + n] == window:
                out |= items
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, list[tuple[int, int]], set[int]]]]:
        """(first word of each text, (text, its hit spans, its items) of each text that has any).

        Windows that winnowing finds a fingerprint for are compared whole with the items' surroundings, equal windows of a text once; windows that follow one another
        extend to one span. Work is about the windows found and the distinct surroundings, not the product of repeats on both sides.
        """
        starts, _, first = word_spans(data, offsets, WORD_BYTES)
        h = word_hashes(data, starts)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = []
        for n in self.tables:
            grams = gram_hashes(h, self.gram if n == self.span else n)
            place = minimum_places(grams, n - self.gram + 1) if n == self.span else np.arange(len(grams))
            at = self._known(n, grams[place])
            at = at[doc[at] == doc[at + n - 1]] if len(at) else at
            if len(at):
                found.append((at, np.full(len(at), n), grams[place[at]], place[at] - at))
        return first, self._checked(data, offsets, first, doc, found)

    def _checked(self, data, offsets, first, doc, found):
        if not found:
            return
        at, length, key, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, doc[at]))
        at, length, key, offset = at[order], length[order], key[order], offset[order]
        of = doc[at]
        cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            d = int(of[a])
            words = WORD.findall(LOWER[data[offsets[d] : offsets[d + 1]]].tobytes())
            told: dict[tuple[bytes, ...], set[int]] = {}
            keep, items = np.zeros(b - a, bool), set()
            for j, (p, n, k, o) in enumerate(zip((at[a:b] - first[d]).tolist(), length[a:b].tolist(), key[a:b].tolist(), offset[a:b].tolist(), strict=True)):
                window = words[p : p + n]
                same = tuple(window)
                if same not in told:
                    told[same] = self._items(n, k, window, o)
                    items |= told[same]
                keep[j] = bool(told[same])
            if keep.any():
                yield d, merged(at[a:b][keep] - first[d], length[a:b][keep]), items


def covered(spans: list[tuple[int, int]]) -> int:
    """Positions inside spans that don't overlap."""
    return sum(b - a for a, b in spans)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(index: Index):
    """For each batch of rows (id, text): per text its words, hit words, items and hit spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                first, found = index.hits(data, offsets)
                n = len(first) - 1
                hit, items, spans = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
                for d, at, of in found:
                    hit[d], items[d] = covered(at), sorted({index.names[k] for k in of})
                    spans[d] = [{"start": a, "end": b} for a, b in at]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)], ["id", "n_words", "n_hit", "items", "spans"])

    return run


def _fingerprints(span: int, gram: int, lengths: list[int]):
    """For each batch of rows (row, text): its distinct fingerprints, of windows (n = span) and of each short length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                starts, _, first = word_spans(data, offsets, WORD_BYTES)
                h, names = word_hashes(data, starts), rows.column(0).to_numpy()
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for n in [span, *lengths]:
                    keys = window_minima(gram_hashes(h, gram), n - gram + 1) if n == span else gram_hashes(h, n)
                    if not len(keys):
                        continue
                    ok = doc[: len(keys)] == doc[n - 1 :]
                    pairs = np.unique(np.rec.fromarrays([doc[: len(keys)][ok], keys[ok]]))
                    yield pa.RecordBatch.from_arrays([pa.array(names[pairs.f0]), pa.array(np.full(len(pairs), n, np.int32)), pa.array(pairs.f1.view(np.int64))], ["row", "n", "fp"])

    return run


def _windows(span: int, gram: int):
    """For each batch of rows (row, text, known: a list of (n, fp), or null for all): (row, n, at, a, b) of the windows whose fingerprint is known; a and b are two hashes of the window's words, 128 bits together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["row", "n", "at", "a", "b"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in small_slices(batches):
            for row, text, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                h = word_hashes(raw, word_spans(raw, np.array([0, len(raw)]), WORD_BYTES)[0])
                words = WORD.findall(LOWER[raw].tobytes())
                lengths = sorted({x["n"] for x in known}) if known is not None else [min(span, len(h))] * bool(len(h))
                for n in lengths:
                    grams = gram_hashes(h, gram if n == span else n)
                    place = minimum_places(grams, n - gram + 1) if n == span else np.arange(len(grams))
                    at = np.arange(len(place)) if known is None else np.flatnonzero(np.isin(grams[place], np.array([x["fp"] for x in known if x["n"] == n], np.int64).view(np.uint64)))
                    for lo in range(0, len(at), 20_000):
                        part = at[lo : lo + 20_000]
                        digests = np.array([xxhash.xxh3_128_intdigest(b" ".join(words[i : i + n])).to_bytes(16, "big") for i in part.tolist()], "V16").view(">i8").astype(np.int64).reshape(-1, 2)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.full(len(part), row), np.full(len(part), n), part, digests[:, 0], digests[:, 1]), kinds, strict=True)], names)

    return run


def _merge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches):
        spans = []
        for windows in batch.column(1).to_pylist():
            at = sorted((x["at"], x["n"]) for x in windows)
            spans.append(merged(np.array([x[0] for x in at]), np.array([x[1] for x in at])))
        told = [[{"start": a, "end": b} for a, b in x] for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([covered(x) for x in spans], pa.int64()), pa.array(told, _SPANS)], ["row", "n_hit", "spans"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_slices(batch, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(word_spans(data, offsets, WORD_BYTES)[2]))], ["row", "n_words"])


def _by_join(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """The result of contamination() where the items are too many to send: fingerprints meet by a shuffle join, then the windows that have them.

    Texts are read twice and never shipped: of a text only fingerprints, then windows with a fingerprint that some item has, are shuffled. Frequent fingerprints and
    windows (passages of many documents) are joined by join_narrow, dealt by salt.
    """
    kind = docs.schema["id"].dataType.simpleString()
    numbered = materialise(docs.withColumn("row", F.monotonically_increasing_id()))
    passages = materialise(items.withColumn("key", F.monotonically_increasing_id()))
    lengths = passages.select("key", "text").mapInArrow(_count_words, "row long, n_words long")
    lengths = [r.n_words for r in lengths.where((F.col("n_words") > 0) & (F.col("n_words") < span)).select("n_words").distinct().collect()]  # span - 1 values at most
    prints = lambda df, key: df.select(key, "text").mapInArrow(_fingerprints(span, gram, lengths), "row long, n int, fp long")
    theirs = materialise(prints(passages, "key").select(F.struct("n", "fp").alias("print")).distinct())
    mine = join_narrow(prints(numbered, "row").select("row", F.struct("n", "fp").alias("print")), theirs, "print")
    found = materialise(mine.groupBy("row").agg(F.collect_set("print").alias("known")))  # of a row no more than its own
    windows = lambda df: df.mapInArrow(_windows(span, gram), "row long, n int, at long, a long, b long").select("row", "n", "at", F.struct("n", "a", "b").alias("window"))
    theirs = materialise(windows(passages.select("key", "text", F.lit(None).cast("array<struct<n:int,fp:bigint>>"))).select(F.col("row").alias("key"), "window").distinct())
    mine = materialise(windows(numbered.join(found, "row").select("row", "text", "known")))
    hit = materialise(join_narrow(mine, theirs.select("window").distinct(), "window"))
    per_row = hit.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("windows")).mapInArrow(_merge_windows, "row long, n_hit long, spans array<struct<start:bigint,end:bigint>>")
    # a window's items meet each text once, however often the text repeats the window
    names = join_narrow(hit.select("row", "window").distinct(), theirs, "window").select("row", "key").distinct().join(passages.select("key", "item"), "key")
    names = names.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    counts = numbered.select("row", "text").mapInArrow(_count_words, "row long, n_words long")
    out = numbered.select("row", "id").join(counts, "row").join(per_row, "row", "left").join(names, "row", "left")
    nothing = lambda c, t: F.coalesce(c, F.array().cast(t))
    return out.select(F.col("id").cast(kind), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), nothing("items", "array<string>").alias("items"), nothing("spans", "array<struct<start:bigint,end:bigint>>").alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, span: int = SPAN, gram: int = GRAM, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans): how far each row's whole text repeats the items.

    A window is `span` consecutive words of an item (an item of fewer words, but some, is one window); a word of a
    document inside any occurrence of a window is hit; items are the ids (as strings, sorted,
    distinct) with an occurring window; spans are the hit stretches, in words from 0. Null, empty and wordless texts have no words, hits or items; a null
    item id counts as ''; repeated rows on either side give repeated rows or the same items. Items of up to
    index_bytes (measured first) are indexed on the driver and sent to the tasks, so documents aren't
    shuffled; beyond that both sides' fingerprints are joined by a shuffle, with the same result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    if size > index_bytes:
        return _by_join(docs, items, span, gram)
    index = Index([tuple(r) for r in items.collect()], span, gram)
    return docs.mapInArrow(_scan(index), f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>")


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least a twentieth of the words, and one, are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, span: int = SPAN, gram: int = GRAM, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of df that aren't contaminated (is_contaminated), all columns as they are. Items beyond index_bytes: rows are numbered, and those found are taken out by number."""
    known = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    if (known.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0) > index_bytes:
        at = free_name(df, "_at")
        rows = materialise(df.withColumn(at, F.monotonically_increasing_id()))
        found = contamination(rows.select(F.col(at).alias("at"), F.col(text_col).alias("t")), items, "at", "t", item_col, item_text_col, span, gram, index_bytes)
        bad = materialise(found.where(is_contaminated()).select(F.col("id").alias(at)))
        return join_narrow(rows, bad, at, "left_anti").select(*df.columns)
    index = Index([tuple(r) for r in known.collect()], span, gram)

    def keep(batch: pa.RecordBatch, at: int) -> np.ndarray:
        parts = [np.zeros(0, bool)]
        for _, data, offsets in text_slices(batch, at):
            first, found = index.hits(data, offsets)
            hit = np.zeros(len(first) - 1, np.int64)
            for d, spans, _ in found:
                hit[d] = covered(spans)
            parts.append(~((hit > 0) & (20 * hit >= np.diff(first))))
        return np.concatenate(parts)

    return filter_texts(df, text_col, lambda: keep)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents; null and wordless texts have no hits, repeated rows stay."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


_ITEMS = hashlib.sha256(b"").hexdigest()  # of a document without items
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS n, array_to_string(w[i:i + least(len(w), {SPAN}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SPAN} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, '{_ITEMS}') AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
