"""Functions over binary columns. All but the pandas UDFs at the end are built from Spark's own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..parsers import images, videos
from ..parsers.source import Source


def unpack_be(data: Column, offset: int, width: int) -> Column:
    """Unsigned big-endian number of `width` (up to 7) bytes at a 0-based offset; null if the bytes aren't all there."""
    part = F.substring(data, offset + 1, width)
    return F.when(F.octet_length(part) == width, F.conv(F.hex(part), 16, 10).cast("long"))


def unpack_le(data: Column, offset: int, width: int) -> Column:
    """As unpack_be, little-endian."""
    part = F.substring(data, offset + 1, width)
    turned = F.concat(*[F.hex(F.substring(data, offset + i, 1)) for i in range(width, 0, -1)])
    return F.when(F.octet_length(part) == width, F.conv(turned, 16, 10).cast("long"))


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def prefix_md5(data: Column, n: int = dims.HASH_PREFIX) -> Column:
    """Fingerprint of the first n bytes."""
    return F.md5(F.substring(data, 1, n))


def matching_probes(data: Column) -> Column:
    """Names of all known prefixes that the bytes start with, in fixed order."""
    return F.filter(F.array(*[F.when(F.substring(data, 1, len(magic)) == F.lit(magic), F.lit(name)) for magic, name in dims.REGION_PROBES]), lambda x: x.isNotNull())


def is_transport_stream(data: Column, stride: int = 188, count: int = 8) -> Column:
    """Sync byte 0x47 at `count` places, `stride` apart."""
    hits = [F.coalesce(F.substring(data, i * stride + 1, 1) == F.lit(b"\x47"), F.lit(False)) for i in range(count)]
    out = hits[0]
    for hit in hits[1:]:
        out = out & hit
    return out


def entropy_band(entropy: Column) -> Column:
    low, mid, high = dims.BANDS
    return F.when(entropy < low, "empty").when(entropy < mid, "low").when(entropy < high, "medium").otherwise("high")


def entropy_of(data: bytes) -> float:
    """Shannon entropy of a byte string in bits per byte; 0 if it is empty."""
    if not data:
        return 0.0
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return float(-(p * np.log2(p)).sum()) + 0.0


@F.pandas_udf(T.DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """entropy_of() of each value; null stays null. Arrow-batched: a histogram has no cheap built-in form."""
    return data.map(lambda x: None if x is None else entropy_of(x)).astype("float64")


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("progressive", T.BooleanType())]))
def jpeg_frame(data: pd.Series) -> pd.DataFrame:
    """Size and kind from the first frame header of each JPEG; nulls if there is none."""
    found = [images.jpeg_frame(x) if x is not None else None for x in data]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["width", "height", "progressive"]).astype({"width": "Int32", "height": "Int32", "progressive": "boolean"})


def trim_after_last(data: Column, marker: Column) -> Column:
    """The bytes up to and with the last marker; all of them if it doesn't occur. Bytes are searched as characters of ISO 8859-1, one each."""
    text, mark = F.decode(data, "ISO-8859-1"), F.decode(marker, "ISO-8859-1")
    behind = F.length(F.call_function("substring_index", text, mark, F.lit(-1)))
    return F.when(F.call_function("instr", text, mark) > 0, F.substring(data, F.lit(1), F.octet_length(data) - behind)).otherwise(data)


_KIND = T.StructType([T.StructField(n, T.StringType()) for n in ("format", "extension", "media")])


@F.pandas_udf(_KIND)
def brand_format(data: pd.Series) -> pd.DataFrame:
    """What the type box at the start of each value tells: by the major brand, else the first known compatible one."""
    return pd.DataFrame([(None,) * 3 if x is None else videos.ftyp_format(Source(bytes(x)), 0) for x in data], columns=["format", "extension", "media"], dtype=object)


@F.pandas_udf(_KIND)
def tiff_kind(data: pd.Series) -> pd.DataFrame:
    """What the make in the first directory of each TIFF tells."""
    return pd.DataFrame([(None,) * 3 if x is None else (*images.tiff_format(Source(bytes(x)), 0), "photo") for x in data], columns=["format", "extension", "media"], dtype=object)


_EXIF = T.StructType([T.StructField(n, T.StringType()) for n in ("camera_make", "camera_model", "datetime_original", "datetime")] + [T.StructField(n, T.BooleanType()) for n in ("exif_readable", "has_camera_identity", "has_timestamp")])


@F.pandas_udf(_EXIF)
def exif_facts(data: pd.Series) -> pd.DataFrame:
    """Make, model and times of each JPEG, and what they say; what can't be read is null or false."""
    return pd.DataFrame([images.exif_facts(b"" if x is None else x) for x in data], columns=_EXIF.names, dtype=object)


@F.pandas_udf(T.BooleanType())
def is_valid_jpeg(data: pd.Series, least: pd.Series) -> pd.Series:
    """Whether segments and scans of each value end where it does, and both sides have `least` or more; null isn't valid."""
    return pd.Series([x is not None and images.is_valid_jpeg(bytes(x), n) for x, n in zip(data, least, strict=True)], dtype=bool)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def marked_pieces(data: pd.Series, head: pd.Series, foot: pd.Series) -> pd.Series:
    """Places of the pieces from each head to behind the next foot after it, one after the other; a head without a foot begins none."""

    def pieces(x: bytes, head: bytes, foot: bytes) -> Iterator[dict]:
        at = x.find(head)
        while at >= 0:
            stop = x.find(foot, at + len(head))
            if stop < 0:
                return
            yield {"start": at, "end": stop + len(foot)}
            at = x.find(head, stop + len(foot))

    return pd.Series([None if x is None else list(pieces(bytes(x), bytes(h), bytes(f))) for x, h, f in zip(data, head, foot, strict=True)], dtype=object)


def entropy_by_histogram(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """(id, n_bytes, entropy) by a grouped byte histogram, all in SQL functions: one row per byte, combined before the shuffle.

    Counts per value are summed, so blocks of one id may stand in many rows. Ids without any byte have entropy 0.
    """
    pairs = F.explode(F.expr("regexp_extract_all(h, '..', 0)"))
    hist = df.select(F.col(id_col).alias("id"), F.hex(data).alias("h")).select("id", pairs.alias("b")).groupBy("id", "b").agg(F.count(F.lit(1)).alias("c"))
    per = hist.groupBy("id").agg(F.sum("c").alias("n_bytes"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    found = per.select("id", "n_bytes", (F.log2(F.col("n_bytes").cast("double")) - F.col("s") / F.col("n_bytes")).alias("entropy"))
    ids = df.select(F.col(id_col).alias("id")).distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


#: Keys that a task counts for at a time, before it hands their histograms on.
HELD_KEYS = 4096


def _histograms(n_keys: int):
    """mapInArrow over (keys..., data): (keys..., bin, n) of the bytes of each key, summed within the task; a row with bin -1 tells that a key is there."""

    def give(names: list[str], kinds: list[pa.DataType], held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        rows, bins = np.nonzero(np.stack(list(held.values())))
        counts = np.stack(list(held.values()))[rows, bins]
        keys = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), pa.array((bins - 1).astype(np.int32)), pa.array(counts)], [*names, "bin", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, kinds = {}, [], []
        for batch in batches:
            names, kinds = batch.schema.names[:n_keys], batch.schema.types[:n_keys]
            for *key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = held.setdefault(tuple(key), np.zeros(257, np.int64))
                found[0] = 1
                found[1:] += np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)
                if len(held) > HELD_KEYS:
                    yield give(names, kinds, held)
                    held = {}
        if held:
            yield give(names, kinds, held)

    return run


def byte_counts(df: DataFrame, keys: list[str], data: Column) -> DataFrame:
    """(keys..., bin, n): how often each byte value occurs in all values of a key. Histograms are summed in every task first and then by key and bin, so a key may stand in any number of rows, of any sizes."""
    at = df.select(*keys, data.cast("binary").alias("data"))
    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema.fields[: len(keys)])
    return at.mapInArrow(_histograms(len(keys)), f"{told}, bin int, n long").groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def entropy_by(df: DataFrame, keys: list[str], data: Column) -> DataFrame:
    """(keys..., n_bytes, entropy): bits per byte over all values of each key, from mergeable histograms; 0 for keys without bytes. Null keys are a key, null data no bytes."""
    at = byte_counts(df, keys, data).withColumn("c", F.when(F.col("bin") >= 0, F.col("n")).otherwise(0))
    spread = F.sum(F.when(F.col("c") > 0, F.col("c") * F.log2("c")).otherwise(0.0))
    per = at.groupBy(*keys).agg(F.sum("c").alias("n_bytes"), spread.alias("_s"))
    found = F.log2(F.col("n_bytes").cast("double")) - F.col("_s") / F.col("n_bytes")
    return per.select(*keys, "n_bytes", F.when(F.col("n_bytes") > 0, F.abs(found)).otherwise(0.0).alias("entropy"))
