"""Registered queries of the streaming forms and of the byte-level operators."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming as R
from ..functions import bytes as B
from ..sources.lines import numbered_lines
from ..sources.scratch import new_folder
from . import crossverify
from .tables import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


@query("SELECT DISTINCT event_type, user_id FROM events")
def r1_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "streams")
    keyed = _stream(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    return R.run_available(R.first_seen(keyed, "key").select("event_type", "user_id"), f"{folder}/out", f"{folder}/check")


@query("""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM f) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us FROM g GROUP BY user_id, r""")
def w3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = R.sessions(e, "ts", "user_id", "1 hour", "1 hour")
    return found.select("user_id", "n", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, CAST(count(*) AS BIGINT) AS top FROM events GROUP BY event_type")
def r1_stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running ids are dense: as many as rows, the greatest being their number."""
    folder = new_folder(spark, "streams")
    rows = _stream(spark, sf_dir, "events").select("event_type", "event_id")
    out = R.run_available(R.with_running_ids(rows, "event_type", "event_id"), f"{folder}/out", f"{folder}/check")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.max("id").alias("top"))


def tiny_jpeg(width: int, height: int, progressive: bool = False, body: bytes = b"") -> bytes:
    """A JPEG's markers around some body: enough for the parsers."""
    sof = b"\xff" + (b"\xc2" if progressive else b"\xc0") + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00" + sof + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + body + b"\xff\xd9"


def tiny_png(body: bytes = b"") -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def tiny_avi(frames: list[bytes], handler: bytes = b"MJPG", pad_to: int = 0) -> bytes:
    """An AVI with one video stream."""
    block = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) % 2)
    strh = block(b"strh", b"vids" + handler + b"\x00" * 48)
    hdrl = block(b"LIST", b"hdrl" + block(b"avih", b"\x00" * 56) + block(b"LIST", b"strl" + strh))
    movi = block(b"LIST", b"movi" + b"".join(block(b"00dc", f) for f in frames))
    body = b"AVI " + hdrl + movi
    if len(body) + 8 < pad_to:
        body += block(b"JUNK", b"\x00" * (pad_to - len(body) - 16))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@query("SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no, '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' AS line FROM events")
def s5_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log of each event type, numbered over splits of 10,000 bytes."""
    folder = new_folder(spark, "logs")
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.to_json(F.struct("event_id", "user_id")).alias("value"))
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(folder)
    kind = F.regexp_extract("line_file", "event_type=([^/]+)", 1)
    return numbered_lines(spark, f"{folder}/event_type=*", 10_000).select(kind.alias("event_type"), "line_no", "line")


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents), f AS (SELECT *, n + 4 AS f, 24 + 8 + n + 4 + n % 2 + 14 AS rec FROM t),
r AS (SELECT *, 0 AS i, 32::BIGINT AS o, f AS c, true AS j FROM f UNION ALL SELECT *, 1, rec + 20, n, false FROM f WHERE n > 0 UNION ALL SELECT *, 2, rec + 20 + n + n % 2 + 8, f + 3, true FROM f)
SELECT doc_id, i AS "index", o AS offset_in_avi, c AS chunk_size, CASE WHEN j THEN f ELSE n END AS jpeg_size, CASE WHEN j THEN sha256(CAST(unhex('FFD8' || hex(encode(t)) || 'FFD9') AS BLOB)) ELSE sha256(t) END AS sha256, j AS is_jpeg FROM r""")
def e21_avi_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of films made from the documents' texts, by the table function: a picture, sound, a frame in a list of its own that is no picture, a picture with filling behind."""
    crossverify.avi_frames(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("x"))
    le = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]))
    even = lambda x: F.concat(x, F.when(F.octet_length(x) % 2 == 1, F.lit(b"\x00")).otherwise(F.lit(b"")))
    chunk = lambda name, x: F.concat(F.lit(name), le(F.octet_length(x)), even(x))
    picture = F.concat(F.lit(b"\xff\xd8"), "x", F.lit(b"\xff\xd9"))
    inner = F.concat(F.lit(b"rec "), chunk(b"00db", F.col("x")))
    movi = F.concat(F.lit(b"movi"), chunk(b"00dc", picture), chunk(b"01wb", F.lit(b"sound")), F.lit(b"LIST"), le(F.octet_length(inner)), inner, chunk(b"00dc", F.concat(picture, F.lit(bytes(3)))))
    body = F.concat(F.lit(b"AVI LIST"), le(F.octet_length(movi)), movi)
    films = d.select("doc_id", F.concat(F.lit(b"RIFF"), le(F.octet_length(body)), body).alias("content"))
    films.createOrReplaceTempView("_films")
    return spark.sql("SELECT doc_id, f.index, f.offset_in_avi, f.chunk_size, f.jpeg_size, f.sha256, f.is_jpeg FROM _films, LATERAL avi_frames(content) f")


@query("SELECT doc_id, CAST(doc_id % 500 + 1 AS INTEGER) AS width, CAST(n_chars % 700 + 1 AS INTEGER) AS height, doc_id % 2 = 0 AS progressive FROM documents")
def e18_jpeg_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes read back from frame headers."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 500 + 1).alias("w"), (F.col("n_chars") % 700 + 1).alias("h"))
    be = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    kind = F.when(F.col("doc_id") % 2 == 0, F.lit(b"\xc2")).otherwise(F.lit(b"\xc0"))
    data = F.concat(F.lit(b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff"), kind, F.lit(b"\x00\x0b\x08"), be(F.col("h")), be(F.col("w")), F.lit(b"\x01\x01\x11\x00\xff\xd9"))
    return d.select("doc_id", B.jpeg_frame(data).alias("f")).select("doc_id", "f.width", "f.height", "f.progressive")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 16777216 AS be, l_suppkey % 65536 AS le FROM lineitem")
def x26_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big- and little-endian numbers read out of packed bytes."""
    item = table(spark, sf_dir, "lineitem")
    hexed = lambda n, width: F.lpad(F.hex(n), 2 * width, "0")
    low = F.col("l_suppkey") % 65536
    data = F.unhex(F.concat(F.lit("AA"), hexed(F.col("l_partkey") % 16777216, 3), hexed(low % 256, 1), hexed(F.floor(low / 256), 1)))
    return item.select("l_orderkey", "l_linenumber", B.unpack_be(data, 1, 3).alias("be"), B.unpack_le(data, 4, 2).alias("le"))
