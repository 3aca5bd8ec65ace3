"""A raw image laid out from the documents, and the recovery operators over it; their DuckDB forms know where everything lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import bytes as B
from ..operators.ordered import running_before
from ..sources.rawimage import read_image, write_parts
from ..sources.scratch import materialise, new_folder
from . import carve as C
from . import classify, crossverify, entropy
from .tables import table

QUERIES, ORACLES = {}, {}
#: A picture's bytes around its text: markers, frame header (height and width in between), scan header.
_HEAD, _SCAN = "FFD8FFE000104A46494600010100000100010000FFC0000B08", "01011100FFDA0008010100003F00"
#: Least bytes of a picture, and the stride of the entropy scan.
LEAST, STRIDE = 1000, 8192
#: Places (two numbers each) that are sent to all tasks at most.
SENT_ROWS = 200_000


def picture_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, data): each document's text as the scan of a picture; sides follow from n_chars, so that equal documents are equal pictures."""
    side = lambda n: F.lpad(F.hex(F.coalesce("n_chars", F.lit(0)) % n + 1), 4, "0")
    lead = F.unhex(F.concat(F.lit(_HEAD), side(500), side(700), F.lit(_SCAN)))
    return docs.select("doc_id", F.concat(lead, F.coalesce("text", F.lit("")).cast("binary"), F.lit(b"\xff\xd9")).alias("data"))


def film_table(pictures: DataFrame) -> DataFrame:
    """(video, content): a film of one frame for each picture."""
    le = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]))
    padded = F.when(F.octet_length("data") % 2 == 1, F.concat("data", F.lit(b"\x00"))).otherwise(F.col("data"))
    movi = F.concat(F.lit(b"movi00dc"), le(F.octet_length("data")), padded)
    body = F.concat(F.lit(b"AVI LIST"), le(F.octet_length(movi)), movi)
    return pictures.select(F.col("doc_id").cast("string").alias("video"), F.concat(F.lit(b"RIFF"), le(F.octet_length(body)), body).alias("content"))


def lay_out(spark: SparkSession, sf_dir: str) -> str:
    """The path of an image that holds each document's text as a picture, by doc_id, with gaps between."""
    pieces = picture_bytes(table(spark, sf_dir, "documents")).select("doc_id", F.concat("data", F.lit(bytes(32))).alias("data"))
    return lay_in_order(spark, pieces, "doc_id")


def lay_in_order(spark: SparkSession, pieces: DataFrame, order: str) -> str:
    """The path of an image in which pieces (order, data) follow one another. Places are a running sum of lengths, so only lengths are put in order.

    The data is made twice, for its lengths and for the image, and written once: of large images no other copy lies on disk.
    """
    lengths = materialise(pieces.select(order, F.octet_length("data").cast("long").alias("n")))
    at = materialise(running_before(lengths, [], [order], {"place": (F.col("n"), "sum")}))
    rows, size = at.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    places = at.select(order, "place")
    return write_parts(pieces.join(F.broadcast(places) if rows <= SENT_ROWS else places, order).select("place", "data"), size, new_folder(spark, "images"))


_IMAGE = f"""p AS (SELECT doc_id, '{_HEAD}' || lpad(hex(coalesce(n_chars, 0) % 500 + 1), 4, '0') || lpad(hex(coalesce(n_chars, 0) % 700 + 1), 4, '0') || '{_SCAN}' || hex(encode(coalesce(text, ''))) || 'FFD9' AS h,
  CAST(coalesce(n_chars, 0) % 500 + 1 AS INTEGER) AS height, CAST(coalesce(n_chars, 0) % 700 + 1 AS INTEGER) AS width FROM documents),
q AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n, CAST(coalesce(sum(length(h) // 2 + 32) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM p)"""


def e1_carve_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the image: pictures of LEAST bytes or more, the first of equal ones."""
    found = C.carve(spark, lay_out(spark, sf_dir), C.Settings(photo_min=LEAST), image_id="documents")
    return found.select("format", "bucket", "source_offset", "source_end", "size_bytes", "sha256", F.col("jpeg.width").alias("width"), F.col("jpeg.height").alias("height"), F.col("jpeg.bits_per_pixel").alias("bpp"), F.substring_index("path", "_", 2).alias("name"))


ORACLES["e1_carve_image"] = f"""WITH {_IMAGE}, r AS (SELECT *, sha256(CAST(unhex(h) AS BLOB)) AS s, row_number() OVER (ORDER BY a) AS id FROM q WHERE n >= {LEAST}), f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY a) AS k FROM r)
SELECT 'JPEG' AS format, 'photos' AS bucket, a AS source_offset, a + n AS source_end, n AS size_bytes, s AS sha256, width, height, round(8.0 * n / (CAST(width AS DOUBLE) * height), 5) AS bpp, 'photos/photo_' || lpad(CAST(id AS VARCHAR), greatest(5, length(CAST(id AS VARCHAR)))::INT, '0') AS name FROM f WHERE k = 1"""
_KEPT = f"{_IMAGE}, r AS (SELECT *, sha256(CAST(unhex(h) AS BLOB)) AS s FROM q WHERE n >= {LEAST}), f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY a) AS k, round(8.0 * n / (CAST(width AS DOUBLE) * height), 5) AS bpp FROM r), kept AS (SELECT * FROM f WHERE k = 1)"


def a10_classify_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carved pictures judged as stills or film frames."""
    found = materialise(C.carve(spark, lay_out(spark, sf_dir), C.Settings(photo_min=LEAST), image_id="documents"))
    return classify.classify(found).select("source_offset", "still", "frame", F.array_join("reasons", ";").alias("reasons"), "suggested")


ORACLES["a10_classify_image"] = f"""WITH {_KEPT}, v AS (SELECT a, 1 + CASE WHEN bpp > 0.72 THEN 1 ELSE 0 END AS still, CASE WHEN bpp > 0 AND bpp < 0.22 THEN 2 ELSE 0 END AS frame, bpp FROM kept)
SELECT a AS source_offset, still, frame, concat_ws(';', 'carver_bucket_photos', CASE WHEN bpp > 0 AND bpp < 0.22 THEN 'low_bits_per_pixel_heavy_compression' END, CASE WHEN bpp > 0.72 THEN 'higher_bits_per_pixel_milder_compression' END) AS reasons,
  CASE WHEN still >= frame + 2 THEN 'likely_still' WHEN frame >= still + 2 THEN 'likely_frame' ELSE 'uncertain' END AS suggested FROM v"""
GAP = 10_000


def j3_cross_verify_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carved pictures that no film holds, in regions: films, a frame each, are made of the pictures of even documents."""
    path = lay_out(spark, sf_dir)
    found = materialise(C.carve(spark, path, C.Settings(photo_min=LEAST), image_id="documents"))
    carved = found.select("sha256", F.col("source_offset").cast("string").alias("fname"), "bucket", F.col("source_offset").alias("seq"), F.col("source_offset").alias("start"), F.col("source_end").alias("end"))
    crossverify.avi_frames(spark)
    films = film_table(picture_bytes(table(spark, sf_dir, "documents").where("pmod(doc_id, 2) = 0")))
    frames = materialise(films.lateralJoin(crossverify.avi_frames(spark)(F.col("content").outer())).select("video", "index", "sha256", "is_jpeg"))
    matches = crossverify.file_matches(crossverify.match_frames(carved.select("sha256", "fname", "bucket", "seq"), frames))
    left = crossverify.orphans(carved, matches).join(carved.select("fname", "start", "end"), "fname")
    none = spark.createDataFrame([], "start long, end long")
    return crossverify.orphan_regions(materialise(left), none, GAP).select("start", "end", "frame_count", F.array_join("files", ",").alias("files"))


ORACLES["j3_cross_verify_image"] = f"""WITH {_KEPT}, o AS (SELECT a, a + n AS z FROM kept WHERE s NOT IN (SELECT sha256(CAST(unhex(h) AS BLOB)) FROM p WHERE doc_id % 2 = 0)),
w AS (SELECT *, CASE WHEN a - max(z) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM o), g AS (SELECT *, sum(fresh) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING) AS region FROM w)
SELECT min(a) AS start, max(z) AS "end", count(*) AS frame_count, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS files FROM g GROUP BY region"""


def f16_entropy_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the image's strided blocks, and how many of the dense ones lie in what was carved."""
    path = lay_out(spark, sf_dir)
    found = materialise(C.carve(spark, path, C.Settings(photo_min=LEAST), image_id="documents"))
    return entropy.scan(spark, path, found.select(F.col("source_offset").alias("start"), F.col("source_end").alias("end")), stride=STRIDE)["bands"]


_BYTES = f"{_IMAGE}, i AS (SELECT string_agg(h || '{'00' * 32}', '' ORDER BY doc_id) AS h FROM p)"


def s4_strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 4 KiB at every 64 KiB of the image."""
    blocks = read_image(spark, lay_out(spark, sf_dir), tile=dims.BLOCK, stride=dims.STRIDE)
    return blocks.select("offset", F.col("length").cast("long").alias("length"), F.md5("data").alias("block_md5"), F.round(B.byte_entropy("data"), 6).alias("entropy"))


ORACLES["s4_strided_sample"] = f"""WITH {_BYTES}, b AS (SELECT o AS "offset", substr(h, 2 * o + 1, {2 * dims.BLOCK}) AS x FROM i, range(0, (SELECT sum(length(h) // 2 + 32) FROM p)::BIGINT, {dims.STRIDE}) t(o)),
c AS (SELECT "offset", y, count(*) AS c FROM (SELECT "offset", unnest(regexp_extract_all(x, '..')) AS y FROM b) GROUP BY ALL), e AS (SELECT "offset", sum(c) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM c GROUP BY 1)
SELECT "offset", CAST(n AS BIGINT) AS length, md5(CAST(unhex(x) AS BLOB)) AS block_md5, round(abs(entropy), 6) AS entropy FROM b JOIN e USING ("offset")"""


def s3_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of the image, in tiles of its own bytes."""
    tiles = read_image(spark, lay_out(spark, sf_dir), tile=1000, start=500, end=20_250, overlap=7, partition_bytes=4000)
    return tiles.select("offset", F.col("length").cast("long").alias("length"), F.md5(F.expr("substring(data, 1, length)")).alias("own_md5"))


ORACLES["s3_range_scan"] = f"""WITH {_BYTES} SELECT o AS "offset", CAST(least(1000, 20250 - o) AS BIGINT) AS length, md5(CAST(unhex(substr(h, 2 * o + 1, 2 * least(1000, 20250 - o))) AS BLOB)) AS own_md5 FROM i, range(500, 20250, 1000) t(o)"""

ORACLES["f16_entropy_image"] = f"""WITH {_KEPT}, i AS (SELECT string_agg(h || '{'00' * 32}', '' ORDER BY doc_id) AS h FROM p), b AS (SELECT o, substr(h, 2 * o + 1, {2 * dims.BLOCK}) AS x FROM i, range(0, (SELECT sum(length(h) // 2 + 32) FROM p)::BIGINT, {STRIDE}) t(o)),
c AS (SELECT o, y, count(*) AS c FROM (SELECT o, unnest(regexp_extract_all(x, '..')) AS y FROM b) GROUP BY ALL), e AS (SELECT o, sum(c) AS n, round(abs(log2(sum(c)) - sum(c * log2(c)) / sum(c)), 6) AS v FROM c GROUP BY 1),
m AS (SELECT v, EXISTS (SELECT 1 FROM kept WHERE kept.a < e.o + e.n AND kept.a + kept.n > e.o) AS hit FROM e)
SELECT count(*) AS n_blocks, count(*) FILTER (v < 1) AS n_empty, count(*) FILTER (v >= 1 AND v < 5) AS n_low, count(*) FILTER (v >= 5 AND v < 7) AS n_medium, count(*) FILTER (v >= 7) AS n_high, count(*) FILTER (v >= 5 AND hit) AS n_recovered, count(*) FILTER (v >= 5 AND NOT hit) AS n_unrecovered FROM m"""

QUERIES |= {f.__name__: f for f in (e1_carve_image, a10_classify_image, j3_cross_verify_image, f16_entropy_image, s4_strided_sample, s3_range_scan)}
