"""A raw image of files of many formats, laid out from the documents beside decoys, cut-off files and copies, and carved; DuckDB knows from lengths alone where each file lies."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators.ordered import running_before
from ..sources import manifest as M
from ..sources.reports import read_report, with_presence, write_report
from ..sources.scratch import drop_folder, materialise, new_folder
from . import carve as C
from . import classify
from .imaged import LEAST, lay_in_order
from .tables import table

QUERIES, ORACLES = {}, {}
#: Zeros that bring a film over the least size of films; zeros between files.
FILL, GAP = 52_000, 32
#: Bytes of text in a program stream's packet; of a GIF's block; of a transport packet.
PES, BLOCK, PACKET = 60_000, 255, 187
#: Brands of type boxes, and makes in TIFFs, that are laid out in turn.
BRANDS = ("isom", "qt  ", "3gp4", "M4V ", "heic", "avif", "mif1", "crx ")
MAKES = (("NIKON", "NEF", "nef"), ("SONY", "ARW", "arw"), ("OLYMPUS", "ORF", "orf"), ("Panasonic", "RW2", "rw2"), ("PENTAX", "PEF", "pef"))


class Kind(NamedTuple):
    """A format to lay out: its bytes for a text, and in SQL its length for a text of n bytes and what a carver should call it. j numbers the files of a kind."""

    build: Callable[[Column, Column, Column], Column]  # text as bytes, its length n, j
    length: str
    format: str
    extension: str
    media: str | None
    param: str = "0"  # what tells files of equal texts apart
    least: int = LEAST


def _be(n: Column | int, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(F.lit(n) if isinstance(n, int) else n), 2 * width, "0"))


def _le(n: Column | int, width: int) -> Column:
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(width)]))


def _zeros(n: Column | int) -> Column:
    return F.lit(bytes(n)) if isinstance(n, int) else F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def _cat(*parts: Column | bytes) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, bytes) else p for p in parts])


def _grouped(data: Column, size: int, lead: str, last: Callable[[Column], Column]) -> Column:
    """data cut into groups of `size` bytes, each behind the bytes `lead` (hex); a shorter last one behind last(its length), where there is one."""
    whole = F.floor(F.octet_length(data) / size).cast("int") * size
    rest = F.octet_length(data) - whole
    groups = F.unhex(F.regexp_replace(F.hex(F.substring(data, F.lit(1), whole)), f"(.{{{2 * size}}})", f"{lead}$1"))
    return F.concat(groups, F.when(rest > 0, _cat(last(rest), F.substring(data, whole + 1, rest))).otherwise(F.lit(b"")))


def jpeg(x: Column, height: Column | int, width: Column | int, ended: bool = True) -> Column:
    head = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00\xff\xc0\x00\x0b\x08"
    return _cat(head, _be(height, 2), _be(width, 2), b"\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00", x, b"\xff\xd9" if ended else b"")


def _png(x: Column, n: Column, j: Column) -> Column:
    chunk = lambda kind, data: _cat(_be(F.octet_length(data), 4), kind, data, _be(F.crc32(_cat(kind, data)), 4))
    return _cat(b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", F.lit(b"\x00\x00\x00\x01\x00\x00\x00\x01\x08\x02\x00\x00\x00")), chunk(b"IDAT", x), chunk(b"IEND", F.lit(b"")))


def _gif(x: Column, n: Column, j: Column) -> Column:
    head = F.when(j % 2 == 0, F.lit(b"GIF89a")).otherwise(F.lit(b"GIF87a"))
    return _cat(head, b"\x01\x00\x01\x00\x00\x00\x00", b"\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02", _grouped(x, BLOCK, "FF", lambda m: _be(m, 1)), b"\x00\x3b")


def _bmp(x: Column, n: Column, j: Column) -> Column:
    return _cat(b"BM", _le(n + 54, 4), _zeros(4), _le(54, 4), _le(40, 4), _le(10, 4), _le(10, 4), b"\x01\x00\x18\x00", _zeros(24), x)


def _webp(x: Column, n: Column, j: Column) -> Column:
    padded = _cat(x, _zeros(n % 2))
    return _cat(b"RIFF", _le(n + n % 2 + 12, 4), b"WEBPVP8 ", _le(n, 4), padded)


def _block(name: bytes, data: Column, size: Column | int) -> Column:
    return _cat(name, _le(size, 4), data)


def _avi(x: Column, n: Column, j: Column) -> Column:
    """A film of three frames, a motion-JPEG stream, with filling behind."""
    frame = _cat(jpeg(x, 120, 160), _zeros((n + 1) % 2))
    head = F.lit(b"hdrl" + b"avih" + (56).to_bytes(4, "little") + bytes(56) + b"LIST" + (68).to_bytes(4, "little") + b"strl" + b"strh" + (56).to_bytes(4, "little") + b"vidsMJPG" + bytes(48))
    film = F.concat(F.lit(b"movi"), *[_block(b"00dc", frame, n + 45) for _ in range(3)])
    body = _cat(b"AVI ", _block(b"LIST", head, 144), _block(b"LIST", film, 4 + 3 * (53 + n + (n + 1) % 2)), _block(b"JUNK", _zeros(FILL), FILL))
    return _block(b"RIFF", body, F.octet_length(body))


def _tiff(little: bool, make: bool, raw: bool) -> Callable[[Column, Column, Column], Column]:
    """A directory with a strip that is said to begin 100 bytes beyond the text's length; carvers add a tenth to the farthest place they are told of."""

    def build(x: Column, n: Column, j: Column) -> Column:
        number = _le if little else _be
        entry = lambda tag, kind, count, value: _cat(number(tag, 2), number(kind, 2), number(count, 4), number(value, 4))
        first = 16 if raw else 8
        makes = F.element_at(F.array(*[F.lit(m.encode().ljust(12, b"\x00")) for m, _, _ in MAKES]), (j % len(MAKES) + 1).cast("int"))
        rows = [entry(0x010F, 2, 12, first + 2 + 2 * 12 + 4)] if make else []
        rows.append(entry(273, 4, 1, n + 100))
        head = _cat(b"II*\x00" if little else b"MM\x00*", number(first, 4), b"CR\x02\x00\x00\x00\x00\x00" if raw else b"", number(len(rows), 2), *rows, number(0, 4), makes if make else b"")
        total = n + 100 + F.floor((n + 100) / 10)
        return _cat(head, x, _zeros(total - F.octet_length(head) - n))

    return build


_FAR = "(n + 100 + (n + 100) // 10)"


def _raf(x: Column, n: Column, j: Column) -> Column:
    return _cat(b"FUJIFILMCCD-RAW" + bytes(85), _be(108, 4), _be(n, 4), x)


def _boxes(x: Column, n: Column, j: Column) -> Column:
    brand = F.element_at(F.array(*[F.lit(b.encode()) for b in BRANDS]), (j % len(BRANDS) + 1).cast("int"))
    return _cat(b"\x00\x00\x00\x14ftyp", brand, b"\x00\x00\x00\x00isom", b"\x00\x00\x00\x08moov", _be(n + 8, 4), b"mdat", x)


def _matroska(x: Column, n: Column, j: Column) -> Column:
    """Header, a void element, a segment whose size is a number of eight bytes."""
    return _cat(b"\x1a\x45\xdf\xa3\x84\x42\x86\x81\x01", b"\xec\x83\x00\x00\x00", b"\x18\x53\x80\x67\x01", _be(n + FILL, 7), _zeros(FILL), x)


def _flv(x: Column, n: Column, j: Column) -> Column:
    tag = lambda kind, data, size: _cat(kind, _be(size, 3), _zeros(7), data, _be(size + 11, 4))
    return _cat(b"FLV\x01\x05\x00\x00\x00\x09" + bytes(4), tag(b"\x12", _zeros(FILL), F.lit(FILL)), tag(b"\x09", x, n))


def _asf(x: Column, n: Column, j: Column) -> Column:
    head = b"\x30\x26\xb2\x75\x8e\x66\xcf\x11\xa6\xd9\x00\xaa\x00\x62\xce\x6c" + (154).to_bytes(8, "little") + b"\x01\x00\x00\x00\x01\x02" + bytes(16) + (124).to_bytes(8, "little") + bytes(100)
    return _cat(head, b"\x36\x26\xb2\x75\x8e\x66\xcf\x11\xa6\xd9\x00\xaa\x00\x62\xce\x6c", _le(n + 50 + FILL, 8), _zeros(26 + FILL), x)


def _program(x: Column, n: Column, j: Column) -> Column:
    pack = b"\x00\x00\x01\xba\x44\x00\x04\x00\x04\x01\x00\x00\x03\xf8"
    packet = lambda m: _cat(b"\x00\x00\x01\xe0", _be(m, 2))
    return _cat(pack, packet(F.lit(FILL)), _zeros(FILL), _grouped(x, PES, f"000001E0{PES:04X}", packet), b"\x00\x00\x01\xb9")


def _transport(x: Column, n: Column, j: Column) -> Column:
    """Packets of 188 bytes; the last one is filled up."""
    return _grouped(_cat(_zeros(FILL), x, _zeros(F.pmod(-(n + FILL), F.lit(PACKET)))), PACKET, "47", lambda m: F.lit(b""))


def _decoys(x: Column, n: Column, j: Column) -> Column:
    """Signatures with nothing sound behind them, and a picture without its end."""
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR" + bytes(17 + 64)
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00\x99" + bytes(100)
    bmp = b"BM\x88\x13\x00\x00" + bytes(62)
    return F.when(j % 4 == 0, F.lit(png)).when(j % 4 == 1, jpeg(x, 48, 64, ended=False)).when(j % 4 == 2, F.lit(gif)).otherwise(F.lit(bmp))


_pick = lambda names: "CASE " + " ".join(f"WHEN j % {len(names)} = {i} THEN '{x}'" for i, x in enumerate(names)) + " END"
KINDS = (
    Kind(lambda x, n, j: jpeg(x, n % 500 + 1, n % 700 + 1), "n + 45", "'JPEG'", "'jpg'", "'photo'"),
    Kind(_png, "n + 57", "'PNG'", "'png'", "'photo'"),
    Kind(_avi, f"184 + 3 * (53 + n + (n + 1) % 2) + {FILL}", "'AVI'", "'avi'", "'video'"),
    Kind(lambda x, n, j: jpeg(x, 720, 1280), "n + 45", "'JPEG'", "'jpg'", "'photo'"),
    Kind(_gif, f"n + (n + {BLOCK - 1}) // {BLOCK} + 26", "CASE WHEN j % 2 = 0 THEN 'GIF89a' ELSE 'GIF87a' END", "'gif'", "'photo'", "j % 2"),
    Kind(_bmp, "n + 54", "'BMP'", "'bmp'", "'photo'"),
    Kind(_webp, "20 + n + n % 2", "'WebP'", "'webp'", "'photo'"),
    Kind(_tiff(True, False, False), _FAR, "'TIFF'", "'tif'", "'photo'", least=1001),
    Kind(_tiff(False, True, False), _FAR, _pick([m[1] for m in MAKES]), _pick([m[2] for m in MAKES]), "'photo'", f"j % {len(MAKES)}", 1001),
    Kind(_tiff(True, False, True), _FAR, "'CR2'", "'cr2'", "'photo'", least=1001),
    Kind(_raf, "n + 108", "'RAF'", "'raf'", "'photo'", least=1001),
    Kind(_boxes, "n + 36", *[_pick([dims.BRANDS[b][i] for b in BRANDS]) for i in range(3)], f"j % {len(BRANDS)}", 0),
    Kind(_matroska, f"n + 26 + {FILL}", "'Matroska'", "'mkv'", "'video'"),
    Kind(_flv, f"n + 43 + {FILL}", "'FLV'", "'flv'", "'video'"),
    Kind(_asf, f"n + 204 + {FILL}", "'ASF/WMV'", "'wmv'", "'video'"),
    Kind(_program, f"n + 6 * ((n + {PES - 1}) // {PES}) + 24 + {FILL}", "'MPEG-PS'", "'mpg'", "'video'"),
    Kind(_transport, f"188 * ((n + {FILL + PACKET - 1}) // {PACKET})", "'MPEG-TS'", "'ts'", "'video'"),
    Kind(_decoys, "CASE j % 4 WHEN 0 THEN 97 WHEN 1 THEN n + 43 WHEN 2 THEN 114 ELSE 68 END", "NULL", "NULL", "NULL"),
)


def file_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, data): a file of each document's text, in one of KINDS by doc_id."""
    x, k = F.coalesce("text", F.lit("")).cast("binary"), F.pmod("doc_id", F.lit(len(KINDS)))
    at = docs.select("doc_id", x.alias("x"), F.octet_length(x).cast("long").alias("n"), k.alias("k"), F.floor(F.col("doc_id") / len(KINDS)).alias("j"))
    built = F.when(F.lit(False), F.lit(b""))
    for i, kind in enumerate(KINDS):
        built = built.when(F.col("k") == i, kind.build(F.col("x"), F.col("n"), F.col("j")))
    return at.select("doc_id", F.concat(built, F.lit(bytes(GAP))).alias("data"))


def _twice() -> Column:
    """Every seventh document's file is there twice."""
    return F.pmod("doc_id", F.lit(7)) == 0


def lay_out_mixed(spark: SparkSession, sf_dir: str, times: int = 1) -> str:
    """The path of the mixed image; all of it `times` over."""
    copies = F.explode(F.when(_twice(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    pieces = file_bytes(table(spark, sf_dir, "documents")).select("doc_id", "data", copies.alias("copy"))
    nr = 2 * F.col("doc_id") + F.col("copy")
    if times > 1:
        last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
        pieces = pieces.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        nr = nr + F.col("round") * (2 * last + 2)
    return lay_in_order(spark, pieces.select(nr.alias("nr"), "data"), "nr")


def file_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, place) of the files of the mixed image."""
    copies = F.explode(F.when(_twice(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    sizes = materialise(file_bytes(table(spark, sf_dir, "documents")).select("doc_id", F.octet_length("data").cast("long").alias("n"))).withColumn("copy", copies)
    return materialise(running_before(sizes.withColumn("nr", 2 * F.col("doc_id") + F.col("copy")), [], ["nr"], {"place": (F.col("n"), "sum")}).select("doc_id", "place"))


def e17_mixed_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the mixed image: format, bucket, extent, name and, of pictures, how far the last film's start is."""
    path = lay_out_mixed(spark, sf_dir)
    found = C.carve(spark, path, C.Settings(photo_min=LEAST), image_id="mixed")
    drop_folder(spark, path)  # chosen files and their hashes are tables by now
    name = F.regexp_extract("path", r"^[a-z]+/[a-z_]+_\d+", 0)
    return found.select("format", "extension", "bucket", "source_offset", "source_end", "size_bytes", name.alias("name"), F.col("jpeg.width").alias("width"), F.col("jpeg.height").alias("height"), F.col("jpeg.near_video_offset_bytes").alias("behind_film"))


def _by_kind(f: Callable[[Kind], str | int | None]) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {f(kind)}" for i, kind in enumerate(KINDS)) + " END"


_FILES = f"""t AS (SELECT doc_id, coalesce(text, '') AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, doc_id % {len(KINDS)} AS k, doc_id // {len(KINDS)} AS j FROM documents),
s AS (SELECT *, CAST({_by_kind(lambda k: k.length)} AS BIGINT) AS z, {_by_kind(lambda k: k.format)} AS format, {_by_kind(lambda k: k.extension)} AS extension, {_by_kind(lambda k: k.media)} AS media, {_by_kind(lambda k: k.param)} AS param, {_by_kind(lambda k: k.least)} AS least FROM t),
p AS (SELECT *, CAST(coalesce(sum(z + {GAP}) OVER (ORDER BY doc_id, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM s, (VALUES (0), (1)) v(c) WHERE c = 0 OR doc_id % 7 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY a) AS id, row_number() OVER (PARTITION BY k, param, x ORDER BY a) AS nth, max(CASE WHEN media = 'video' THEN a END) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING) AS film
  FROM p WHERE media IS NOT NULL AND z >= least)"""
ORACLES["e17_mixed_image"] = f"""WITH {_FILES}, b AS (SELECT *, CASE WHEN media = 'video' THEN 'videos' WHEN k = 3 AND film IS NOT NULL THEN 'frames' ELSE 'photos' END AS bucket FROM f WHERE nth = 1)
SELECT format, extension, bucket, a AS source_offset, a + z AS source_end, z AS size_bytes, bucket || '/' || CASE bucket WHEN 'frames' THEN 'video_frame' ELSE media END || '_' || lpad(CAST(id AS VARCHAR), greatest(5, length(CAST(id AS VARCHAR)))::INT, '0') AS name,
  CAST(CASE k WHEN 0 THEN n % 700 + 1 WHEN 3 THEN 1280 END AS INTEGER) AS width, CAST(CASE k WHEN 0 THEN n % 500 + 1 WHEN 3 THEN 720 END AS INTEGER) AS height, CASE WHEN k IN (0, 3) THEN a - film END AS behind_film FROM b"""

QUERIES["e17_mixed_image"] = e17_mixed_image


def v2_carve_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files in each document's bytes, by the table function in SQL: some zeros, a file, and behind every seventh one a copy."""
    data = file_bytes(table(spark, sf_dir, "documents"))
    content = F.concat(F.unhex(F.repeat(F.lit("00"), F.pmod("doc_id", F.lit(50)).cast("int"))), "data", F.when(_twice(), F.col("data")).otherwise(F.lit(b"")))
    C.carve_function(spark)
    data.select("doc_id", content.alias("content")).createOrReplaceTempView("_contents")
    return spark.sql(f"SELECT doc_id, f.* FROM _contents, LATERAL carve(content, {LEAST}) f")


ORACLES["v2_carve_content"] = f"""WITH {_FILES} SELECT doc_id, doc_id % 50 + c * (z + {GAP}) AS start, doc_id % 50 + c * (z + {GAP}) + z AS "end", format, extension, media,
  CAST(CASE k WHEN 0 THEN n % 700 + 1 WHEN 3 THEN 1280 END AS INTEGER) AS width, CAST(CASE k WHEN 0 THEN n % 500 + 1 WHEN 3 THEN 720 END AS INTEGER) AS height FROM f"""

QUERIES["v2_carve_content"] = v2_carve_content


def k5_report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of a classification report, read back: pictures of the mixed image, half of which were copied out, judged, with the moves that they ask for."""
    path, folder = lay_out_mixed(spark, sf_dir), new_folder(spark, "extracted")
    found = materialise(C.carve(spark, path, C.Settings(photo_min=LEAST), image_id="mixed"))
    out = f"{folder}/files"
    C.extract(found.where(F.col("source_offset") % 2 == 0), path, out).agg(F.sum("bytes")).collect()  # one row
    drop_folder(spark, path)
    M.append_json(found, f"{folder}/manifest")
    lines = M.lines(spark, f"{folder}/manifest")
    manifest = M.parse_manifest(lines).where("kind = 'valid'")
    items = materialise(with_presence(classify.classify(manifest), M.listing(spark, out), out))
    drop_folder(spark, out)
    moves = classify.plan_moves(items).select("path", "suggested", "status", "reason", "path_after")
    told = items.select("path", "bucket", "source_offset", "present", "still", "frame", "suggested", F.array_join("reasons", ";").alias("reasons"))
    write_report(spark, classify.report(lines, told, moves, {"manifest": f"{folder}/manifest"}), f"{folder}/report")
    report = read_report(spark, f"{folder}/report")
    total = report["summary"]["jpeg_rows"] + report["summary"]["skipped_non_jpeg"]
    return report["items"].join(report["bucket_moves"].select("path", "status", "reason"), "path").select("source_offset", "bucket", "present", "still", "frame", "suggested", "status", "reason", F.lit(total).cast("long").alias("manifest_rows"))


ORACLES["k5_report_items"] = f"""WITH {_FILES}, b AS (SELECT *, CASE WHEN media = 'video' THEN 'videos' WHEN k = 3 AND film IS NOT NULL THEN 'frames' ELSE 'photos' END AS bucket, count(*) OVER () AS manifest_rows FROM f WHERE nth = 1),
i AS (SELECT *, round(8.0 * z / (CASE k WHEN 3 THEN 921600.0 ELSE CAST((n % 500 + 1) * (n % 700 + 1) AS DOUBLE) END), 5) AS bpp FROM b WHERE k IN (0, 3)),
j AS (SELECT *, CASE WHEN bucket = 'photos' THEN 1 ELSE 0 END + CASE WHEN bpp > 0.72 AND k = 0 THEN 1 ELSE 0 END AS still,
  CASE WHEN bucket = 'frames' THEN 2 ELSE 0 END + CASE WHEN k = 3 THEN 4 ELSE 0 END + CASE WHEN a - film <= {dims.VIDEO_WINDOW} THEN 1 ELSE 0 END + CASE WHEN bpp < 0.22 THEN 2 ELSE 0 END AS frame FROM i),
v AS (SELECT *, CASE WHEN still >= frame + 2 THEN 'likely_still' WHEN frame >= still + 2 THEN 'likely_frame' ELSE 'uncertain' END AS suggested, a % 2 = 0 AS present FROM j),
r AS (SELECT *, CASE WHEN NOT present THEN 'file_not_found' WHEN suggested = 'uncertain' THEN 'uncertain_or_neutral_suggestion' WHEN (suggested = 'likely_still') = (bucket = 'photos') THEN 'already_in_target_bucket' END AS reason FROM v)
SELECT a AS source_offset, bucket, present, still, frame, suggested, CASE WHEN reason IS NULL THEN 'planned' ELSE 'skipped' END AS status, reason, manifest_rows FROM r"""

QUERIES["k5_report_items"] = k5_report_items
