"""Fixed values of the formats and rules: signatures, brands, makes, resolutions, thresholds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


class Signature(NamedTuple):
    name: str
    media: str  # photo | video
    extension: str
    magic: bytes
    offset: int  # of magic within the file
    magic2: bytes  # b"" if none
    offset2: int
    strategy: str  # name of the extent parser
    max_size: int


# Greatest and least sizes of pictures and films.
PHOTO_MAX, VIDEO_MAX = 80 * MIB, 8 * GIB
PHOTO_MIN, VIDEO_MIN = 4 * KIB, 50 * KIB

# The signatures in order of priority.
SIGNATURES = (
    Signature("JPEG", "photo", "jpg", b"\xff\xd8\xff", 0, b"", 0, "jpeg_eoi", PHOTO_MAX),
    Signature("PNG", "photo", "png", b"\x89PNG\r\n\x1a\n", 0, b"", 0, "png_iend", PHOTO_MAX),
    Signature("GIF87a", "photo", "gif", b"GIF87a", 0, b"", 0, "gif_trailer", PHOTO_MAX),
    Signature("GIF89a", "photo", "gif", b"GIF89a", 0, b"", 0, "gif_trailer", PHOTO_MAX),
    Signature("BMP", "photo", "bmp", b"BM", 0, b"", 0, "bmp_header", PHOTO_MAX),
    Signature("RAF", "photo", "raf", b"FUJIFILMCCD-RAW", 0, b"", 0, "raf_header", PHOTO_MAX),
    Signature("WebP", "photo", "webp", b"RIFF", 0, b"WEBP", 8, "riff_size", PHOTO_MAX),
    Signature("AVI", "video", "avi", b"RIFF", 0, b"AVI ", 8, "riff_size", VIDEO_MAX),
    Signature("TIFF-LE", "photo", "tif", b"II\x2a\x00", 0, b"", 0, "tiff_ifd", PHOTO_MAX),
    Signature("TIFF-BE", "photo", "tif", b"MM\x00\x2a", 0, b"", 0, "tiff_ifd", PHOTO_MAX),
    Signature("Matroska", "video", "mkv", b"\x1a\x45\xdf\xa3", 0, b"", 0, "ebml_walk", VIDEO_MAX),
    Signature("FLV", "video", "flv", b"FLV\x01", 0, b"", 0, "flv_tags", VIDEO_MAX),
    Signature("ASF/WMV", "video", "wmv", b"\x30\x26\xb2\x75\x8e\x66\xcf\x11\xa6\xd9\x00\xaa\x00\x62\xce\x6c", 0, b"", 0, "asf_header", VIDEO_MAX),
    Signature("MPEG-PS", "video", "mpg", b"\x00\x00\x01\xba", 0, b"", 0, "mpeg_ps_scan", VIDEO_MAX),
    Signature("MP4/MOV", "video", "mp4", b"ftyp", 4, b"", 0, "isobmff_walk", VIDEO_MAX),
)
# Fourth byte of a JPEG.
JPEG_FOURTH = (0xE0, 0xE1, 0xE2, 0xE3, 0xDB, 0xC0, 0xC2, 0xC4, 0xEE, 0xED, 0xFE)
# Brand of an ftyp box -> (format, extension, media).
BRANDS = {
    "isom": ("MP4", "mp4", "video"), "iso2": ("MP4", "mp4", "video"), "iso5": ("MP4", "mp4", "video"), "iso6": ("MP4", "mp4", "video"),
    "mp41": ("MP4", "mp4", "video"), "mp42": ("MP4", "mp4", "video"), "M4V ": ("M4V", "m4v", "video"), "M4A ": ("M4A", "m4a", "video"),
    "qt  ": ("MOV", "mov", "video"), "3gp4": ("3GP", "3gp", "video"), "3gp5": ("3GP", "3gp", "video"), "3gp6": ("3GP", "3gp", "video"),
    "3g2a": ("3G2", "3g2", "video"), "dash": ("DASH", "mp4", "video"), "avc1": ("MP4", "mp4", "video"),
    "heic": ("HEIC", "heic", "photo"), "heix": ("HEIC", "heic", "photo"), "mif1": ("HEIF", "heif", "photo"), "msf1": ("HEIF", "heif", "photo"),
    "avif": ("AVIF", "avif", "photo"), "avis": ("AVIF", "avif", "photo"), "crx ": ("CR3", "cr3", "photo"),
}
# Fixed value: what an unknown brand is taken for.
DEFAULT_BRAND = ("MP4", "mp4", "video")
# Text in a TIFF's Make tag, in order of priority -> (format, extension).
MAKES = (
    ("NIKON", "NEF", "nef"), ("SONY", "ARW", "arw"), ("Canon", "CR2", "cr2"), ("OLYMPUS", "ORF", "orf"), ("Panasonic", "RW2", "rw2"), ("SAMSUNG", "SRW", "srw"), ("PENTAX", "PEF", "pef"),
    ("RICOH", "DNG", "dng"), ("DNG", "DNG", "dng"), ("Adobe", "DNG", "dng"), ("FUJIFILM", "RAF", "raf"), ("Phase One", "IIQ", "iiq"), ("Leica", "DNG", "dng"), ("Hasselblad", "3FR", "3fr"),
)
# Handlers (lower case) of motion JPEG in an AVI's stream header.
MJPEG_HANDLERS = (b"mjpg", b"jpeg", b"ijpg", b"avi1", b"dmb1", b"jfif", b"acdv", b"qpeg", b"slmj")
# Usual sizes of stills.
STILL_SIZES = (
    (4032, 3024), (3024, 4032), (4032, 2880), (2880, 4032), (4000, 3000), (3000, 4000), (4608, 3456), (3456, 4608),
    (3264, 2448), (2448, 3264), (3456, 2304), (2304, 3456), (2592, 1944), (1944, 2592), (2560, 1920), (1920, 2560),
    (2048, 1536), (1536, 2048), (1280, 960), (960, 1280), (1024, 768), (768, 1024),
)
# Usual sizes of film frames.
FRAME_SIZES = ((1280, 720), (1920, 1080))
# Prefixes that are probed at a region's start (bytes, name); several may fit.
REGION_PROBES = (
    (b"\xff\xd8\xff", "JPEG"), (b"\x89PNG\r\n\x1a\n", "PNG"), (b"RIFF", "RIFF (AVI/WAV/WebP)"), (b"\x00\x00\x00", "ISOBMFF (MP4/MOV/HEIF)"), (b"\x1a\x45\xdf\xa3", "Matroska/WebM"),
    (b"GIF8", "GIF"), (b"BM", "BMP"), (b"FLV\x01", "FLV"), (b"\x30\x26\xb2\x75", "ASF/WMV"), (b"\x00\x00\x01\xba", "MPEG-PS"), (b"\x47", "MPEG-TS sync"), (b"PK\x03\x04", "ZIP/DOCX/XLSX"), (b"%PDF", "PDF"),
)
# Entropy bands (bits per byte), sampling and merging of blocks.
BANDS = (1.0, 5.0, 7.0)
BLOCK, STRIDE, MERGE_GAP, LEAST_REGION = 4096, 64 * KIB, 2 * MIB, 32 * KIB
# Orphan gap, frame routing window, burst rule, hash prefix.
ORPHAN_GAP, VIDEO_WINDOW, BURST_WINDOW, BURST_COUNT, BURST_STEP, BURST_MEMORY, HASH_PREFIX = 5 * MIB, 256 * MIB, 3 * MIB, 3, MIB, 64, 64 * KIB
# Spanish month names.
MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")


def signatures(spark: SparkSession) -> DataFrame:
    """The signatures as a table, with their priority."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SIGNATURES)], "priority int, name string, media string, extension string, magic binary, offset int, magic2 binary, offset2 int, strategy string, max_size long")


def brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in BRANDS.items()], "brand string, format string, extension string, media string")


def makes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(MAKES)], "priority int, make string, format string, extension string")
