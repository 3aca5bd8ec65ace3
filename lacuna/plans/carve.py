"""Carve files out of raw images: candidates, extents, greedy choice, routing, ids, duplicates, manifest, payloads."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import dims
from ..functions import text as T
from ..operators import dedup as D
from ..operators.intervals import gap_regions, greedy_nonoverlap, inside_spans
from ..operators.ordered import running_before
from ..parsers import find_end, images, videos
from ..parsers.source import Source
from ..sources.rawimage import ImageFile, clamp, input_size, located, new_file
from ..sources.scratch import materialise

#: Bytes that a tile repeats of the next one: a sync pattern needs 8 * 192.
LOOK_AHEAD = 8 * 192
#: Bytes of the image that a task scans, hashes or copies.
TASK_BYTES = 32 * dims.MIB
#: Tasks that chosen files are dealt to at most.
MOST_TASKS = 4096
#: What may begin a file -> how far behind the file's first byte it stands.
_STARTS = {s.magic: s.offset for s in dims.SIGNATURES}
FOUND = "image_id string, start bigint, end bigint, format string, extension string, media string, width int, height int, progressive boolean, is_mjpeg boolean, valid boolean"
HASHES = "prefix_md5 string, sha256 string"
#: Format of a row that is a part of a transport stream, as far as one tile shows it.
RUN = "sync-run"


@dataclass(frozen=True)
class Settings:
    photo_min: int = dims.PHOTO_MIN
    video_min: int = dims.VIDEO_MIN
    frame_sizes: tuple = dims.FRAME_SIZES
    skip_after_video: bool = False  # route JPEGs close behind a video to frames
    window: int = dims.VIDEO_WINDOW
    burst: bool = False
    dedup: str = "strict"  # by SHA-256 of all bytes; fast: by MD5 of the first ones; none
    photo_prefix: str = ""
    video_prefix: str = ""
    first_id: int = 0
    validate: str = "structure"  # JPEGs: all segments and the scan must end where the file does; none: any end marker counts; decode: Pillow must read it whole, too
    min_dimension: int = 0  # least width and height of a valid JPEG


def jpeg_extent(src: Source, start: int, end: int, most: int, s: Settings) -> tuple[int, bool]:
    """(end, valid): the first end, from the first end marker on, that gives a valid JPEG; after eight more markers, the first end and False."""
    if s.validate == "none":
        return end, True
    for stop in images.jpeg_ends(src, start, most):
        if stop >= end and images.is_valid_jpeg(src.at(start, stop - start), s.min_dimension, s.validate == "decode"):
            return stop, True
    return end, False


def file_hashes(src: Source, start: int, end: int, whole: bool = True, block: int = 4 * dims.MIB) -> tuple[str, str | None]:
    """(MD5 of the first 64 KiB, SHA-256 of all or None) in pieces; files may be larger than memory."""
    first = hashlib.md5(src.at(start, min(dims.HASH_PREFIX, end - start))).hexdigest()
    if not whole:
        return first, None
    digest = hashlib.sha256()
    for at in range(start, end, block):
        digest.update(src.at(at, min(block, end - at)))
    return first, digest.hexdigest()


def recognise(src: Source, place: int, size: int, s: Settings) -> tuple | None:
    """(end, format, extension, media, valid) of the file that begins at a place: the first signature, in order of priority, whose extent is sound.

    Extents are judged as they are stated, against the greatest size of their format, and then end with the image at most: a file that the image cuts off is kept. A signature that
    fails gives way to the next one. Files whose stated size is below the least of their media don't count, but for those told by a type box. Transport streams are found by sync_run().
    """
    head = src.at(place, LOOK_AHEAD)
    if head[4:8] == b"ftyp":
        if not 8 < int.from_bytes(head[:4], "big") < 200:
            return None
        fmt, ext, media = videos.ftyp_format(src, place)
        end = find_end("isobmff_walk", src, place, dims.PHOTO_MAX if media == "photo" else dims.VIDEO_MAX)
        return None if end is None else (min(end, size), fmt, ext, media, True)
    for sig in dims.SIGNATURES:
        if sig.offset or not head.startswith(sig.magic) or (sig.magic2 and head[sig.offset2 : sig.offset2 + len(sig.magic2)] != sig.magic2):
            continue
        if sig.name == "JPEG" and (len(head) < 4 or head[3] not in dims.JPEG_FOURTH):
            continue
        end = find_end(sig.strategy, src, place, sig.max_size)
        if end is None or end - place < (s.photo_min if sig.media == "photo" else max(s.video_min, dims.VIDEO_MIN)):
            continue
        fmt, ext, valid = sig.name, sig.extension, True
        if sig.strategy == "tiff_ifd":
            fmt, ext = images.tiff_format(src, place)
        elif sig.name == "JPEG":
            end, valid = jpeg_extent(src, place, end, min(sig.max_size, size - place), s)
        return min(end, size), fmt, ext, sig.media, valid
    return None


def sync_run(data: bytes, at: int, stride: int) -> int:
    """Where the sync bytes from `at` on stop within a tile and its look-ahead (the first place without one, or beyond the data)."""
    syncs = data[at::stride]
    found = re.match(b"G*", syncs).end()
    return at + found * stride


def starts_in(data: bytes, own: int) -> Iterator[int]:
    """Places within the first `own` bytes of a tile where a file may begin, ascending: at any signature (a type box begins four bytes before its name) or eight sync bytes."""
    places = set()
    for magic, offset in _STARTS.items():
        found = data.find(magic)
        while found >= 0:
            places.add(found - offset)
            found = data.find(magic, found + 1)
    is_sync = np.frombuffer(data, np.uint8) == 0x47
    syncs = np.flatnonzero(is_sync[: max(0, len(data) - LOOK_AHEAD + 1)])
    for stride in (188, 192):
        at = syncs
        for i in range(1, 8):
            at = at[is_sync[at + i * stride]]
        places.update(at.tolist())
    yield from sorted(at for at in places if 0 <= at < own)


def find_files(spark: SparkSession, path: str, settings: Settings | None = None, start: int = 0, end: int = 0, image_id: str | None = None, tile: int = 4 * dims.MIB) -> DataFrame:
    """All candidate files of an image (FOUND), overlapping ones and invalid JPEGs too: tiles are scanned in parallel, one in a task's memory at a time, extents read the image itself by seeks.

    A transport stream has no length of its own, so tiles only tell how far its sync bytes go in them; runs that meet in step are joined afterwards (join_runs), so the
    image is read about once whatever it holds.
    """
    s, size, name = settings or Settings(), input_size(path), image_id or path
    start, end = clamp(start, end, size)
    tiles = spark.range(start, end, tile, max(1, -(-(end - start) // max(tile, TASK_BYTES)))).withColumnRenamed("id", "offset")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ImageFile(path) as f:
            src = Source(file=f, size=size)
            for tile_rows in batches:
                for offset in tile_rows["offset"]:
                    own = min(tile, end - int(offset))
                    f.seek(int(offset))
                    rows, data, until = [], f.read(own + LOOK_AHEAD), {}  # until: of each stride and step, the end of the run at hand
                    for at in starts_in(data, own):
                        place = int(offset) + at
                        stride = videos.ts_stride(data, at) if data[at] == 0x47 else None
                        if stride and at < until.get((stride, at % stride), 0):
                            continue
                        found = recognise(src, place, size, s)
                        if found is None:
                            if stride:
                                stop = until[stride, at % stride] = sync_run(data, at, stride)
                                rows.append((name, place, min(size, int(offset) + stop), RUN, str(stride), "video", None, None, None, False, True))
                            continue
                        stop, fmt, ext, media, valid = found
                        w, h, prog = (images.jpeg_frame(src.at(place, min(stop - place, dims.MIB))) or (None, None, None)) if fmt == "JPEG" else (None, None, None)
                        mjpeg = fmt == "AVI" and videos.avi_is_mjpeg(src, place, stop)
                        rows.append((name, place, stop, fmt, ext, media, w, h, prog, mjpeg, valid))
                    if rows:
                        out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
                        yield out.astype({"width": "Int32", "height": "Int32", "progressive": "boolean"})

    return materialise(join_runs(materialise(tiles.mapInPandas(scan, FOUND)), s))


def join_runs(found: DataFrame, s: Settings) -> DataFrame:
    """found, with sync runs of one stride and step that meet joined to transport streams; streams of too few bytes go, longer ones than a video may be are cut there.

    Where another candidate ends within a run, a scan that accepted it goes on there, so the rest of the run from its next packet on is a candidate too: a byte before a stream may look like one more sync.
    """
    found = found.withColumn("_run", F.col("format") == RUN)
    if found.where("_run").isEmpty():
        return found.drop("_run")
    step = F.pmod(F.col("start"), F.col("extension").cast("long")).alias("_step")
    runs = gap_regions(found.where("_run").select("*", step), ["image_id", "extension", "_step"], "start", "end", 0)
    runs = runs.groupBy("image_id", "extension", "_step", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = materialise(runs.select("image_id", F.col("extension").cast("long").alias("_stride"), "start", "end"))
    ends = found.where("NOT _run AND valid").select("image_id", "end").unionByName(runs.select("image_id", "end"))
    cut = inside_spans(ends.withColumnRenamed("end", "stop").distinct(), runs, "stop", "start", "end", ["image_id"], pairs=True)
    rest = cut.select("image_id", (F.col("_s_start") + F.ceil((F.col("stop") - F.col("_s_start")) / F.col("_s__stride")) * F.col("_s__stride")).alias("start"), F.col("_s_end").alias("end"))
    runs = runs.select("image_id", "start", "end").unionByName(rest).distinct().where(F.col("end") - F.col("start") > max(s.video_min, dims.VIDEO_MIN))
    longest = dims.VIDEO_MAX // (188 * 192) * (188 * 192)
    cuts = F.explode(F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - 1), F.lit(longest))).alias("start")
    runs = runs.select("image_id", cuts, F.col("end").alias("stop")).select("image_id", "start", F.least("stop", F.col("start") + longest).alias("end")).where(F.col("end") - F.col("start") > max(s.video_min, dims.VIDEO_MIN))
    absent = {"width": "int", "height": "int", "progressive": "boolean"}
    streams = runs.withColumns({"format": F.lit("MPEG-TS"), "extension": F.lit("ts"), "media": F.lit("video"), "is_mjpeg": F.lit(False), "valid": F.lit(True)} | {c: F.lit(None).cast(t) for c, t in absent.items()})
    return found.where("NOT _run").drop("_run").unionByName(streams)


def dealt_by_place(rows: DataFrame, at: str, size: int) -> DataFrame:
    """Rows of an image of `size` bytes, dealt to tasks that read about TASK_BYTES of it each, in order of their place `at`. Rows are narrow, so left alone they would share few tasks, however much these have to read."""
    tasks = min(MOST_TASKS, max(1, -(-size // TASK_BYTES)))
    return rows.repartition(tasks, F.floor(F.col(at) / TASK_BYTES)).sortWithinPartitions(at)


def with_hashes(files: DataFrame, path: str, s: Settings) -> DataFrame:
    """files with prefix_md5, and sha256 if duplicates are told by it: only files that were chosen are read for it."""
    whole = s.dedup != "fast"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ImageFile(path) as f:
            src = Source(file=f, size=f.bytes)
            for rows in batches:
                told = [file_hashes(src, int(a), int(z), whole) for a, z in zip(rows["start"], rows["end"], strict=True)]
                yield rows.assign(prefix_md5=[x[0] for x in told], sha256=[x[1] for x in told])

    kinds = files.schema
    return dealt_by_place(files, "start", input_size(path)).mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), HASHES]))


def route(files: DataFrame, s: Settings) -> DataFrame:
    """Chosen files (is_copy: duplicates that aren't kept) with seq, the nearest video before, whether a JPEG lies in a motion-JPEG film, and its bucket.

    Copies of films count as films before a JPEG, and around it, like any other; copies of pictures don't make a burst.
    """
    files = files.withColumn("seq", F.col("start"))
    video = F.when(F.col("media") == "video", F.col("start"))
    at = running_before(files, ["image_id"], ["seq"], {"video_at": (video, "last")})
    films = files.where("is_mjpeg").select("image_id", "start", "end")
    inside = inside_spans(files.where("format = 'JPEG'").select("image_id", "seq", "start"), films, "start", "start", "end", ["image_id"], extra=lambda p, q: q["_s_start"] < p["start"]).select("image_id", "seq").withColumn("inside", F.lit(True))
    at = at.join(inside, ["image_id", "seq"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    one_of = lambda sizes: F.coalesce(F.array_contains(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in sizes]), F.struct(F.col("width").alias("w"), F.col("height").alias("h"))), F.lit(False)) & F.col("width").isNotNull()
    at = at.withColumn("frame_size", one_of(s.frame_sizes)).withColumn("still_size", one_of(dims.STILL_SIZES)).withColumn("near", F.col("start") - F.col("video_at"))
    close = F.coalesce(F.col("near").between(0, s.window), F.lit(False))
    force = F.col("inside")
    if s.skip_after_video:
        force = force | (close & (F.col("width").isNull() | F.col("frame_size")))
    else:
        force = force | (F.col("video_at").isNotNull() & F.col("frame_size"))
    if s.burst:
        from ..operators.intervals import burst_members

        shape = F.concat_ws("x", "width", "height")
        jpegs = burst_members(at.where("format = 'JPEG' AND width IS NOT NULL AND NOT is_copy"), ["image_id"], ["seq"], "start", shape).select("image_id", "seq", "burst")
        at = at.join(jpegs, ["image_id", "seq"], "left")
        force = force | (F.coalesce("burst", F.lit(False)) & (F.col("inside") | F.col("frame_size") | (close & ~F.col("still_size"))))
    bucket = F.when(F.col("media") == "video", "videos").when((F.col("format") == "JPEG") & force, "frames").otherwise("photos")
    return at.withColumn("bucket", bucket)


def name_files(files: DataFrame, s: Settings) -> DataFrame:
    """file_id over all attempts of a media type, and path. Frames are numbered with the photos."""
    at = D.assign_ids(files, ["image_id", "media"], "seq", s.first_id, "file_id")
    c = F.col
    size = c("end") - c("start")
    plain = T.file_name(F.when(c("bucket") == "frames", "video_frame").otherwise(c("media")), c("file_id"), F.regexp_replace("format", "/", "-"), c("width"), c("height"), size, c("extension"))
    name = plain
    if s.photo_prefix:
        name = F.when(c("bucket") == "photos", T.camera_name(F.lit(s.photo_prefix), c("file_id"), c("extension"))).otherwise(name)
    if s.video_prefix:
        name = F.when(c("bucket") == "videos", T.camera_name(F.lit(s.video_prefix), c("file_id"), c("extension"))).otherwise(name)
    return at.withColumn("size_bytes", size).withColumn("path", F.concat_ws("/", "bucket", name))


def manifest_rows(files: DataFrame, s: Settings) -> DataFrame:
    """Rows as sources.manifest reads them."""
    c = F.col
    bpp = T.bits_per_pixel(c("size_bytes"), c("width"), c("height"))
    jpeg = F.when(c("format") == "JPEG", F.struct(c("width"), c("height"), c("inside").alias("inside_mjpeg_avi"), c("frame_size").alias("matches_skip_frame_resolution"), c("near").alias("near_video_offset_bytes"), F.lit(s.window).cast("long").alias("video_proximity_window_bytes"), bpp.alias("bits_per_pixel"), c("progressive").alias("progressive_jpeg"), c("still_size").alias("matches_common_still_resolution")))
    return files.select(F.lit(2).alias("v"), F.lit(None).cast("string").alias("status"), "image_id", "path", "bucket", "format", "extension", c("start").alias("source_offset"), c("end").alias("source_end"), "size_bytes", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("skip_reason"), "sha256", jpeg.alias("jpeg"))


def skipped_rows(found: DataFrame, chosen: DataFrame, like: DataFrame) -> DataFrame:
    """The JPEGs that a scan meets and finds invalid, as manifest rows (columns of `like`) of status skipped: those that lie in no chosen file."""
    bad = found.where("NOT valid")
    outside = inside_spans(bad, chosen.select("image_id", "start", "end"), "start", "start", "end", ["image_id"], outside=True)
    kind = like.schema["jpeg"].dataType
    known = F.when(F.col("width").isNotNull(), F.struct(*[(F.col(f.name) if f.name in ("width", "height") else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]))
    told = {"v": F.lit(2), "status": F.lit("skipped"), "image_id": F.col("image_id"), "format": F.lit("JPEG"), "source_offset": F.col("start"), "source_end": F.col("end"), "size": F.col("end") - F.col("start"), "skip_reason": F.lit("validation failed after EOI retries")}
    return outside.select(*[(known if f.name == "jpeg" else told.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in like.schema])


def choose(spark: SparkSession, path: str, s: Settings, start: int = 0, end: int = 0, image_id: str | None = None, chunk_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(candidates, chosen files with hashes): of overlapping valid candidates a scan from the start keeps the first."""
    found = find_files(spark, path, s, start, end, image_id).withColumn("chunk", F.floor(F.col("start") / chunk_bytes) if chunk_bytes else F.lit(0).cast("long"))
    return found, materialise(with_hashes(greedy_nonoverlap(found.where("valid"), ["image_id", "chunk"], "start", "end"), path, s))


def carve(spark: SparkSession, path: str, settings: Settings | None = None, start: int = 0, end: int = 0, image_id: str | None = None, seen: DataFrame | None = None, chunk_bytes: int = 0, skipped: bool = False) -> DataFrame:
    """The manifest of an image. seen (sha256, of earlier runs; md5 in fast mode) are duplicates too.

    Of overlapping candidates a scan from the start keeps the first; duplicates keep their place (and, in strict mode, their id) but give no row.
    chunk_bytes > 0 makes the choice anew in every chunk of the image, as a scan in chunks does. skipped adds the JPEGs that weren't valid.
    """
    s = settings or Settings()
    found, chosen = choose(spark, path, s, start, end, image_id, chunk_bytes)
    rows = manifest_rows(keep_new(chosen, s, seen), s)
    return rows.unionByName(skipped_rows(found, chosen, rows)) if skipped else rows


def keep_new(chosen: DataFrame, s: Settings, seen: DataFrame | None = None) -> DataFrame:
    """Chosen files, routed and named, without duplicates: in fast mode those take no id, in strict mode they do; either way films among them count for what follows."""
    if s.dedup == "none":
        return name_files(materialise(route(chosen.withColumn("is_copy", F.lit(False)), s)), s)
    key = F.col("prefix_md5" if s.dedup == "fast" else "sha256")
    at = D.flag_first(chosen, key, "start").withColumn("is_copy", ~F.col("is_first")).drop("is_first")
    if seen is not None:
        old = seen.select(F.col(seen.columns[0]).alias("_old")).distinct().withColumn("_seen", F.lit(True))
        at = at.join(old, key == F.col("_old"), "left").withColumn("is_copy", F.col("is_copy") | F.coalesce("_seen", F.lit(False))).drop("_old", "_seen")
    if s.dedup == "fast":
        return name_files(materialise(route(materialise(at), s).where("NOT is_copy")), s)
    # a strict scan hashes a picture after it has joined a burst
    return name_files(materialise(route(materialise(at.withColumn("_copy", F.col("is_copy")).withColumn("is_copy", F.lit(False))), s)), s).where("NOT _copy")


def scan_stats(chosen: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: files chosen, photos and videos kept, duplicates of both, bytes kept."""
    a = chosen.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("media") == "photo").alias("_p"), F.count_if(F.col("media") == "video").alias("_v"))
    b = kept.agg(F.count_if(F.col("bucket") != "videos").alias("photos"), F.count_if(F.col("bucket") == "videos").alias("videos"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return a.join(b).select("files", "photos", "videos", (F.col("_p") - F.col("photos")).alias("dup_photos"), (F.col("_v") - F.col("videos")).alias("dup_videos"), "bytes")  # one row each


def extract(manifest: DataFrame, image: str, folder: str) -> DataFrame:
    """Copy the files of a manifest out of the image, in pieces, under their paths; (path, bytes, sha256) of what was written.

    A file is written under another name and renamed, so that a repeated task does no harm. folder is a path that all workers share, or a URI of any file system pyarrow knows.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = located(folder)
        with ImageFile(image) as f:
            for rows in batches:
                out = []
                for rel, a, z in zip(rows["path"], rows["source_offset"], rows["source_end"], strict=True):
                    if rel.startswith("/") or ".." in rel.split("/"):
                        raise ValueError(f"unsafe path: {rel}")
                    target, whole = f"{root}/{rel}", hashlib.sha256()
                    fs.create_dir(os.path.dirname(target))
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    with new_file(fs, part) as to:
                        f.seek(a)
                        left = z - a
                        while left > 0 and (piece := f.read(min(left, 4 * dims.MIB))):
                            to.write(piece)
                            whole.update(piece)
                            left -= len(piece)
                    fs.move(part, target)
                    out.append((rel, int(z - a - left), whole.hexdigest()))
                yield pd.DataFrame(out, columns=["path", "bytes", "sha256"])

    fs, root = located(folder)
    fs.create_dir(root)
    return dealt_by_place(manifest.select("path", "source_offset", "source_end"), "source_offset", input_size(image)).mapInPandas(write, "path string, bytes bigint, sha256 string")


def carve_bytes(data: bytes, settings: Settings | None = None) -> Iterator[tuple]:
    """(start, end, format, extension, media, width, height) of the files in some bytes, as a scan from the start accepts them."""
    s, src, until = settings or Settings(), Source(data), 0
    for at in starts_in(data, len(data)):
        if at < until:
            continue
        found, stride = recognise(src, at, len(data), s), videos.ts_stride(data, at) if data[at] == 0x47 else None
        if found is None and stride:
            stop = min(len(data), sync_run(data, at, stride))
            found = (stop, "MPEG-TS", "ts", "video", stop - at > max(s.video_min, dims.VIDEO_MIN))
        if found is None or not found[4]:
            continue
        until, fmt, ext, media, _ = found
        w, h, _ = (images.jpeg_frame(src.at(at, min(until - at, dims.MIB))) or (None, None, None)) if fmt == "JPEG" else (None, None, None)
        yield at, until, fmt, ext, media, w, h


class CarveFunction:
    """Table function: the files in a value's bytes; null bytes hold none. photo_min is the least size of pictures."""

    def eval(self, content: bytes, photo_min: int):
        if content is not None:
            yield from carve_bytes(bytes(content), Settings(photo_min=photo_min))


def carve_function(spark: SparkSession):
    """Registers carve(content, photo_min) for SQL and returns it for lateral joins: one value at a time, of up to 2 GB; larger images go through carve()."""
    f = udtf(CarveFunction, returnType="start bigint, end bigint, format string, extension string, media string, width int, height int")
    spark.udtf.register("carve", f)
    return f
