"""Match carved JPEGs with the frames inside carved films; what matches none lies in orphan regions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import dims
from ..functions import text as T
from ..operators.intervals import gap_regions, inside_spans
from ..parsers import videos
from ..parsers.source import Source
from ..sources.rawimage import located

#: Films that a task reads, by number and bytes; tasks at most.
TASK_FILES, TASK_BYTES, MOST_TASKS = 1000, 32 * dims.MIB, 4096
FRAMES = "index int, offset_in_avi bigint, chunk_size bigint, jpeg_size bigint, sha256 string, is_jpeg boolean"


class AviFrames:
    """Table function: the frames of an AVI given as bytes."""

    def eval(self, content: bytes):
        if content is not None:
            yield from videos.avi_frames(Source(bytes(content)))


def avi_frames(spark: SparkSession):
    """Registers avi_frames(content) for SQL and returns it for use in lateral joins."""
    f = udtf(AviFrames, returnType=FRAMES)
    spark.udtf.register("avi_frames", f)
    return f


def frames_of_files(files: DataFrame) -> DataFrame:
    """files (path, name, and size where it is known) -> (video, ...FRAMES): films are read in place by seeks, one file a row, so their size doesn't matter. Files are dealt to tasks by what there is to read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, name in zip(rows["path"], rows["name"], strict=True):
                fs, at = located(path.removeprefix("file:") if "://" not in path else path)
                with fs.open_input_file(at) as f:
                    found = [(name, *x) for x in videos.avi_frames(Source(file=f, size=f.size()))]
                if found:
                    yield pd.DataFrame(found, columns=["video", *[c.split()[0] for c in FRAMES.split(", ")]])

    n, size = files.agg(F.count(F.lit(1)), F.sum("size") if "size" in files.columns else F.lit(0)).first()
    tasks = min(MOST_TASKS, max(1, -(-n // TASK_FILES), -(-(size or 0) // TASK_BYTES)))
    return files.select("path", "name").repartition(tasks, "path").mapInPandas(read, f"video string, {FRAMES}")


def match_frames(carved: DataFrame, frames: DataFrame) -> DataFrame:
    """frames with fname and bucket of the carved file (sha256, fname, bucket, seq) of equal hash; of several with one hash the last counts.

    A hash join; the smaller side is broadcast only if it is measured to be small.
    """
    build = carved.groupBy("sha256").agg(F.max_by(F.struct("fname", "bucket"), "seq").alias("_c")).select("sha256", "_c.fname", "_c.bucket")
    return frames.join(build, "sha256", "left")


def file_matches(matched: DataFrame) -> DataFrame:
    """(fname, bucket, video, index): the last frame, by video then index, that each carved file matches."""
    best = matched.where("fname IS NOT NULL").groupBy("fname").agg(F.max_by(F.struct("bucket", "video", "index"), F.struct("video", "index")).alias("_m"))
    return best.select("fname", "_m.bucket", "_m.video", "_m.index")


def orphans(carved: DataFrame, matches: DataFrame) -> DataFrame:
    """Carved files without a match."""
    return carved.join(matches.select("fname"), "fname", "left_anti").select("fname", "bucket").distinct().orderBy("fname")


def orphan_names(left: DataFrame, n: int = 10) -> DataFrame:
    """The first n orphans by name, with what is said of the rest: (fname, bucket, more), more being how many there are beyond."""
    total = left.agg(F.count(F.lit(1)).alias("_all"))
    return left.orderBy("fname").limit(n).join(total).select("fname", "bucket", F.greatest(F.lit(0), F.col("_all") - n).cast("long").alias("more"))  # one row


def per_video(films: DataFrame, matched: DataFrame) -> DataFrame:
    """Every film (video), even without frames: total, jpeg, matched and unrecovered frames."""
    counts = matched.groupBy("video").agg(F.count(F.lit(1)).alias("total_frames"), F.count_if("is_jpeg").alias("jpeg_frames"), F.count("fname").alias("matched_carved"))
    at = films.select("video").distinct().join(counts, "video", "left").na.fill(0)
    return at.withColumn("unrecovered", F.col("total_frames") - F.col("matched_carved"))


def orphan_regions(items: DataFrame, spans: DataFrame, gap: int = dims.ORPHAN_GAP) -> DataFrame:
    """Regions (start, end, frame_count, files) of orphans (fname, start, end) that lie in no film's span."""
    out = inside_spans(items, spans, "start", "start", "end", outside=True)
    runs = gap_regions(out, [], "start", "end", gap, ties=["fname"])
    files = F.transform(F.array_sort(F.collect_list(F.struct("start", "fname"))), lambda x: x["fname"])
    found = runs.groupBy("region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("frame_count"), files.alias("files"))
    return found.withColumn("start_mb", T.mib(F.col("start"))).withColumn("end_mb", T.mib(F.col("end"))).orderBy("start")


def summary(carved: DataFrame, videos_: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of totals and rates in percent, 0 where there is nothing to divide by."""
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 2), F.lit(0.0))
    a = carved.agg(F.count_distinct("fname").alias("carved_files"))
    b = videos_.agg(F.count(F.lit(1)).alias("videos"), F.coalesce(F.sum("total_frames"), F.lit(0)).alias("avi_frames"))
    c = matches.agg(F.count(F.lit(1)).alias("matched_to_video"))
    at = a.join(b).join(c)  # one row each
    at = at.withColumn("orphaned", F.col("carved_files") - F.col("matched_to_video"))
    return at.withColumn("match_rate_percent", rate("matched_to_video", "carved_files")).withColumn("recovery_rate_percent", rate("matched_to_video", "avi_frames"))


def report(carved: DataFrame, films: DataFrame, matched: DataFrame, regions: DataFrame, facts: dict) -> dict[str, DataFrame | dict]:
    """The sections of a cross-verification report (see sources.reports): facts, totals, a row a film, the orphans and their regions."""
    told, matches = per_video(films, matched), file_matches(matched)
    return {"facts": facts, "summary": summary(carved, told, matches).first().asDict(), "videos": told, "orphans": orphans(carved, matches), "regions": regions}


def offsets_of(manifest: DataFrame) -> DataFrame:
    """(fname, start, end): where each carved JPEG lies, by file name; of several rows of one name the last (line_no) counts. Rows without whole offsets are left out."""
    name = F.substring_index("path", "/", -1)
    at = manifest.where("format = 'JPEG' AND path IS NOT NULL AND source_offset IS NOT NULL AND source_end IS NOT NULL").withColumn("fname", name)
    best = at.groupBy("fname").agg(F.max_by(F.struct("source_offset", "source_end"), "line_no").alias("_o"))
    return best.select("fname", F.col("_o.source_offset").alias("start"), F.col("_o.source_end").alias("end"))


def film_spans(manifest: DataFrame) -> DataFrame:
    """(start, end, path) of the AVI files of a manifest, in order."""
    at = manifest.where("format = 'AVI' AND source_offset IS NOT NULL AND source_end IS NOT NULL")
    return at.select(F.col("source_offset").alias("start"), F.col("source_end").alias("end"), "path").orderBy("start")


def frame_sized(manifest: DataFrame) -> DataFrame:
    """The JPEG rows whose size is one of video frames; not known counts as no."""
    return manifest.where("format = 'JPEG'").where(F.coalesce(F.col("jpeg.matches_skip_frame_resolution"), F.lit(False)))
