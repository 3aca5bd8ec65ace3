"""Classify a recovery manifest: still or frame, with reasons, move plan and summary."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..sources import manifest as M
from ..sources.rawimage import located


def skip_code(fmt: Column) -> Column:
    """Why a row that isn't a JPEG isn't scored."""
    return F.when(fmt.isNull() | (fmt == ""), "missing_format").otherwise("format_not_jpeg")


def bucket_of(path: Column) -> Column:
    """photos or frames, if the path is below one."""
    top = F.substring_index(path, "/", 1)
    return F.when(path.contains("/") & top.isin("photos", "frames"), top)


def plan_moves(items: DataFrame, taken: DataFrame | None = None, executed: bool = False) -> DataFrame:
    """items (path, suggested, present) with status, reason, path_after, apply_executed.

    The first of these reasons that applies skips a row: file_not_found, uncertain_or_neutral_suggestion, not_under_photos_or_frames,
    already_in_target_bucket, unsafe_relative_path. taken (path) lists files that exist: a name that is taken gets
    _reclass, then _reclass_2 and so on; items that want the same name are numbered too. A null path is under no bucket.
    """
    want, have = S.target_bucket(F.col("suggested")), bucket_of(F.col("path"))
    reason = (
        F.when(~F.coalesce("present", F.lit(False)), "file_not_found")
        .when(want.isNull(), "uncertain_or_neutral_suggestion")
        .when(have.isNull(), "not_under_photos_or_frames")
        .when(have == want, "already_in_target_bucket")
        .when(T.is_unsafe_path(F.col("path")), "unsafe_relative_path")
    )
    goal = F.when(reason.isNull(), F.concat(want, F.substring(F.col("path"), F.length(have) + 1, F.length("path"))))
    at = items.withColumn("reason", reason).withColumn("path_after", goal)
    if taken is not None:
        at = _free_names(at, taken)
    status = F.when(F.col("reason").isNotNull(), "skipped").otherwise(F.lit("moved" if executed else "planned"))
    return at.withColumn("status", status).withColumn("apply_executed", F.lit(executed))


def _free_names(at: DataFrame, taken: DataFrame) -> DataFrame:
    parts = T.path_parts(F.col("path_after"))
    folder = F.substring(F.col("path_after"), F.lit(1), F.length("path_after") - F.length(parts["name"]))
    pattern = r"^(.*?)(?:_reclass(?:_(\d+))?)?(\.[^./]*)?$"
    known = taken.select(F.concat(F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 3)).alias("_base"), F.when(F.regexp_extract("path", r"_reclass(_\d+)?(\.[^./]*)?$", 0) == "", 0).otherwise(F.coalesce(F.regexp_extract("path", pattern, 2).try_cast("int"), F.lit(1))).alias("_n"))
    used = known.groupBy("_base").agg(F.array_sort(F.collect_set("_n")).alias("_used"))
    at = at.join(used, at["path_after"] == used["_base"], "left").withColumn("_rank", F.row_number().over(Window.partitionBy("path_after").orderBy("path")))
    # the _rank-th number, from 0, that isn't used
    candidates = F.sequence(F.lit(0), F.col("_rank") + F.size(F.coalesce("_used", F.array().cast("array<int>"))))
    n = F.get(F.array_except(candidates, F.coalesce("_used", F.array().cast("array<int>"))), F.col("_rank") - 1)
    label = F.when(n == 0, "").when(n == 1, "_reclass").otherwise(F.concat(F.lit("_reclass_"), n.cast("string")))
    return at.withColumn("path_after", F.when(F.col("path_after").isNotNull(), F.concat(folder, parts["stem"], label, parts["suffix"]))).drop("_base", "_used", "_rank")


def classify(manifest: DataFrame, exif: DataFrame | None = None) -> DataFrame:
    """The JPEG rows of a manifest (see sources.manifest) with still, frame, reasons, suggested.

    exif (path, has_camera_identity, has_timestamp, exif_readable) may add facts by path. Rows that the carver skipped have format JPEG too and
    are scored like the others.
    """
    at = manifest.where(F.col("format") == "JPEG")
    if exif is not None:
        at = at.join(exif, "path", "left")
    else:
        at = at.withColumns({c: F.lit(None).cast("boolean") for c in ("has_camera_identity", "has_timestamp", "exif_readable")})
    j = lambda name: F.col(f"jpeg.{name}")
    return at.withColumns(
        S.still_or_frame(F.col("bucket"), j("inside_mjpeg_avi"), j("matches_skip_frame_resolution"), j("near_video_offset_bytes"), j("video_proximity_window_bytes"), j("matches_common_still_resolution"), j("bits_per_pixel"), j("progressive_jpeg"), F.col("has_camera_identity"), F.col("has_timestamp"))
    )


def skipped_rows(manifest: DataFrame) -> DataFrame:
    """The rows that aren't scored, with their code."""
    return manifest.where(~F.col("format").eqNullSafe("JPEG")).select("path", "bucket", "format", skip_code(F.col("format")).alias("reason_code"))


def summary(items: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """One row: counts of suggestions, all of them even at 0, and of move statuses."""
    count = lambda name: F.count_if(F.col("suggested") == name).alias(name)
    out = items.agg(F.count(F.lit(1)).alias("jpeg_rows"), *map(count, ("likely_still", "likely_frame", "uncertain")))
    if moves is None:
        return out
    return out.join(moves.agg(*[F.count_if(F.col("status") == s).alias(f"moves_{s}") for s in ("planned", "moved", "skipped", "error")]))  # one row each


def report(lines: DataFrame, items: DataFrame, moves: DataFrame, facts: dict) -> dict[str, DataFrame | dict]:
    """The sections of a classification report (see sources.reports): facts, what was read, what wasn't, counts, rows that weren't scored, moves and items. lines are the manifest's (line, and line_no where it is known)."""
    counted = lambda df: {k: int(v) for k, v in df.first().asDict().items()}  # noqa: E731  one row
    parsed = M.parse_manifest(lines).where("kind = 'valid'")
    counts = counted(summary(items, moves)) | {"skipped_non_jpeg": parsed.where(~F.col("format").eqNullSafe("JPEG")).count()}
    return {"facts": facts, "manifest_input_stats": counted(M.input_stats(lines)), "summary": counts, "manifest_load_issues": M.issues(lines), "skipped_entries": skipped_rows(parsed), "bucket_moves": moves, "items": items}


def write_csv(items: DataFrame, folder: str) -> None:
    """csv_rows() with a header, as CSV files in a folder."""
    csv_rows(items).write.mode("overwrite").option("header", True).csv(folder)


def csv_rows(items: DataFrame) -> DataFrame:
    """The summary table as it goes into a CSV file: reasons joined by ';'."""
    return items.select("path", "bucket", "suggested", F.col("still").alias("score_still"), F.col("frame").alias("score_frame"), F.array_join("reasons", ";").alias("reasons"))


def apply_moves(moves: DataFrame, root: str) -> DataFrame:
    """Rename the planned files below a folder (a path that all workers share, or a URI of any file system pyarrow knows); moves with status moved, skipped (file_not_found_at_rename) or error.

    A file that is already at its new place and no longer at the old one counts as moved, so a repeated task does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = located(root)
        there = lambda path: fs.get_file_info(path).type == pyarrow.fs.FileType.File
        for rows in batches:
            for i, r in rows[rows["status"] == "planned"].iterrows():
                old, new = f"{top}/{r['path']}", f"{top}/{r['path_after']}"
                try:
                    if there(old):
                        fs.create_dir(os.path.dirname(new))
                        fs.move(old, new)
                    elif not there(new):
                        rows.loc[i, ["status", "reason"]] = ["skipped", "file_not_found_at_rename"]
                        continue
                    rows.loc[i, "status"] = "moved"
                except OSError as e:
                    rows.loc[i, ["status", "reason"]] = ["error", str(e)]
            yield rows

    at = moves.select("path", "suggested", "status", "reason", "path_after")
    return at.mapInPandas(run, at.schema)
