"""Weighted rules: still or video frame, best model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Lead that one score must have over the other.
MARGIN = 2


def still_or_frame(bucket: Column, inside_mjpeg: Column, frame_size: Column, near: Column, window: Column, still_size: Column, bpp: Column, progressive: Column, has_camera: Column, has_time: Column) -> dict[str, Column]:
    """still, frame (scores), reasons (array, in order of the rules) and suggested, from nullable facts: null is 'not known' and fires no rule."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    rules = [  # condition, points for still, points for frame, reason
        (sure(bucket == "frames"), 0, 2, "carver_bucket_frames"),
        (sure(bucket == "photos"), 1, 0, "carver_bucket_photos"),
        (sure(inside_mjpeg), 0, 4, "jpeg_inside_mjpeg_avi"),
        (sure(frame_size), 0, 4, "matches_skip_frame_resolution"),
        (sure((near >= 0) & (near <= window)), 0, 1, "within_video_proximity_window"),
        (sure(still_size), 2, 0, "common_still_photo_resolution"),
        (sure((bpp > 0) & (bpp < 0.22)), 0, 2, "low_bits_per_pixel_heavy_compression"),
        (sure(bpp > 0.72) & ~sure(frame_size), 1, 0, "higher_bits_per_pixel_milder_compression"),
        (sure(progressive), 1, 0, "progressive_jpeg"),
        (sure(has_camera), 3, 0, "exif_camera_make_or_model"),
        (sure(has_time), 1, 0, "exif_timestamp"),
    ]
    total = lambda i: sum((F.when(r[0], r[i]).otherwise(0) for r in rules if r[i]), F.lit(0))
    still, frame = total(1), total(2)
    reasons = F.array_compact(F.array(*[F.when(r[0], F.lit(r[3])) for r in rules]))
    return {"still": still, "frame": frame, "reasons": reasons, "suggested": verdict(still, frame)}


def verdict(still: Column, frame: Column) -> Column:
    return F.when(still >= frame + MARGIN, "likely_still").when(frame >= still + MARGIN, "likely_frame").otherwise("uncertain")


def target_bucket(suggested: Column) -> Column:
    """Folder that a suggestion asks for; null for uncertain."""
    return F.when(suggested == "likely_still", "photos").when(suggested == "likely_frame", "frames")


def is_model_type(kind: Column) -> Column:
    """No type, or one of language models."""
    return F.coalesce(F.lower(kind), F.lit("")).isin("", "llm", "model")


def model_score(name: Column, hint: Column, loaded: Column, tool_use: Column, params: Column, prefer_small: bool) -> Column:
    """Sort score of a model; params null if unknown."""
    label = F.concat_ws(" ", name, F.coalesce(hint, F.lit("")))
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), float(n)).otherwise(0.0)
    score = points(loaded, 1000) + points(tool_use, 500) + points(label.rlike("(?i)coder|instruct|chat"), 100) + points(label.rlike("(?i)abliterat|uncensor"), 300 if prefer_small else 600)
    if prefer_small:
        return score + F.when(params.isNull(), -1.0).otherwise(points(params <= 8.5e9, 400) - params / 1e12)
    return score + F.coalesce(params / 1e9, F.lit(0.0))


def known_params(stated: Column, *names: Column) -> Column:
    """The stated amount, else what the first name says."""
    return F.coalesce(T.parse_params(stated), T.infer_params(T.first_text(*names)))
