"""JSON-lines sources: recovery manifest with its bad lines, spans, request logs; and the matching sinks."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import SPLIT, numbered_lines
from .rawimage import located
from .scratch import materialise

JPEG = "struct<width:int,height:int,inside_mjpeg_avi:boolean,matches_skip_frame_resolution:boolean,near_video_offset_bytes:bigint,video_proximity_window_bytes:bigint,bits_per_pixel:double,progressive_jpeg:boolean,matches_common_still_resolution:boolean>"
#: Columns of a manifest row; rows of older versions lack some.
SCHEMA = f"v int, status string, path string, bucket string, format string, extension string, source_offset bigint, source_end bigint, size_bytes bigint, size bigint, skip_reason string, sha256 string, jpeg {JPEG}"

#: Tasks that list the folders of one level at most.
LISTING_TASKS = 1000


def lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(line_file, line) of text files, a JSON object a line."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("line_file"), F.col("value").alias("line"))


def kind_of(line) -> F.Column:
    """blank, invalid (no JSON, or no object) or valid."""
    first = F.ltrim(line)
    return F.when(F.trim(F.coalesce(line, F.lit(""))) == "", "blank").when(F.try_parse_json(line).isNull() | ~first.startswith("{"), "invalid").otherwise("valid")


def parse_manifest(rows: DataFrame) -> DataFrame:
    """rows (line, and any others) with kind and the columns of SCHEMA, null where a line isn't valid."""
    at = rows.withColumn("kind", kind_of(F.col("line")))
    at = at.withColumn("_r", F.from_json(F.when(F.col("kind") == "valid", F.col("line")), SCHEMA))
    return at.select(*rows.columns, "kind", "_r.*")


def issues(rows: DataFrame) -> DataFrame:
    """The lines that aren't valid or blank, with reason and a snippet; (line_no is passed on where rows have it)."""
    bad = rows.where(kind_of(F.col("line")) == "invalid")
    reason = F.when(F.try_parse_json("line").isNull(), "invalid_json").otherwise("not_an_object")
    return bad.select(*[c for c in ("line_file", "line_no") if c in rows.columns], reason.alias("reason"), T.snippet(F.col("line")).alias("snippet"))


def with_line_numbers(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(line_file, line_no from 1, line) of manifests or logs of any size; see numbered_lines()."""
    return numbered_lines(spark, path, split_bytes)


def input_stats(rows: DataFrame) -> DataFrame:
    """One row: physical, blank, invalid and parsed lines."""
    kind = kind_of(F.col("line"))
    return rows.agg(F.count(F.lit(1)).alias("physical_lines"), *[F.count_if(kind == k).alias(n) for k, n in (("blank", "blank_lines"), ("invalid", "invalid_lines"), ("valid", "parsed_rows"))])


def spans(rows: DataFrame, with_skipped: bool = False) -> DataFrame:
    """(start, end, format, status, path) of lines whose offsets are whole numbers; format 'unknown' and status 'recovered' by default. JSON true isn't a number."""
    v = F.try_parse_json("line")
    number = lambda name: F.when(F.try_variant_get(v, f"$.{name}", "variant").isNotNull() & F.get_json_object("line", f"$.{name}").rlike(r"^-?\d+$") & ~F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.lit(False)), F.try_variant_get(v, f"$.{name}", "bigint"))
    text = lambda name, default: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(default))
    at = rows.select(number("source_offset").alias("start"), number("source_end").alias("end"), text("format", "unknown").alias("format"), text("status", "recovered").alias("status"), F.try_variant_get(v, "$.path", "string").alias("path"))
    at = at.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    return at if with_skipped else at.where(F.col("status") != "skipped")


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as compact JSON lines without null fields."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("append").text(path)


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Overwrite a Parquet table only if its rows differ (as multisets); whether it wrote."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None and old.columns == df.columns and df.exceptAll(old).isEmpty() and old.exceptAll(df).isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, extension, size) of files below a folder, as it is now; the contents aren't read. Hidden names (those that Spark's readers pass over) are left out.

    Folders are listed by tasks, level by level, so the driver holds no names and a task isn't made for every few files. Patterns, and file systems that pyarrow doesn't know, are left to Spark's reader, which passes over empty files.
    """
    try:
        fs, root = (None, "") if set("*?[{") & set(path) else located(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    except pa.ArrowInvalid:
        fs, root = None, ""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size")) if fs is None else _walked(spark, path, fs, root)
    parts = T.path_parts(F.col("path"))
    found = found.select("path", parts["name"].alias("name"), F.ltrim(parts["suffix"], F.lit(".")).alias("extension"), "size")
    return found.where(F.lower("extension").isin(*[e.lower() for e in extensions])) if extensions else found


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _walked(spark: SparkSession, path: str, fs: pyarrow.fs.FileSystem, root: str) -> DataFrame:
    """(path, size) of the files below a folder, or of a file."""
    local = isinstance(fs, pyarrow.fs.LocalFileSystem)
    root = os.path.abspath(root) if local else root.rstrip("/")
    if fs.get_file_info(root).type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    lead, uri = "file:" if local else path[: path.index(root, path.index("://") + 3)], root if local else path

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on, _ = located(uri)
        for folder in (f for rows in batches for f in rows["at"]):
            one = on.get_file_info(folder)
            found = [one] if one.type == pyarrow.fs.FileType.File else on.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
            for i in range(0, len(found), 10_000):
                told = [(x.path, x.size, x.type == pyarrow.fs.FileType.Directory) for x in found[i : i + 10_000] if x is one or not _hidden(x.base_name)]
                yield pd.DataFrame(told, columns=["at", "size", "folder"]).astype({"at": "object", "size": "Int64", "folder": "bool"})

    files, level, n = [], spark.range(1).select(F.lit(root).alias("at")), 1
    while n:
        found = materialise(level.repartition(min(n, LISTING_TASKS), "at").mapInPandas(look, "at string, size long, folder boolean"))
        files.append(found.where("NOT folder").select(F.concat(F.lit(lead), "at").alias("path"), "size"))
        level = found.where("folder").select("at")
        n = level.count()
    return functools.reduce(DataFrame.unionByName, files)


def listings(*parts: DataFrame) -> DataFrame:
    """All rows of several listings, by column name; a file that stands in two of them stands there twice, columns that one lacks are null."""
    out, *rest = parts
    for part in rest:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def without_fields(rows: DataFrame, *names: str) -> DataFrame:
    """rows without the named columns or, as 'column.field', fields of structs (at any depth); names that aren't there change nothing. A struct loses no more than its last field but one."""
    for name in names:
        column, _, field = name.partition(".")
        if not field:
            rows = rows.drop(column)
            continue
        kind, parts = rows.schema[column].dataType if column in rows.columns else None, field.split(".")
        for part in parts:
            kind = kind[part].dataType if hasattr(kind, "fieldNames") and part in kind.fieldNames() else None
        if kind is not None:
            rows = rows.withColumn(column, F.col(column).dropFields(field))
    return rows


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes per extension (case counts), most files first."""
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).orderBy(F.desc("n"), "extension")
