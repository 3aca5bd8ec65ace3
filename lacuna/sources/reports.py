"""Report documents: named sections, written as one version that replaces the last one at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file that names a report's version.
CURRENT = "current.json"


def normal_path(path: Column) -> Column:
    """A path without '.', empty and resolvable '..' parts; a leading '/' stays."""
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
    odd = path.rlike(r"//|/$|(^|/)\.{1,2}(/|$)")
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, part: F.when(F.size(done) > 0, step(done, part)).otherwise(F.when(part.isin("", "."), done).otherwise(F.array(part))))
    return F.when(odd, F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))).otherwise(path)  # most paths need no walk over their parts


def below(path: Column, root: str) -> Column:
    """The part of a path or file URI below a folder; null outside of it."""
    plain = lambda p: normal_path(F.regexp_replace(p, r"^file:/+", "/"))
    at, top = plain(path), F.concat(plain(F.lit(root)), F.lit("/"))
    return F.when(F.startswith(at, top), F.substring(at, F.length(top) + 1, F.length(at)))


def with_presence(items: DataFrame, files: DataFrame, root: str, name: str = "present") -> DataFrame:
    """items (path, relative to root) with name: whether files (path, as listing() gives them) has that file, however the path is spelled. A null path isn't there.

    One join against the listing, which may be as large as the items; nothing looks at files one by one.
    """
    there = files.select(below(F.col("path"), root).alias("_there")).where("_there IS NOT NULL").distinct().withColumn(name, F.lit(True))
    return items.join(there, normal_path(items["path"]) == there["_there"], "left").drop("_there").withColumn(name, F.coalesce(name, F.lit(False)))


def write_report(spark: SparkSession, sections: dict[str, DataFrame | dict | str | int | float | None], path: str) -> str:
    """Writes a report and returns its version. A DataFrame becomes a folder of JSON lines, written by tasks; all other sections are kept in the report's own file, as nested JSON.

    All sections go into a folder of their own; the file that names it is then renamed over the last one's. A run that dies before leaves the old report as it was; old versions are deleted afterwards.
    """
    version = uuid.uuid4().hex
    rows = {name: part for name, part in sections.items() if isinstance(part, DataFrame)}
    for name, part in rows.items():
        part.select(F.to_json(F.struct(*part.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/{version}/{name}")
    head = {"version": version, "values": {name: part for name, part in sections.items() if name not in rows}, "rows": {name: part.schema.json() for name, part in rows.items()}}
    old = _current(spark, path)
    jvm = spark.sparkContext._jvm
    fs_path, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs = fs_path(path).getFileSystem(conf)
    fs.mkdirs(fs_path(path))
    part = fs_path(f"{path}/.{version}.part")
    out = fs.create(part)
    out.write(bytearray(json.dumps(head, ensure_ascii=False, indent=2).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = fs.makeQualified(fs_path(f"{path}/{CURRENT}"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(part), target, over)
    if old:
        fs.delete(fs_path(f"{path}/{old['version']}"), True)
    return version


def _current(spark: SparkSession, path: str) -> dict | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(f"{path}/{CURRENT}", wholetext=True).first()[0])


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame | dict | str | int | float | None]:
    """The sections of a report, with the types they were written with; none where there is no report."""
    head = _current(spark, path)
    if head is None:
        return {}
    from pyspark.sql.types import StructType

    read = lambda name, schema: spark.read.schema(StructType.fromJson(json.loads(schema))).json(f"{path}/{head['version']}/{name}")
    return head["values"] | {name: read(name, schema) for name, schema in head["rows"].items()}
