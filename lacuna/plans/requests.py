"""Requests to a model server: bodies with their model rewritten, and a catalog kept in step with what the server lists; with DuckDB forms."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType

from ..operators import dedup as D
from ..sources.scratch import new_folder
from ..sources.state import read_if_there
from .ledger import models_of, normalize_models, resolve_aliases
from .tables import table

QUERIES, ORACLES = {}, {}
#: The path whose bodies are rewritten.
MESSAGES = "/v1/messages"


def member_place(body: str, name: str) -> list[tuple[int, int]]:
    """(start, end) of the value of each top-level member of that name in a JSON object; none if the text isn't one."""
    decoder, found = json.JSONDecoder(), []
    blank = lambda at: at + len(body[at:]) - len(body[at:].lstrip(" \t\r\n"))
    try:
        at = blank(0)
        if body[at] != "{":
            return []
        at = blank(at + 1)
        while body[at] != "}":
            key, at = decoder.raw_decode(body, at)
            at = blank(at)
            if not isinstance(key, str) or body[at] != ":":
                return []
            start = blank(at + 1)
            _, at = decoder.raw_decode(body, start)
            if key == name:
                found.append((start, at))
            at = blank(at)
            if body[at] == ",":
                at = blank(at + 1)
                if body[at] == "}":
                    return []
            elif body[at] != "}":
                return []
        return found if blank(at + 1) == len(body) else []
    except (ValueError, IndexError, RecursionError):
        return []


def with_member(body: str, name: str, value: str) -> str:
    """body with a top-level member's value replaced by a string; every other character stays, so members keep their order, numbers their digits."""
    for start, end in reversed(member_place(body, name)):
        body = body[:start] + json.dumps(value, ensure_ascii=False) + body[end:]
    return body


@F.pandas_udf(StringType())
def set_member(body: pd.Series, name: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([b if b is None or v is None else with_member(b, n, v) for b, n, v in zip(body, name, value, strict=True)], dtype=object)


def body_facts(body: Column) -> dict[str, Column]:
    """model, calls_functions and streams of a JSON object: model only if it is a text, streams only if it is true; null and false for what is no object."""
    v = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    of_kind = lambda name, kind: is_object & F.coalesce(F.schema_of_variant(part(name)) == kind, F.lit(False))
    model = F.when(of_kind("model", "STRING"), F.nullif(F.try_variant_get(v, "$.model", "string"), F.lit("")))
    tools = is_object & F.coalesce(F.size(F.try_variant_get(v, "$.tools", "array<variant>")) > 0, F.lit(False))
    streams = F.when(of_kind("stream", "BOOLEAN"), F.try_variant_get(v, "$.stream", "boolean")).otherwise(False)
    return {"model": model, "calls_functions": tools, "streams": streams}


def rewrite_requests(requests: DataFrame, known: DataFrame, explicit: dict[str, str], main: str | None, small: str | None, families: tuple[str, ...], small_families: tuple[str, ...] = (), tool_model: str | None = None) -> DataFrame:
    """requests (path, body, any others) with streams and rewritten: the body with its model resolved (see resolve_aliases).

    Other paths, empty and null bodies, texts that aren't JSON objects, objects without a model's name and names that resolve to themselves pass as they are, character by character.
    """
    facts = body_facts(F.when(F.col("path") == MESSAGES, F.col("body")))
    at = resolve_aliases(requests.withColumns(facts), known, explicit, main, small, families, small_families, tool_model)
    changed = F.col("model").isNotNull() & (F.col("resolved") != F.col("model"))
    return at.withColumn("rewritten", F.when(changed, set_member("body", F.lit("model"), F.when(changed, F.col("resolved")))).otherwise(F.col("body"))).select(*requests.columns, "streams", "rewritten")


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows (key, change) of two versions of a keyed table: added, gone or changed; equal rows give none. Nulls are equal to nulls."""
    rest = [c for c in new.columns if c != key]
    told = lambda df, name: df.select(F.col(key).alias(f"_{name}_key"), F.struct(*rest).alias(f"_{name}"))
    both = told(old, "old").join(told(new, "new"), F.col("_old_key").eqNullSafe(F.col("_new_key")), "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(F.coalesce("_new_key", "_old_key").alias(key), change.alias("change")).where("change IS NOT NULL")


def sync_catalog(payloads: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps a catalog below `folder` in step with a stream of payloads (version, pos, model as JSON): every batch's greatest version replaces the last one, if it is later.

    state/version=V holds a version's models (the last of each id), changes/version=V what it added, changed and took away; a version that changes nothing writes no state. Each is one
    folder that is overwritten whole, so a batch that is run again after a failure writes the same once more. A version without usable models raises an error and leaves the catalog as it was.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        version = df.agg(F.max("version")).first()[0]
        if version is None:
            return
        now = D.last_wins(normalize_models(df.where(F.col("version") == version).select("pos", F.try_parse_json("model").alias("model"))), ["value"], "pos").drop("pos")
        last = [r.version for r in _versions(spark, folder) if r.version < version]
        old = spark.read.parquet(f"{folder}/state/version={last[-1]}") if last else now.limit(0)
        if now.isEmpty():
            raise ValueError(f"version {version} has no usable model")
        changes = difference(old, now, "value")
        if changes.isEmpty():
            return
        now.write.mode("overwrite").parquet(f"{folder}/state/version={version}")
        changes.write.mode("overwrite").parquet(f"{folder}/changes/version={version}")

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, folder: str) -> list:
    """The versions whose changes are written whole, in order."""
    found = read_if_there(spark, f"{folder}/changes", "value string, change string, version bigint")
    return found.select("version").distinct().orderBy("version").collect()  # one row a version


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The models of the last version; none before the first."""
    versions = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/state/version={versions[-1].version}") if versions else spark.createDataFrame([], "value string")


_BODY = """CASE WHEN turn % 7 = 0 THEN '[1, "model"]' WHEN turn % 7 = 1 THEN '{"model": ' ELSE '{"stream": ' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE '1' END || ', "messages":[{"model": "inner", "role":"' || coalesce(role, '') || '", "n":1.50}] ,"model" : ' || {} || CASE WHEN turn % 3 = 0 THEN ', "tools":[{"name":"t"}]' ELSE '' END || ', "hash":"' || md5(coalesce(text, '')) || '"}' END"""
_MODEL = """CASE role WHEN 'user' THEN '"USER"' WHEN 'assistant' THEN '"my-assistant-1"' WHEN 'system' THEN '"System"' ELSE '7' END"""


def m8_rewrite_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies made of conversations, with their models rewritten; some are no objects, or go to another path."""
    c = table(spark, sf_dir, "conversations")
    body = F.expr(_BODY.replace("{}", _MODEL))
    at = c.select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, "/v1/other").otherwise(MESSAGES).alias("path"), body.alias("body"))
    known = spark.createDataFrame([(0, "user")], "pos int, value string")
    return rewrite_requests(at, known, {"System": "mapped"}, "main-model", "small-model", ("assistant",), ("tiny",), "tool-model").select("conv_id", "turn", "streams", "rewritten")


_RESOLVED = """CASE role WHEN 'user' THEN '"user"' WHEN 'assistant' THEN CASE WHEN turn % 3 = 0 THEN '"tool-model"' ELSE '"main-model"' END WHEN 'system' THEN '"mapped"' ELSE '7' END"""
ORACLES["m8_rewrite_bodies"] = f"""SELECT conv_id, turn, turn % 5 <> 4 AND turn % 7 NOT IN (0, 1) AND turn % 2 = 0 AS streams, CASE WHEN turn % 5 = 4 THEN {_BODY.replace('{}', _MODEL)} ELSE {_BODY.replace('{}', _RESOLVED)} END AS rewritten FROM conversations"""


def s12_catalog_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a catalog made of part, synchronised one after the other: what each of them changed, and the models there are at last (version 0)."""
    folder = new_folder(spark, "catalog")
    p = table(spark, sf_dir, "part")
    for version in (1, 2, 3):
        size = F.when((F.col("p_partkey") % 5 == 0) & F.lit(version > 1), F.col("p_size") + 1).otherwise(F.col("p_size"))
        model = F.to_json(F.struct(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), F.lit("llm").alias("type"), F.concat(size.cast("string"), F.lit("B")).alias("paramsString")))
        there = p.where(F.col("p_partkey") % 4 != (version if version < 3 else 2))
        there.select(F.to_json(F.struct(F.lit(version).alias("version"), F.col("p_partkey").alias("pos"), model.alias("model"))).alias("value")).write.text(f"{folder}/in/{version}")
    for version in (1, 2, 3):  # the source takes up what is new, as after a restart
        lines = spark.readStream.text(f"{folder}/in/{version}").select(F.from_json("value", "version bigint, pos bigint, model string").alias("r")).select("r.*")
        sync_catalog(lines, f"{folder}/catalog", f"{folder}/check{version}").awaitTermination()
    changes = spark.read.parquet(f"{folder}/catalog/changes").select(F.col("version").cast("long").alias("version"), "value", "change")
    return changes.unionByName(catalog(spark, f"{folder}/catalog").select(F.lit(0).cast("long").alias("version"), "value", F.col("description").alias("change")))


ORACLES["s12_catalog_sync"] = """WITH a AS (SELECT p_partkey % 4 AS m, p_partkey % 5 AS f, 'part/' || p_partkey AS value, p_size FROM part),
c AS (SELECT 1 AS version, value, 'added' AS change FROM a WHERE m <> 1
UNION ALL SELECT 2, value, CASE WHEN m = 1 THEN 'added' WHEN m = 2 THEN 'gone' ELSE 'changed' END FROM a WHERE m IN (1, 2) OR f = 0
UNION ALL SELECT 0, value, (p_size + CASE WHEN f = 0 THEN 1 ELSE 0 END) || 'B' FROM a WHERE m <> 2)
SELECT CAST(version AS BIGINT) AS version, value, change FROM c"""

QUERIES |= {f.__name__: f for f in (m8_rewrite_bodies, s12_catalog_sync)}
