"""Entropy scan: blocks, bands, recovered spans, high regions. Each query stands beside its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import bytes as B
from ..functions import text as T
from ..operators.intervals import gap_regions, overlapping_spans
from ..sources.rawimage import read_image
from ..sources.scratch import materialise
from .tables import HOUR, SECOND, TIMELINE, table, timeline

QUERIES, ORACLES = {}, {}


def band_counts(blocks: DataFrame) -> DataFrame:
    """One row: blocks per band, and of those of 5 bits or more how many lie in recovered spans. blocks has entropy and recovered."""
    high = F.col("entropy") >= dims.BANDS[1]
    band = lambda name: F.count_if(B.entropy_band(F.col("entropy")) == name).alias(f"n_{name}")
    return blocks.agg(F.count(F.lit(1)).alias("n_blocks"), *map(band, ("empty", "low", "medium", "high")), F.count_if(high & F.col("recovered")).alias("n_recovered"), F.count_if(high & ~F.col("recovered")).alias("n_unrecovered"))


def high_regions(blocks: DataFrame, keys: list[str], gap: int = dims.MERGE_GAP, least: int = dims.LEAST_REGION) -> DataFrame:
    """Runs of blocks (offset, entropy) whose starts lie at most `gap` apart; a region spans from first to last start and has `least` bytes or more."""
    runs = gap_regions(blocks, keys, "offset", None, gap)
    found = runs.groupBy(*keys, "region").agg(F.min("offset").alias("start"), F.max("offset").alias("end"), F.count(F.lit(1)).alias("sample_count"), F.round(F.avg("entropy"), 3).alias("avg_entropy"), F.round(F.max("entropy"), 3).alias("max_entropy"))
    found = found.withColumn("size_bytes", F.col("end") - F.col("start")).where(F.col("size_bytes") >= least)
    return found.withColumn("start_mb", T.mib(F.col("start"))).withColumn("end_mb", T.mib(F.col("end"))).withColumn("size_readable", T.human_size(F.col("size_bytes")))


def mark_recovered(blocks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (offset, length) with recovered: whether some span [start, end) overlaps. The id column `block` tells blocks apart."""
    hit = overlapping_spans(blocks, spans, "offset", "length", "start", "end", keys).select("block").withColumn("recovered", F.lit(True))
    return blocks.join(hit, "block", "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))


def scan(spark: SparkSession, path: str, spans: DataFrame | None = None, block: int = dims.BLOCK, stride: int = dims.STRIDE, gap: int = dims.MERGE_GAP, least: int = dims.LEAST_REGION, **options) -> dict[str, DataFrame]:
    """A strided entropy scan of an image: blocks (offset, length, entropy, recovered), bands (one row), and regions of dense blocks (5 bits or more) that no span (start, end) of what was recovered
    touches, each with the formats that the bytes at its start suggest.
    """
    tiles = read_image(spark, path, tile=block, stride=stride, **options)
    at = tiles.select(F.col("offset").alias("block"), "offset", F.col("length").cast("long").alias("length"), F.round(B.byte_entropy("data"), 6).alias("entropy"))
    none = spark.createDataFrame([], "start long, end long")
    blocks = materialise(mark_recovered(materialise(at), none if spans is None else spans, []))
    found = high_regions(blocks.where((F.col("entropy") >= dims.BANDS[1]) & ~F.col("recovered")), [], gap, least)
    heads = tiles.select(F.col("offset").alias("start"), B.matching_probes(F.col("data")).alias("probes"))
    return {"blocks": blocks.drop("block"), "bands": band_counts(blocks), "regions": found.join(heads, "start").drop("region")}


def report(found: dict[str, DataFrame], facts: dict) -> dict[str, DataFrame | dict]:
    """The sections of an entropy report (see sources.reports) of what scan() found."""
    return {"facts": facts, "bands": found["bands"].first().asDict(), "regions": found["regions"]}


def a1_entropy_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return d.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.round(B.byte_entropy("data"), 6).alias("entropy"))


_ENTROPY = """
h AS (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS b FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n_bytes FROM h GROUP BY doc_id),
e AS (SELECT doc_id, n_bytes, -sum(c / n_bytes * log2(c / n_bytes)) AS entropy FROM h JOIN n USING (doc_id) GROUP BY doc_id, n_bytes),
x AS (SELECT doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, round(coalesce(entropy, 0), 6) AS entropy FROM documents LEFT JOIN e USING (doc_id))"""
ORACLES["a1_entropy_per_doc"] = f"WITH {_ENTROPY} SELECT * FROM x"


def a2_entropy_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("data"), (F.pmod("doc_id", F.lit(3)) == 0).alias("recovered"))
    return band_counts(d.select(F.round(B.byte_entropy("data"), 6).alias("entropy"), "recovered"))


ORACLES["a2_entropy_bands"] = f"""WITH {_ENTROPY}
SELECT count(*) AS n_blocks, count(*) FILTER (entropy < 1) AS n_empty, count(*) FILTER (entropy >= 1 AND entropy < 5) AS n_low, count(*) FILTER (entropy >= 5 AND entropy < 7) AS n_medium,
  count(*) FILTER (entropy >= 7) AS n_high, count(*) FILTER (entropy >= 5 AND doc_id % 3 = 0) AS n_recovered, count(*) FILTER (entropy >= 5 AND doc_id % 3 <> 0) AS n_unrecovered FROM x"""


def a3_high_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = timeline(spark, sf_dir).groupBy("user_id", F.col("us").alias("offset")).agg(F.max("value").alias("entropy"))
    found = high_regions(blocks, ["user_id"], gap=HOUR, least=60 * SECOND)
    return found.select("user_id", "start", "end", "sample_count", "max_entropy", "size_bytes")


ORACLES["a3_high_regions"] = f"""WITH {TIMELINE}, b AS (SELECT user_id, us, max(value) AS v FROM tl GROUP BY ALL),
f AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS r FROM f)
SELECT user_id, min(us) AS start, max(us) AS "end", count(*) AS sample_count, round(max(v), 3) AS max_entropy, max(us) - min(us) AS size_bytes FROM g GROUP BY user_id, r HAVING max(us) - min(us) >= {60 * SECOND}"""


def j6_overlap_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    blocks = t.where("event_type = 'view'").select(F.col("event_id").alias("block"), "user_id", F.col("us").alias("offset"), F.lit(600 * SECOND).cast("long").alias("length"))
    spans = t.where("event_type = 'purchase'").select("user_id", F.col("us").alias("start"), (F.col("us") + (F.col("value") * 60).cast("long") * SECOND).alias("end"))
    return mark_recovered(blocks, spans, ["user_id"]).select("block", "recovered")


ORACLES["j6_overlap_recovered"] = f"""WITH {TIMELINE}, s AS (SELECT user_id, us AS a, us + CAST(trunc(value * 60) AS BIGINT) * {SECOND} AS z FROM tl WHERE event_type = 'purchase')
SELECT event_id AS block, EXISTS (SELECT 1 FROM s WHERE s.user_id = tl.user_id AND s.z > s.a AND tl.us < s.z AND tl.us + {600 * SECOND} > s.a) AS recovered FROM tl WHERE event_type = 'view'"""


def v5_region_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the texts of each language and source, as regions of many tiles."""
    found = B.entropy_by(table(spark, sf_dir, "documents"), ["lang", "source"], F.coalesce("text", F.lit("")))
    return found.withColumn("entropy", F.round("entropy", 6))


ORACLES["v5_region_entropy"] = """WITH b AS (SELECT lang, source, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS b FROM documents), h AS (SELECT lang, source, b, count(*) AS c FROM b GROUP BY ALL),
e AS (SELECT lang, source, sum(c) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM h GROUP BY ALL)
SELECT d.lang, d.source, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, round(abs(coalesce(e, 0)), 6) AS entropy FROM (SELECT DISTINCT lang, source FROM documents) d LEFT JOIN e ON d.lang IS NOT DISTINCT FROM e.lang AND d.source IS NOT DISTINCT FROM e.source"""


def x6_size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_totalprice") * 100).cast("long") * F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), T.human_size(n).alias("readable"), T.size_label(n).alias("label"), T.mib(n, 3).alias("mib"))


ORACLES["x6_size_labels"] = """WITH t AS (SELECT o_orderkey, CAST(trunc(o_totalprice * 100) AS BIGINT) * o_orderkey AS n FROM orders)
SELECT o_orderkey, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS readable,
  CASE WHEN n < 10485760 THEN (n // 1024) || 'KB' ELSE (n // 1048576) || 'MB' END AS label, round(n / 1048576.0, 3) AS mib FROM t"""

QUERIES |= {f.__name__: f for f in (a1_entropy_per_doc, a2_entropy_bands, a3_high_regions, j6_overlap_recovered, x6_size_labels, v5_region_entropy)}
