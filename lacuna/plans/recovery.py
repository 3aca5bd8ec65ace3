"""Recovery: duplicates, ids, interval routing, bursts, still-or-frame scores, moves, cross-verification; with DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import bytes as B
from ..functions import scoring as S
from ..functions import text as T
from ..operators import dedup as D
from ..operators import intervals as I
from ..sources import manifest as M
from . import crossverify as X
from .tables import HOUR, SECOND, TIMELINE, table, timeline

QUERIES, ORACLES = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


@query("""WITH a AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS sha, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS id, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS k FROM documents)
SELECT doc_id, lang, sha, id FROM a WHERE k = 1""")
def w7_strict_dedup(spark, sf_dir):
    """First text of each SHA-256, with ids per language that duplicates use up too."""
    rows = _docs(spark, sf_dir).select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return D.first_of(D.assign_ids(rows, ["lang"], "doc_id"), F.col("sha"), "doc_id").select("doc_id", "lang", "sha", "id")


_HEAD = f"md5(CAST(unhex(substr(hex(encode(coalesce(text, ''))), 1, {2 * dims.HASH_PREFIX})) AS BLOB))"


@query(f"SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM (SELECT doc_id, {_HEAD} AS k FROM documents)) WHERE n = 1")
def w8_fast_dedup(spark, sf_dir):
    """First text of each MD5 of the first 64 KiB."""
    rows = _docs(spark, sf_dir).select("doc_id", B.prefix_md5(F.col("text").cast("binary")).alias("k"))
    return D.first_of(rows, F.col("k"), "doc_id")


def as_files(spark, sf_dir):
    """Documents as chosen files of one image: pictures and films, a file every million bytes."""
    at, media = F.col("doc_id") * 1_000_000, F.when(F.pmod("doc_id", F.lit(3)) == 0, "video").otherwise("photo")
    data = F.col("text").cast("binary")
    known = {"image_id": F.lit("docs"), "start": at, "end": at + F.octet_length("text"), "format": F.when(media == "video", "AVI").otherwise("PNG"), "extension": F.when(media == "video", "avi").otherwise("png"), "media": media, "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "progressive": F.lit(None).cast("boolean"), "is_mjpeg": F.lit(False), "valid": F.lit(True), "prefix_md5": B.prefix_md5(data), "sha256": B.sha256(data)}
    return _docs(spark, sf_dir).select(*[c.alias(n) for n, c in known.items()])


@query("""WITH f AS (SELECT doc_id % 3 = 0 AS film, strlen(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS k FROM documents)
SELECT count(*) AS files, count(*) FILTER (k = 1 AND NOT film) AS photos, count(*) FILTER (k = 1 AND film) AS videos, count(*) FILTER (k > 1 AND NOT film) AS dup_photos, count(*) FILTER (k > 1 AND film) AS dup_videos, CAST(sum(n) FILTER (k = 1) AS BIGINT) AS bytes FROM f""")
def a13_dup_counts(spark, sf_dir):
    """What a scan chose, kept and found twice."""
    from . import carve

    chosen = as_files(spark, sf_dir)
    return carve.scan_stats(chosen, carve.keep_new(chosen, carve.Settings()))


@query("SELECT doc_id FROM documents b WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents a WHERE a.doc_id % 2 = 0 AND coalesce(a.text, '') = coalesce(b.text, ''))")
def u1_not_seen(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return D.not_seen(rows.where("pmod(doc_id, 2) = 1"), rows.where("pmod(doc_id, 2) = 0"), F.col("sha"), "sha").select("doc_id")


_PROBED = [(k, m.hex(), ",".join(n for other, n in dims.REGION_PROBES if m.startswith(other))) for k, (m, _) in enumerate(dims.REGION_PROBES)]


@query(f"SELECT doc_id, CASE doc_id % {len(_PROBED) + 1} {' '.join(f"WHEN {k} THEN '{n}'" for k, _, n in _PROBED)} ELSE '' END AS probes FROM documents")
def e23_prefix_probe(spark, sf_dir):
    """All known prefixes that bytes start with: each document is led by one of them, or by none."""
    at = F.pmod("doc_id", F.lit(len(_PROBED) + 1))
    lead = F.coalesce(*[F.when(at == k, F.unhex(F.lit(h))) for k, h, _ in _PROBED], F.lit(b"\x01"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(B.matching_probes(F.concat(lead, F.lit(b"\x01"), F.col("text").cast("binary"))), ",").alias("probes"))


@query("SELECT page_id, i AS n, m[i] AS piece FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>.*?</p>') AS m FROM pages))")
def f1_marker_carve(spark, sf_dir):
    """Every piece between a header and the next footer marker, in order."""
    data = F.col("html").cast("binary")
    p = table(spark, sf_dir, "pages").select("page_id", data.alias("data"), F.posexplode(B.marked_pieces(data, F.lit(b"<p>"), F.lit(b"</p>"))).alias("n", "at"))
    piece = F.decode(F.expr("substring(data, CAST(at.start + 1 AS INT), CAST(at.end - at.start AS INT))"), "UTF-8")
    return p.select("page_id", (F.col("n") + 1).cast("long").alias("n"), piece.alias("piece"))


@query("SELECT doc_id, CASE WHEN strpos(t, '.') = 0 THEN t ELSE left(t, length(t) - strpos(reverse(t), '.') + 1) END AS trimmed FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def x3_trim_last_marker(spark, sf_dir):
    """Up to and with the last full stop; whole without one."""
    return _docs(spark, sf_dir).select("doc_id", F.decode(B.trim_after_last(F.col("text").cast("binary"), F.lit(b".")), "UTF-8").alias("trimmed"))


def _candidates(spark, sf_dir):
    return timeline(spark, sf_dir).select("event_id", "user_id", F.col("us").alias("start"), (F.col("us") + (F.col("value") * 600).cast("long") * SECOND).alias("end"))


@query(f"""WITH RECURSIVE {TIMELINE}, c AS (SELECT event_id, user_id, us AS a, us + CAST(trunc(value * 600) AS BIGINT) * {SECOND} AS z FROM tl),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS n FROM c),
g AS (SELECT user_id, n, event_id, true AS taken, z AS until FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.n, o.event_id, o.a >= g.until, CASE WHEN o.a >= g.until THEN greatest(g.until, o.z) ELSE g.until END FROM o JOIN g ON o.user_id = g.user_id AND o.n = g.n + 1)
SELECT event_id, user_id FROM g WHERE taken""")
def w1_greedy_nonoverlap(spark, sf_dir):
    return I.greedy_nonoverlap(_candidates(spark, sf_dir), ["user_id"], "start", "end", ["event_id"]).select("event_id", "user_id")


@query(f"""WITH {TIMELINE}, c AS (SELECT event_id, user_id, us AS a, us + CAST(trunc(value * 60) AS BIGINT) * {SECOND} AS z FROM tl),
f AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS r FROM f)
SELECT user_id, CAST(r AS BIGINT) AS region, min(a) AS start, max(z) AS "end", count(*) AS frame_count, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY a, event_id) AS frames FROM g GROUP BY user_id, r""")
def w2_gap_regions(spark, sf_dir):
    c = timeline(spark, sf_dir).select("event_id", "user_id", F.col("us").alias("start"), (F.col("us") + (F.col("value") * 60).cast("long") * SECOND).alias("end"))
    runs = I.gap_regions(c, ["user_id"], "start", "end", HOUR, ties=["event_id"])
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return runs.groupBy("user_id", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("frame_count"), names.alias("frames"))


@query(f"""WITH {TIMELINE}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM tl),
m AS (SELECT a.event_id, a.us, b.us AS p FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 64 AND a.n - 1 AND b.event_type = a.event_type AND b.us BETWEEN a.us - {24 * HOUR} AND a.us),
s AS (SELECT event_id, us, p, lead(p, 1, us) OVER (PARTITION BY event_id ORDER BY p) - p AS step FROM m)
SELECT event_id, count(p) + 1 >= 3 AND coalesce(bool_and(step <= {12 * HOUR}), true) AS burst FROM s GROUP BY event_id""")
def w4_burst_members(spark, sf_dir):
    return I.burst_members(timeline(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", F.col("event_type"), 24 * HOUR, 3, 12 * HOUR).select("event_id", "burst")


@query(f"""WITH {TIMELINE}, v AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM tl)
SELECT event_id, CASE WHEN us - p BETWEEN 0 AND {48 * HOUR} THEN p END AS video_us FROM v""")
def j8_asof_video(spark, sf_dir):
    return I.asof_previous(timeline(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("event_type") == "purchase", "us", "video_us", 48 * HOUR).select("event_id", "video_us")


_SPANS = f"{TIMELINE}, s AS (SELECT event_id, user_id, us AS a, us + CAST(trunc(value * 60) AS BIGINT) * {SECOND} AS z FROM tl WHERE event_type = 'purchase')"


def _points_and_spans(spark, sf_dir):
    t = timeline(spark, sf_dir)
    spans = t.where("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("start"), (F.col("us") + (F.col("value") * 60).cast("long") * SECOND).alias("end"))
    return t.where("event_type <> 'purchase'"), spans


@query(f"WITH {_SPANS} SELECT event_id FROM tl WHERE event_type <> 'purchase' AND EXISTS (SELECT 1 FROM s WHERE s.user_id = tl.user_id AND tl.us >= s.a AND tl.us < s.z)")
def j5_inside_spans(spark, sf_dir):
    points, spans = _points_and_spans(spark, sf_dir)
    return I.inside_spans(points, spans, "us", "start", "end", ["user_id"]).select("event_id")


@query(f"WITH {_SPANS} SELECT event_id FROM tl WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = tl.user_id AND tl.us >= s.a AND tl.us < s.z)")
def j5_outside_spans(spark, sf_dir):
    points, spans = _points_and_spans(spark, sf_dir)
    return I.inside_spans(points, spans, "us", "start", "end", ["user_id"], outside=True).select("event_id")


@query(f"WITH {_SPANS} SELECT event_id FROM tl WHERE event_type <> 'purchase' AND EXISTS (SELECT 1 FROM s WHERE s.user_id = tl.user_id AND tl.us >= s.a AND tl.us < s.z AND s.event_id < tl.event_id)")
def j7_inside_earlier_spans(spark, sf_dir):
    """Inside a span that was found before the point (a lower id)."""
    points, spans = _points_and_spans(spark, sf_dir)
    return I.inside_spans(points, spans, "us", "start", "end", ["user_id"], extra=lambda p, s: s["_s_event_id"] < p["event_id"]).select("event_id")


_LINES = r"SELECT {0}, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {1}"


@query(f"""WITH d AS (SELECT doc_id, sha256(line) AS h FROM ({_LINES.format("doc_id", "documents")})), b AS (SELECT h, max(item_id) AS fname FROM (SELECT item_id, sha256(line) AS h FROM ({_LINES.format("item_id", "benchmark")})) GROUP BY h)
SELECT fname, max(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS matched FROM d JOIN b USING (h) GROUP BY fname""")
def j2_hash_match(spark, sf_dir):
    """Lines of documents matched by hash with those of items; of equal items' lines the last counts. Equal lines of documents are counted before they meet."""
    lines = lambda df, *cols: df.select(*cols, F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).withColumn("sha256", F.sha2("line", 256))
    carved = lines(table(spark, sf_dir, "benchmark"), "item_id").select("sha256", F.col("item_id").alias("fname"), F.lit("photos").alias("bucket"), F.col("item_id").alias("seq"))
    frames = lines(table(spark, sf_dir, "documents"), "doc_id").groupBy("sha256").agg(F.count(F.lit(1)).alias("c"), F.max("doc_id").alias("doc_id"))
    return X.match_frames(carved, frames).where("fname IS NOT NULL").groupBy("fname").agg(F.max("doc_id").alias("doc_id"), F.sum("c").alias("matched"))


@query("SELECT CAST(doc_id AS VARCHAR) AS fname, source AS bucket FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j4_orphans(spark, sf_dir):
    name = F.col("doc_id").cast("string").alias("fname")
    return X.orphans(table(spark, sf_dir, "documents").select(name, F.col("source").alias("bucket")), table(spark, sf_dir, "labels").select(name))


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT source AS video, count(*) AS total_frames, count(l.doc_id) AS jpeg_frames, count(*) FILTER (quality = 1) AS matched_carved, count(*) - count(*) FILTER (quality = 1) AS unrecovered FROM documents LEFT JOIN l USING (doc_id) GROUP BY source""")
def a5_per_source(spark, sf_dir):
    one = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(True).alias("is_jpeg"))
    frames = table(spark, sf_dir, "documents").join(one, "doc_id", "left").select(F.col("source").alias("video"), "is_jpeg", F.when(F.col("quality") == 1, F.col("doc_id").cast("string")).alias("fname"))
    return X.per_video(frames.select("video"), frames)


_FACTS = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'photos' WHEN 1 THEN 'frames' END AS bucket, quality = 0 AS inside, toxic = 1 AS frame_size, doc_id % 11 = 0 AS still_size, n_chars % 1000 AS near, 500 AS win,
  round(8.0 * n_chars / (100.0 * (doc_id % 7) * 100.0 + 1), 5) AS bpp, doc_id % 5 = 0 AS progressive, doc_id % 13 = 0 AS camera, doc_id % 17 = 0 AS timed FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)"""
_RULES = [("bucket = 'frames'", 0, 2, "carver_bucket_frames"), ("bucket = 'photos'", 1, 0, "carver_bucket_photos"), ("inside", 0, 4, "jpeg_inside_mjpeg_avi"), ("frame_size", 0, 4, "matches_skip_frame_resolution"), ("near BETWEEN 0 AND win", 0, 1, "within_video_proximity_window"), ("still_size", 2, 0, "common_still_photo_resolution"), ("bpp > 0 AND bpp < 0.22", 0, 2, "low_bits_per_pixel_heavy_compression"), ("bpp > 0.72 AND NOT coalesce(frame_size, false)", 1, 0, "higher_bits_per_pixel_milder_compression"), ("progressive", 1, 0, "progressive_jpeg"), ("camera", 3, 0, "exif_camera_make_or_model"), ("timed", 1, 0, "exif_timestamp")]
_SUM = lambda i: " + ".join(f"CASE WHEN {r[0]} THEN {r[i]} ELSE 0 END" for r in _RULES)
SCORED = f"f AS ({_FACTS}), s AS (SELECT doc_id, bucket, {_SUM(1)} AS still, {_SUM(2)} AS frame, array_to_string(list_filter([{', '.join(f'CASE WHEN {r[0]} THEN {chr(39)}{r[3]}{chr(39)} END' for r in _RULES)}], lambda x: x IS NOT NULL), ';') AS reasons FROM f), v AS (SELECT *, CASE WHEN still >= frame + 2 THEN 'likely_still' WHEN frame >= still + 2 THEN 'likely_frame' ELSE 'uncertain' END AS suggested FROM s)"


def scored(spark, sf_dir):
    one = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(one, "doc_id", "left")
    every = lambda n: F.pmod("doc_id", F.lit(n))
    facts = d.select(
        "doc_id", F.when(every(3) == 0, "photos").when(every(3) == 1, "frames").alias("bucket"), (F.col("quality") == 0).alias("inside"), (F.col("toxic") == 1).alias("frame_size"), (every(11) == 0).alias("still_size"), (F.col("n_chars") % 1000).alias("near"),
        F.lit(500).alias("win"), F.round(8.0 * F.col("n_chars") / (100.0 * every(7) * 100.0 + 1), 5).alias("bpp"), (every(5) == 0).alias("progressive"), (every(13) == 0).alias("camera"), (every(17) == 0).alias("timed"),
    )
    c = F.col
    scored = S.still_or_frame(c("bucket"), c("inside"), c("frame_size"), c("near"), c("win"), c("still_size"), c("bpp"), c("progressive"), c("camera"), c("timed"))
    return facts.withColumns(scored)


@query(f"WITH {SCORED} SELECT doc_id, still, frame, reasons, suggested FROM v")
def x22_rule_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "still", "frame", F.array_join("reasons", ";").alias("reasons"), "suggested")


@query(f"WITH {SCORED} SELECT count(*) AS jpeg_rows, count(*) FILTER (suggested = 'likely_still') AS likely_still, count(*) FILTER (suggested = 'likely_frame') AS likely_frame, count(*) FILTER (suggested = 'uncertain') AS uncertain FROM v")
def a7_class_counts(spark, sf_dir):
    from .classify import summary

    return summary(scored(spark, sf_dir))


@query(f"""WITH {SCORED}, p AS (SELECT doc_id, bucket || '/' || doc_id || '.jpg' AS path, CASE suggested WHEN 'likely_still' THEN 'photos' WHEN 'likely_frame' THEN 'frames' END AS want, bucket FROM v)
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'file_not_found' WHEN want IS NULL THEN 'uncertain_or_neutral_suggestion' WHEN bucket IS NULL THEN 'not_under_photos_or_frames' WHEN bucket = want THEN 'already_in_target_bucket' END AS reason,
  CASE WHEN doc_id % 10 <> 9 AND want IS NOT NULL AND bucket IS NOT NULL AND bucket <> want THEN 'planned' ELSE 'skipped' END AS status, CASE WHEN doc_id % 10 <> 9 AND want IS NOT NULL AND bucket IS NOT NULL AND bucket <> want THEN want || '/' || doc_id || '.jpg' END AS path_after FROM p""")
def f17_move_plan(spark, sf_dir):
    from .classify import plan_moves

    items = scored(spark, sf_dir).select("doc_id", F.concat("bucket", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), "suggested", (F.pmod("doc_id", F.lit(10)) != 9).alias("present"))
    return plan_moves(items).select("doc_id", "reason", "status", "path_after")


@query("""WITH f AS (SELECT event_id, user_id, event_id * 1000 AS a, event_type = 'purchase' AS film, event_type = 'purchase' AND value > 50 AS mjpeg, event_type = 'click' AS jpeg, event_id % 2 = 0 AS framed, event_id % 90000 + 1000 AS n FROM events),
g AS (SELECT *, max(CASE WHEN film THEN a END) OVER w AS last, max(CASE WHEN mjpeg THEN a END) OVER v AS inner_film, row_number() OVER (PARTITION BY user_id, film ORDER BY a) AS id FROM f WINDOW w AS (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN film THEN 'videos' WHEN jpeg AND (coalesce(a - inner_film < 3000000, false) OR (framed AND last IS NOT NULL)) THEN 'frames' ELSE 'photos' END AS bucket FROM g)
SELECT event_id, bucket, bucket || '/' || CASE bucket WHEN 'videos' THEN 'video' WHEN 'frames' THEN 'video_frame' ELSE 'photo' END || '_' || lpad(CAST(id AS VARCHAR), CAST(greatest(5, length(CAST(id AS VARCHAR))) AS INTEGER), '0') || CASE WHEN film THEN '_AVI' WHEN jpeg THEN CASE WHEN framed THEN '_JPEG_1280x720' ELSE '_JPEG_640x480' END ELSE '_PNG' END
  || '_' || CASE WHEN film THEN 2929 ELSE n // 1024 END || 'KB.' || CASE WHEN film THEN 'avi' WHEN jpeg THEN 'jpg' ELSE 'png' END AS path FROM h""")
def p4_route_and_name(spark, sf_dir):
    """Events as files, an image a user: films of 3,000,000 bytes, pictures in them and behind them, routed and named."""
    from . import carve

    e = table(spark, sf_dir, "events")
    kind = lambda film, jpeg, other: F.when(F.col("event_type") == "purchase", film).when(F.col("event_type") == "click", jpeg).otherwise(other)
    side = lambda wide, narrow: F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 2 == 0, wide).otherwise(narrow)).cast("int")
    at = F.col("event_id") * 1000
    files = e.select("event_id", F.col("user_id").cast("string").alias("image_id"), at.alias("start"), (at + F.when(F.col("event_type") == "purchase", 3_000_000).otherwise(F.col("event_id") % 90_000 + 1000)).alias("end"), kind("AVI", "JPEG", "PNG").alias("format"), kind("avi", "jpg", "png").alias("extension"), kind("video", "photo", "photo").alias("media"), side(1280, 640).alias("width"), side(720, 480).alias("height"), F.lit(False).alias("progressive"), ((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("is_mjpeg"), F.lit(False).alias("is_copy"))
    s = carve.Settings()
    return carve.name_files(carve.route(files, s), s).select("event_id", "bucket", "path")


@query(r"SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT ltrim(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.[a-z]+$'), '.') AS extension, strlen(coalesce(html, '')) AS size FROM pages) GROUP BY 1")
def a11_by_extension(spark, sf_dir):
    ext = F.ltrim(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"\.[a-z]+$", 0), F.lit("."))
    return M.inventory(table(spark, sf_dir, "pages").select(ext.alias("extension"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 AND h > 0 THEN round(8.0 * sz / (CAST(w AS DOUBLE) * h), 5) END AS bpp FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) - 5 AS w, l_linenumber AS h, l_partkey AS sz FROM lineitem)")
def x4_bits_per_pixel(spark, sf_dir):
    w, h = F.col("l_quantity").cast("long") - 5, F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.bits_per_pixel(F.col("l_partkey"), w, h).alias("bpp"))


@query("SELECT count(*) AS physical_lines, count(*) FILTER (event_id % 10 = 5) AS blank_lines, count(*) FILTER (event_id % 10 IN (0, 1)) AS invalid_lines, count(*) FILTER (event_id % 10 NOT IN (0, 1, 5)) AS parsed_rows FROM events")
def a9_manifest_counts(spark, sf_dir):
    """Lines by kind: every tenth is broken, a list, or blank."""
    at = F.col("event_id") % 10
    return M.input_stats(table(spark, sf_dir, "events").select(F.when(at == 0, "{broken").when(at == 1, "[1]").when(at == 5, "  ").otherwise(F.col("props")).alias("line")))


@query("SELECT CASE WHEN f IS NULL OR f = '' THEN 'missing_format' ELSE 'format_not_jpeg' END AS reason_code, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'JPEG' WHEN 'view' THEN '' ELSE event_type END AS f FROM events) WHERE f IS DISTINCT FROM 'JPEG' GROUP BY 1")
def a8_skip_reasons(spark, sf_dir):
    from .classify import skip_code

    f = F.when(F.col("event_type") == "click", "JPEG").when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(f.alias("format")).where(~F.col("format").eqNullSafe("JPEG"))
    return rows.groupBy(skip_code(F.col("format")).alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


#: Makes as cameras write them; some fit several known ones, or none.
_MAKES = ("NIKON CORPORATION", "Sony", "canon", "OLYMPUS for Canon", "ACME", "Adobe DNG", "Leica Camera", "PENTAX RICOH", "Hasselblad", "")
_MADE = f"({list(_MAKES)})[p_partkey % {len(_MAKES)} + 1]"


@query(f"SELECT p_partkey, CASE {' '.join(f"WHEN contains(lower({_MADE}), '{key.lower()}') THEN '{fmt}'" for key, fmt, _ in dims.MAKES)} ELSE 'TIFF' END AS format FROM part")
def j11_ordered_contains(spark, sf_dir):
    """The format of TIFFs by the first known make, in order of priority, that their Make tag holds."""
    make = F.element_at(F.array(*map(F.lit, _MAKES)), (F.col("p_partkey") % len(_MAKES) + 1).cast("int"))
    head = b"II*\x00\x08\x00\x00\x00\x01\x00\x0f\x01\x02\x00\x20\x00\x00\x00\x1a\x00\x00\x00\x00\x00\x00\x00"
    data = F.concat(F.lit(head), F.rpad(make, 32, " ").cast("binary"))
    return table(spark, sf_dir, "part").select("p_partkey", B.tiff_kind(data)["format"].alias("format"))


@query("SELECT p_partkey, CASE b WHEN '1' THEN 'MP4' WHEN '2' THEN 'MOV' WHEN '3' THEN 'HEIC' ELSE CASE c WHEN '1' THEN 'MP4' WHEN '2' THEN 'MOV' WHEN '3' THEN 'HEIC' ELSE 'MP4' END END AS format FROM (SELECT p_partkey, substr(p_brand, 7, 1) AS b, CAST(p_size % 5 AS VARCHAR) AS c FROM part)")
def j10_brand_lookup(spark, sf_dir):
    """The format of type boxes by their major brand, else the first known of the compatible ones, else the default."""
    brand = lambda x: F.coalesce(*[F.when(x == d, F.lit(b)) for d, b in (("1", b"isom"), ("2", b"qt  "), ("3", b"heic"))], F.lit(b"none"))
    box = F.concat(F.lit(b"\x00\x00\x00\x1cftyp"), brand(F.substring("p_brand", 7, 1)), F.lit(b"\x00\x00\x00\x00none"), brand((F.col("p_size") % 5).cast("string")), F.lit(b"avif"))
    return table(spark, sf_dir, "part").select("p_partkey", B.brand_format(box)["format"].alias("format"))


@query("SELECT doc_id || '.jpg' AS fname, lang AS bucket, greatest(0, count(*) OVER () - 10) AS more FROM documents WHERE doc_id % 3 <> 0 ORDER BY fname LIMIT 10")
def t5_first_orphans(spark, sf_dir):
    """The first ten documents, by name, that no frame matches, and how many more there are."""
    carved = _docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("fname"), F.col("lang").alias("bucket"), "doc_id")
    return X.orphan_names(X.orphans(carved, carved.where("pmod(doc_id, 3) = 0")))


@query("""WITH u AS (SELECT lang AS extension, strlen(coalesce(text, '')) AS size FROM documents UNION ALL SELECT lang, strlen(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'html', strlen(coalesce(html, '')) FROM pages)
SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM u GROUP BY extension""")
def u2_listings(spark, sf_dir):
    """The inventory of three listings together; documents of even id stand in two of them."""
    docs = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("extension"), F.octet_length("text").cast("long").alias("size"))
    pages = table(spark, sf_dir, "pages").select(F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"), F.lit("html").alias("extension"))
    return M.inventory(M.listings(docs, docs.where("pmod(doc_id, 2) = 0"), pages))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"jpeg":{"width":' || doc_id % 500 || ',"inner":{"b":' || doc_id % 7 || '}}}' AS line FROM documents""")
def p10_dropped_fields(spark, sf_dir):
    """Rows without a column, a field and a field of a field, as JSON."""
    inner = F.struct(F.lit("x").alias("a"), (F.col("doc_id") % 7).alias("b"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct((F.col("doc_id") % 500).alias("width"), F.lit(1).alias("pillow"), inner.alias("inner")).alias("jpeg"), F.lit(2).alias("frames"))
    left = M.without_fields(rows, "frames", "jpeg.pillow", "jpeg.inner.a", "jpeg.none", "none.x", "none")
    return left.select("doc_id", F.to_json(F.struct(*left.columns)).alias("line"))
