"""Queries over operators in use: files written and read back, state between runs, streams, reports; with DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming as R
from ..functions import bytes as B
from ..functions import scoring as S
from ..functions import text as T
from ..operators import intervals as I
from ..sources import manifest as M
from ..sources import state
from ..sources.rawimage import input_size
from ..sources.reports import read_report, write_report
from ..sources.scratch import drop_folder, materialise, new_folder
from . import carve as C
from . import classify, crossverify, dispatch, ledger, mixed, recovery
from .tables import table

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), o AS (SELECT DISTINCT t FROM d WHERE doc_id % 2 = 0), k AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS n FROM d),
a AS (SELECT 'photo' AS media, max(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END) AS x FROM d)
SELECT doc_id * 1000000 AS source_offset, id AS file_id, CAST((SELECT count(DISTINCT t) FROM d WHERE doc_id % 2 = 0) AS BIGINT) AS known, 0::BIGINT AS after_reset FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 3 = 0 ORDER BY doc_id) AS id FROM k) WHERE n = 1 AND t NOT IN (SELECT t FROM o)""")
def s10_seen_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run keeps: hashes of even documents are saved, loaded as seen, and reset at last."""
    folder = new_folder(spark, "state")
    chosen = recovery.as_files(spark, sf_dir)
    state.save(chosen.where("pmod(start / 1000000, 2) = 0"), folder)
    seen = materialise(state.load_seen(spark, folder))
    kept = materialise(C.keep_new(chosen, C.Settings(), seen).select("start", "file_id"))
    known = seen.count()
    state.reset(spark, folder)
    return kept.select(F.col("start").alias("source_offset"), F.col("file_id").cast("long").alias("file_id"), F.lit(known).cast("long").alias("known"), F.lit(state.load_seen(spark, folder).count()).cast("long").alias("after_reset"))


@query(f"WITH {recovery.SCORED} SELECT doc_id || '.jpg' AS path, bucket, suggested, CAST(still AS VARCHAR) AS score_still, CAST(frame AS VARCHAR) AS score_frame, nullif(reasons, '') AS reasons FROM v")
def k6_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV summary of judged pictures, read back."""
    folder = new_folder(spark, "csv")
    classify.write_csv(recovery.scored(spark, sf_dir).withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))), folder)
    return spark.read.option("header", True).csv(folder)


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT t, max(doc_id) AS last FROM d WHERE doc_id % 3 <> 0 GROUP BY t), f AS (SELECT doc_id, t FROM d WHERE doc_id % 2 = 0),
m AS (SELECT count(DISTINCT c.last) AS matched FROM f JOIN c USING (t)), n AS (SELECT (SELECT count(*) FROM d WHERE doc_id % 3 <> 0) AS carved, (SELECT count(*) FROM f) AS videos, matched FROM m)
SELECT CAST(f.doc_id AS VARCHAR) AS video, 1::BIGINT AS total_frames, 1::BIGINT AS jpeg_frames, CAST(c.last IS NOT NULL AS BIGINT) AS matched_carved, CAST(c.last IS NULL AS BIGINT) AS unrecovered, carved AS carved_files, matched AS matched_to_video, carved - matched AS orphaned, round(100.0 * matched / carved, 2) AS match_rate_percent
FROM f LEFT JOIN c USING (t), n""")
def k7_cross_verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-verification report, read back: pictures of two thirds of the documents against films, of one frame each, of the even ones."""
    docs = table(spark, sf_dir, "documents")
    picture = F.concat(F.lit(b"\xff\xd8"), F.coalesce("text", F.lit("")).cast("binary"), F.lit(b"\xff\xd9"))
    carved = docs.where("pmod(doc_id, 3) <> 0").select(F.sha2(picture, 256).alias("sha256"), F.col("doc_id").cast("string").alias("fname"), F.lit("photos").alias("bucket"), F.col("doc_id").alias("seq"))
    films = docs.where("pmod(doc_id, 2) = 0").select(F.col("doc_id").cast("string").alias("video"))
    frames = docs.where("pmod(doc_id, 2) = 0").select(F.col("doc_id").cast("string").alias("video"), F.lit(0).alias("index"), F.sha2(picture, 256).alias("sha256"), F.lit(True).alias("is_jpeg"))
    matched = materialise(crossverify.match_frames(carved, frames))
    none = spark.createDataFrame([], "start long, end long, frame_count long")
    path = f"{new_folder(spark, 'reports')}/verify"
    write_report(spark, crossverify.report(carved, films, matched, none, {"films": "even"}), path)
    found = read_report(spark, path)
    total = found["summary"]
    names = ("carved_files", "matched_to_video", "orphaned", "match_rate_percent")
    return found["videos"].select("video", "total_frames", "jpeg_frames", "matched_carved", "unrecovered", *[F.lit(total[n]).cast("double" if n.endswith("percent") else "long").alias(n) for n in names])


@query("""WITH o AS (SELECT *, o_orderkey % 1000 AS k FROM orders), s AS (SELECT min(o_orderkey) AS stop FROM o WHERE o_orderkey > 700 AND k = 333)
SELECT o_orderkey AS row, CASE WHEN o_orderstatus = 'F' THEN 'Pendiente' ELSE o_orderstatus END AS estado, strftime(o_orderdate, '%Y-%m-%d') AS fecha_presentacion FROM o, s WHERE stop IS NULL OR o_orderkey < stop""")
def s11_first_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's rows before the first without a number, with defaults and plain dates."""
    o = table(spark, sf_dir, "orders")
    blank = (F.col("o_orderkey") > 700) & (F.col("o_orderkey") % 1000 == 333)
    sheet = o.select(F.col("o_orderkey").alias("row"), F.when(~blank, 1).alias("num"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise("").alias("estado"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("fecha_presentacion"))
    return ledger.until_first_blank(sheet).select("row", "estado", "fecha_presentacion")


@query("""SELECT 'requests' AS kind, CASE k WHEN 3 THEN 'unknown' WHEN 4 THEN 'notification' WHEN 5 THEN 'invalid' ELSE 'ping' END AS route, count(*) AS n FROM (SELECT event_id % 12 AS k FROM events) WHERE k IN (0, 3, 4, 5) GROUP BY ALL
UNION ALL SELECT 'rejects', 'reject', count(*) FROM events WHERE event_id % 12 IN (6, 7) HAVING count(*) > 0""")
def s13_request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and rejects of a folder of request lines, taken up by streams and routed."""
    folder = new_folder(spark, "streams")
    lines = table(spark, sf_dir, "events").where("event_id % 12 IN (0, 3, 4, 5, 6, 7)").select(F.expr(dispatch._LINE).alias("value"))
    lines.write.text(f"{folder}/in")
    requests, rejects = R.request_stream(spark, f"{folder}/in")
    asked = R.run_available(requests, f"{folder}/requests", f"{folder}/check1").select(F.to_json(F.struct(F.col("id").cast("long").alias("id"), "method")).alias("line"), F.lit("requests").alias("kind"))
    refused = R.run_available(rejects, f"{folder}/rejects", f"{folder}/check2").select("line", F.lit("rejects").alias("kind"))
    routed = dispatch.dispatch(asked.unionByName(refused), [], ("v1",), {"name": "s"})
    return routed.groupBy("kind", "route").agg(F.count(F.lit(1)).alias("n"))


_MANIFEST = """CASE doc_id % 10 WHEN 7 THEN '{broken' WHEN 8 THEN '' WHEN 9 THEN '[1]' ELSE '{"v":2,"path":"' || CASE doc_id % 3 WHEN 0 THEN 'videos/' ELSE 'photos/' END || doc_id || '.x","format":"' || CASE doc_id % 3 WHEN 0 THEN 'AVI' WHEN 1 THEN 'JPEG' ELSE 'PNG' END
 || '","source_offset":' || doc_id * 100 || ',"source_end":' || CASE WHEN doc_id % 10 = 6 THEN 'true' ELSE '' || (doc_id * 100 + 50) END || CASE WHEN doc_id % 10 = 5 THEN ',"status":"skipped"' ELSE '' END || ',"jpeg":{"matches_skip_frame_resolution":' || CASE WHEN doc_id % 4 = 0 THEN 'true' ELSE 'false' END || '}}' END"""


def _manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_MANIFEST).alias("line"))


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS f, doc_id % 10 AS k FROM documents WHERE doc_id % 10 < 7)
SELECT 'span' AS kind, doc_id * 100 AS start, doc_id * 100 + 50 AS "end" FROM d WHERE k NOT IN (5, 6) UNION ALL SELECT 'film', doc_id * 100, doc_id * 100 + 50 FROM d WHERE f = 0 AND k <> 6
UNION ALL SELECT 'offset', doc_id * 100, doc_id * 100 + 50 FROM d WHERE f = 1 AND k <> 6 UNION ALL SELECT 'frame', doc_id * 100, CASE WHEN k <> 6 THEN doc_id * 100 + 50 END FROM d WHERE f = 1 AND doc_id % 4 = 0
UNION ALL SELECT 'far', doc_id * 100, doc_id * 100 + 50 FROM d WHERE f = 1 AND k <> 6 AND NOT EXISTS (SELECT 1 FROM d e WHERE e.f = 0 AND e.k <> 6 AND d.doc_id * 100 >= e.doc_id * 100 AND d.doc_id * 100 < e.doc_id * 100 + 50)""")
def f10_manifest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that a manifest's lines tell: all spans, films, pictures' offsets, film-sized pictures, and pictures in no film."""
    lines = _manifest_lines(spark, sf_dir)
    rows = materialise(M.parse_manifest(lines).where("kind = 'valid'").withColumn("line_no", F.col("doc_id")))
    films, offsets = crossverify.film_spans(rows), crossverify.offsets_of(rows)
    told = lambda df, kind, a="start", z="end": df.select(F.lit(kind).alias("kind"), F.col(a).alias("start"), F.col(z).alias("end"))
    far = I.inside_spans(offsets, films, "start", "start", "end", outside=True)
    return told(M.spans(lines), "span").unionByName(told(films, "film")).unionByName(told(offsets, "offset")).unionByName(told(crossverify.frame_sized(rows), "frame", "source_offset", "source_end")).unionByName(told(far, "far"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AVI' WHEN 1 THEN 'JPEG' ELSE 'PNG' END AS format, doc_id * 100 AS source_offset FROM documents WHERE doc_id % 10 < 7""")
def r2_manifest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows of manifest files, taken up as a stream in two runs from one checkpoint."""
    folder, lines = new_folder(spark, "streams"), _manifest_lines(spark, sf_dir)
    for half in (0, 1):
        lines.where(F.pmod("doc_id", F.lit(2)) == half).select("line").write.mode("append").text(f"{folder}/in")
        rows = M.parse_manifest(M.lines(spark, f"{folder}/in", stream=True)).where("kind = 'valid'").drop("kind", "line") if half else R.manifest_stream(spark, f"{folder}/in")
        out = R.run_available(rows, f"{folder}/out", f"{folder}/check")
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "format", "source_offset")


@query("SELECT e.event_id, c.c_name AS name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def r4_refreshed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events joined with the customers as they are when a batch runs."""
    folder = new_folder(spark, "streams")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).select("event_id", "user_id")
    load = lambda: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    R.refreshed_join(stream, load, "user_id", f"{folder}/out", f"{folder}/check").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "name")


def _jpeg(doc: DataFrame, cut: Column) -> DataFrame:
    """(doc_id, data): JPEGs with a make, a model and a time of day, whose ends `cut` (a number of bytes) takes off."""
    text = lambda c: F.concat(c.cast("binary"), F.lit(b"\x00"))
    make, model, time = text(F.concat(F.lit("Maker"), (F.col("doc_id") % 7).cast("string"))), text(F.format_string("Model-%05d", F.col("doc_id") % 100_000)), text(F.lit("2024:05:06 07:08:09"))
    le = lambda n, width: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(F.lit(n) if isinstance(n, int) else n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(width)]))
    entry = lambda tag, size, at: F.concat(le(tag, 2), le(2, 2), le(size, 4), le(at, 4))
    tiff = F.concat(F.lit(b"II*\x00\x08\x00\x00\x00\x03\x00"), entry(0x010F, 7, 50), entry(0x0110, 12, 57), entry(0x0132, 20, 69), F.lit(bytes(4)), make, model, time)
    body = F.concat(F.lit(b"Exif\x00\x00"), tiff)
    data = F.concat(F.lit(b"\xff\xd8\xff\xe1"), F.unhex(F.lpad(F.hex(F.octet_length(body) + 2), 4, "0")), body, F.lit(b"\xff\xc0\x00\x0b\x08\x00\x30\x00\x40\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"), F.coalesce("text", F.lit("")).cast("binary"), F.lit(b"\xff\xd9"))
    return doc.select("doc_id", F.substring(data, F.lit(1), F.octet_length(data) - cut).alias("data"))


@query("""SELECT doc_id, doc_id % 3 = 0 AND doc_id % 5 <> 0 AS valid, 'Maker' || doc_id % 7 AS make, printf('Model-%05d', doc_id % 100000) AS model, '2024:05:06 07:08:09' AS time, true AS has_identity FROM documents""")
def e22_exif_and_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF facts and structure of pictures made of the documents: two thirds are cut off, a fifth is smaller than asked for."""
    at = _jpeg(table(spark, sf_dir, "documents"), (F.col("doc_id") % 3).cast("int"))
    found = at.select("doc_id", B.exif_facts("data").alias("e"), B.is_valid_jpeg("data", F.when(F.col("doc_id") % 5 == 0, 49).otherwise(48)).alias("valid"))
    return found.select("doc_id", "valid", F.col("e.camera_make").alias("make"), F.col("e.camera_model").alias("model"), F.col("e.datetime").alias("time"), F.col("e.has_camera_identity").alias("has_identity"))


@query(f"""WITH {mixed._FILES} SELECT a AS source_offset, i AS "index", (SELECT max(a + z + {mixed.GAP}) FROM p) AS image_bytes, n + 45 AS jpeg_size, 184 + i * (53 + n + (n + 1) % 2) AS offset_in_avi FROM f, range(3) t(i) WHERE k = 2 AND nth = 1""")
def s15_extracted_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the films that were carved out of the mixed image and copied into a folder, read there by seeks."""
    path, folder = mixed.lay_out_mixed(spark, sf_dir), f"{new_folder(spark, 'extracted')}/films"
    found = materialise(C.carve(spark, path, C.Settings(), image_id="mixed").where("format = 'AVI'"))
    C.extract(found, path, folder).agg(F.sum("bytes")).collect()  # one row
    size = input_size(path)
    drop_folder(spark, path)
    frames = materialise(crossverify.frames_of_files(M.listing(spark, folder, ("avi",))).select("video", "index", "jpeg_size", "offset_in_avi"))
    drop_folder(spark, folder)
    named = found.select(F.substring_index("path", "/", -1).alias("video"), "source_offset")
    return frames.join(named, "video").select("source_offset", F.col("index").cast("long").alias("index"), F.lit(size).cast("long").alias("image_bytes"), "jpeg_size", "offset_in_avi")


@query(f"""WITH {mixed._FILES}, b AS (SELECT *, CASE WHEN k = 3 AND film IS NOT NULL THEN 'frames' ELSE 'photos' END AS bucket FROM f WHERE nth = 1 AND k IN (0, 3) AND z >= 4096)
SELECT CASE WHEN doc_id % 2 = 0 THEN CASE bucket WHEN 'photos' THEN 'frames' ELSE 'photos' END ELSE bucket END AS top, bucket AS before, count(*) AS n, CAST(sum(z) AS BIGINT) AS bytes, CASE WHEN doc_id % 2 = 0 THEN 'moved' ELSE 'skipped' END AS status FROM b GROUP BY ALL""")
def k15_apply_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files after moves were carried out: pictures of even documents are asked into the other folder; the listing tells where files are."""
    path, folder = mixed.lay_out_mixed(spark, sf_dir), f"{new_folder(spark, 'extracted')}/files"
    found = materialise(C.carve(spark, path, image_id="mixed").where("format = 'JPEG'"))
    C.extract(found, path, folder).agg(F.sum("bytes")).collect()  # one row
    drop_folder(spark, path)
    # the scan lines of a picture are its document's text, whose number the places tell
    places = mixed.file_places(spark, sf_dir)
    items = found.join(places, found["source_offset"] == places["place"]).withColumn("present", F.lit(True))
    other = F.when(F.col("bucket") == "photos", "likely_frame").otherwise("likely_still")
    same = F.when(F.col("bucket") == "photos", "likely_still").otherwise("likely_frame")
    moves = classify.plan_moves(items.withColumn("suggested", F.when(F.col("doc_id") % 2 == 0, other).otherwise(same)), M.listing(spark, folder).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path")))
    done = materialise(classify.apply_moves(moves, folder))
    files = materialise(M.listing(spark, folder).select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("top"), F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("now"), "size"))
    drop_folder(spark, folder)
    at = files.join(done.select(F.when(F.col("status") == "moved", F.col("path_after")).otherwise(F.col("path")).alias("now"), F.substring_index("path", "/", 1).alias("before"), "status"), "now")
    return at.groupBy("top", "before", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("""SELECT p_partkey, lower(p_type) IN ('a', 'standard polished tin', 'economy brushed steel') AS allowed, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-02' ELSE 'on ' || p_partkey END AS date, 'http://x/' || p_partkey AS url, CASE WHEN length(p_comment) > 8 THEN left(p_comment, 8) || '…' ELSE p_comment END AS snippet,
  'a' AS top, p_partkey || '.tar.gz' AS name, '.gz' AS suffix, p_partkey || '.tar' AS stem, p_partkey % 3 = 0 AS unsafe, CASE WHEN p_size % 2 = 0 THEN p_size || 'x' || (p_size + 1) END AS size, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 2 END AS sizes, p_size % 4 IN (0, 1) AS is_model
FROM (SELECT *, coalesce(p_name, '') AS p_comment FROM part)""")
def x16_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices, dates, addresses, cuts, parts of paths, sizes and kinds out of texts made of part."""
    p = table(spark, sf_dir, "part")
    c, key = F.col, F.col("p_partkey").cast("string")
    allowed = T.one_of(F.concat(F.lit(" "), F.upper("p_type")), ["a", "standard polished tin", "economy brushed steel"], "none") != "none"
    path = F.concat(F.when(c("p_partkey") % 3 == 0, F.lit("a/../")).otherwise(F.lit("a/b/")), key, F.lit(".tar.gz"))
    parts = T.path_parts(path)
    size = T.parse_size(F.concat(F.lit(" "), c("p_size").cast("string"), F.when(c("p_size") % 2 == 0, " X ").otherwise("by"), (c("p_size") + 1).cast("string")))
    sizes = T.parse_sizes(F.concat(F.lit("640x480,"), F.when(c("p_size") % 5 == 0, "640X480").otherwise("1x2"), F.lit(",0x5,none")))
    kind = F.when(c("p_size") % 4 == 0, "LLM").when(c("p_size") % 4 == 1, F.lit(None)).otherwise("embedding")
    return p.select(
        "p_partkey", allowed.alias("allowed"), T.iso_date(F.when(c("p_partkey") % 2 == 0, "2024-01-02 03:04:05").otherwise(F.concat(F.lit("on "), key))).alias("date"), T.without_trailing_slashes(F.concat(F.lit("http://x/"), key, F.lit("//"))).alias("url"), T.snippet(F.coalesce("p_name", F.lit("")), 8).alias("snippet"),
        parts["top"].alias("top"), parts["name"].alias("name"), parts["suffix"].alias("suffix"), parts["stem"].alias("stem"), T.is_unsafe_path(path).alias("unsafe"), F.when(size.isNotNull(), F.concat(size["w"].cast("string"), F.lit("x"), size["h"].cast("string"))).alias("size"), F.size(sizes).alias("sizes"), S.is_model_type(kind).alias("is_model"),
    )


@query("""WITH p AS (SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part) SELECT p_brand, CAST(pos AS INTEGER) AS pos, 'm/' || p_partkey AS value FROM p WHERE p_partkey % 3 <> 0""")
def p11_models_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models out of payloads, one a brand, in the four forms that servers give them; a third are no language models."""
    p = table(spark, sf_dir, "part")
    model = F.struct(F.concat(F.lit("m/"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 3 == 0, "embedding").otherwise("llm").alias("type"), F.col("p_brand").alias("architecture"))
    lists = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", model.alias("m")))).alias("l")).select("p_brand", F.transform("l", lambda x: x["m"]).alias("l"))
    form = F.pmod(F.xxhash64("p_brand"), F.lit(4))
    wrapped = F.when(form == 0, F.to_json("l"))
    for i, name in ((1, "data"), (2, "models"), (3, "items")):
        wrapped = wrapped.when(form == i, F.to_json(F.struct(F.col("l").alias(name))))
    found = ledger.normalize_models(ledger.models_of(lists.select(wrapped.alias("json")), "json"))
    return found.select(F.substring_index(F.col("description"), " · ", 1).alias("p_brand"), "pos", "value")


@query("SELECT 'first' AS step, true AS wrote, count(*) AS n FROM part UNION ALL SELECT 'same', false, count(*) FROM part UNION ALL SELECT 'changed', true, count(*) FILTER (p_partkey % 2 = 0) FROM part")
def k13_write_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, left alone as its rows are the same, and replaced."""
    path, p = new_folder(spark, "written"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    steps = []
    for step, rows in (("first", p), ("same", p.repartition(3)), ("changed", p.where("p_partkey % 2 = 0"))):
        steps.append((step, M.write_if_changed(rows, path), spark.read.parquet(path).count()))
    return spark.createDataFrame(steps, "step string, wrote boolean, n long")


@query("""SELECT o_orderpriority AS servicio, CAST(count(*) AS VARCHAR) AS total, CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR) AS finalizadas, (SELECT count(*) FROM orders) AS seguimiento, (SELECT count(*) FROM orders) AS lista FROM orders GROUP BY 1""")
def k10_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's sheets, written as CSV and read back."""
    folder = new_folder(spark, "workbook")
    rows = ledger._filings(spark, sf_dir).withColumns({"num": F.col("row")} | {c: F.lit(None).cast("string") for c in ("carpeta_tecnica", "fecha_presentacion")})
    ledger.write_workbook(rows, folder)
    sheet = lambda name: spark.read.option("header", True).csv(f"{folder}/{name}")
    counts = sheet("seguimiento").agg(F.count(F.lit(1)).alias("seguimiento")).join(sheet("finalizadas").agg(F.count(F.lit(1)).alias("lista")))  # one row each
    return sheet("resumen").select("servicio", "total", "finalizadas").join(counts)
