"""Carving, classifying, cross-verifying and entropy over small images and manifests made here."""

import glob
import hashlib
import json
import random
import struct

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from lacuna import registry
from lacuna.plans import carve as C
from lacuna.plans import classify as K
from lacuna.plans import crossverify as X
from lacuna.plans import entropy as E
from lacuna.plans.streams import tiny_avi, tiny_jpeg, tiny_png
from lacuna.sources import manifest as M
from lacuna.sources.rawimage import clamp, input_size, read_image, write_parts
from lacuna.sources.scratch import shared_dir


def image(tmp_path, *parts, name="disk.img"):
    path = tmp_path / name
    path.write_bytes(b"".join(parts))
    return str(path)


def noise(n, seed=1):
    return random.Random(seed).randbytes(n).replace(b"\xff", b"\x01")


def test_rawimage_ranges(spark, tmp_path):
    path = image(tmp_path, bytes(range(256)) * 40)
    assert input_size(path) == 10240 and clamp(5, 0, 10) == (5, 10) and clamp(-3, 99, 10) == (0, 10)
    rows = read_image(spark, path, tile=1000, partition_bytes=2000, overlap=10).orderBy("offset").collect()
    assert b"".join(bytes(r.data[: r.length]) for r in rows) == bytes(range(256)) * 40
    assert [r.offset for r in rows] == list(range(0, 10240, 1000)) and len(rows[0].data) == 1010
    some = read_image(spark, path, tile=16, stride=512, start=1024, end=3000).orderBy("offset").collect()
    assert [r.offset for r in some] == [1024, 1536, 2048, 2560] and all(r.length == 16 for r in some)


def test_two_equal_pngs_give_one(spark, tmp_path):
    png = tiny_png(noise(5000))
    path = image(tmp_path, b"\x00" * 4096, png, b"\x11" * 2048, png, b"\x22" * 4096)
    got = C.carve(spark, path).collect()
    assert [(r.format, r.source_offset, r.source_end, r.sha256) for r in got] == [("PNG", 4096, 4096 + len(png), hashlib.sha256(png).hexdigest())]
    assert len(C.carve(spark, path, C.Settings(dedup="none")).collect()) == 2
    seen = spark.createDataFrame([(hashlib.sha256(png).hexdigest(),)], "sha256 string")
    assert C.carve(spark, path, seen=seen).count() == 0


def test_frames_after_a_film(spark, tmp_path):
    avi = tiny_avi([noise(2000)], b"XVID", 60 << 10)
    for (w, h), gap, settings, bucket in [((1280, 720), 100, C.Settings(), "frames"), ((4032, 2880), 100, C.Settings(), "photos"), ((1280, 720), 2 << 20, C.Settings(skip_after_video=True, window=1 << 20), "photos")]:
        jpeg = tiny_jpeg(w, h, body=noise(6000, 3))
        path = image(tmp_path, b"\x33" * 2048, avi, b"\x44" * gap, jpeg, b"\x55" * 1024)
        got = {r.format: r for r in C.carve(spark, path, settings).collect()}
        assert set(got) == {"AVI", "JPEG"} and got["JPEG"].bucket == bucket and got["AVI"].bucket == "videos"
        assert got["JPEG"].jpeg.width == w and got["JPEG"].path.startswith(f"{bucket}/{'video_frame' if bucket == 'frames' else 'photo'}_00001_JPEG_{w}x{h}")


def test_cut_off_files_end_with_the_image(spark, tmp_path):
    film = b"RIFF" + (300_000).to_bytes(4, "little") + b"AVI " + noise(150_000)
    bmp = b"BM" + struct.pack("<I4xII", 90_000, 54, 40) + struct.pack("<iiHHII", 100, 300, 1, 24, 0, 0) + noise(20_000)
    raf = b"FUJIFILMCCD-RAW" + bytes(85) + struct.pack(">II", 200, 50_000) + noise(10_000)
    for data, fmt in ((film, "AVI"), (bmp, "BMP"), (raf, "RAF")):
        got = C.carve(spark, image(tmp_path, bytes(512), data)).collect()
        assert [(r.format, r.source_offset, r.source_end) for r in got] == [(fmt, 512, 512 + len(data))]


def test_thumbnails_and_truncated_jpegs(spark, tmp_path):
    thumb = tiny_jpeg(16, 12, body=noise(5000))
    whole = tiny_jpeg(640, 480, body=noise(9000, 5))
    framed = whole[:2] + b"\xff\xe1" + (len(thumb) + 2).to_bytes(2, "big") + thumb + whole[2:]
    path = image(tmp_path, bytes(100), framed, bytes(50), whole[:5000] + b"\x00\xff\xd9"[1:], bytes(3000))
    got = C.carve(spark, path).collect()
    assert [(r.source_offset, r.source_end) for r in got] == [(100, 100 + len(framed)), (150 + len(framed), 150 + len(framed) + 5002)]
    cut = whole[:20] + b"\xff\xd9" + bytes(6000)  # an end marker where a segment should be
    manifest = C.carve(spark, image(tmp_path, bytes(100), cut, whole), C.Settings(photo_min=10), skipped=True).collect()
    assert {(r.status, r.source_offset, r.source_end) for r in manifest} == {("skipped", 100, 122), (None, 100 + len(cut), 100 + len(cut) + len(whole))}
    assert len(C.carve(spark, image(tmp_path, bytes(100), cut, whole), C.Settings(photo_min=10, validate="none")).collect()) == 2
    assert C.carve(spark, path, C.Settings(min_dimension=500)).count() == 0


def test_copies_of_films_still_route_frames(spark, tmp_path):
    avi = tiny_avi([noise(2000)], b"XVID", 60 << 10)
    jpeg = tiny_jpeg(1280, 720, body=noise(6000, 3))
    path = image(tmp_path, avi, bytes(3 << 20), avi, bytes(100), jpeg)
    for mode in ("strict", "fast"):
        got = {r.format: r for r in C.carve(spark, path, C.Settings(dedup=mode, skip_after_video=True, window=1 << 20)).collect()}
        assert set(got) == {"AVI", "JPEG"} and got["JPEG"].bucket == "frames"


def test_transport_streams_are_joined_over_tiles(spark, tmp_path):
    packet = lambda i: b"\x47" + noise(187, i).replace(b"\x47", b"\x48")
    stream = b"".join(packet(i) for i in range(2000))
    path = image(tmp_path, bytes(777), stream, bytes(5000), stream[: 188 * 400], bytes(100))
    found = C.find_files(spark, path, tile=64 << 10).orderBy("start").collect()
    assert [(r.format, r.start, r.end) for r in found if r.format == "MPEG-TS"] == [("MPEG-TS", 777, 777 + len(stream)), ("MPEG-TS", 5777 + len(stream), 5777 + len(stream) + 188 * 400)]


def test_tiles_stay_in_the_tasks(spark, tmp_path, monkeypatch):
    """A scan is given places alone and reads a tile at a time: no batch of tiles passes through the JVM; layouts ask for small batches."""
    plans, real = [], C.materialise
    monkeypatch.setattr(C, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    jpeg = tiny_jpeg(30, 20, body=noise(9000))
    path = image(tmp_path, bytes(100), jpeg, bytes(70_000), jpeg)
    found = C.find_files(spark, path, tile=8 << 10).orderBy("start").collect()
    assert [(r.start, r.end) for r in found] == [(100, 100 + len(jpeg)), (70_100 + len(jpeg), 70_100 + 2 * len(jpeg))]
    assert "Range" in plans[0] and "data" not in plans[0]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    write_parts(spark.createDataFrame([(0, b"x")], "place long, data binary"), 1, str(tmp_path / "parts"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_a_stream_outlives_a_sync_byte_before_it(spark, tmp_path):
    """A picture's byte that stands one packet before a stream looks like its first sync; a scan takes the picture, then the stream."""
    stream = b"".join(b"\x47" + noise(187, i).replace(b"\x47", b"\x48") for i in range(500))
    body = bytearray(noise(9000).replace(b"\x47", b"\x48").replace(b"\xff", b"\xfe"))
    body[-(188 - 2 - 32)] = 0x47  # the end marker and a gap lie between
    picture = tiny_jpeg(30, 20, body=bytes(body))
    path = image(tmp_path, bytes(50), picture, bytes(32), stream, bytes(4000))
    found = C.carve(spark, path, C.Settings(photo_min=1000)).orderBy("source_offset").collect()
    at = 50 + len(picture) + 32
    assert [(r.format, r.source_offset, r.source_end) for r in found] == [("JPEG", 50, at - 32), ("MPEG-TS", at, at + len(stream))]


@pytest.fixture(scope="module")
def behind_a_cut_off_picture(tmp_path_factory):
    """Documents whose mixed image has a picture without its end (107) 0xFFE2 bytes before the end of a film's first frame (110), counted from the next picture's start."""
    folder = tmp_path_factory.mktemp("cut")
    lengths = {107: 5000, 108: 20_000, 109: 25_000, 110: 65_113 - 45_000}
    rows = [(i, chr(97 + i % 26) * lengths.get(i, 4500 + i)) for i in range(100, 126)]
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    pq.write_table(table, f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["e17_mixed_image", "k15_apply_moves", "k5_report_items", "s15_extracted_films"])
def test_mixed_image_behind_a_cut_off_picture(spark, behind_a_cut_off_picture, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{behind_a_cut_off_picture}/documents.parquet'")
    same_rows(registry.QUERIES[name](spark, behind_a_cut_off_picture), con.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", ["e17_mixed_image", "k15_apply_moves", "k5_report_items", "s15_extracted_films"])
def test_images_and_copies_are_dropped(spark, behind_a_cut_off_picture, name):
    left = lambda: {f for kind in ("images", "extracted") for f in glob.glob(f"{shared_dir(spark).removeprefix('file://')}/{kind}/**", recursive=True) if f.endswith((".part", ".jpg", ".avi"))}
    tables = lambda: {f for f in glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tables/**/*.parquet", recursive=True)}
    files, old = left(), tables()
    registry.QUERIES[name](spark, behind_a_cut_off_picture).collect()
    assert left() <= files
    assert not any("data" in pq.read_schema(f).names for f in tables() - old)  # the image is the only copy of the data


def test_extract_and_stats(spark, tmp_path):
    jpeg, png = tiny_jpeg(30, 20, body=noise(9000)), tiny_png(noise(7000, 2))
    path = image(tmp_path, b"\x00" * 100, jpeg, b"\x00" * 77, png, jpeg[:-2], b"\x00" * 10)
    manifest = C.carve(spark, path, C.Settings(photo_prefix="PHO", first_id=7)).cache()
    assert sorted(r.path for r in manifest.collect()) == ["photos/PHO00008.JPG", "photos/PHO00009.PNG"]
    out = tmp_path / "out"
    done = C.extract(manifest, path, str(out)).collect()
    assert {r.sha256 for r in done} == {hashlib.sha256(x).hexdigest() for x in (jpeg, png)}
    assert (out / "photos/PHO00008.JPG").read_bytes() == jpeg
    stats = C.scan_stats(C.choose(spark, path, C.Settings())[1], manifest).first()
    assert (stats.files, stats.photos, stats.videos, stats.dup_photos) == (2, 2, 0, 0) and stats.bytes == len(jpeg) + len(png)
    files = M.listing(spark, str(out), ("jpg",)).collect()
    assert [(r.name, r.size) for r in files] == [("PHO00008.JPG", len(jpeg))]
    assert {(r.extension, r.n) for r in M.inventory(M.listing(spark, str(out))).collect()} == {("JPG", 1), ("PNG", 1)}


def test_manifest_lines(spark, tmp_path):
    good = {"v": 2, "path": "photos/a.jpg", "bucket": "photos", "format": "JPEG", "source_offset": 10, "source_end": 20, "jpeg": {"width": 4, "inside_mjpeg_avi": True}}
    lines = [json.dumps(good), "", "{broken", "[1]", json.dumps({"source_offset": "7", "source_end": 9}), json.dumps({"source_offset": True, "source_end": 9}), json.dumps({**good, "status": "skipped"}), json.dumps({"source_offset": 1, "source_end": 2})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n")
    rows = M.with_line_numbers(spark, str(tmp_path / "m.jsonl"))
    stats = M.input_stats(rows).first()
    assert (stats.physical_lines, stats.blank_lines, stats.invalid_lines, stats.parsed_rows) == (8, 1, 2, 5)
    assert {(r.line_no, r.reason, r.snippet) for r in M.issues(rows).collect()} == {(3, "invalid_json", "{broken"), (4, "not_an_object", "[1]")}
    assert {(r.start, r.end, r.format, r.status) for r in M.spans(rows).collect()} == {(10, 20, "JPEG", "recovered"), (1, 2, "unknown", "recovered")}
    parsed = M.parse_manifest(rows).where("line_no = 1").first()
    assert parsed.jpeg.width == 4 and parsed.jpeg.inside_mjpeg_avi is True and parsed.jpeg.bits_per_pixel is None
    out = str(tmp_path / "log")
    M.append_json(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"a":1}', '{"a":2,"b":"x"}']


def test_write_if_changed(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(3)
    assert M.write_if_changed(df, path) and not M.write_if_changed(df, path) and M.write_if_changed(spark.range(4), path)


def test_classify_and_moves(spark):
    rows = [
        ("photos/a.jpg", "photos", "JPEG", (None, None, False, False, None, None, 0.9, True, True), True),
        ("photos/b.jpg", "photos", "JPEG", (None, None, True, True, 5, 10, 0.1, None, None), True),
        ("frames/c.jpg", "frames", "JPEG", (None, None, False, False, None, None, None, None, True), False),
        (None, None, "JPEG", None, None),
        ("videos/d.mp4", "videos", "MP4", None, True),
        ("photos/../x.jpg", "photos", "JPEG", (None, None, True, True, None, None, None, None, None), True),
    ]
    df = spark.createDataFrame(rows, f"path string, bucket string, format string, jpeg {M.JPEG}, present boolean")
    items = K.classify(df)
    got = {r.path: (r.still, r.frame, r.suggested) for r in items.collect()}
    assert got["photos/a.jpg"] == (5, 0, "likely_still") and got["photos/b.jpg"] == (1, 11, "likely_frame")
    assert got["frames/c.jpg"] == (2, 2, "uncertain") and got[None] == (0, 0, "uncertain")
    moves = {r.path: (r.status, r.reason, r.path_after) for r in K.plan_moves(items, df.select(F.lit("frames/b.jpg").alias("path")).limit(1)).collect()}
    assert moves["photos/a.jpg"][1] == "already_in_target_bucket" and moves[None][1] == "file_not_found"
    assert moves["photos/b.jpg"] == ("planned", None, "frames/b_reclass.jpg") and moves["photos/../x.jpg"][1] == "unsafe_relative_path"
    assert [(r.format, r.reason_code) for r in K.skipped_rows(df).collect()] == [("MP4", "format_not_jpeg")]
    total = K.summary(items, K.plan_moves(items)).first()
    assert (total.likely_still, total.likely_frame, total.uncertain, total.moves_planned, total.moves_error) == (1, 2, 2, 1, 0)
    assert K.csv_rows(items).where("path = 'photos/a.jpg'").first().reasons == "carver_bucket_photos;common_still_photo_resolution;higher_bits_per_pixel_milder_compression;progressive_jpeg"


def test_cross_verify(spark, tmp_path):
    a, b, c = (tiny_jpeg(2, 2, body=noise(50, s)) for s in (1, 2, 3))
    (tmp_path / "one.avi").write_bytes(tiny_avi([a, b, b"raw!"]))
    (tmp_path / "two.avi").write_bytes(tiny_avi([]))
    films = M.listing(spark, str(tmp_path), ("avi",)).withColumn("video", F.col("name"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    carved = spark.createDataFrame([(sha(a), "a1.jpg", "photos", 1), (sha(a), "a2.jpg", "photos", 2), (sha(c), "c.jpg", "photos", 3)], "sha256 string, fname string, bucket string, seq int")
    matched = X.match_frames(carved, X.frames_of_files(films)).cache()
    matches = X.file_matches(matched)
    assert [(r.fname, r.video, r["index"]) for r in matches.collect()] == [("a2.jpg", "one.avi", 0)]
    assert [r.fname for r in X.orphans(carved, matches).collect()] == ["a1.jpg", "c.jpg"]
    per = X.per_video(films, matched)
    assert {(r.video, r.total_frames, r.jpeg_frames, r.matched_carved, r.unrecovered) for r in per.collect()} == {("one.avi", 3, 2, 1, 2), ("two.avi", 0, 0, 0, 0)}
    total = X.summary(carved, per, matches).first()
    assert (total.orphaned, total.match_rate_percent, total.recovery_rate_percent) == (2, 33.33, 33.33)
    m = 1_000_000
    spans = spark.createDataFrame([(1000, 5000), (8000, 12000)], "start long, end long")
    items = spark.createDataFrame([("in.jpg", 1500, 1600), ("a.jpg", m, m + 10), ("b.jpg", 2 * m, 2 * m + 10), ("c.jpg", 50 * m, 50 * m + 10)], "fname string, start long, end long")
    assert [(r.frame_count, r.files) for r in X.orphan_regions(items, spans).collect()] == [(2, ["a.jpg", "b.jpg"]), (1, ["c.jpg"])]


def test_entropy_scan(spark, tmp_path):
    path = image(tmp_path, b"\x00" * (1 << 16), noise(1 << 17), b"ab" * (1 << 15))
    blocks = read_image(spark, path, tile=4096, stride=8192).select(F.col("offset").alias("block"), "offset", "length", E.B.byte_entropy("data").alias("entropy"))
    spans = spark.createDataFrame([(1 << 16, (1 << 16) + 40_000)], "start long, end long")
    row = E.band_counts(E.mark_recovered(blocks, spans, [])).first()
    assert (row.n_blocks, row.n_empty, row.n_low, row.n_medium, row.n_high) == (32, 8, 8, 0, 16)
    assert (row.n_recovered, row.n_unrecovered) == (5, 11)
    regions = E.high_regions(blocks.where("entropy >= 7"), []).collect()
    assert [(r.start, r.size_bytes, r.sample_count, r.size_readable) for r in regions] == [(1 << 16, 15 * 8192, 16, "120.0 KB")]


def test_probes_and_hashes(spark):
    df = spark.createDataFrame([(b"\x00\x00\x00\x18ftyp",), (b"BM",), (b"",), (b"RIFFxxxxAVI ",)], "data binary")
    got = [list(r[0]) for r in df.select(E.B.matching_probes(F.col("data"))).collect()]
    assert got == [["ISOBMFF (MP4/MOV/HEIF)"], ["BMP"], [], ["RIFF (AVI/WAV/WebP)"]]
    assert df.select(E.B.is_transport_stream(F.lit((b"\x47" + b"\x00" * 187) * 8)).alias("t")).first().t


def test_state_moves_and_offsets(spark, tmp_path):
    from lacuna.sources import state as Z

    folder = str(tmp_path / "state")
    assert Z.load_seen(spark, folder).count() == 0 and Z.load_counters(spark, folder).count() == 0
    Z.save(spark.createDataFrame([("a",), ("a",), (None,)], "sha256 string"), folder)
    Z.save(spark.createDataFrame([("b",)], "sha256 string"), folder)
    Z.save_counters(spark.createDataFrame([("photo", 7)], Z.COUNTERS), folder)
    Z.save_counters(Z.load_counters(spark, folder).withColumn("last_id", F.col("last_id") + 1), folder)
    assert sorted(r.hash for r in Z.load_seen(spark, folder).collect()) == ["a", "b"] and Z.load_counters(spark, folder).first().last_id == 8
    Z.reset(spark, folder)
    assert Z.load_seen(spark, folder).count() == 0
    root = tmp_path / "files"
    (root / "photos").mkdir(parents=True)
    (root / "photos/a.jpg").write_bytes(b"a")
    plan = K.plan_moves(spark.createDataFrame([("photos/a.jpg", "likely_frame", True), ("photos/gone.jpg", "likely_frame", True), ("photos/b.jpg", "uncertain", True)], "path string, suggested string, present boolean"))
    done = {r.path: (r.status, r.reason) for r in K.apply_moves(plan, str(root)).collect()}
    assert done["photos/a.jpg"] == ("moved", None) and done["photos/gone.jpg"] == ("skipped", "file_not_found_at_rename") and done["photos/b.jpg"][0] == "skipped"
    assert (root / "frames/a.jpg").read_bytes() == b"a"
    rows = [json.dumps({"path": "photos/x.jpg", "format": "JPEG", "source_offset": i, "source_end": i + 5, "jpeg": {"matches_skip_frame_resolution": i == 9}}) for i in (1, 9)] + [json.dumps({"path": "videos/v.avi", "format": "AVI", "source_offset": 0, "source_end": 99})]
    parsed = M.parse_manifest(spark.createDataFrame(list(enumerate(rows)), "line_no long, line string"))
    assert [(r.fname, r.start, r.end) for r in X.offsets_of(parsed).collect()] == [("x.jpg", 9, 14)]
    assert [(r.start, r.end) for r in X.film_spans(parsed).collect()] == [(0, 99)] and X.frame_sized(parsed).count() == 1
