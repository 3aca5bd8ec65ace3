"""Rewritten bodies, catalog versions, batch plans, reports and presence."""

import json

import pytest
from pyspark.sql import functions as F

from lacuna.plans import carve as C
from lacuna.plans import ledger
from lacuna.plans import requests as R
from lacuna.plans.streams import tiny_avi, tiny_jpeg, tiny_png
from lacuna.sources import reports


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('{"model":"a"}', '{"model":"new \\"x\\""}'),
        (' { "b" : 1.50, "model" :\n"a" , "z":[{"model":"a"}]} ', ' { "b" : 1.50, "model" :\n"new \\"x\\"" , "z":[{"model":"a"}]} '),
        ('{"model":{"model":1},"é":"日\\u00e9"}', '{"model":"new \\"x\\"","é":"日\\u00e9"}'),
        ('{"model":"a","model":"b"}', '{"model":"new \\"x\\"","model":"new \\"x\\""}'),
        ('{"other":"model"}', '{"other":"model"}'),
        ("[]", "[]"),
        ("{}", "{}"),
        ('{"model":"a",}', '{"model":"a",}'),
        ('{"model":"a"} x', '{"model":"a"} x'),
        ('{"model" "a"}', '{"model" "a"}'),
        ("", ""),
        ('{"a":' + "[" * 100_000, '{"a":' + "[" * 100_000),
    ],
)
def test_one_member_changes(body, want):
    assert R.with_member(body, "model", 'new "x"') == want


def test_requests_that_pass_as_they_are(spark):
    rows = [(1, R.MESSAGES, '{"model": "best", "stream": true}'), (2, "/v1/models", '{"model": "best"}'), (3, R.MESSAGES, '{"model": 5, "stream": true}'), (4, R.MESSAGES, '{"model": ""}'), (5, R.MESSAGES, "[true]"), (6, R.MESSAGES, "no json"), (7, R.MESSAGES, None), (8, None, '{"model": "best"}'), (9, R.MESSAGES, '{"model": "best", "tools": [1], "stream": "true"}'), (10, R.MESSAGES, '{"model": "Known"}'), (11, R.MESSAGES, "")]
    df = spark.createDataFrame(rows, "id int, path string, body string")
    known = spark.createDataFrame([(1, "known")], "pos int, value string")
    got = {r.id: (r.streams, r.rewritten) for r in R.rewrite_requests(df, known, {}, "big", "little", (), (), "tool").collect()}
    body = {i: b for i, _, b in rows}
    assert got == {i: (i in (1, 3), b) for i, b in body.items()} | {1: (True, '{"model": "big", "stream": true}'), 9: (False, '{"model": "tool", "tools": [1], "stream": "true"}'), 10: (False, '{"model": "known"}')}


def test_catalog_survives_restarts(spark, tmp_path):
    def put(name, version, *models):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps({"version": version, "pos": i, "model": json.dumps(m)}) + "\n" for i, m in enumerate(models)))

    def run(check):
        lines = spark.readStream.schema("version bigint, pos bigint, model string").json(str(tmp_path / "in"))
        R.sync_catalog(lines, str(tmp_path / "catalog"), str(tmp_path / check)).awaitTermination()
        return {r.value: r.label for r in R.catalog(spark, str(tmp_path / "catalog")).collect()}

    a, b = {"id": "x/a", "type": "llm"}, {"id": "b", "displayName": "B", "loaded": True}
    put("1", 1, a, b, {"id": "e", "type": "embedding"})
    assert run("c") == {"x/a": "a", "b": "B"}
    put("2", 2, {**b, "displayName": "B2"}, {"id": "new"})
    assert run("c") == run("c") == {"b": "B2", "new": "new"}
    assert run("other") == {"b": "B2", "new": "new"}  # all batches once more, from no checkpoint
    changes = spark.read.parquet(str(tmp_path / "catalog" / "changes"))
    assert {(r.version, r.value, r.change) for r in changes.collect()} == {(1, "x/a", "added"), (1, "b", "added"), (2, "x/a", "gone"), (2, "b", "changed"), (2, "new", "added")}
    put("3", 3, {"id": "e", "type": "embedding"})
    with pytest.raises(Exception, match="no usable model"):
        run("c")
    assert {r.value for r in R.catalog(spark, str(tmp_path / "catalog")).collect()} == {"b", "new"}


def test_batches_stop_at_their_first_error(spark):
    rows = [(i, "A" if i < 8 else None, 2024, i % 12 + 1, "Enviada" if i == 2 else "pendiente", i in (4, 6, 9)) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "row long, servicio string, anio int, periodo_num int, estado string, bad boolean")
    got = {r.row: (r.place, r.status, r.new_estado) for r in ledger.batch_plan(df, F.col("bad"), by=["servicio"]).collect()}
    assert got == {1: (1, "ok", "En curso"), 3: (2, "ok", "En curso"), 4: (3, "error", "pendiente"), 5: (4, "not_attempted", "pendiente"), 6: (5, "not_attempted", "pendiente"), 7: (6, "not_attempted", "pendiente"), 8: (1, "ok", "En curso"), 9: (2, "error", "pendiente"), 10: (3, "not_attempted", "pendiente"), 11: (4, "not_attempted", "pendiente")}
    assert [(r.row, r.status) for r in ledger.batch_plan(df, F.col("bad"), 2, False).orderBy("row").collect()] == [(1, "ok"), (3, "ok")]
    assert ledger.batch_plan(df.limit(0), F.col("bad"), by=["servicio"]).count() == 0 and ledger.batch_plan(df, F.lit(None).cast("boolean")).where("status <> 'ok'").count() == 0


def test_reports_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    assert reports.read_report(spark, path) == {}
    items = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "é")], "id int, reasons array<string>, note string")
    first = reports.write_report(spark, {"items": items, "none": items.limit(0), "summary": {"n": 2, "rate": 0.5, "by": {"x": None}}, "name": "ünï"}, path)
    got = reports.read_report(spark, path)
    assert sorted(map(tuple, got["items"].collect())) == sorted(map(tuple, items.collect())) and got["none"].columns == items.columns and got["none"].count() == 0
    assert got["summary"] == {"n": 2, "rate": 0.5, "by": {"x": None}} and got["name"] == "ünï"
    broken = items.select(F.raise_error(F.lit("task died")).alias("x"))
    with pytest.raises(Exception, match="task died"):
        reports.write_report(spark, {"items": broken, "name": "second"}, path)
    assert reports.read_report(spark, path)["name"] == "ünï" and reports.read_report(spark, path)["items"].count() == 2
    reports.write_report(spark, {"name": "third"}, path)
    assert reports.read_report(spark, path) == {"name": "third"} and not (tmp_path / "report" / first).exists()


def test_presence_joins_however_paths_are_spelled(spark):
    items = spark.createDataFrame([("photos/a.jpg",), ("./photos//b.jpg",), ("photos/../photos/c.jpg",), ("photos/no.jpg",), ("../x/photos/a.jpg",), (None,), ("",)], "path string")
    files = spark.createDataFrame([("file:/root/x/photos/a.jpg",), ("file:///root/x/photos/b.jpg",), ("/root/x/photos/c.jpg",), ("/root/xphotos/no.jpg",), ("/root/x/photos/a.jpg",)], "path string")
    got = {r.path: r.present for r in reports.with_presence(items, files, "file:///root//x/").collect()}
    assert got == {"photos/a.jpg": True, "./photos//b.jpg": True, "photos/../photos/c.jpg": True, "photos/no.jpg": False, "../x/photos/a.jpg": False, None: False, "": False}


def test_carve_function(spark):
    body = bytes(range(1, 200)) * 40
    avi, png, jpeg = tiny_avi([b"frame"], pad_to=60 << 10), tiny_png(body), tiny_jpeg(64, 48, body=body)
    data = bytes(100) + avi + bytes(40) + png + jpeg + b"\x89PNG\r\n\x1a\n" + bytes(50)
    C.carve_function(spark)
    spark.createDataFrame([(1, data), (2, None), (3, b"")], "id int, content binary").createOrReplaceTempView("some_bytes")
    got = spark.sql("SELECT id, f.* FROM some_bytes, LATERAL carve(content, 1000) f").orderBy("start").collect()
    ends = [100 + len(avi), 140 + len(avi) + len(png), 140 + len(avi) + len(png) + len(jpeg)]
    assert [(r.id, r.format, r.start, r.end, r.width) for r in got] == [(1, "AVI", 100, ends[0], None), (1, "PNG", ends[0] + 40, ends[1], None), (1, "JPEG", ends[1], ends[2], 64)]
