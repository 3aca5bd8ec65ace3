"""Tracker, catalog, scalar functions and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lacuna import streaming as R
from lacuna.functions import text as T
from lacuna.plans import ledger as L

SHEET = "row int, num int, servicio string, anio int, periodo_num int, periodo_nombre string, estado string, carpeta_tecnica string, fecha_presentacion string, fundamento string, notas string"


@pytest.fixture
def sheet(spark):
    rows = [(2, 1, "NORTE", 2024, 1, "Enero", "pendiente", None, "2024-02-03 00:00:00", None, None), (3, 2, "NORTE", 2024, 2, "Febrero", None, "CT", "later", None, None), (4, None, "X", 2024, 3, None, "Enviada", None, None, None, None), (5, 4, "SUR", 2024, 4, "Abril", "Finalizada", None, None, None, None)]
    return spark.createDataFrame(rows, SHEET)


def test_tracker(sheet):
    rows = L.until_first_blank(sheet)
    assert [(r.row, r.estado, r.fecha_presentacion) for r in rows.orderBy("row").collect()] == [(2, "pendiente", "2024-02-03"), (3, "Pendiente", "later")]
    assert L.pending(rows).count() == 2 and L.pending(rows, 1).first().row == 2
    assert L.find(sheet, "SUR", 2024, 4).first().row == 5 and L.find(sheet, "SUR", 1999, 4).count() == 0
    changed = L.update(sheet, "NORTE", 2024, 2, estado="Enviada", notas=None).orderBy("row").collect()
    assert [r.estado for r in changed] == ["pendiente", "Enviada", "Enviada", "Finalizada"]
    states = sheet.select("row", *[c.alias(n) for n, c in L.transition(F.col("estado"), False).items()]).orderBy("row").collect()
    assert [(r.status, r.new_estado) for r in states] == [("ok", "Enviada"), ("error", None), ("skipped", "Enviada"), ("skipped", "Finalizada")]


def test_workbook(spark, sheet, tmp_path):
    L.write_workbook(sheet, str(tmp_path))
    per = {r.servicio: (r.total, r.finalizadas, r.percent) for r in spark.read.csv(str(tmp_path / "resumen"), header=True, inferSchema=True).collect()}
    assert per == {"NORTE": (2, 0, 0.0), "SUR": (1, 1, 100.0), "X": (1, 0, 0.0)}
    assert spark.read.csv(str(tmp_path / "finalizadas"), header=True).count() == 4


def test_periods(spark):
    got = L.expand_periods(spark.createDataFrame([("A", "2023-12:2024-01")], "servicio string, spec string")).orderBy("num").collect()
    assert [(r.num, r.anio, r.mes, r.nombre) for r in got] == [(1, 2023, 12, "Diciembre"), (2, 2024, 1, "Enero")]
    for bad in ("2024-02:2024-01", "nonsense", None):
        with pytest.raises(Exception, match="not a range of months"):
            L.expand_periods(spark.createDataFrame([("A", bad)], "servicio string, spec string")).collect()


def test_catalog(spark):
    models = [
        {"id": " a/b-chat_7b ", "type": "LLM", "loaded_instances": [1], "maxContextLength": 131072, "vision": True},
        {"key": "z", "displayName": "Zed", "paramsString": "350M", "loaded": False, "quantization": {"name": "Q4"}},
        {"id": "emb", "type": "embedding"},
        {"name": ""},
        {"id": "z", "display_name": "Alpha", "capabilities": {"trained_for_tool_use": True}, "loaded_instances": []},
    ]
    payloads = spark.createDataFrame([(json.dumps({"data": models}),)], "body string")
    found = L.normalize_models(L.models_of(payloads, "body"))
    rows = L.options(found).collect()
    assert [(r.value, r.label) for r in rows] == [("z", "Alpha"), ("a/b-chat_7b", "b chat 7b")]
    assert rows[0].description == "not loaded · tool use" and rows[1].description == "131.1K ctx · loaded · vision"
    assert L.best_model(found).first().value == "a/b-chat_7b"
    assert L.models_of(spark.createDataFrame([("[{}]",), ("oops",), ('{"items": [{}, {}]}',)], "body string"), "body").count() == 3
    asked = spark.createDataFrame([("z", False), ("A/B-CHAT_7B", True), ("best", True), ("Mapped", False), ("tiny-1", False), ("fam-2", False), ("other", True)], "model string, calls_functions boolean")
    out = {r.model: r.resolved for r in L.resolve_aliases(asked, found, {"mapped": "m"}, "main", "small", ("fam",), ("tiny",)).collect()}
    assert out == {"z": "z", "A/B-CHAT_7B": "a/b-chat_7b", "best": "small", "Mapped": "m", "tiny-1": "small", "fam-2": "main", "other": "other"}


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.collapsed(F.lit(" a \n b\t"))) == "a b" and one(T.preview(F.lit("abcdefghij"), 6)) == "abc..." and one(T.preview(F.lit("ab"), 6)) == "ab"
    assert one(T.snippet(F.lit("x" * 300))) == "x" * 240 + "…" and one(T.first_text(F.lit(None).cast("string"), F.lit("  "), F.lit(" b "))) == "b"
    assert one(T.first_number(F.lit(float("nan")), F.lit(3.0))) == 3.0 and one(T.parse_params(F.lit(" 1.5B x"))) == 1.5e9 and one(T.infer_params(F.lit("m-7b"))) == 7e9
    assert one(T.infer_params(F.lit("m7bit"))) is None and one(T.pretty_id(F.lit("o/a--b_c"))) == "a b c"
    assert [one(T.compact_number(F.lit(float(x)))) for x in (999, 1000, 131072, 2_500_000)] == ["999", "1K", "131.1K", "2.5M"]
    assert one(T.without_trailing_slashes(F.lit("a//"))) == "a" and one(T.one_of(F.lit(" NONE "), ["auto", "none"], "auto")) == "none"
    assert [one(T.parse_bool(F.lit(x))) for x in ("off", "No", "yes", "")] == [False, False, True, True]
    assert [tuple(s) for s in one(T.parse_sizes(F.lit("1280x720, 1280X720,0x5,bad,640x480")))] == [(1280, 720), (640, 480)]
    assert one(T.human_size(F.lit(1536))) == "1.5 KB" and one(T.size_label(F.lit(11 << 20))) == "11MB" and one(T.padded(F.lit(123456))) == "123456"
    assert one(T.camera_name(F.lit("MOV"), F.lit(3), F.lit("avi"))) == "MOV00003.AVI" and one(T.period_label(F.lit("A"), F.lit(2024), F.lit(3))) == "A 2024-03"
    assert one(T.sorted_keys(F.lit('{"b":1,"a":2}'))) == ["a", "b"] and one(T.elapsed_ms(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:00.0125").cast("timestamp"))) == 12.5


def test_stream_dedup_resumes(spark, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, h string").coalesce(1).write.parquet(src)
    run = lambda: R.run_available(R.first_seen(spark.readStream.schema("i int, h string").parquet(src), "h"), sink, check)
    assert sorted(r.h for r in run().collect()) == ["a", "b"]
    spark.createDataFrame([(4, "b"), (5, "c")], "i int, h string").coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.h for r in run().collect()) == ["a", "b", "c"]


def test_requests_manifest_and_refresh(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id":"1","method":"ping"}\nnot json\n[1]\n\n{"id":"2"}\n')
    good, bad = R.request_stream(spark, str(folder))
    rows = R.run_available(good.withColumn("code", R.reply_code(F.col("method"), ("ping",))), str(tmp_path / "g"), str(tmp_path / "gc")).collect()
    assert sorted((r.id, r.code) for r in rows) == [("1", 0), ("2", -32600)]
    assert sorted(r.line for r in R.run_available(bad, str(tmp_path / "b"), str(tmp_path / "bc")).collect()) == ["[1]", "not json"]
    stream = R.manifest_stream(spark, str(folder))
    assert stream.isStreaming and "jpeg" in stream.columns
    names = lambda: spark.createDataFrame([("1", "one")], "id string, name string")
    R.refreshed_join(good.select("id"), names, "id", str(tmp_path / "j"), str(tmp_path / "jc")).awaitTermination()
    assert sorted((r.id, r.name or "") for r in spark.read.parquet(str(tmp_path / "j")).collect()) == [("1", "one"), ("2", "")]


def test_windows_drop_nothing_in_time(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 00:00:10", "u", 1.0), ("2024-01-01 00:00:50", "u", 3.0), ("2024-01-01 00:10:00", "u", 5.0), ("2024-01-01 01:00:00", "v", 0.0)], "t string, k string, v double").select(F.col("t").cast("timestamp"), "k", "v").write.parquet(src)
    stream = spark.readStream.schema("t timestamp, k string, v double").parquet(src)
    bands = R.run_available(R.tumbling_bands(stream, "t", "v", "1 minute", "1 minute"), str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert sorted((r.n, r.mean) for r in bands)[:2] == [(1, 5.0), (2, 2.0)]
    runs = R.run_available(R.sessions(stream, "t", "k", "2 minutes", "1 minute"), str(tmp_path / "s"), str(tmp_path / "sc")).collect()
    assert (2, "u") in {(r.n, r.k) for r in runs}


def test_trimming_needs_no_python(spark, sf):
    from lacuna.functions import bytes as B
    from lacuna.registry import QUERIES

    r = random.Random(4)
    rows = [(bytes(r.choices(b"a.\xe9\x00\xff", k=n)), bytes(r.choices(b"a.\xe9\xff", k=r.randint(0, 2)))) for n in list(range(12)) * 20]
    df = spark.createDataFrame([*rows, (None, b".")], "data binary, marker binary")
    want = [(x if x.rfind(m) < 0 else x[: x.rfind(m) + len(m)]) for x, m in rows] + [None]
    got = [r.t if r.t is None else bytes(r.t) for r in df.select(B.trim_after_last(F.col("data"), F.col("marker")).alias("t")).collect()]
    assert got == want
    assert "Python" not in QUERIES["x3_trim_last_marker"](spark, sf)._jdf.queryExecution().executedPlan().toString()
