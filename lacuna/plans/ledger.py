"""Small tables: a tracker of monthly filings, a catalog of models, requests for them; with DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scoring as S
from ..functions import text as T
from ..operators import dedup as D
from ..operators.ordered import number_rows
from ..sources.manifest import append_json
from ..sources.scratch import materialise, new_folder
from .tables import table

QUERIES, ORACLES = {}, {}
PENDING, TERMINAL = "pendiente", ("enviada", "validada", "finalizada")


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Tracker: columns row, num, servicio, anio, periodo_num, periodo_nombre, estado, carpeta_tecnica, fecha_presentacion, fundamento, notas


def until_first_blank(rows: DataFrame) -> DataFrame:
    """A sheet's rows before the first one without a number, with defaults filled in."""
    blank = rows.where(F.col("num").isNull()).agg(F.min("row").alias("_stop"))
    at = rows.join(blank).where(F.col("_stop").isNull() | (F.col("row") < F.col("_stop"))).drop("_stop")  # one row
    return at.withColumn("estado", F.coalesce(F.nullif("estado", F.lit("")), F.lit("Pendiente"))).withColumn("fecha_presentacion", T.iso_date(F.col("fecha_presentacion")))


def pending(rows: DataFrame, limit: int = 0) -> DataFrame:
    return D.limit_or_all(rows.where(F.lower("estado") == PENDING).orderBy("row"), limit)


def find(rows: DataFrame, servicio: str, anio: int, periodo_num: int) -> DataFrame:
    """The first row of a key."""
    return rows.where((F.col("servicio") == servicio) & (F.col("anio") == anio) & (F.col("periodo_num") == periodo_num)).orderBy("row").limit(1)


def update(rows: DataFrame, servicio: str, anio: int, periodo_num: int, **values: str | None) -> DataFrame:
    """rows with the given values (None leaves as is) in the first row of a key."""
    key = (F.col("servicio") == servicio) & (F.col("anio") == anio) & (F.col("periodo_num") == periodo_num)
    first = rows.where(key).agg(F.min("row").alias("_first"))
    at = rows.join(first)  # one row
    hit = key & (F.col("row") == F.col("_first"))
    return at.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if v is not None}).drop("_first")


def transition(estado: Column, dry_run: bool) -> dict[str, Column]:
    """status and new_estado of a submission: missing is an error, a terminal state is left, all else is sent (or begun, in a dry run)."""
    done = F.lower(estado).isin(*TERMINAL)
    return {"status": F.when(estado.isNull(), "error").when(done, "skipped").otherwise("ok"), "new_estado": F.when(done, estado).when(estado.isNotNull(), "En curso" if dry_run else "Enviada")}


def batch_plan(rows: DataFrame, failing: Column, limit: int = 0, dry_run: bool = True, by: list[str] | None = None) -> DataFrame:
    """What submitting the pending rows one after the other comes to (the first `limit` of each batch; all if 0): rows with place (from 1), period, status and new_estado.

    A batch, the rows of equal `by`, stops at its first row for which `failing` holds: that is an error and changes nothing, and later ones are 'not_attempted'. Places are numbers within
    buckets and a batch's first error is an aggregate, so a batch of any size is many tasks' work.
    """
    by = by or []
    at = number_rows(rows.where(F.lower("estado") == PENDING), by, ["row"], "place")
    at = at.where(F.col("place") <= limit) if limit else at
    at = materialise(at.withColumn("_fails", F.coalesce(failing, F.lit(False))))
    stops = at.where("_fails").groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.min("place").alias("_stop"))
    same = F.lit(True)
    for c in by:
        same = same & at[c].eqNullSafe(F.col(f"_k_{c}"))
    at = at.join(stops, same, "left") if by else at.join(stops)  # one row
    told = transition(F.col("estado"), dry_run)
    status = F.when(F.col("place") > F.col("_stop"), "not_attempted").when(F.col("_fails"), "error").otherwise(told["status"])
    period = T.period_label(F.col("servicio"), F.col("anio"), F.col("periodo_num"))
    return at.select(*rows.columns, "place", period.alias("period"), status.alias("status")).withColumn("new_estado", F.when(F.col("status").isin("ok", "skipped"), told["new_estado"]).otherwise(F.col("estado")))


def status_counts(rows: DataFrame) -> DataFrame:
    """One row of the summary sheet: filings (rows with a number), how many of them are in each known state, the finished ones' share in percent."""
    state = lambda *names: F.count_if(F.lower("estado").isin(*names))
    at = rows.where(F.col("num").isNotNull()).agg(F.count("num").alias("total"), state("pendiente").alias("pendientes"), state("en curso").alias("en_curso"), state("enviada").alias("enviadas"), state("validada").alias("validadas"), state("finalizada").alias("finalizadas"))
    return at.withColumn("percent", F.coalesce(F.round(F.try_divide(100.0 * F.col("finalizadas"), F.col("total")), 2), F.lit(0.0)))


def summary(rows: DataFrame) -> DataFrame:
    """Rows per status (null: all), with each one's share in percent."""
    per = rows.rollup("estado").agg(F.count(F.lit(1)).alias("n"), F.grouping("estado").alias("is_total"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return per.join(total).select("estado", "n", F.col("is_total").cast("int").alias("is_total"), F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))  # one row


def expand_periods(specs: DataFrame) -> DataFrame:
    """specs (servicio, spec as 'YYYY-MM:YYYY-MM') -> num, servicio, anio, mes, nombre: all months of each range, both ends included; repeated ranges repeat their months.

    A spec that isn't one, or ends before it starts, raises an error.
    """
    edge = lambda i: F.try_to_timestamp(F.concat(F.regexp_extract("spec", r"^(\d{4}-(?:0[1-9]|1[0-2])):(\d{4}-(?:0[1-9]|1[0-2]))$", i), F.lit("-01"))).cast("date")
    at = specs.select("servicio", "spec", edge(1).alias("a"), edge(2).alias("b"))
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.col("b") < F.col("a"))
    months = F.when(bad, F.raise_error(F.concat(F.lit("not a range of months: "), F.coalesce("spec", F.lit("null")))).cast("array<date>")).otherwise(F.sequence("a", "b", F.expr("interval 1 month")))
    out = at.select("servicio", F.explode(months).alias("d")).select("servicio", F.year("d").alias("anio"), F.month("d").alias("mes"))
    out = out.withColumn("nombre", T.month_name(F.col("mes"))).withColumn("seq", (F.col("anio") * 12 + F.col("mes")).cast("long"))
    return number_rows(out, [], ["seq", "servicio"], "num").select("num", "servicio", "anio", "mes", "nombre")


def workbook(rows: DataFrame) -> dict[str, DataFrame]:
    """The tracker's three sheets as tables: all periods, the summary (with finished shares per service), and a row per filing for the finished ones' list.

    The last sheet lists every row, finished or not, as its formulas refer to the first sheet row by row.
    """
    finished = F.lower("estado").isin("finalizada")
    per = rows.groupBy("servicio").agg(F.count(F.lit(1)).alias("total"), F.count_if(finished).alias("finalizadas"))
    per = per.withColumn("percent", F.coalesce(F.round(F.try_divide(100.0 * F.col("finalizadas"), F.col("total")), 2), F.lit(0.0)))
    return {"seguimiento": rows.orderBy("anio", "servicio", "periodo_num"), "resumen": per.orderBy("servicio"), "finalizadas": rows.select("num", "servicio", "anio", "periodo_num", "carpeta_tecnica", "fecha_presentacion")}


def write_workbook(rows: DataFrame, folder: str) -> None:
    """Each sheet as CSV below a folder."""
    for name, sheet in workbook(rows).items():
        sheet.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


_ORDERS = "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Pendiente' WHEN 'F' THEN 'Finalizada' WHEN 'P' THEN 'En curso' ELSE o_orderstatus END AS estado, o_orderpriority AS servicio, CAST(year(o_orderdate) AS INTEGER) AS anio, CAST(month(o_orderdate) AS INTEGER) AS mes FROM orders"


def _filings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    estado = F.when(F.col("o_orderstatus") == "O", "Pendiente").when(F.col("o_orderstatus") == "F", "Finalizada").when(F.col("o_orderstatus") == "P", "En curso").otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("row"), estado.alias("estado"), F.col("o_orderpriority").alias("servicio"), F.year("o_orderdate").alias("anio"), F.month("o_orderdate").alias("periodo_num"))


@query(f"SELECT o_orderkey AS row, servicio, anio FROM ({_ORDERS}) WHERE lower(estado) = 'pendiente' ORDER BY o_orderkey LIMIT 100")
def f12_tracker_pending(spark, sf_dir):
    return pending(_filings(spark, sf_dir), 100).select("row", "servicio", "anio")


@query(f"SELECT o_orderkey AS row, estado, servicio, anio, mes AS periodo_num FROM ({_ORDERS}) WHERE servicio = '1-URGENT' AND anio = 1996 AND mes = 3 ORDER BY o_orderkey LIMIT 1")
def j14_tracker_find(spark, sf_dir):
    return find(_filings(spark, sf_dir), "1-URGENT", 1996, 3)


@query(f"WITH t AS ({_ORDERS}), f AS (SELECT min(o_orderkey) AS k FROM t WHERE servicio = '1-URGENT' AND anio = 1996 AND mes = 3) SELECT o_orderkey AS row, CASE WHEN o_orderkey = k THEN 'Enviada' ELSE estado END AS estado, servicio, anio, mes AS periodo_num FROM t, f")
def k11_tracker_update(spark, sf_dir):
    return update(_filings(spark, sf_dir), "1-URGENT", 1996, 3, estado="Enviada")


@query(f"WITH t AS ({_ORDERS}) SELECT estado, count(*) AS n, CAST(grouping(estado) AS INTEGER) AS is_total, round(100.0 * count(*) / (SELECT count(*) FROM t), 2) AS percent FROM t GROUP BY ROLLUP (estado)")
def a14_tracker_summary(spark, sf_dir):
    return summary(_filings(spark, sf_dir))


@query(f"SELECT servicio, count(*) AS total, count(*) FILTER (estado = 'Finalizada') AS finalizadas, round(100.0 * count(*) FILTER (estado = 'Finalizada') / count(*), 2) AS percent FROM ({_ORDERS}) GROUP BY servicio")
def a16_per_service(spark, sf_dir):
    return workbook(_filings(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("num", "carpeta_tecnica", "fecha_presentacion")}))["resumen"]


@query(f"SELECT o_orderkey AS row, CASE WHEN lower(estado) IN ('enviada', 'validada', 'finalizada') THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN lower(estado) IN ('enviada', 'validada', 'finalizada') THEN estado ELSE 'En curso' END AS new_estado, printf('%s %d-%02d', servicio, anio, mes) AS label FROM ({_ORDERS})")
def m2_status_machine(spark, sf_dir):
    f = _filings(spark, sf_dir)
    return f.withColumns(transition(F.col("estado"), True)).select("row", "status", "new_estado", T.period_label(F.col("servicio"), F.col("anio"), F.col("periodo_num")).alias("label"))


_PLAN = f"""WITH t AS ({_ORDERS}), p AS (SELECT *, row_number() OVER (PARTITION BY servicio ORDER BY o_orderkey) AS place FROM t WHERE lower(estado) = 'pendiente'),
q AS (SELECT *, o_orderkey % 97 = 0 AS fails, min(CASE WHEN o_orderkey % 97 = 0 THEN place END) OVER (PARTITION BY servicio) AS stop FROM p)"""


@query(f"{_PLAN} SELECT o_orderkey AS row, servicio, place, printf('%s %d-%02d', servicio, anio, mes) AS period, CASE WHEN place > stop THEN 'not_attempted' WHEN fails THEN 'error' ELSE 'ok' END AS status, CASE WHEN place >= stop THEN estado ELSE 'En curso' END AS new_estado FROM q")
def m3_batch_plan(spark, sf_dir):
    """All pending filings as a batch for each service; every 97th order's submission fails."""
    return batch_plan(_filings(spark, sf_dir), F.col("row") % 97 == 0, by=["servicio"]).select("row", "servicio", "place", "period", "status", "new_estado")


@query(f"SELECT count(*) AS total, count(*) FILTER (estado = 'Pendiente') AS pendientes, count(*) FILTER (estado = 'En curso') AS en_curso, 0::BIGINT AS enviadas, 0::BIGINT AS validadas, count(*) FILTER (estado = 'Finalizada') AS finalizadas, round(100.0 * count(*) FILTER (estado = 'Finalizada') / count(*), 2) AS percent FROM ({_ORDERS})")
def a15_status_counts(spark, sf_dir):
    return status_counts(_filings(spark, sf_dir).withColumn("num", F.col("row")))


@query(f"""WITH s AS (SELECT 'C' || o_custkey AS servicio, date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS b FROM orders GROUP BY o_custkey),
m AS (SELECT servicio, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM s)
SELECT row_number() OVER (ORDER BY year(d), month(d), servicio) AS num, servicio, CAST(year(d) AS INTEGER) AS anio, CAST(month(d) AS INTEGER) AS mes, ({list(dims.MONTHS)})[month(d)] AS nombre FROM m""")
def x20_month_expand(spark, sf_dir):
    """The months from each customer's first order to the last."""
    month = lambda d: F.date_format(d, "yyyy-MM")
    specs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(month(F.min("o_orderdate")), F.lit(":"), month(F.max("o_orderdate"))).alias("spec"))
    return expand_periods(specs.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("servicio"), "spec"))


# Catalog of models


def models_of(payload: DataFrame, json: str) -> DataFrame:
    """One row (pos, model as variant) per model of each payload: an array, or an object's data, models or items."""
    v = F.try_parse_json(json)
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.data", "$.models", "$.items")]
    return payload.select(F.posexplode(F.coalesce(*lists)).alias("pos", "model"))


def normalize_models(models: DataFrame) -> DataFrame:
    """pos, type, value (id), label, description, loaded, tool_use, params of each model (variant) that has an id and is of a language-model type."""
    s = lambda *paths: T.first_text(*[F.try_variant_get("model", f"$.{p}", "string") for p in paths])
    yes = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get("model", f"$.{p}", "boolean"), F.lit(False)) for p in paths], F.lit(False))
    instances = F.size(F.try_variant_get("model", "$.loaded_instances", "array<variant>"))
    name = s("id", "key", "model", "modelKey", "identifier", "name")
    hint, stated = s("displayName", "display_name", "name"), s("paramsString", "params_string")
    context = T.first_number(*[F.try_variant_get("model", f"$.{p}", "double") for p in ("maxContextLength", "max_context_length")])
    loaded = yes("loaded") | F.coalesce(instances > 0, F.lit(False))
    at = models.select(
        "pos", s("type").alias("type"), name.alias("value"), F.coalesce(hint, T.pretty_id(name)).alias("label"), hint.alias("hint"), stated.alias("stated"), s("architecture").alias("architecture"), s("quantization.name", "quantizationName").alias("quantization"), context.alias("context"),
        loaded.alias("loaded"), (yes("loaded") | instances.isNotNull() & (instances >= 0)).alias("knows_loaded"), yes("trainedForToolUse", "capabilities.trained_for_tool_use").alias("tool_use"), yes("vision", "capabilities.vision").alias("vision"),
    )
    at = at.where(F.col("value").isNotNull() & S.is_model_type(F.col("type")))
    parts = F.concat_ws(" · ", "stated", "architecture", "quantization", F.concat(T.compact_number(F.col("context")), F.lit(" ctx")), F.when(F.col("knows_loaded"), F.when(F.col("loaded"), "loaded").otherwise("not loaded")), F.when(F.col("tool_use"), "tool use"), F.when(F.col("vision"), "vision"))
    params = F.coalesce(T.parse_params(F.col("stated")), T.infer_params(F.col("value")))
    described = F.when(parts == "", F.concat(F.lit("Local model ("), F.col("value"), F.lit(")"))).otherwise(parts)
    return at.select("pos", "type", "value", "label", "hint", described.alias("description"), "loaded", "tool_use", params.alias("params"))


def options(models: DataFrame) -> DataFrame:
    """Normalised models, the last of each id, by label then value in the order of the locale."""
    return D.last_wins(models, ["value"], "pos").orderBy(F.collate("label", "UNICODE"), F.collate("value", "UNICODE"))


def best_model(models: DataFrame, prefer_small: bool = False) -> DataFrame:
    """The model of greatest score, ties by id in the order of the locale."""
    score = S.model_score(F.col("value"), F.col("hint"), F.col("loaded"), F.col("tool_use"), F.col("params"), prefer_small)
    return D.top_one(models.withColumn("score", score), F.col("score"), F.collate("value", "UNICODE"))


def resolve_aliases(requests: DataFrame, known: DataFrame, explicit: dict[str, str], main: str | None, small: str | None, families: tuple[str, ...], small_families: tuple[str, ...] = (), tool_model: str | None = None) -> DataFrame:
    """requests (model, calls_functions) with resolved: the first of these that applies.

    A known id; a known id without regard to case; for an alias in a request that lets the model call functions, the tool model (else the small one); the explicit map by the
    name, then in lower case; a small family's small model; an alias' main model; the name itself. An alias is 'default', 'best' or a name with one of families in it.
    """
    flat = explicit | {k.lower(): v for k, v in explicit.items()}
    ids = known.select(F.col("value").alias("_id")).distinct()
    folded = known.groupBy(F.lower("value").alias("_low")).agg(F.min_by("value", "pos").alias("_folded"))
    at = requests.join(ids, requests["model"] == ids["_id"], "left").join(folded, F.lower(requests["model"]) == folded["_low"], "left")
    low = F.lower("model")
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(low, n)) if names else F.lit(False)
    alias = low.isin("default", "best") | has(families)
    table_ = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv]) if flat else F.create_map().cast("map<string,string>")
    chain = [F.col("_id"), F.col("_folded"), F.when(F.col("calls_functions") & alias, F.lit(tool_model or small)), F.try_element_at(table_, F.col("model")), F.try_element_at(table_, low), F.when(has(small_families), F.coalesce(F.lit(small), F.lit(main), F.col("model"))), F.when(alias, F.coalesce(F.lit(main), F.col("model"))), F.col("model")]
    return at.withColumn("resolved", F.coalesce(*chain)).drop("_id", "_folded", "_low")


@query("""SELECT p_partkey, p_name AS value, trim(regexp_replace(p_name, '[-_ ]+', ' ', 'g')) AS label, concat_ws(' · ', p_size || 'B', CASE WHEN p_size % 3 = 0 THEN p_type END,
 CASE WHEN c < 1000 THEN CAST(c AS VARCHAR) ELSE regexp_replace(printf('%.1f', c / 1000.0), '\\.0$', '') || 'K' END || ' ctx', CASE WHEN p_size % 2 = 0 THEN 'loaded' END, CASE WHEN p_size % 5 = 0 THEN 'tool use' END) AS description
FROM (SELECT *, p_size * 100 AS c FROM part)""")
def p9_catalog_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    described = F.struct(
        F.col("p_name").alias("id"), F.lit("llm").alias("type"), F.concat(F.col("p_size").cast("string"), F.lit("B")).alias("paramsString"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("architecture"),
        (F.col("p_size") * 100).alias("maxContextLength"), (F.col("p_size") % 2 == 0).alias("loaded"), (F.col("p_size") % 5 == 0).alias("trainedForToolUse"),
    )
    models = p.select(F.col("p_partkey").alias("pos"), F.parse_json(F.to_json(described)).alias("model"))
    return normalize_models(models).select(F.col("pos").alias("p_partkey"), "value", "label", "description")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def t8_last_wins(spark, sf_dir):
    return D.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def _scored_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_name").alias("value"), F.col("p_type").alias("hint"), (F.col("p_size") % 2 == 0).alias("loaded"), (F.col("p_size") % 5 == 0).alias("tool_use"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 1e9).alias("params"))


_TOP = "(CASE WHEN p_size % 2 = 0 THEN 1000 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 500 ELSE 0 END + CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), 'coder|instruct|chat') THEN 100 ELSE 0 END)"


@query(f"SELECT p_name AS value, round(CAST({_TOP} AS DOUBLE) + CASE WHEN p_size % 7 <> 0 THEN p_size ELSE 0 END, 6) AS score FROM part ORDER BY score DESC, p_name LIMIT 1")
def t6_best_main(spark, sf_dir):
    return best_model(_scored_parts(spark, sf_dir)).select("value", F.round("score", 6).alias("score"))


@query(f"SELECT p_name AS value, round(CAST({_TOP} AS DOUBLE) + CASE WHEN p_size % 7 = 0 THEN -1 ELSE (CASE WHEN p_size <= 8.5 THEN 400 ELSE 0 END) - p_size / 1000.0 END, 6) AS score FROM part ORDER BY score DESC, p_name LIMIT 1")
def t6_best_small(spark, sf_dir):
    return best_model(_scored_parts(spark, sf_dir), True).select("value", F.round("score", 6).alias("score"))


@query(r"SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN 1e9 ELSE 1e6 END AS stated, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 1e9 END AS inferred FROM part")
def x12_param_parse(spark, sf_dir):
    unit = F.when(F.col("p_partkey") % 2 == 0, " b").otherwise("M")
    name = F.concat(F.lit("model-"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "bit").otherwise("b-chat"))
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_params(F.concat(F.col("p_size").cast("string"), unit)).alias("stated"), T.infer_params(name).alias("inferred"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN CASE WHEN turn % 2 = 0 THEN 'tool-model' ELSE 'main-model' END ELSE 'mapped' END AS resolved FROM conversations")
def j12_alias_resolve(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "USER").when(F.col("role") == "assistant", "my-assistant-1").otherwise(F.col("role")).alias("model"), (F.col("turn") % 2 == 0).alias("calls_functions"))
    known = spark.createDataFrame([(0, "user")], "pos int, value string")
    out = resolve_aliases(c, known, {"System": "mapped"}, "main-model", "small-model", ("assistant",), ("tiny",), "tool-model")
    return out.select("conv_id", "turn", "resolved")


@query(r"SELECT conv_id, turn, CASE WHEN length(t) <= 80 THEN t ELSE left(t, 77) || '...' END AS preview, length(text) AS n_chars FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)")
def x8_prompt_preview(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.preview(F.col("text"), 80).alias("preview"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT CASE WHEN event_type = 'click' THEN 'event,id' ELSE 'event,id,user' END AS keys, CASE WHEN event_type = 'click' THEN '{\"event\":\"click\",\"id\":' || event_id || '}' ELSE '{\"event\":\"' || event_type || '\",\"id\":' || event_id || ',\"user\":' || user_id || '}' END AS line FROM events")
def k12_event_rows(spark, sf_dir):
    """Log lines as compact JSON without null fields, appended to a log and read again."""
    log = new_folder(spark, "logs")
    append_json(table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("event_id").alias("id"), F.when(F.col("event_type") != "click", F.col("user_id")).alias("user")), log)
    return spark.read.text(log).select(F.array_join(T.sorted_keys(F.col("value")), ",").alias("keys"), F.col("value").alias("line"))
