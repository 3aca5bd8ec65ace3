"""Line-delimited JSON-RPC requests routed in one pass: replies that need no tool, errors, and the calls that are left for one; with DuckDB forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

QUERIES, ORACLES = {}, {}
# Codes of errors.
INVALID_REQUEST, UNKNOWN_METHOD, INVALID_PARAMS = -32600, -32601, -32602


def _envelope(id_: Column, name: str, body: Column) -> Column:
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), id_, F.lit(f',"{name}":'), body, F.lit("}"))


def _error(id_: Column, code: int, message: Column) -> Column:
    return _envelope(id_, "error", F.to_json(F.struct(F.lit(code).alias("code"), message.alias("message"))))


def dispatch(lines: DataFrame, tools: list[dict], versions: tuple[str, ...], server: dict, instructions: str = "", enabled: Column | None = None) -> DataFrame:
    """lines (line, any others) with route, reply, tool and arguments.

    route is 'reject' for what is no JSON object, 'invalid' for objects without a method, 'initialize' (the asked version if it is one of `versions`, else the first), 'ping', 'list' (the tools, none unless
    enabled), 'call' (tool and arguments as JSON), 'disabled' (a call while not enabled), 'bad_call' (no tool's name, arguments that are no object, an unknown tool), 'unknown' and 'notification'.
    reply is the answer as JSON: null for notifications, for invalid and unknown requests without an id, and for calls, whose answer the tool gives. An id is passed on as it was written; a missing one is null.
    """
    enabled = F.lit(True) if enabled is None else enabled
    v = F.try_parse_json("line")
    part = lambda path: F.try_variant_get(v, path, "variant")
    of_kind = lambda path, kind: F.coalesce(F.startswith(F.schema_of_variant(part(path)), F.lit(kind)), F.lit(False))
    there = lambda path: part(path).isNotNull() & ~of_kind(path, "VOID")
    text = lambda path: F.when(of_kind(path, "STRING"), F.try_variant_get(v, path, "string"))
    has_id, id_ = there("$.id"), F.when(there("$.id"), F.to_json(part("$.id"))).otherwise("null")
    method = F.coalesce(text("$.method"), F.when(there("$.method"), F.to_json(part("$.method"))))
    empty = F.coalesce(method.isin("", "0", "false", "[]", "{}", "0.0"), F.lit(True))
    name, known = text("$.params.name"), [t["name"] for t in tools]
    given = F.when(there("$.params.arguments"), F.to_json(part("$.params.arguments")))
    falsy = F.coalesce(given.isin('""', "0", "false", "[]", "{}", "0.0"), F.lit(True))
    bad = F.when(name.isNull(), "Missing tool name.").when(~falsy & ~of_kind("$.params.arguments", "OBJECT"), "Tool arguments must be an object.").when(~name.isin(known), F.concat(F.lit("Unknown tool: "), name))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    route = (
        F.when(~is_object, "reject")
        .when(empty, "invalid")
        .when(method == "initialize", "initialize")
        .when(method == "notifications/initialized", "notification")
        .when(method == "ping", "ping")
        .when(method == "tools/list", "list")
        .when((method == "tools/call") & ~enabled, "disabled")
        .when((method == "tools/call") & bad.isNotNull(), "bad_call")
        .when(method == "tools/call", "call")
        .when(has_id, "unknown")
        .otherwise("notification")
    )
    version = F.when(text("$.params.protocolVersion").isin(*versions), text("$.params.protocolVersion")).otherwise(versions[0])
    hello = F.concat(F.lit('{"protocolVersion":"'), version, F.lit('","capabilities":{"tools":{"listChanged":false}},"serverInfo":' + json.dumps(server) + ',"instructions":' + json.dumps(instructions) + "}"))
    listed = F.when(enabled, F.lit(json.dumps({"tools": tools}, separators=(",", ":")))).otherwise('{"tools":[]}')
    closed = F.lit('{"content":[{"type":"text","text":"Local mode is disabled."}],"isError":true}')
    at = lines.withColumns({"route": route, "_id": id_, "_has": has_id, "_method": method, "_bad": bad, "_hello": hello, "_list": listed})
    c = F.col
    reply = (
        F.when((c("route") == "invalid") & c("_has"), _error(c("_id"), INVALID_REQUEST, F.lit("Invalid Request")))
        .when(c("route") == "initialize", _envelope(c("_id"), "result", c("_hello")))
        .when(c("route") == "ping", _envelope(c("_id"), "result", F.lit("{}")))
        .when(c("route") == "list", _envelope(c("_id"), "result", c("_list")))
        .when(c("route") == "disabled", _envelope(c("_id"), "result", closed))
        .when(c("route") == "bad_call", _error(c("_id"), INVALID_PARAMS, c("_bad")))
        .when(c("route") == "unknown", _error(c("_id"), UNKNOWN_METHOD, F.concat(F.lit("Method not found: "), c("_method"))))
    )
    called = c("route") == "call"
    return at.withColumns({"reply": reply, "tool": F.when(called, name), "arguments": F.when(called, F.when(falsy, "{}").otherwise(given))}).select(*lines.columns, "route", "reply", "tool", "arguments")


_LINE = """CASE event_id % 12 WHEN 0 THEN '{"jsonrpc":"2.0","id":' || event_id || ',"method":"ping"}' WHEN 1 THEN '{"id":"e' || event_id || '","method":"tools/list"}'
 WHEN 2 THEN '{"id":' || event_id || ',"method":"tools/call","params":{"name":"' || event_type || '","arguments":{"user":' || user_id || '}}}' WHEN 3 THEN '{"id":' || event_id || ',"method":"' || event_type || '"}' WHEN 4 THEN '{"method":"' || event_type || '"}'
 WHEN 5 THEN '{"id":' || event_id || ',"method":""}' WHEN 6 THEN '[' || event_id || ']' WHEN 7 THEN '{"id":' || event_id WHEN 8 THEN '{"id":' || event_id || ',"method":"initialize","params":{"protocolVersion":"v' || user_id % 3 || '"}}'
 WHEN 9 THEN '{"id":' || event_id || ',"method":"tools/call","params":{"name":"click","arguments":[1]}}' WHEN 10 THEN '{"id":' || event_id || ',"method":"tools/call","params":{}}' ELSE '{"method":"notifications/initialized","id":' || event_id || '}' END"""


def m5_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of events, every fourth user's in a mode without tools."""
    lines = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_LINE).alias("line"))
    tools = [{"name": "click", "inputSchema": {"type": "object"}}, {"name": "view", "inputSchema": {"type": "object"}}]
    return dispatch(lines, tools, ("v1", "v2"), {"name": "s", "version": "1"}, 'Say "hi"', F.col("user_id") % 4 != 0).select("event_id", "route", "reply", "tool", "arguments")


ORACLES["m5_dispatch"] = """WITH e AS (SELECT *, event_id % 12 AS k, user_id % 4 <> 0 AS on_, '{"jsonrpc":"2.0","id":' || CASE WHEN event_id % 12 = 1 THEN '"e' || event_id || '"' ELSE event_id || '' END AS head FROM events),
r AS (SELECT *, CASE WHEN k = 0 THEN 'ping' WHEN k = 1 THEN 'list' WHEN k IN (2, 9, 10) AND NOT on_ THEN 'disabled' WHEN k IN (9, 10) OR (k = 2 AND event_type NOT IN ('click', 'view')) THEN 'bad_call' WHEN k = 2 THEN 'call' WHEN k = 3 THEN 'unknown' WHEN k IN (4, 11) THEN 'notification' WHEN k = 5 THEN 'invalid' WHEN k IN (6, 7) THEN 'reject' ELSE 'initialize' END AS route FROM e)
SELECT event_id, route, head || CASE route WHEN 'ping' THEN ',"result":{}}' WHEN 'list' THEN ',"result":{"tools":[' || CASE WHEN on_ THEN '{"name":"click","inputSchema":{"type":"object"}},{"name":"view","inputSchema":{"type":"object"}}' ELSE '' END || ']}}'
  WHEN 'disabled' THEN ',"result":{"content":[{"type":"text","text":"Local mode is disabled."}],"isError":true}}' WHEN 'bad_call' THEN ',"error":{"code":-32602,"message":"' || CASE k WHEN 9 THEN 'Tool arguments must be an object.' WHEN 10 THEN 'Missing tool name.' ELSE 'Unknown tool: ' || event_type END || '"}}'
  WHEN 'unknown' THEN ',"error":{"code":-32601,"message":"Method not found: ' || event_type || '"}}' WHEN 'invalid' THEN ',"error":{"code":-32600,"message":"Invalid Request"}}'
  WHEN 'initialize' THEN ',"result":{"protocolVersion":"' || CASE WHEN user_id % 3 = 2 THEN 'v2' ELSE 'v1' END || '","capabilities":{"tools":{"listChanged":false}},"serverInfo":{"name": "s", "version": "1"},"instructions":"Say \\"hi\\""}}' END AS reply,
  CASE WHEN route = 'call' THEN event_type END AS tool, CASE WHEN route = 'call' THEN '{"user":' || user_id || '}' END AS arguments FROM r"""

QUERIES["m5_dispatch"] = m5_dispatch
