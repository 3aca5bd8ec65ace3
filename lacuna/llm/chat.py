"""Chat formatting: a finite-state machine over roles checks turn order; a declarative template emits text segments with loss flags."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_before
from .common import small_batches, small_slices, table


@dataclass(frozen=True)
class Template:
    """What stands around a turn's text, which roles are learned, and which turn may follow which.

    A turn is head + text + end. Known roles have a head of their own, others carry the role as JSON. Inside texts,
    control strings (open, end) get one more backslash after their first character than they had, so
    that neither occurs in an escaped text and every text comes back exactly.
    """

    open: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: frozenset[tuple[str, str]] = frozenset({("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")})
    final: frozenset[str] = frozenset({"assistant"})

    def _controls(self, slashes: str) -> re.Pattern:
        return re.compile("|".join(re.escape(x[0]) + slashes + re.escape(x[1:]) for x in (self.open, self.end.rstrip())))

    def escape(self, text: str) -> str:
        return self._controls(r"\\*").sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._controls(r"\\+").sub(lambda m: m[0][0] + m[0][2:], text)

    def head(self, role: str) -> str:
        return self.open + (self.names[role] if role in self.names else "@" + self.escape(json.dumps(role))) + self.colon

    def role(self, head: str) -> str:
        name = head[len(self.open) : -len(self.colon)]
        known = {v: k for k, v in self.names.items()}
        return known[name] if name in known else json.loads(self.unescape(name[1:]))


def read_turn(template: Template, text: str) -> tuple[str, str]:
    """(role, text) of one formatted turn; the text must be a whole turn."""
    if not (text.startswith(template.open) and text.endswith(template.end)):
        raise ValueError(f"not a turn: {text[:80]!r}")
    at = len(template.open)
    if text[at] == "@":
        at = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(text, at + 1).end()
    stop = text.index(template.colon, at) + len(template.colon)
    return template.role(text[:stop]), template.unescape(text[stop : -len(template.end)])


def _render(template: Template):
    """Rows (conv, turn_no, before, role, text) in any order -> rows (conv, turn_no, part, segment, loss, allowed, may_end): three segments a turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv", "turn_no", "part", "segment", "loss", "allowed", "may_end"], (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
        for batch in small_slices(batches):
            out: list[tuple] = []
            for no, before, role, text in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                allowed, learned = (template.start if before is None else before, role) in template.moves, role in template.learned
                parts = ((template.head(role), False), (template.escape(text), learned), (template.end, False))
                out += [(no, i, part, loss, allowed, role in template.final) for i, (part, loss) in enumerate(parts)]
            conv = batch.column(0).take(pa.array([i for i in range(len(batch)) for _ in range(3)], pa.int64()))
            yield pa.RecordBatch.from_arrays([conv, *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names)

    return run


def format_chat(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, template: Template | None = None) -> DataFrame:
    """(conv, turn_no, part, segment, loss, allowed, may_end): the formatted text of each conversation as segments, three a turn.

    Joined by turn_no and part, a conversation's segments are its training text; loss marks what is learned. Turns (whole numbers) are
    taken by turn, then role, then text (ties and repeated rows all stay; null turns come first); null roles and texts are empty; rows of a null conversation are one
    conversation. The machine's state is the role of the turn before: allowed says if it may go from there to this turn's role (a role it doesn't know or expect
    is emitted all the same), may_end if it may end after this turn. Numbers and roles before are running aggregates over buckets of turns, so that a conversation of any
    length is many tasks' work, and each turn is formatted on its own.
    """
    small_batches(df.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    kind = src.schema["conv"].dataType.simpleString()
    at = running_before(src, ["conv"], ["turn", "role", "text"], {"turn_no": (F.lit(1).cast("long"), "sum"), "before": (F.col("role"), "last")})
    return at.select("conv", "turn_no", "before", "role", "text").mapInArrow(_render(template or Template()), f"conv {kind}, turn_no long, part int, segment string, loss boolean, allowed boolean, may_end boolean")


def _read_back(template: Template):
    """Segments in order -> digests. Of the columns only conv, the segment's text and its loss flag say what stands where: turns are cut out of the running text by the template's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        convs, out = [], []
        now: dict | None = None

        def close() -> None:
            if now["text"]:
                raise ValueError(f"text after the last turn: {now['text'][:80]!r}")
            out.append((now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["ok"] and now["may_end"]))
            convs.append(now["conv"])

        def told(kind: pa.DataType) -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(convs, kind), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names)
            convs.clear()
            out.clear()
            return rows

        kind = None
        for batch in small_slices(batches):
            kind = batch.schema[0].type
            for conv, segment, loss, allowed, may_end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        close()
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ok": True, "text": ""}
                now["chars"] += len(segment)
                now["ok"], now["may_end"] = now["ok"] and allowed, may_end
                if loss:
                    plain = template.unescape(segment)
                    now["loss"].update(plain.encode())
                    now["loss_chars"] += len(plain)
                seen = max(0, len(now["text"]) - len(template.end))
                now["text"] += segment
                while (at := now["text"].find(template.end, seen)) >= 0:
                    at += len(template.end)
                    role, text = read_turn(template, now["text"][:at])
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    now["n"], now["text"], seen = now["n"] + 1, now["text"][at:], 0
            if out:
                yield told(kind)
        if now is not None:
            close()
            yield told(kind)

    return run


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, read from format_chat()'s segments joined in order: turns parsed out of the running text alone, loss text by its mask.

    valid is true if every turn was allowed and the conversation may end where it does. A digest is a sequential hash, so here (and only here) a conversation is one task's
    stream; a turn at a time is in memory.
    """
    kind = segments.schema["conv"].dataType.simpleString()
    ordered = segments.repartition("conv").sortWithinPartitions("conv", "turn_no", "part").select("conv", "segment", "loss", "allowed", "may_end")
    return ordered.mapInArrow(_read_back(template or Template()), f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


#: A conversation that the query adds: control strings inside the texts themselves.
TRICKY = r"\### Assistant: </turn> ok"


def with_tricky(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(extra)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid of all conversations and the tricky one; null texts and roles are empty, repeated rows are turns of their own."""
    segments = format_chat(with_tricky(table(spark, sf_dir, "conversations")), "conv_id", "turn", "role", "text")
    return read_back(segments).withColumnRenamed("conv", "conv_id")


_T = Template()
ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS n, lag(role) OVER w AS before,
  lead(conv_id) OVER w IS NULL AND row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + len(regexp_extract_all(text, '#\\*## |<\\*/turn>')) + {len(_T.open + _T.colon + _T.end)}
    + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE length(CAST(to_json(role) AS VARCHAR)) + 1 END) AS BIGINT) AS formatted_chars,
  bool_and((CASE WHEN n = 1 THEN 'start' ELSE before END, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AND (NOT is_last OR role = 'assistant')) AS valid
FROM t GROUP BY conv_id
"""
