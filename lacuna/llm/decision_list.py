"""Quality rules: text statistics and a learned decision list. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hash_rows, materialise, table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Labelled rows that the list is learned from at most (those of least hash), cut points tried per statistic, conditions per rule, rules.
SAMPLE_ROWS, CUTS, MAX_CONDITIONS, MAX_RULES = 20_000, 32, 4, 12
#: Share of a rule's pruning rows that must be bad for it to be kept, and how many it must cover.
LEAST_PRECISION, LEAST_COVER = 0.9, 3


class Condition(NamedTuple):
    stat: str
    op: str  # "<=" or ">"
    cut: float


def word_array(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks) of whole texts.

    n_repeat_words counts words inside any 5-word window that the text holds twice or more: windows are hashed
    (64 bits, from the words' hashes), and only texts with an equal pair sort them, so a text of n words costs n log n. Null, empty and
    blank texts have zeros everywhere but n_symbols, n_upper and n_marks, which are 0 too as no such character is in them.
    """
    at = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    at = at.withColumn("words", word_array(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: F.length("text") - F.length(F.regexp_replace("text", chars, ""))
    at = at.select(
        "id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        without(r"[#*$%&|<>]+").alias("n_symbols"),
        without(r"[A-Z]+").alias("n_upper"),
        without(r"[!?;:~^=+_@\\/]+").alias("n_marks"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    heads = F.slice("h", F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)))
    keys = F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, WINDOW)]))
    at = at.select("id", "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), keys.alias("keys"))
    at = at.withColumn("placed", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    twice = F.filter("placed", lambda x, j: (x["k"] == F.get("placed", j - 1)["k"]) | (x["k"] == F.get("placed", j + 1)["k"]))
    at = at.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end"))
    covered = F.aggregate("starts", first, step, lambda acc: acc["n"])
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    return at.select("id", *longs, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), *[F.col(c).cast("long").alias(c) for c in ("n_upper", "n_marks")])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The statistics that rules may test: counts and shares, never null."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "marks": share("n_marks", "word_chars"),
    }


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's information gain of going from (p0, n0) bad and good rows covered to (p1, n1)."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _covers(rule: Sequence[Condition], row: dict) -> bool:
    return all(row[c.stat] <= c.cut if c.op == "<=" else row[c.stat] > c.cut for c in rule)


def _counts(rule: Sequence[Condition], rows: list[tuple[dict, bool]]) -> tuple[int, int]:
    hit = [bad for row, bad in rows if _covers(rule, row)]
    return sum(hit), len(hit) - sum(hit)


def _best_condition(rows: list[tuple[dict, bool]], stats: Sequence[str], cuts: int) -> tuple[float, Condition | None]:
    p0 = sum(bad for _, bad in rows)
    n0, best = len(rows) - p0, (1e-9, None)
    for stat in stats:
        ordered = sorted((row[stat], bad) for row, bad in rows)
        p = n = 0
        step, since = max(1, len(ordered) // cuts), 0
        for (value, bad), (after, _) in zip(ordered, ordered[1:], strict=False):
            p, n, since = p + bad, n + (not bad), since + 1
            if value == after or (since < step and p and n and p < p0):
                continue
            since, cut = 0, (value + after) / 2
            for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = _gain(p0, n0, a, b)
                if gain > best[0]:
                    best = (gain, Condition(stat, op, cut))
    return best


def learn(rows: list[tuple[dict, bool]], stats: Sequence[str], cuts: int = CUTS) -> list[tuple[Condition, ...]]:
    """Rules for bad rows by sequential covering.

    Two thirds of the rows grow each rule, one condition of greatest gain after the other, until no good row is covered; the last third
    prunes it, dropping final conditions while (bad - good) / (bad + good) doesn't fall, and decides if it
    stays. Covered rows then leave both sets. Rows of one kind alone give no rule.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    out: list[tuple[Condition, ...]] = []
    while len(out) < MAX_RULES and any(bad for _, bad in grow):
        rule, at = [], grow
        while len(rule) < MAX_CONDITIONS and any(not bad for _, bad in at):
            _, condition = _best_condition(at, stats, cuts)
            if condition is None:
                break
            rule.append(condition)
            at = [r for r in at if _covers([condition], r[0])]
        worth = lambda k, rule=rule: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_counts(rule[:k], prune))
        keep = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k), default=0)
        rule = rule[:keep]
        p, n = _counts(rule, prune) if rule else (0, 0)
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        out.append(tuple(rule))
        grow, prune = ([r for r in part if not _covers(rule, r[0])] for part in (grow, prune))
    return out


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """True if no rule covers the row: the ordered list as one conditional expression over the statistics."""
    stats, out = ratios(), None
    for rule in rules:
        fits = F.lit(True)
        for c in rule:
            fits = fits & (stats[c.stat] <= c.cut if c.op == "<=" else stats[c.stat] > c.cut)
        out = F.when(fits, False) if out is None else out.when(fits, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_sample(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[dict, bool]]:
    """At most `rows` labelled statistics that pass the base rules, those of least hash of the id; labels has columns id and good (null: none)."""
    at = stats.where(~base_failed()).join(labels.select("id", "good").where("good IS NOT NULL"), "id")
    at = at.select("id", *[c.alias(k) for k, c in ratios().items()], (F.col("good") == 0).alias("bad"))
    names = list(ratios())
    return [({k: r[k] for k in names}, r["bad"]) for r in least_hash_rows(at, "id", rows, 1, *names, "bad")]


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[tuple[Condition, ...]]]:
    """(statistics with base_failed and kept, the learned rules).

    One row per row of df. The statistics are written once, so texts are read once. A label counts for every row of its
    id, conflicting ones as many times as they stand; without labels, or with labels of one kind, only the base rules hold.
    """
    stats = materialise(statistics(df, id_col, text_col))
    rules = learn(labelled_sample(stats, labels), list(ratios()))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules)), rules


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five statistics, base_failed and kept of every row of documents; null texts have no words and fail the base rules, repeated rows stay, null labels teach nothing."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    found, _ = quality_rules(table(spark, sf_dir, "documents"), labels, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
