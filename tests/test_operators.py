"""Ordered and interval operators against plain Python on random rows, with many small buckets."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import dedup as D
from lacuna.operators import intervals as I
from lacuna.operators import ordered as O


def rows(seed, n=300, keys=3, span=2000, longest=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(span)
        out.append((r.randrange(keys), i, a, a + r.randrange(longest)))
    return out


@pytest.fixture(params=[1, 2])
def data(request, spark):
    found = rows(request.param)
    return found, spark.createDataFrame(found, "k int, i int, a long, z long")


def by_key(found):
    out = {}
    for r in sorted(found, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_before(data):
    found, df = data
    got = {r.i: (r.m, r.s, r.l) for r in O.running_before(df, ["k"], ["a", "i"], {"m": (F.col("z"), "max"), "s": (F.lit(1), "sum"), "l": (F.when(F.col("i") % 3 == 0, F.col("a")), "last")}, rows=17).collect()}
    for group in by_key(found).values():
        for n, r in enumerate(group):
            before = group[:n]
            thirds = [x[2] for x in before if x[1] % 3 == 0]
            assert got[r[1]] == (max((x[3] for x in before), default=None), n, thirds[-1] if thirds else None)


def test_number_rows_is_dense(data):
    found, df = data
    got = {r.i: r.n for r in O.number_rows(df, ["k"], ["a", "i"], "n", base=10, rows=13).collect()}
    for group in by_key(found).values():
        assert [got[r[1]] for r in group] == list(range(11, 11 + len(group)))


def test_gap_regions_and_greedy(data):
    found, df = data
    regions = {r.i: r.region for r in I.gap_regions(df, ["k"], "a", "z", 5, ties=["i"], rows=11).collect()}
    chosen = {r.i for r in I.greedy_nonoverlap(df, ["k"], "a", "z", ["i"], rows=11).collect()}
    for group in by_key(found).values():
        reach, number, until, want = None, 0, -1, set()
        for r in group:
            number += reach is None or r[2] - reach > 5
            assert regions[r[1]] == number
            reach = r[3] if reach is None else max(reach, r[3])
            if r[2] >= until:
                want.add(r[1])
                until = max(until, r[3], r[2])
        assert chosen & {r[1] for r in group} == want


@pytest.mark.parametrize("outside", [False, True])
def test_span_joins(data, spark, outside):
    found, df = data
    spans = rows(9, 40)
    sdf = spark.createDataFrame(spans, "k int, j int, s long, e long")
    inside = {r.i for r in I.inside_spans(df, sdf, "a", "s", "e", ["k"], outside).collect()}
    assert inside == {r[1] for r in found if any(q[0] == r[0] and q[2] <= r[2] < q[3] for q in spans) != outside}
    blocks = df.withColumn("n", F.col("z") - F.col("a"))
    over = {r.i for r in I.overlapping_spans(blocks, sdf, "a", "n", "s", "e", ["k"], outside).collect()}
    assert over == {r[1] for r in found if any(q[0] == r[0] and q[3] > q[2] and r[2] < q[3] and r[3] > q[2] for q in spans) != outside}


def test_asof_and_bursts(data):
    found, df = data
    got = {r.i: r.v for r in I.asof_previous(df, ["k"], ["a", "i"], F.col("i") % 7 == 0, "a", "v", 100, rows=19).collect()}
    burst = {r.i: r.burst for r in I.burst_members(df, ["k"], ["a", "i"], "a", F.col("i") % 2, 90, 3, 30, 8).collect()}
    for group in by_key(found).values():
        for n, r in enumerate(group):
            last = next((x[2] for x in reversed(group[:n]) if x[1] % 7 == 0), None)
            assert got[r[1]] == (last if last is not None and r[2] - last <= 100 else None)
            chain = sorted(x[2] for x in group[max(0, n - 8) : n] if x[1] % 2 == r[1] % 2 and x[2] >= r[2] - 90) + [r[2]]
            assert burst[r[1]] == (len(chain) >= 3 and all(b - a <= 30 for a, b in zip(chain, chain[1:], strict=False)))


def test_dedup_and_lookups(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "x", 6), (3, None, 7), (4, None, 8), (5, "y", 9)], "seq int, h string, v int")
    assert [r.seq for r in D.first_of(df, F.col("h"), "seq").orderBy("seq").collect()] == [1, 3, 5]
    assert {(r.h, r.v) for r in D.last_wins(df, ["h"], "seq").collect()} == {("x", 6), (None, 8), ("y", 9)}
    assert [r.seq for r in D.not_seen(df, df.where("seq = 1"), F.col("h"), "h").orderBy("seq").collect()] == [3, 4, 5]
    assert D.top_one(df, F.col("v"), F.col("seq")).first().seq == 5
    assert D.limit_or_all(df, 0).count() == 5 and D.limit_or_all(df, 2).count() == 2


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k int, i int, a long, z long")
    assert I.greedy_nonoverlap(df, ["k"], "a", "z").count() == 0
    assert I.gap_regions(df, ["k"], "a", "z", 1).count() == 0
    assert I.inside_spans(df, df.select("k", F.col("a").alias("s"), F.col("z").alias("e")), "a", "s", "e", ["k"]).count() == 0
