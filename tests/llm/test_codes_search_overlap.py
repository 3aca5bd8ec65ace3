"""Vector codes, ranked search and the Jaccard join against brute force, and over odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import elkan, overlap, ranked

LOWER = str.maketrans(ranked.UPPER, ranked.LOWERED)


def plain_rounds(x, parts, entries, rounds):
    """(codes, errors, codebooks) of Lloyd's rounds over whole numbers, every distance computed."""
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    assign = lambda: np.array([[((x[i, p] - books[p]) ** 2).sum(1).argmin() for p in range(parts)] for i in range(len(x))])
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in set(at[:, p].tolist()):
                mine = x[at[:, p] == e, p]
                books[p, e] = mine.sum(0) // len(mine)
    at = assign()
    return at, sum(((x[:, p] - books[p][at[:, p]]) ** 2).sum(1) for p in range(parts)), books


@pytest.mark.parametrize("spread", [2, 40])
def test_codes_equal_plain_rounds(spark, spread):
    """A small spread makes many ties between entries, and equal entries."""
    r = np.random.default_rng(spread)
    whole = r.integers(-spread, spread + 1, (300, 8))
    df = spark.createDataFrame([(int(i), (v / 1024 + 0.0003).tolist()) for i, v in enumerate(whole)], "vec long, v array<double>").repartition(5)
    coded, books = elkan.compress(df, "vec", "v", parts=2, entries=16, rounds=4)
    at, error, expected = plain_rounds(whole, 2, 16, 4)
    assert (books == expected).all()
    assert {x.id: (x.codes, x.error) for x in coded.collect()} == {i: (a.tolist(), int(e)) for i, (a, e) in enumerate(zip(at, error, strict=True))}


def test_bounds_rule_out_most_distances():
    r = np.random.default_rng(1)
    centres = r.integers(-4000, 4000, (32, 8))
    x = centres[r.integers(0, 32, 2000)] + r.integers(-40, 40, (2000, 8))
    at, upper, lower = elkan.first_assignment(x, centres)
    moved = centres + r.integers(-3, 4, centres.shape)
    step = elkan.Step(moved, elkan.above(((moved - centres) ** 2).sum(1)))
    new, _, bounds, compared = step(x, at, upper, np.floor(lower))
    exact = elkan.square_distances(x, moved)
    assert (new == exact.argmin(1)).all() and (bounds <= np.sqrt(exact) + 1e-6).all() and compared < 0.1 * exact.size


def test_codes_of_odd_tables(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], None), (None, [0.5, -0.5], None), (2, None, "a"), (3, [1.0, None], "a"), (4, [float("nan"), 1.0], "a"), (5, [float("inf"), 1.0], "a"), (6, [1.0, 2.0, 3.0, 4.0], "b"), (7, [], "b"), (8, [-0.0001, 9.0], "b")]
    df = spark.createDataFrame(rows, "vec long, v array<double>, label string").withColumns({"id": F.lit(9), "x": F.lit("y"), "at": F.lit(1), "codes": F.lit(2)})
    coded, books = elkan.compress(df, "vec", "v", {"kind": F.col("label")}, parts=2, entries=3)
    got = sorted(coded.collect(), key=str)
    assert len(got) == 4 and {x.id for x in got} == {1, None, 8} and books.shape == (2, 3, 1) and coded.columns == ["id", "kind", "codes", "error"]
    coded, books = elkan.compress(df.limit(0), "vec", "v", parts=2)
    assert coded.count() == 0 and books.shape[1] == 0 and elkan.books_digest(books) == elkan.books_digest(np.zeros(0, np.int64))
    assert elkan.compress(df.where("vec = 7"), "vec", "v")[0].collect()[0].error == 0
    for bad in (df.where("vec = 6").withColumn("v", F.slice("v", 1, 3)), df.where("vec = 1").withColumn("v", F.array(F.lit(1e30), F.lit(1.0)))):
        with pytest.raises(ValueError):
            elkan.compress(bad, "vec", "v", parts=2)


def brute_search(docs, items, k):
    """docs: (id, text) rows; items: (id, text) rows."""
    words = lambda t: re.findall(ranked.TERM, (t or "").translate(LOWER))
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sent_pairs", [ranked.SENT_PAIRS, 0])
def test_search_equals_brute_force(spark, sent_pairs, monkeypatch):
    monkeypatch.setattr(ranked, "TERM_ROWS", 20)  # frequent terms are dealt
    r = random.Random(3)
    vocabulary = ["Über", "the", "of", "x1", "日本", "end", "a", "b", "c", "dé"]
    docs = [(i, " ".join(r.choices(vocabulary, weights=range(1, 11), k=r.randint(0, 30))) + r.choice(["", "!", ".The-END"])) for i in range(200)]
    docs += [(None, "the end"), (300, None), (301, ""), (302, " ,;"), (7, "the end"), (7, "the end"), (303, "THE " * 30_000)]
    items = [(1, "the end of"), (2, "日本 über"), (2, "x1"), (3, "unknown"), (4, None), (5, ""), (None, "A b C"), (1, "the end of")]
    df = spark.createDataFrame(docs, "doc long, text string").withColumns({"id": F.lit(1), "row": F.lit(2), "n": F.lit("x"), "term": F.lit(3)}).repartition(7)
    asked = spark.createDataFrame(items, "item long, t string").withColumn("item_id", F.lit(0))
    got = ranked.search(df, "doc", "text", asked, "item", "t", 5, sent_pairs)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 5)
    for a, b in ((df.limit(0), asked), (df, asked.limit(0)), (df.where("doc = 300"), asked)):
        assert ranked.search(a, "doc", "text", b, "item", "t", 5, sent_pairs).count() == 0


def test_radix_order_is_the_stable_order():
    keys = np.random.default_rng(2).integers(0, 1 << 40, 5000)
    keys[::3] = keys[0]
    assert (ranked.radix_order(keys, 40) == np.argsort(keys, kind="stable")).all()


def brute_components(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def shingles(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.mark.parametrize(("percent", "block"), [(90, overlap.BLOCK_NGRAMS), (90, 300), (80, 2000)])
def test_overlap_equals_brute_force(spark, percent, block):
    """Families of texts that differ about as much as the bound allows, so that links and near misses are many; shared passages; all sizes from a word on."""
    r = random.Random(percent + block)
    word = lambda: r.choice("abcdefghij") + str(r.randint(0, 99))
    passage, texts = [word() for _ in range(40)], []
    for n in [1, 2, 3, 5, 8, 11, 12, 15, 20, 25, 30, 45, 60, 100, 150, 400]:
        base = [word() for _ in range(n)]
        for k in range(9):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, n // 60, n // 40])):
                at = r.randrange(len(copy))
                copy[at : at + r.randint(0, 1)] = [word()] * r.randint(0, 2) or []
            texts.append(" ".join(copy if k < 7 else [*copy, *passage]))
    texts += ["", None, " \n", "one", "ONE", "one two", "one two", " ".join(["x"] * 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumns({"id": F.lit(1), "row": F.lit(2), "n": F.lit(3), "uid": F.lit(4), "block": F.lit(5)}).repartition(5)
    sets = [shingles(t) for t in texts]
    got = {x.id: (x.n, x.component) for x in overlap.jaccard_components(df, "doc", "text", percent=percent, block_ngrams=block).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, brute_components(sets, percent), strict=True))}
    assert len({c for _, c in got.values()}) < len(texts) - 40


def test_overlap_of_odd_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "A B C D"), (None, None), (None, "only null ids here"), (2, "word " * 40_000), (3, "word word word"), (4, None)]
    df = spark.createDataFrame(rows, "doc long, text string")
    got = sorted(map(tuple, overlap.jaccard_components(df, "doc", "text").collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (None, 2, None), (2, 1, 2), (3, 1, 2), (4, 0, 4)], key=str)
    assert overlap.jaccard_components(df.limit(0), "doc", "text").count() == 0


def test_pairs_that_link_agree_in_a_cell():
    """Sets that differ in as many hashes as the bound allows share a signature, under the scheme of the smaller one's band."""
    r = np.random.default_rng(5)
    starts = overlap.band_starts(90)
    most = np.append(overlap.most_differing(starts[1:] - 1, 90), 0)
    for a in [9, 10, 19, 40, 97, 300, 1000, 5000]:
        for b in range(a, 10 * a // 9 + 1, max(1, a // 40)):
            shared = -(-90 * (a + b) // 190)
            if shared > a:
                continue
            pool = r.integers(0, 1 << 63, a + b, dtype=np.uint64) * np.uint64(2)
            one, two = np.unique(pool[:a]), np.unique(np.concatenate((pool[:shared], pool[a : a + b - shared])))
            band = np.searchsorted(starts, [a, b], "right") - 1
            assert band[1] - band[0] in (0, 1)
            found = [set(overlap.cell_signatures(s, np.array([0, len(s)]), band[:1], most[band[:1]])[0].tolist()) for s in (one, two)]
            assert found[0] & found[1], (a, b)
