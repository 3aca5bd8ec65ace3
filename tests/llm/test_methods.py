"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import pickle
import random
import re

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import chat, components, decision_list, html_tree, pieces, pu_quality, reputation, simhash, toxicity, warc, winnowing

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash_equals_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, sf).collect()}
    fps = {i: brute_fingerprint(t) for i, t in documents.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_dense_buckets_lose_no_link(spark, bucket_rows):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = {}
    for i in range(240):
        x = base[i % 3]
        for _ in range(r.randrange(5)):
            x ^= 1 << r.randrange(64)
        fps[i] = x
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "id long, fp long")
    got = {x.id: x.component for x in simhash.near_duplicate_components(df, 4, bucket_rows).collect()}
    assert got == brute_components(fps)


def test_buckets_of_unlike_fingerprints_are_blocked_again(spark):
    """Many fingerprints agree in 30 bits, so that first buckets are large, and few of them are close."""
    r = random.Random(6)
    fps = [(0x2F1E3D4C << 34) | r.getrandbits(34) for _ in range(700)]
    fps += [x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for x in fps[:150]]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "id long, fp long")
    got = {x.id: x.component for x in simhash.near_duplicate_components(df, 4, 40).collect()}
    assert got == brute_components(dict(enumerate(fps)))


def test_masks_cover_every_close_pair():
    r = random.Random(1)
    for mask in simhash.block_masks(10**8, 4)[:10]:
        inner = simhash.inner_masks(mask, 4, 6)
        for _ in range(50):
            d = sum(1 << b for b in r.sample([b for b in range(64) if not mask >> b & 1], 4))
            assert any(d & m == 0 and m & mask == 0 for m in inner)
    for n in (2, 10**6, 10**10):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            d = sum(1 << b for b in r.sample(range(64), 4))
            assert any(d & m == 0 for m in masks)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_contamination(text, items, span=13):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for name, passage in items:
        w = ALNUM.findall(lower(passage))
        n = min(span, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("index_bytes", [winnowing.INDEX_BYTES, 0])
def test_winnowing_equals_brute_force(spark, index_bytes):
    r = random.Random(7)
    word = lambda: r.choice(["a", "b", "c", "dé", "X1"])
    items = [(f"i{k}", " ".join(word() for _ in range(n))) for k, n in enumerate([1, 5, 12, 13, 14, 20, 40])]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(30)))]
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            parts += [", ".join(w[a : a + r.randrange(1, 25)]), "zz" * r.randrange(2)]
        docs.append((i, " ".join(parts)))
    got = winnowing.contamination(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i string, t string"), "d", "t", "i", "t", index_bytes=index_bytes)
    assert {x.id: (x.n_words, x.n_hit, x["items"]) for x in got.collect()} == {i: brute_contamination(t, items) for i, t in docs}


def test_repeats_on_both_sides_cost_no_product(spark):
    index = winnowing.Index([("a", "a " * 2000), ("b", "b a " * 700), ("c", "a " * 2000)])
    raw = np.frombuffer(("a " * 20_000 + "x " + "a b " * 3000).encode(), np.uint8)
    _, found = index.hits(raw, np.array([0, len(raw)]))
    assert list(found) == [(0, [(0, 20_000), (20_001, 26_001)], {0, 1, 2})]
    assert sum(map(len, index.places.values())) < 200


def test_statistics_equal_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in decision_list.op5_rules(spark, sf).collect()}
    for i, text in documents.items():
        x = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", x)
        lines = [line for line in x.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
        windows = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        mark = {p for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(mark))
        assert r.base_failed == (len(w) < 10 or 100 * len(mark) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_kept_follows_the_learned_rules(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("good")).withColumn("n_words", F.lit(1))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, rules = decision_list.quality_rules(docs, labels, "doc_id", "text")
    for r in found.collect():
        row = {"n_words": r.n_words, "word_length": r.word_chars / max(r.n_words, 1), "symbols": r.n_symbols / max(r.word_chars, 1), "dup_lines": r.n_dup_lines, "repeats": r.n_repeat_words / max(r.n_words, 1), "upper": r.n_upper / max(r.word_chars, 1), "marks": r.n_marks / max(r.word_chars, 1)}
        assert r.kept == (not r.base_failed and not any(decision_list._covers(rule, row) for rule in rules))


def test_learned_rules_separate():
    r = random.Random(2)
    rows = [({"a": r.random(), "b": r.random()}, False) for _ in range(300)]
    rows = [(x, x["a"] > 0.7 and x["b"] <= 0.4) for x, _ in rows]
    rules = decision_list.learn(rows, ["a", "b"])
    wrong = sum(any(decision_list._covers(rule, x) for rule in rules) != bad for x, bad in rows)
    assert rules and wrong <= 6
    assert decision_list.learn([(x, False) for x, _ in rows], ["a", "b"]) == []


def area(scores, labels):
    pairs = [(s > t) + 0.5 * (s == t) for s, a in zip(scores, labels, strict=True) if a for t, b in zip(scores, labels, strict=True) if not b]
    return sum(pairs) / len(pairs)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for query, name, least in ((pu_quality.op7_quality, "quality", 0.98), (toxicity.op6_toxicity, "toxic", 0.85)):
        rows = [r for r in query(spark, d).collect() if r.held_out and r.doc_id in labels]
        assert area([r.score for r in rows], [labels[r.doc_id][name] for r in rows]) >= least


def brute_kneser_ney(words, order, shared, discount):
    """p(class, context, character) by the definitions. words: (word, number of texts of class 0, of class 1)."""
    seen = collections.defaultdict(collections.Counter)  # class or "both" -> grams of the top order with their occurrences
    for w, *c in words:
        text = toxicity.START * (order - 1) + w + toxicity.END
        for end in range(order, len(text) + 1):
            for k in (0, 1):
                if c[k]:
                    seen[k][text[end - order : end]] += c[k]
                    seen["both"][text[end - order : end]] += c[k]
    kept = {}

    def counts(k, n):
        if (k, n) not in kept:
            out = collections.Counter()
            if n == order:
                out = seen[k]
            else:
                for gram in {g[order - n - 1 :] for g in seen[k]}:  # distinct grams of one more
                    if not gram[1:].startswith(toxicity.START):
                        out[gram[1:]] += 1
                for gram, c in seen[k].items():
                    if gram[order - n :].startswith(toxicity.START):
                        out[gram[order - n :]] += c
            kept[k, n] = out
        return kept[k, n]

    alphabet = {g[-1] for g in seen["both"]}

    def p(k, ctx, char):
        n = len(ctx) + 1
        lower = 1 / (len(alphabet) + 1) if n == 1 else p(k, ctx[1:], char)
        table = counts("both" if n <= shared else k, n)
        after = {g: c for g, c in table.items() if g[:-1] == ctx}
        total = sum(after.values())
        return max(after.get(ctx + char, 0) - discount, 0) / total + discount * len(after) / total * lower if total else lower

    return p, alphabet


@pytest.mark.parametrize("shared", [1, 2])
def test_kneser_ney_equals_brute_force(spark, shared):
    texts = [("abc abd cab", 0), ("abd xyz abc abc", 1), ("ab ba", 1), ("cabd", 0), ("xyx ax", 0)]
    df = toxicity.word_counts(spark.createDataFrame(texts, "text string, label int"))
    order, discount = 4, 0.75
    p, alphabet = brute_kneser_ney([tuple(r) for r in df.collect()], order, shared, discount)
    tables = {n: {r.gram: r for r in t.collect()} for n, t in toxicity.levels(toxicity.gram_counts(df, order), shared, discount).items()}
    for n, rows in tables.items():
        for gram, r in rows.items():
            assert abs(r.p0 - p(0, gram[:-1], gram[-1])) < 1e-12 and abs(r.p1 - p(1, gram[:-1], gram[-1])) < 1e-12, (n, gram)
    for ctx in {g[:-1] for g in tables[order]}:
        for k in (0, 1):
            assert abs(sum(p(k, ctx, c) for c in alphabet | {"?"}) - 1) < 1e-9
    model = toxicity.models_of(df, order, shared, discount)
    for word in ("abd", "cab", "zzz", "xa"):
        text = toxicity.START * (order - 1) + word + toxicity.END
        want = sum(np.log(p(1, text[i - order + 1 : i], text[i])) - np.log(p(0, text[i - order + 1 : i], text[i])) for i in range(order - 1, len(text)))
        assert abs(model.word(word) - want) < 1e-5


def test_words_of_long_texts_are_cut_at_borders(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 7)
    for text in ("", "one", "Ünder stood, once more_and again  x" * 9, "a" * 50):
        assert [w for part in toxicity.words_of(text) for w in part] == toxicity.WORD.findall(text.lower())


def test_models_beyond_the_sent_size_keep_all_grams(spark):
    texts = [(i, t, int("zorn" in t)) for i, t in enumerate(["plain words here", "more plain words", "zornig zorn words", "a zorn " + "q" * 50 + " zorn", "", None, "rare наука words"] * 6) if t is not None] + [(99, None, 0)]
    df = spark.createDataFrame(texts, "id long, text string, label int")
    model = toxicity.train_models(df.where("text is not null").select("text", "label"))
    tables = toxicity.train_models(df.where("text is not null").select("text", "label"), model_rows=5)
    x = lambda m: {r.id: r.x for r in m.apply(df.select("id", "text"), lambda x: toxicity.pa.array(list(x)), "x", "array<double>").collect()}
    mine, theirs = x(model), x(tables)
    assert isinstance(tables, toxicity.TableModel) and mine.keys() == theirs.keys() and len(mine) == len(texts)
    assert all(np.allclose(mine[i], theirs[i], atol=1e-9) for i in mine)
    labels = df.select("id", F.col("label").alias("toxic"))
    kept = toxicity.drop_toxic(df, labels, "id", "text", model_rows=5)
    ids = [r.id for r in kept.collect()]
    assert kept.columns == df.columns and 0 < len(ids) == len(set(ids)) and set(ids) <= set(mine)


def test_neither_driver_nor_tasks_code_holds_the_models(spark):
    words = [f"w{hashlib.md5(str(i).encode()).hexdigest()}" for i in range(3000)]
    texts = spark.createDataFrame([(w, i % 2) for i, w in enumerate(words)], "text string, label int")
    model = toxicity.train_models(texts)
    assert len(pickle.dumps(model)) < 10_000
    assert model.word(words[1]) > 0 > model.word(words[0])  # all entries are there once they are asked for
    assert len(model.ratios) > 10_000 and len(pickle.dumps(model)) < 10_000


def test_final_models_count_all_labelled_texts(spark):
    df = spark.createDataFrame([(i, f"word{chr(0x4E00 + i)}", i % 2) for i in range(24)], "id long, text string, toxic int")
    model = toxicity.train_detector(df, df.select("id", "toxic"), "id", "text", folds=1).model
    assert all(any(chr(0x4E00 + i) in gram for gram in model.ratios) for i in range(24))


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (1500, 3)), rng.normal(-1.5, 1, (500, 3))
    unlabelled = rng.permutation(np.concatenate([good[:1200], bad[:400]]))
    prior = pu_quality.estimate_prior(good[600:], unlabelled)
    assert 0.6 <= prior <= 0.85
    net = pu_quality.fit_pu(good[1200:], unlabelled, prior)
    assert area(net(np.concatenate([good[:200], bad[400:]])), [1] * 200 + [0] * 100) > 0.97


def odd_texts(seed, n):
    r = random.Random(seed)
    return ["", "a", "  b", " ", "▁x", "日本語 😀", "ab" * 60, " " * 40, "the quick, brown fox; jumps.\n" * 5] + ["".join(r.choice("ab \nés😀.") for _ in range(r.randrange(1, 150))) for _ in range(n)]


def test_segments_equal_the_library():
    raw = open(pieces.MODEL, "rb").read()
    sp, model = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.load(raw=raw)
    encoder = pieces.Encoder(model)
    for text in odd_texts(1, 200):
        ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
        assert ids == sp.encode(text) and (model.decode(ids) == text or SPACE in text)


@pytest.mark.parametrize(("chunk", "walk_all"), [(7, True), (7, False), (40, True), (40, False)])
def test_encode_of_many_chunks_equals_the_library(spark, chunk, walk_all):
    """Up to twenty chunks a text, so several rounds of pairs; all steps walked, or only those outside borders."""
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = dict(enumerate(odd_texts(chunk, 30)))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: r.ids for r in pieces.encode(df, "id", "text", chunk=chunk, walk_all=walk_all).collect()}
    assert got == {i: sp.encode(t) for i, t in texts.items()}


def test_products_are_associative():
    model = pieces.load()
    s = model.surface("".join(random.Random(2).choice("theran .,") for _ in range(90)))
    cuts = [0, 13, 31, 32, 55, 71, len(s)]
    parts = [pieces.border_matrix(model, s, a, b, k, b == len(s), True) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    left = parts[0]
    for m in parts[1:]:
        left = pieces.product(left, m)
    p = pieces.product
    pairs = p(p(p(parts[0], parts[1]), p(parts[2], parts[3])), p(parts[4], parts[5]))
    order = lambda m: sorted((x, y, z) for x, y, z in m["out"])
    assert left["in"] == pairs["in"] and order(left) == order(pairs)


def test_piece_query_equals_the_library(spark, sf, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.op2_pieces(spark, sf).collect()
    assert len(got) == len(documents)
    for r in got:
        text = documents[r.doc_id] or ""
        assert r.token_ids == sp.encode(text) and r.n_tokens == len(r.token_ids)
        assert (r.decoded_chars, r.decoded_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())


SPACE = pieces.SPACE


def test_unigram_scan_is_the_best_path():
    model = pieces.load(raw=open(pieces.MODEL, "rb").read() + b"\x12\x02\x18\x01")  # the same vocabulary, read as a unigram model
    assert isinstance(model, pieces.Unigram)
    r = random.Random(3)
    for _ in range(20):
        s = model.surface("".join(r.choice("theran ") for _ in range(60)))
        best = [0.0] + [float("-inf")] * len(s)
        for p in range(len(s)):
            for q, _, _, w in model.steps(s, p, ""):
                best[q] = max(best[q], best[p] + w)
        whole = pieces.transfer(model, s, [(0, "")], len(s))
        assert whole[len(s), ""][0] == best[-1]
        left = pieces.transfer(model, s, [(0, "")], 25)
        rows = model.entries(s, 25)
        joined = pieces.combine(left, rows, pieces.transfer(model, s, rows, len(s)))
        assert joined[len(s), ""][0] == best[-1]
        assert sum(model.scores[p] for p in model.solve(s)) == best[-1]


def test_chat_round_trip_and_machine():
    t = chat.Template()
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["### ", "</turn>", "\\", "#", "<", "/turn>", "a", " ", "\n", "## "]) for _ in range(r.randrange(12)))
        safe = t.escape(text)
        assert t.unescape(safe) == text and "</turn>" not in safe and "### " not in safe
        role = r.choice(["user", "assistant", text])
        assert chat.read_turn(t, t.head(role) + safe + t.end) == (role, text)


def test_chat_flags(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "x"), (2, 1, "user", "y"), (3, 0, "user", "q"), (3, 1, "assistant", "r"), (3, 2, "user", "q")], "c long, t int, r string, x string")
    seg = chat.format_chat(df, "c", "t", "r", "x")
    assert [r.segment for r in seg.where("conv = 1 AND loss").collect()] == ["a"]
    assert {(r.conv, r.turn_no): r.allowed for r in seg.where("part = 0").collect()} == {(1, 0): True, (1, 1): True, (1, 2): True, (2, 0): False, (2, 1): True, (3, 0): True, (3, 1): True, (3, 2): True}
    assert {r.conv: r.valid for r in chat.read_back(seg).collect()} == {1: True, 2: False, 3: False}


def test_chat_reads_turns_from_the_text_alone(spark):
    """However the running text is cut into segments, the same turns come back; a conversation of one very long turn too."""
    r = random.Random(6)
    controls = ["### ", "</turn>", "</turn>\n", "\\", "#", "<", "/turn>\n", "a", " ", "\n", ": ", "### User: "]
    turns = [(c, t, r.choice(["user", "assistant", "odd"]), "".join(r.choice(controls) for _ in range(r.randrange(15)))) for c in range(12) for t in range(r.randrange(1, 6))] + [(99, 0, "user", "</turn>\n### " * 100_000)]
    df = spark.createDataFrame(turns, "c long, t long, r string, x string")
    seg = chat.format_chat(df, "c", "t", "r", "x")
    whole = seg.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "part", "segment"))), lambda x: x["segment"]), "").alias("segment"))
    again = whole.select("conv", F.lit(0).cast("long").alias("turn_no"), F.lit(0).alias("part"), "segment", F.lit(False).alias("loss"), F.lit(True).alias("allowed"), F.lit(True).alias("may_end"))
    want = collections.defaultdict(lambda: hashlib.sha256())
    for c, _, role, x in turns:
        want[c].update(f"{role}\n{x}\n".encode())
    for form in (seg, again):
        assert {x.conv: x.turns_sha256 for x in chat.read_back(form).collect()} == {c: h.hexdigest() for c, h in want.items()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><header><h1>Head&amp;line</h1></header><p>First <b>bold</b>&nbsp;text<br>next<p>Second &lt;p&gt; &#233;<aside>Side</aside>
<form><input><button>Go</button></form><!-- hidden <p> --><section id="comments"><p>Nice!</p></section></article><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_tree.main_text(PAGE) == "Head&line First bold text next Second <p> é"
    assert html_tree.main_text("<div>a<div class='sidebar'>b</div>c") == "a c"
    assert html_tree.main_text("<nav><article><p>kept</article>") == "kept"
    assert html_tree.main_text("a < b <!-- open") == "a < b" and html_tree.main_text(None) == ""
    assert html_tree.main_text("<p>a<p>b</p>c<ul><li>d<li>e</ul><table><tr><td>f<td>g<tr><td>h</table>") == "a b c d e f g h"
    assert html_tree.main_text("in<script>x</script>side <b>b</b>old <a href='x>y'>z</a> <i title=\"q>end</i>") == "inside bold z end"


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<p>" * 3000 + "deep", "<b>" * 50_000 + "<p>x</p>" * 50_000, "<a " * 400_000, "<p" * 300_000, "<" * 200_000, "</x>" * 100_000, "<a title=\"" * 100_000, "<!--" * 100_000, "<script>" * 50_000, "<div class=" * 100_000 + ">x"])
def test_long_and_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    text = html_tree.main_text(page, {1: (1, 0.0, 0.0)})
    assert time.process_time() - began < 12 and (not page.endswith("deep") or text == "deep")


def test_names_drop_no_main_text():
    story = "<p>A long story about something that matters to readers.</p>" * 3
    text = " ".join(["A long story about something that matters to readers."] * 3)
    for page in (f"<body class='home no-sidebar'>{story}</body>", f"<div class='content has-sidebar'>{story}<div class='sidebar'>Side</div></div>", f"<h1></h1><div id='search-results'><div class='no-ads'>{story}</div></div>"):
        assert html_tree.main_text(page) == text
    assert html_tree.main_text(f"<article>Teaser</article><div class='has-sidebar'><article>{story}</article></div>") == f"Teaser {text}"
    assert html_tree.main_text(f"<div>{story}</div><div class='comments'>Nice</div>") == text


def site_pages(n):
    page = lambda i: f"<body><div class='x7'><p>Follow us everywhere</p></div><div class='body'><p>Story {i} of many {i * i}</p><p>More {i}</p></div></body>"
    return [(i, f"http://h{i % 2}.com/{i}", page(i)) for i in range(n)]


@pytest.mark.parametrize(("sent", "host_pages"), [(html_tree.SENT_ROWS, 10), (-1, 10), (html_tree.SENT_ROWS, 1000)])
def test_style_tree_finds_repeated_branches(spark, sent, host_pages):
    df = spark.createDataFrame(site_pages(40), "p long, u string, h string")
    got = {r.id: r.text for r in html_tree.extract_text(df, "p", "u", "h", host_pages, sent).collect()}
    assert got == {i: f"Story {i} of many {i * i} More {i}" for i in range(40)}


def brute_weights(pages):
    """key -> (pages, styles, presentation, content) by the definitions, over whole pages in memory."""
    import math

    trees = [html_tree.parse(p, "s") for p in pages]
    out = {}
    for key in {k for t in trees for k, m in zip(t.keys, t.marks) if not m & html_tree.RAW_MARK}:
        on, styles, words = 0, collections.Counter(), collections.Counter()
        for t in trees:
            mine = [i for i, k in enumerate(t.keys) if k == key]
            on += bool(mine)
            styles.update({" ".join(t.tags[c] for c, up in enumerate(t.parents) if up == i) for i in mine})
            words.update({w for piece, o in zip(t.pieces, t.owners) if o in mine for w in html_tree.html.unescape(piece).lower().split()})
        if on > 1:
            n = sum(styles.values())
            out[key] = (on, len(styles), -sum(c / n * math.log(c / n, on) for c in styles.values()), 1 - sum(math.log(c, on) for c in words.values()) / len(words) if words else None)
    return out


def test_node_weights_equal_brute_force(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + [p for _, _, p in site_pages(6)]
    df = spark.createDataFrame([("s", p) for p in pages], "site string, html string").repartition(3)
    got = {r.key: r for r in html_tree.node_weights(df).collect()}
    want = brute_weights(pages)
    assert got.keys() == want.keys()
    for key, (on, styles, presentation, content) in want.items():
        r = got[key]
        assert (r.pages, r.styles) == (on, styles) and abs(r.presentation - min(1, max(0, presentation))) < 1e-9 and (r.content is None) == (content is None)
        assert content is None or abs(r.content - max(0, content)) < 1e-9


def test_the_tree_alone_finds_the_articles_of_large_sites(spark):
    """With all that markup names switched off, menus, adverts and footers go by the tree's weights: on nearly all pages the text is the article's, and without the tree on none."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    alone = {r.id: r.text for r in html_tree.extract_text(pages, "page_id", "url", "html", priors=False).collect()}
    rows = [(r.page_id, r.html) for r in pages.collect()]
    same = sum(alone[i] == html_tree.main_text(h) for i, h in rows)
    changed = sum(alone[i] != html_tree.main_text(h, None, False) for i, h in rows)
    assert changed == len(rows) and same >= 0.99 * len(rows)


def test_the_tree_decides_on_large_sites(spark):
    """Repeated branches go wherever they stand, with neutral names, on sites of TREE_PAGES pages; the same pages in a small site are left to markup. On the given pages all sites are large, and the texts are the articles'."""
    story = lambda i: f"Story {i} tells of {hashlib.sha256(str(i).encode()).hexdigest()} and {hashlib.md5(str(i).encode()).hexdigest()}."
    page = lambda i: f"<html><body><div class='k1'><p class='a'>Our paper, every day</p></div><main><p class='s'>{story(i)}</p><div class='k2'>More from this desk</div></main><div class='k3'>Only on page {i}: <i>{story(-i)}</i></div></body></html>"
    plain = lambda i: f"<html><body><div class='k1'><p class='a'>Our paper, every day</p></div><div class='t'><p class='s'>{story(i)}</p><div class='k2'>More from this desk</div></div></body></html>"
    rows = [(i, f"http://big.org/{i}", page(i)) for i in range(300)] + [(i + 1000, f"http://plain.net/{i}", plain(i)) for i in range(300)] + [(i + 2000, f"http://small.com/{i}", plain(i)) for i in range(40)]
    got = {r.id: r.text for r in html_tree.extract_text(spark.createDataFrame(rows, "id long, url string, html string").repartition(4), "id", "url", "html").collect()}
    assert all(got[i] == f"{story(i)} Only on page {i}: {story(-i)}" and got[i + 1000] == story(i) for i in range(300))
    assert sum(got[i + 2000] != story(i) for i in range(40)) < 40
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    sites = html_tree.with_sites(pages.select("url", "html"))
    assert sites.groupBy("site").count().agg(F.min("count")).first()[0] >= html_tree.TREE_PAGES


def test_warc_frames(spark, tmp_path):
    import struct

    import zstandard

    pages = spark.createDataFrame([(i, f"http://e.com/{i}", f"<html><body>{'lorem ipsum ' * 150}{i % 300}</body></html>") for i in range(900)], "i long, u string, h string").coalesce(1)
    manifest = warc.write_archives(pages, "i", "u", "h", f"file://{tmp_path}", archive_bytes=150_000, sample_bytes=60_000)
    files = sorted(tmp_path.glob("*.warc.zst"))
    assert len(files) == manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == 900
    assert all(struct.unpack("<I", f.read_bytes()[:4])[0] == warc.DICTIONARY_MAGIC for f in files)
    raw = files[0].read_bytes()
    size = struct.unpack("<I", raw[4:8])[0]
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert one.decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")  # each record is a frame of its own
    assert one.unused_data.startswith(warc.FRAME_MAGIC)
    index = warc.read_archives(manifest).collect()
    assert sorted(int(r.page_id) for r in index) == list(range(900)) and sum(r.record_type == "revisit" for r in index) == 600
    want = {str(i): hashlib.sha1(f"<html><body>{'lorem ipsum ' * 150}{i % 300}</body></html>".encode()).hexdigest() for i in range(900)}
    assert {r.page_id: r.payload_digest for r in index} == want and all(r.intact for r in index)


def test_large_records_get_a_dictionary():
    import io
    import struct

    r, sink = random.Random(1), io.BytesIO()
    sink.close = lambda: None
    out = warc.ArchiveWriter(sink, warc.SAMPLE_BYTES, warc.DICTIONARY_BYTES, 3)
    records = [warc.info_record("2026-01-01T00:00:00Z")] + [warc.build_record(f"x:{i}", str(i), f"http://e.com/{i}", " ".join(str(r.randrange(5000)) for _ in range(60_000)).encode(), None, None, "2026-01-01T00:00:00Z") for i in range(6)]
    for record in records:
        out.add(record)
    out.close()
    assert struct.unpack("<I", sink.getvalue()[:4])[0] == warc.DICTIONARY_MAGIC
    assert len(list(warc.read_records(io.BytesIO(sink.getvalue())))) == len(records)


@pytest.mark.parametrize("n", [1, 3])
def test_small_archives_have_a_dictionary_of_their_own_bytes(spark, tmp_path, n):
    import struct

    odd = "a\r\nb%0A: c"
    pages = spark.createDataFrame([(odd, f"http://e.com/{i}", "same text " * 200) for i in range(n)] + [("zz", "http://e.com/z", "same text " * 200)], "i string, u string, h string").coalesce(1)
    index = warc.read_archives(warc.write_archives(pages, "i", "u", "h", f"file://{tmp_path}")).collect()
    assert [struct.unpack("<I", f.read_bytes()[:4])[0] for f in tmp_path.glob("*.warc.zst")] == [warc.DICTIONARY_MAGIC]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in index) == [(odd, "revisit", "zz")] * n + [("zz", "response", None)]
    fields = [f for f, _ in warc.read_records(open(next(iter(tmp_path.glob("*.warc.zst"))), "rb"))]
    assert len({f["warc-record-id"] for f in fields}) == n + 2 and {f.get("warc-refers-to-target-uri") for f in fields} == {None, "http://e.com/z"}


def test_chance_below_equals_the_integral(spark):
    import math

    cases = [(0.5, 0.5), (3.0, 9.0), (170.0, 30.0), (2000.0, 350.0), (1.0, 40.0), (40.0, 0.7)]
    got = spark.createDataFrame(cases, "a double, b double").select("a", "b", reputation.chance_below(F.col("a"), F.col("b"), 0.85).alias("p")).collect()
    x = (np.arange(400_000) + 0.5) / 400_000 * math.pi / 2
    for r in got:
        log = (2 * r.a - 1) * np.log(np.sin(x)) + (2 * r.b - 1) * np.log(np.cos(x))
        w = np.exp(log - log.max())
        assert abs(r.p - w[np.sin(x) ** 2 < 0.85].sum() / w.sum()) < 2e-3


def test_reputation_blocks_what_is_worse_beyond_chance(spark):
    r = random.Random(8)
    rates = {f"h{i}.site{i % 7}.com": 0.35 if i % 10 == 0 else 0.9 for i in range(60)}
    pages = [(n * 1000 + k, f"http://{h}/{k}", int(r.random() < p)) for n, (h, p) in enumerate(rates.items()) for k in range(60)]
    df = spark.createDataFrame([x[:2] for x in pages], "i long, u string")
    taught = spark.createDataFrame([(i, g) for i, _, g in pages if i % 3], "id long, good int")
    got = {x.id: x for x in reputation.filter_urls(df, taught, "i", "u", rules=()).collect()}
    held = [(got[i].verdict, g) for i, _, g in pages if i % 3 == 0]
    share = lambda v: np.mean([g for x, g in held if x == v])
    assert share("block") < 0.6 < 0.85 < share("allow") and {x.host for x in got.values() if x.verdict == "block"} == {h for h, p in rates.items() if p < 0.5}


def test_reputation_shrinks(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good' if i < 120 else 'new'}.site.co.uk/{i}") for i in range(130)], "i long, u string")
    outcomes = spark.createDataFrame([(i, 0 if i < 60 else 1) for i in range(120)], "id long, good int")
    got = {r.host: r for r in reputation.filter_urls(pages, outcomes, "i", "u").collect()}
    assert got["bad.site.co.uk"].verdict == "block" and got["good.site.co.uk"].verdict == got["new.site.co.uk"].verdict == "allow"
    assert got["bad.site.co.uk"].mean < got["new.site.co.uk"].mean < got["good.site.co.uk"].mean
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(reputation.domain_of(F.lit(h))) for h in ("a.b.co.uk", "x.y.example.com", "com", "10.0.0.1", "")] == ["b.co.uk", "example.com", "com", "10.0.0.1", ""]


def test_pipeline_equals_its_stages(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.materialise(corpus_pipeline.STAGES[2][1](spark, docs, sf))
    roots = brute_components({i: brute_fingerprint(t) for i, t in documents.items()})
    assert {r.doc_id for r in kept.collect()} == set(roots.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, docs, sf).collect()}
    want = {i for i, t in documents.items() for n, h, _ in [brute_contamination(t, items)] if not (h > 0 and 20 * h >= n)}
    assert clean == want
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r.token_ids == sp.encode(documents[r.doc_id] or "") and r.n_tokens == len(r.token_ids) for r in out)
