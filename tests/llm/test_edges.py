"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import chat, decision_list, html_tree, pieces, pu_quality, reputation, simhash, toxicity, warc, winnowing
from lacuna.llm.common import shared_dir

LONG = "word " * 40_000
#: Extra columns that clash with names used inside the operators.
EXTRA = "id long, text2 string, fp long, score double, row long, label int, key string, host string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (5, LONG), (6, "same text here again"), (7, "same text here again"), (7, "same text here again"), (None, "no id"), (8, "Ünïcödé ✓ 日本語 \U0001f600 ###")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"id": F.lit(1), "fp": F.lit(2), "score": F.lit("x"), "row": F.lit(None).cast("string"), "label": F.lit(9), "key": F.lit("k"), "host": F.lit(0), "component": F.lit(5), "n_words": F.lit("z")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (6, 1, 0), (6, 0, 1)], "id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs, "doc_id", "text").collect()
    assert len(got) == 10
    by = {r.id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[2].component == 1 and by[7].component == 6
    assert simhash.near_duplicates(none, "doc_id", "text").count() == 0
    assert simhash.keep_one_per_group(docs, "doc_id", "text").count() == 6 and simhash.keep_one_per_group(docs, "doc_id", "text").columns == docs.columns


def test_winnowing(spark, docs, none):
    items = spark.createDataFrame([("a", "one two three"), (None, "word word"), ("e", ""), ("n", None), ("a", "one two three")], "item_id string, text string")
    for size in (winnowing.INDEX_BYTES, 0):
        got = {(r.id, r.n_words): r for r in winnowing.contamination(docs, items, "doc_id", "text", "item_id", "text", index_bytes=size).collect()}
        assert got[4, 3].n_hit == 3 and got[4, 3].items == ["a"] and got[5, 40_000].n_hit == 40_000 and got[5, 40_000].items == [""] and got[1, 0].n_hit == 0
        assert winnowing.contamination(none, items, "doc_id", "text", "item_id", "text", index_bytes=size).count() == 0
        assert winnowing.contamination(docs, items.limit(0), "doc_id", "text", "item_id", "text", index_bytes=size).where("n_hit > 0").count() == 0
        assert winnowing.drop_contaminated(docs, items, "text", "item_id", "text", index_bytes=size).count() == 8
        clashing = docs.withColumn("_at", F.lit("kept")).withColumn("item", F.lit(1))
        clean = winnowing.drop_contaminated(clashing, items.withColumn("id", F.lit(0)), "text", "item_id", "text", index_bytes=size)
        assert clean.columns == clashing.columns and clean.where("_at = 'kept'").count() == 8


def test_rules(docs, none, labels):
    known = labels.select("id", F.col("quality").alias("good"))
    got, _ = decision_list.quality_rules(docs, known, "doc_id", "text")
    rows = {r.id: r for r in got.collect()}
    assert got.count() == 10 and rows[5].n_repeat_words == 40_000 and not rows[5].kept and rows[1].n_words == 0 and rows[8].word_chars == 15
    assert decision_list.quality_rules(none, known.limit(0), "doc_id", "text")[0].count() == 0


def test_classifiers(docs, none, labels):
    for f in (toxicity.toxicity, pu_quality.quality):
        got = f(docs, labels, "doc_id", "text").collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got) and all(r.held_out is not None for r in got)
        assert f(none, labels, "doc_id", "text").count() == 0
        assert f(docs, labels.limit(0), "doc_id", "text").count() == 10
    assert toxicity.drop_toxic(docs, labels.limit(0), "doc_id", "text").count() == 10
    clashing = docs.withColumn("_at", F.lit("kept"))
    for rows in (toxicity.MODEL_ROWS, 1):
        kept = toxicity.drop_toxic(clashing, labels, "doc_id", "text", model_rows=rows)
        assert kept.columns == clashing.columns and kept.where("_at <> 'kept'").count() == 0
    assert pu_quality.keep_good(docs, labels.limit(0), "doc_id", "text").columns == docs.columns


def test_pieces(docs, none):
    got = {r.id: r.ids for r in pieces.encode(docs, "doc_id", "text", chunk=5000).collect()}
    assert got[1] == got[2] == [] and len(got[5]) > 40_000
    text = {r.id: r.text for r in pieces.decode(pieces.encode(docs, "doc_id", "text"), "id", "ids").collect()}
    assert text[8] == "Ünïcödé ✓ 日本語 \U0001f600 ###" and text[3] == " \n\t" and text[5] == LONG
    assert pieces.encode(none, "doc_id", "text").count() == 0


@pytest.mark.parametrize("text", ["!," * 5000, "a" + ":!" * 5000, "word " + ".;" * 10_000 + " end", ",." * 30_000, "?" * 10_000])
def test_long_runs_of_marks(spark, text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for walk_all in (False, True):
        got = pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", walk_all=walk_all)
        assert got.first().ids == library.encode(text)
    assert pieces.decode(got, "id", "ids").first().text == text


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "HTTP://Ex.Com/en/1?q#f", "<p>hi"), (3, "http://ex.com/en/1", "<p>hi"), (None, "a://b", "x" * 2000), (5, "http://ex.com", "x" * 2000), (4, "http://ex.com", "x" * 2000)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("payload", F.lit(2))
    text = {r.id: r.text for r in html_tree.extract_text(pages, "page_id", "url", "html").collect()}
    assert text[1] == text[2] == "" and text[3] == "hi" and text[5] == "x" * 2000
    assert html_tree.extract_text(pages, "page_id", "url", "html", sent_rows=-1).count() == 7 and html_tree.extract_text(pages.limit(0), "page_id", "url", "html").count() == 0
    folder = f"{shared_dir(spark)}/edge-warc"
    index = warc.read_archives(warc.write_archives(pages, "page_id", "url", "html", folder)).collect()
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in index}
    assert len(index) == 7 and kinds["4"] == ("revisit", "5") and kinds[None] == ("revisit", "5") and kinds["5"] == ("response", None) and all(r.intact for r in index)
    assert warc.read_archives(warc.write_archives(pages.limit(0), "page_id", "url", "html", folder + "0")).count() == 0
    outcomes = spark.createDataFrame([(3, 1), (3, None), (None, 0), (4, 0)], "id long, good int")
    got = {r.id: r for r in reputation.filter_urls(pages, outcomes, "page_id", "url").collect()}
    assert got[1].host == got[2].host == "" and got[3].host == "ex.com" and got[3].rule == "com/en/" and got[3].verdict == "block" and got[5].rule is None
    assert reputation.filter_urls(pages.limit(0), outcomes.limit(0), "page_id", "url").count() == 0


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, None, None), (2, None, "odd: \"role\"\n### ", "x"), (3, 0, "assistant", chat.TRICKY)], "c long, t long, r string, x string").withColumn("conv", F.lit(0)).withColumn("segment", F.lit(0))
    got = {r.conv: r for r in chat.read_back(chat.format_chat(turns, "c", "t", "r", "x")).collect()}
    assert got[1].n_turns == 3 and not got[1].valid and got[1].loss_chars == 2 and got[None].n_turns == 1 and got[2].n_turns == 1 and got[3].loss_chars == len(chat.TRICKY)
    assert chat.read_back(chat.format_chat(turns.limit(0), "c", "t", "r", "x")).count() == 0


def test_pipeline_stages(spark, docs, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    full = spark.createDataFrame([(r.doc_id, r.text, None, "s", None) for r in docs.collect()], "doc_id long, text string, lang string, source string, n_chars long")
    for at in (full, full.limit(0)):
        n = at.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = corpus_pipeline.materialise(stage(spark, at, sf))
            assert at.columns == columns and at.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() == at.count()


@pytest.mark.parametrize("missing", [False, True])
def test_quality_sends_few_trusted_ids(spark, monkeypatch, missing):
    """Of 3,000 trusted ids about four times the sample are sent, with the same classifier as from all; where texts have too few of them, all are asked for."""
    from lacuna.llm import pu_quality as P

    docs = spark.range(3000).select("id", F.concat_ws(" ", F.lit("some words of text"), F.col("id") % 97, F.repeat(F.lit("#"), (F.col("id") % 5).cast("int"))).alias("text"))
    docs = docs.where("id < 60") if missing else docs
    labels, sent, join = spark.range(3000).select("id", F.lit(1).alias("quality")), [], P.join_narrow
    monkeypatch.setattr(P, "join_narrow", lambda texts, narrow, *a: sent.append(narrow.count()) or join(texts, narrow, *a))
    net = P.train_judge(docs, labels, "id", "text", sample_rows=40).net
    assert 80 <= sent[0] <= 320 and len(sent) == (2 if missing else 1)
    monkeypatch.setattr(P, "least_hash_part", lambda df, *a: df)
    want = P.train_judge(docs, labels, "id", "text", sample_rows=40).net
    assert sent[-1] > 2000 and all((a == b).all() for a, b in zip(net.params, want.params, strict=True))
