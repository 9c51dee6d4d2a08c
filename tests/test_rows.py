"""Operators that no query runs: sinks, prompts, contexts and the analyses of answers and stages."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import catalog, context, evaluate, ingest, models
from lodestone.sources import files


def test_articles_are_written_and_read_back(spark, tmp_path):
    rows = [("1", "T", "C", "u", "grüße\n\"x\""), ("2", None, "", "u", "")]
    files.write_articles(spark.createDataFrame(rows, "article_id string, title string, category string, url string, text string").withColumn("more", F.lit(1)), str(tmp_path / "a"))
    back = files.read_articles(spark, str(tmp_path / "a"))
    assert sorted(tuple(r) for r in back.collect()) == [(*rows[0], 9), (*rows[1], 0)]


def test_category_scan_keeps_to_the_wanted_and_names_failures(spark):
    link = '<a href="knowledgebase.php?{}={}">'.format
    pages = spark.createDataFrame(
        [(1, link("article", 10) + link("article", 11) + link("article", 10), None), (2, link("article", 10) + link("category", 9), None), (3, "", "ConnectError: x"), (4, "<p>", None), (9, link("article", 99), None)],
        "category_id int, html string, error string",
    )
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (1,)], "category_id int")
    found, failed = files.category_scan(pages, wanted)
    assert sorted(map(tuple, found.collect())) == [("10", 2), ("11", 1)]
    assert sorted(map(tuple, failed.collect())) == [(3, "ConnectError: x"), (4, "no article"), (5, "no page")]
    assert [x.count() for x in files.category_scan(pages, wanted.limit(0))] == [0, 0]


def test_vector_records_and_image_paths(spark):
    chunks = spark.createDataFrame([("1_0", "some words", 1, 0, ""), ("1_1", "more words", 1, 1, "c")], "chunk_id string, text string, article_id int, chunk_index int, category string")
    rows = ingest.vector_records(chunks, models.hashing_embedder()).orderBy("id").collect()
    assert [(r.id, r.document, r.article_id, r.chunk_index, r.category, r.source_type) for r in rows] == [("1_0", "some words", "1", 0, catalog.DEFAULT_CATEGORY, "text"), ("1_1", "more words", "1", 1, "c", "text")]
    assert all(len(r.embedding) == 64 for r in rows)
    paths = spark.createDataFrame([("/static/a", "/f/a"), ("", "/f/b"), (None, "/f/c")], "s string, f string")
    assert [r.p for r in paths.select(catalog.image_path(F.col("s"), F.col("f")).alias("p")).collect()] == ["/static/a", "/f/b", "/f/c"]


def test_regressions_are_queries_that_got_worse(spark):
    run = lambda *rows: spark.createDataFrame(list(rows), "query string, recall double")
    worse = evaluate.regressions(run(("a", 1.0), ("b", 0.5), ("c", 0.2)), run(("a", 0.5), ("b", 0.5), ("d", 0.0)))
    assert [tuple(r) for r in worse.collect()] == [("a", 1.0, 0.5)]


def test_context_by_chunk_gives_a_summary_once(spark):
    rows = [("q", 2, "1", "T", "C", "u", "S", "two"), ("q", 1, "1", "T", "C", "u", "S", "one"), ("q", 3, "2", "", None, None, None, "three")]
    got = context.context_by_chunk(spark.createDataFrame(rows, "query_id string, final_rank int, article_id string, title string, category string, url string, summary string, text string")).head().context
    assert got == (
        "---\nArticle: T\nCategory: C\nSource: u\nArticle overview: S\nContent: one\n---\n---\nArticle: T\nCategory: C\nSource: u\nContent: two\n---\n"
        f"---\nArticle: {context.UNTITLED}\nCategory: {context.GENERAL}\nSource: \nContent: three\n---"
    )


def test_image_context_replaces_fillers(spark):
    rows = [("q", 1, "Login page", "", "C", "7"), ("q", 2, "Image from article 7", None, "C", "7"), ("q", 3, None, " alt ", None, None), ("q", 4, "", "", "", "")]
    got = context.image_context(spark.createDataFrame(rows, "query_id string, rank int, caption string, alt_text string, category string, article_id string")).head().images
    assert got == "\n".join([context.IMAGES, "", "- Login page (from article 7)", "- Screenshot from C (from article 7)", "- alt", "- Screenshot from the knowledge base"])


def test_prompts_are_assembled(spark):
    row = spark.range(1).select(
        context.user_prompt(F.lit("c"), F.lit(""), F.lit("h"), F.lit("q?"), "do").alias("u"), context.user_prompt(F.lit("c"), F.lit("i"), F.lit("h"), F.lit("q?")).alias("v"), context.single_prompt(F.lit("s"), F.lit("u")).alias("w")
    ).head()
    assert row.u == f"Retrieved Knowledge Base Context:\nc\n\nImages Shown To The User:\n{context.NO_IMAGES}\n\nConversation History:\nh\n\nUser Question: q?\n\ndo"
    assert row.v.endswith("Images Shown To The User:\ni\n\nConversation History:\nh\n\nUser Question: q?") and row.w == "s\n\nu"


def test_answers_and_their_consistency(spark):
    nan = float("nan")
    rows = [("covered", 0.5, True, False, False), ("covered", nan, True, True, False), ("covered", 1.0, False, True, False), ("offtopic", nan, True, True, True)]
    got = {r.kind: r for r in evaluate.answers_by_kind(spark.createDataFrame(rows, "kind string, grounding double, graded boolean, declined boolean, should_decline boolean")).collect()}
    assert (got["covered"].n, got["covered"].grounding, got["covered"].decline_accuracy) == (3, 0.75, 0.5)
    assert (got["offtopic"].grounding, got["offtopic"].decline_accuracy) == (None, 1.0)
    repeats = [("a", False, 100), ("a", False, 110), ("b", True, 100), ("b", False, 100), ("c", False, 100), ("c", False, 300)]
    assert {r.query: r.unstable for r in evaluate.consistency(spark.createDataFrame(repeats, "query string, declined boolean, length int")).collect()} == {"a": False, "b": True, "c": True}


def test_stage_means_residuals_and_checks(spark):
    traces = spark.createDataFrame([(1, 10.0, {"v": 4.0, "r": 2.0}), (1, 3.0, {"v": 4.0}), (2, 5.0, {})], "level int, total double, timings map<string,double>")
    assert sorted(map(tuple, evaluate.stage_means(traces).collect())) == [(1, "r", 1.0), (1, "v", 4.0)]
    assert [r.x for r in traces.select(evaluate.residual(F.col("total"), F.col("timings")).alias("x")).collect()] == [4.0, 0.0, 5.0]
    yes, no = (spark.range(1).select(F.lit(x).alias("ok")) for x in (True, False))
    assert sorted(map(tuple, evaluate.checks(("a", yes), ("b", no)).collect())) == [("a", True), ("b", False)]


def test_markup_and_request_ids(spark):
    row = spark.range(1).select(text.markdown_html(F.lit("**b** <i> `c`\n[t](https://x.org/a) https://y.org")).alias("m"), text.request_id(F.lit("a b/c_1.2-" + "z" * 80)).alias("r"), text.request_id(F.lit("///")).alias("n")).head()
    assert row.m == '<strong>b</strong> &lt;i&gt; <code>c</code><br><a href="https://x.org/a">t</a> <a href="https://y.org">https://y.org</a>'
    assert row.r == ("abc_1.2-" + "z" * 80)[:64] and row.n is None


def test_shares_of_hashed_shingles_are_those_of_words(spark):
    words = [f"w{i}" for i in range(40)]
    left = spark.createDataFrame([(1, " ".join(words[:20])), (2, "too short"), (3, None)], "left_id int, text string")
    right = spark.createDataFrame([(1, " ".join(words[10:40])), (2, " ".join(words[:20]).upper() + "\n"), (3, "")], "right_id int, text string")
    got = {(r.left_id, r.right_id): (r.shared, r.share) for r in evaluate.contained(left, right).collect()}
    assert got == {(1, 1): (3, pytest.approx(3 / 13)), (1, 2): (13, 1.0)}
