"""The model pass with failures, and the data source of article files."""

import json

from pyspark.sql import functions as F

from lodestone.operators import catalog, enrich
from lodestone.sources import article_files as af


def stored(spark):
    rows = [
        ("a", "T", "C", "  a long text that gives a summary  ", None, None), ("b", "", None, "bad prompt", "kept", None), ("c", None, None, "   ", None, None),
        ("d", "T", "C", "short", None, None), ("e", "T", "C", None, None, None), ("f", "T", "C", "fresh", "new enough", "2026-02-01"),
    ]
    df = spark.createDataFrame(rows, "article_id string, title string, category string, raw_content string, llm_summary string, at string")
    return df.select("*", F.col("at").cast("timestamp").alias("llm_summary_at"), F.lit("2026-01-01").cast("timestamp").alias("updated_at")).drop("at")


def a_model():
    """Inside a function, so that workers get it by value."""

    def load():
        def complete(prompts):
            if any("bad prompt" in p for p in prompts):
                raise RuntimeError("no answer")
            return ["Summary: tiny" if "short" in p else "```\nHere is the summary: " + "words of it " * 8 + "\n```" for p in prompts]

        return complete

    return load


def test_failures_are_rows_and_counters_add_up(spark):
    articles = stored(spark)
    stamp = F.lit("2026-03-01").cast("timestamp")
    out = enrich.enriched(articles, catalog.stale_summaries(articles), a_model(), stamp)
    got = {r.article_id: (r.outcome, r.error, r.attempts) for r in out.outcomes.collect()}
    assert got == {"a": ("enriched", None, 1), "b": ("failed", "RuntimeError: no answer", enrich.ATTEMPTS), "c": ("skipped", None, 0), "d": ("skipped", None, 1), "e": ("skipped", None, 0)}
    assert out.report.head().asDict() == {"considered": 5, "enriched": 1, "skipped": 3, "failed": 1, "errors": ["b: RuntimeError: no answer"]}
    after = {r.article_id: r for r in out.articles.collect()}
    assert len(after) == 6 and out.articles.columns == articles.columns
    assert after["a"].llm_summary == " ".join(["words of it"] * 8) and after["a"].llm_summary_at == after["a"].updated_at
    assert after["b"].llm_summary == "kept" and after["b"].llm_summary_at is None and after["f"].llm_summary == "new enough"
    assert "a" not in {r.article_id for r in catalog.stale_summaries(out.articles).collect()}


def test_prompts_name_defaults_and_cut_the_text(spark):
    long = stored(spark).filter("article_id = 'b'").withColumn("raw_content", F.lit("x" * (enrich.MOST_INPUT + 5)))
    prompt = enrich.prompts(long).head().prompt
    assert "Title: Untitled\nCategory: General\n\n" in prompt and prompt.endswith("\n\n" + "x" * enrich.MOST_INPUT)


def test_model_with_a_missing_answer_and_nothing_to_do(spark):
    articles = stored(spark)
    out = enrich.enriched(articles, articles.filter("article_id in ('a', 'd')"), lambda: lambda p: [])
    assert [r.error for r in out.outcomes.orderBy("article_id").collect()] == ["ValueError: 0 answers to 1 prompts"] * 2
    none = enrich.enriched(articles, articles.limit(0), a_model())
    assert none.report.head().asDict() == {"considered": 0, "enriched": 0, "skipped": 0, "failed": 0, "errors": []}


def test_errors_are_listed_up_to_a_bound(spark):
    rows = spark.range(30).select(F.col("id").alias("article_id"), F.lit("T").alias("title"), F.lit("C").alias("category"), F.lit("bad prompt").alias("raw_content"), F.lit(None).cast("string").alias("llm_summary"), F.lit(None).cast("timestamp").alias("llm_summary_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    report = enrich.enriched(rows, rows, a_model()).report.head()
    assert report.failed == 30 and report.errors == [f"{i}: RuntimeError: no answer" for i in range(enrich.LISTED)]


def folder(tmp_path):
    for i in range(20):
        (tmp_path / af.file_of(i)).write_text(json.dumps({"article_id": str(i), "title": f"T{i}", "category": "c", "url": "u", "text": "é" * i, "more": [1]}))
    (tmp_path / af.file_of("bad")).write_text('{"article_id": "b')
    (tmp_path / af.file_of("list")).write_text("[1]")
    (tmp_path / af.file_of("bytes")).write_bytes(b'{"article_id": "\xff"}')
    (tmp_path / "notes.json").write_text("{}")
    return str(tmp_path)


def test_broken_files_are_named_and_the_others_read(spark, tmp_path):
    df = af.article_files(spark, folder(tmp_path))
    assert df.columns == [*af.FIELDS, "path", "error"]
    good = {r.article_id: r.text for r in df.filter("error IS NULL").collect()}
    assert good == {str(i): "é" * i for i in range(20)}
    bad = {r.path.rsplit("/", 1)[1]: r.error for r in df.filter("error IS NOT NULL").collect()}
    assert set(bad) == {af.file_of(x) for x in ("bad", "list", "bytes")}
    assert bad[af.file_of("list")] == "ValueError: no object with an article_id" and "UTF-8" in bad[af.file_of("bytes")] and "JSONDecodeError" in bad[af.file_of("bad")]


def test_point_fetch_opens_one_file(spark, tmp_path):
    path = folder(tmp_path)
    reader = af.ArticleReader(path)
    kept = list(reader.pushFilters([af.EqualTo(("article_id",), "7"), af.EqualTo(("title",), "x")]))
    assert len(kept) == 2 and [p.paths for p in reader.partitions()] == [(f"{path}/{af.file_of(7)}",)]
    assert [r.title for r in af.fetched(spark, path, "7").collect()] == ["T7"]
    assert af.fetched(spark, path, "99").count() == 0 and af.fetched(spark, path, "bad").count() == 0
    one_each = lambda: af.article_files(spark, path, filesPerTask=1)  # noqa: E731 - partitions are files that are opened
    assert one_each().filter("article_id IN ('3', '4')").rdd.getNumPartitions() == 2
    assert one_each().filter("article_id = '7'").rdd.getNumPartitions() == 1 and one_each().rdd.getNumPartitions() == 23


def test_empty_folder_and_files_of_another_id(spark, tmp_path):
    assert af.article_files(spark, str(tmp_path)).count() == 0
    (tmp_path / af.file_of(1)).write_text('{"article_id": "2"}')
    assert af.fetched(spark, str(tmp_path), "1").count() == 0
    assert [tuple(r) for r in af.article_files(spark, str(tmp_path)).select("article_id", "title").collect()] == [("2", None)]
