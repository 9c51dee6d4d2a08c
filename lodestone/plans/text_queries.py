"""Queries of ingest (pages, chunks, summaries), query understanding, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import html
from lodestone.functions.text import jaccard
from lodestone.operators import catalog, chunking, enrich, evaluate, ingest, models, summarize, understanding
from lodestone.sources import files
from lodestone.streaming import streams

Q: dict = {}
S: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Q["crawl_pages"] = lambda s, d: files.crawled(table(s, d, "pages"))
Q["clean_html"] = lambda s, d: table(s, d, "pages").select("page_id", html.clean_html(F.col("html")).alias("text"))
Q["extract_title"] = lambda s, d: table(s, d, "pages").select("page_id", html.extract_title(F.col("html")).alias("title"))
Q["page_images"] = lambda s, d: table(s, d, "pages").select("page_id", F.explode(html.images("https://example.org")("html")).alias("i")).select("page_id", "i.*")
Q["discover_links"] = lambda s, d: files.discovered(table(s, d, "pages"), r'(?i)href="([^"#]+)"')
S["discover_links"] = "SELECT DISTINCT unnest(regexp_extract_all(html, '(?i)href=\"([^\"#]+)\"', 1)) AS article_id FROM pages"


def _category_pages(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An order is a category's page: it links to its lines' parts, in old orders to none or not at all; customers' numbers are wanted too, of which few are orders."""
    link = lambda kind, c: F.concat(F.lit(f'<a href="KnowledgeBase.php?{kind}='), F.col(c).cast("string"), F.lit('">x</a>'))
    html = F.array_join(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") > 1, link("article", "l_partkey")).otherwise(link("category", "l_partkey")))), " ")
    pages = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("category_id")).agg(html.alias("html"), F.when(F.max("l_quantity") < 10, F.lit("HTTPError: 500")).alias("error"))
    return pages, table(s, d, "customer").select(F.col("c_custkey").alias("category_id")).unionByName(table(s, d, "orders").select(F.col("o_orderkey").alias("category_id")))


Q["category_articles"] = lambda s, d: files.category_scan(*_category_pages(s, d))[0]
Q["category_failures"] = lambda s, d: files.category_scan(*_category_pages(s, d))[1]
_WANTED = "WITH w AS (SELECT c_custkey AS category_id FROM customer UNION SELECT o_orderkey FROM orders), p AS (SELECT l_orderkey AS category_id, max(l_quantity) < 10 AS failed, count(*) FILTER (l_linenumber > 1) AS n FROM lineitem GROUP BY l_orderkey)"
S["category_articles"] = f"{_WANTED} SELECT l_partkey::VARCHAR AS article_id, count(DISTINCT l_orderkey) AS categories FROM lineitem JOIN p ON l_orderkey = category_id SEMI JOIN w ON l_orderkey = w.category_id WHERE NOT failed AND l_linenumber > 1 GROUP BY l_partkey"
S["category_failures"] = f"{_WANTED} SELECT w.category_id, CASE WHEN failed IS NULL THEN 'no page' WHEN failed THEN 'HTTPError: 500' ELSE 'no article' END AS reason FROM w LEFT JOIN p USING (category_id) WHERE failed IS NULL OR failed OR n = 0"


def articles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("article_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("category"), F.col("source").alias("url"), "text")


Q["chunk_articles"] = lambda s, d: chunking.chunk_articles(articles(s, d)).select("chunk_id", "article_id", "chunk_index", "text", "category")
Q["chunk_rows"] = lambda s, d: chunking.chunk_rows(articles(s, d)).select("chunk_id", "article_id", "chunk_index", "text", "category")
Q["chunk_headers"] = lambda s, d: articles(s, d).select("article_id", chunking.header(F.col("title"), F.col("category")).alias("header"))
S["chunk_headers"] = "SELECT doc_id AS article_id, CASE WHEN coalesce(source, '') = '' THEN '[Document ' || doc_id || ']' || chr(10) ELSE '[' || source || ' — Document ' || doc_id || ']' || chr(10) END AS header FROM documents"
Q["summarize"] = lambda s, d: summarize.summarize(articles(s, d).select(F.col("article_id").alias("doc_id"), "text", "title"))
_STOP = ", ".join(f"'{w}'" for w in summarize.STOPWORDS)
Q["summary_terms"] = lambda s, d: table(s, d, "documents").select(F.explode(summarize.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
S["summary_terms"] = f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM documents) WHERE length(term) > 2 AND term NOT IN ({_STOP}) GROUP BY term"

def stand_in_model() -> enrich.Complete:
    """No model is shipped: answers with the end of the prompt, and refuses those whose length is a multiple of 11."""

    def complete(prompts: list[str]) -> list[str]:
        if refused := [p for p in prompts if len(p) % 11 == 0]:
            raise ValueError(f"refused {len(refused[0])}")
        return [f"Summary: {p[-200:]}" for p in prompts]

    return complete


def _enriched(s: SparkSession, d: str) -> enrich.Enrichment:
    none = {"llm_summary": F.lit(None).cast("string"), "llm_summary_at": F.lit(None).cast("timestamp"), "updated_at": F.lit("2026-01-01").cast("timestamp")}
    rows = articles(s, d).withColumnRenamed("text", "raw_content").withColumns(none)
    return enrich.enriched(rows, catalog.stale_summaries(rows), stand_in_model)


Q["enrich_summaries"] = lambda s, d: _enriched(s, d).outcomes
Q["enrich_report"] = lambda s, d: _enriched(s, d).report.withColumn("errors", F.array_join("errors", "\n"))
_PROMPT = enrich.PROMPT.replace("\n", "' || chr(10) || '").replace("{title}", "Document ' || doc_id || '").replace("{category}", "' || coalesce(nullif(source, ''), 'General') || '").replace("{text}", f"' || t[1:{enrich.MOST_INPUT}] || '")
_OUTCOMES = rf"""WITH t AS (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS t FROM documents),
p AS (SELECT doc_id, CASE WHEN t <> '' THEN '{_PROMPT}' END AS p FROM t),
a AS (SELECT doc_id, p, length(p) % 11 = 0 AS refused, trim(regexp_replace(right(p, 200), '\s+', ' ', 'g')) AS summary FROM p),
o AS (SELECT doc_id AS article_id, CASE WHEN refused THEN 'failed' WHEN length(summary) >= {enrich.LEAST_ANSWER} THEN 'enriched' ELSE 'skipped' END AS outcome, summary,
      CASE WHEN refused THEN 'ValueError: refused ' || length(p) END AS error, CASE WHEN p IS NULL THEN 0 WHEN refused THEN {enrich.ATTEMPTS} ELSE 1 END AS attempts FROM a)
"""
S["enrich_summaries"] = f"{_OUTCOMES} SELECT article_id, outcome, CASE WHEN outcome = 'enriched' THEN summary END AS summary, error, attempts::INT AS attempts FROM o"
S["enrich_report"] = f"""{_OUTCOMES} SELECT count(*) AS considered, count(*) FILTER (outcome = 'enriched') AS enriched, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
(SELECT coalesce(string_agg(e, chr(10) ORDER BY article_id), '') FROM (SELECT article_id, article_id || ': ' || error AS e FROM o WHERE outcome = 'failed' ORDER BY article_id LIMIT {enrich.LISTED})) AS errors FROM o"""


#: A small example; real knowledge comes from a file (understanding.load_knowledge).
EXAMPLE = understanding.Knowledge(
    (understanding.Group("the", "The", "system", ("the", "of the", "thand")), understanding.Group("on", "On", "object", ("on", "onth", "onre"))),
    (understanding.Intent("ask", (r"\bth\w+ing\b",), ("how to ask",), ("thing", "ering"), True), understanding.Intent("be", (r"\bbe\b", r"\bbeen\b"), ("what to be",), ("be",))),
    {"er": "erer"}, {"it": "IT"}, {"adn": "and"},
)


def processed(s: SparkSession, d: str) -> DataFrame:
    return understanding.process(table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), EXAMPLE)


Q["process_query"] = lambda s, d: processed(s, d).select("query_id", "normalized", "lexical", "intents", "entities", "boost_terms", "procedural", "variants", "understood")
Q["classify_intents"] = lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(understanding.intents(EXAMPLE, F.col("text")), ",").alias("intents"))
_L, _R = r"(?i)(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
S["classify_intents"] = rf"SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '{_L}th[A-Za-z0-9_]+ing{_R}') THEN 'ask' END, CASE WHEN regexp_matches(text, '{_L}be(en)?{_R}') THEN 'be' END) AS intents FROM documents"


def results(s: SparkSession, d: str) -> DataFrame:
    """query_id, rank, article_id: a stand-in ranking, ten rows a query, derived from labels."""
    ids = table(s, d, "labels").select("doc_id")
    return ids.select(F.col("doc_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")).withColumn("article_id", (F.col("query_id") * 7 + F.col("rank") * F.col("rank")) % 23)


def cases(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "labels")
    kind = F.when(F.col("doc_id") % 12 == 0, "offtopic").when(F.col("quality") == 1, "covered").otherwise("typo")
    return ids.select(F.col("doc_id").alias("query_id"), kind.alias("kind"), F.when(kind == "offtopic", F.expr("cast(array() as array<bigint>)")).otherwise(F.array((F.col("doc_id") * 7 + 4) % 23, F.col("doc_id") % 23)).alias("expected"))


_RESULTS = "res AS (SELECT doc_id AS query_id, rank, (doc_id * 7 + rank * rank) % 23 AS article_id FROM labels, (SELECT unnest(range(1, 11)) AS rank)), cas AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 12 = 0 THEN 'offtopic' WHEN quality = 1 THEN 'covered' ELSE 'typo' END AS kind, CASE WHEN doc_id % 12 = 0 THEN []::BIGINT[] ELSE [(doc_id * 7 + 4) % 23, doc_id % 23] END AS expected FROM labels)"
_QUALITY = _RESULTS + """, got AS (SELECT query_id, list(article_id ORDER BY rank) AS got FROM res GROUP BY query_id),
qual AS (SELECT query_id, kind, CASE WHEN len(expected) = 0 THEN (len(got) = 0)::INT::DOUBLE ELSE len(list_intersect(got, expected)) / len(expected)::DOUBLE END AS recall,
 CASE WHEN len(expected) = 0 THEN (len(got) = 0)::INT::DOUBLE ELSE len(list_filter(got, lambda a: list_contains(expected, a))) / len(got)::DOUBLE END AS precision FROM cas JOIN got USING (query_id))"""
Q["evaluate_quality"] = lambda s, d: evaluate.quality(results(s, d), cases(s, d)).select("query_id", "kind", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))
S["evaluate_quality"] = f"WITH {_QUALITY} SELECT query_id, kind, round(recall, 6) AS recall, round(precision, 6) AS precision FROM qual"
Q["quality_by_kind"] = lambda s, d: evaluate.quality_by_kind(evaluate.quality(results(s, d), cases(s, d))).select("kind", "n", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))
S["quality_by_kind"] = f"WITH {_QUALITY} SELECT kind, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM qual GROUP BY kind"
Q["recall_at_k"] = lambda s, d: evaluate.recall_at(evaluate.first_hits(results(s, d), cases(s, d).select("query_id", F.explode("expected").alias("article_id"))), cases(s, d), (1, 5, 10)).select(*[F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in (1, 5, 10)])
S["recall_at_k"] = f"WITH {_RESULTS}, h AS (SELECT c.query_id, min(rank) AS r FROM (SELECT query_id, unnest(expected) AS article_id FROM cas) c JOIN res USING (query_id, article_id) GROUP BY 1) SELECT " + ", ".join(f"round(avg(coalesce((r <= {k})::INT, 0)), 6) AS recall_at_{k}" for k in (1, 5, 10)) + " FROM cas LEFT JOIN h USING (query_id)"
Q["confidence_separation"] = lambda s, d: evaluate.separation(cases(s, d).withColumn("confidence", F.col("query_id") % 97 / 97.0)).select(F.round("separation", 6).alias("separation"))
S["confidence_separation"] = f"WITH {_RESULTS} SELECT round(avg(CASE WHEN kind = 'covered' THEN query_id % 97 / 97.0 END) - avg(CASE WHEN kind = 'offtopic' THEN query_id % 97 / 97.0 END), 6) AS separation FROM cas"


def grouped(s: SparkSession, d: str) -> DataFrame:
    """Five labels in a row are the phrasings of one question; their articles in order of first occurrence."""
    first = results(s, d).groupBy("query_id", "article_id").agg(F.min("rank").alias("rank"))
    got = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id"))).getField("article_id").alias("articles"))
    return got.select(F.floor(F.col("query_id") / 5).alias("group"), F.col("query_id").alias("phrasing"), "articles", (F.col("query_id") % 97 / 97.0).alias("confidence"))


Q["stability"] = lambda s, d: evaluate.stability(grouped(s, d)).select("group", "n_queries", F.round("mean_overlap", 6).alias("mean_overlap"), F.round("least_overlap", 6).alias("least_overlap"), "agree", F.round("spread", 6).alias("spread"))
S["stability"] = f"""WITH {_RESULTS}, g AS (SELECT query_id // 5 AS "group", query_id AS p, query_id % 97 / 97.0 AS c, list(article_id ORDER BY rank) AS x FROM (SELECT query_id, article_id, min(rank) AS rank FROM res GROUP BY ALL) GROUP BY query_id),
o AS (SELECT a."group", len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE AS o FROM g a JOIN g b ON a."group" = b."group" AND a.p < b.p),
m AS (SELECT "group", avg(o) AS mean, min(o) AS least FROM o GROUP BY ALL)
SELECT "group", count(*) AS n_queries, round(coalesce(any_value(mean), 0.0), 6) AS mean_overlap, round(coalesce(any_value(least), 0.0), 6) AS least_overlap, count(DISTINCT x[1]) = 1 AS agree, round(max(c) - min(c), 6) AS spread FROM g LEFT JOIN m USING ("group") GROUP BY "group" """
Q["benchmark_containment"] = lambda s, d: evaluate.contained(table(s, d, "benchmark").select(F.col("item_id").alias("left_id"), "text"), table(s, d, "documents").select(F.col("doc_id").alias("right_id"), "text"), 0.0).select(F.col("left_id").alias("item_id"), F.col("right_id").alias("doc_id"), "shared")
S["benchmark_containment"] = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM w), bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM b)
SELECT item_id, doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY ALL"""
Q["contained_passages"] = lambda s, d: evaluate.contained(table(s, d, "benchmark").select(F.col("item_id").alias("left_id"), "text"), table(s, d, "documents").select(F.col("doc_id").alias("right_id"), "text")).select(F.col("left_id").alias("item_id"), F.col("right_id").alias("doc_id"), "shared", F.round("share", 6).alias("share"))
S["contained_passages"] = S["benchmark_containment"].rsplit("\n", 1)[0] + f""", p AS (SELECT item_id, doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY ALL),
bn AS (SELECT item_id, count(*) AS a FROM bg GROUP BY item_id), dn AS (SELECT doc_id, count(*) AS b FROM dg GROUP BY doc_id)
SELECT item_id, doc_id, shared, round(shared / least(a, b)::DOUBLE, 6) AS share FROM p JOIN bn USING (item_id) JOIN dn USING (doc_id) WHERE shared / least(a, b)::DOUBLE > {evaluate.CONTAINED}"""
def passage_pairs(s: SparkSession, d: str) -> DataFrame:
    """Whole texts of a passage and each document that shares a run of eight words with it."""
    found = evaluate.contained(table(s, d, "benchmark").select(F.col("item_id").alias("left_id"), "text"), table(s, d, "documents").select(F.col("doc_id").alias("right_id"), "text"), 0.0).select("left_id", "right_id")
    items = table(s, d, "benchmark").select(F.col("item_id").alias("left_id"), F.col("text").alias("a"))
    return found.join(items, "left_id").join(table(s, d, "documents").select(F.col("doc_id").alias("right_id"), F.col("text").alias("b")), "right_id").select(F.col("left_id").alias("item_id"), F.col("right_id").alias("doc_id"), "a", "b")


_PASSAGES = S["benchmark_containment"].rsplit("\n", 1)[0] + """, pp AS (SELECT DISTINCT item_id, doc_id FROM bg JOIN dg USING (g)),
pt AS (SELECT pp.item_id, pp.doc_id, bb.text AS a, dd.text AS b FROM pp JOIN benchmark bb USING (item_id) JOIN documents dd USING (doc_id))"""
Q["token_jaccard"] = lambda s, d: passage_pairs(s, d).select("item_id", "doc_id", F.round(jaccard(F.split("a", " "), F.split("b", " ")), 6).alias("j"))
S["token_jaccard"] = f"{_PASSAGES} SELECT item_id, doc_id, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))::DOUBLE, 6) AS j FROM pt"
Q["declined_answers"] = lambda s, d: table(s, d, "conversations").filter("role = 'assistant'").groupBy(evaluate.declined(F.col("text")).alias("declined"), evaluate.llm_failed(F.col("text")).alias("failed")).agg(F.count("*").alias("n"))
_CUES = lambda cues: "(" + " OR ".join("contains(lower(text), '" + c.replace("'", "''") + "')" for c in cues) + ")"
S["declined_answers"] = f"SELECT {_CUES(evaluate.DECLINE_CUES)} OR ({_CUES(evaluate.HELP_DESK)} AND NOT regexp_matches(text, '(?i)(^|\\n)\\s*(?:\\d+[.)]|step\\s+\\d)') AND length(text) < 700) AS declined, {_CUES(evaluate.FAILURE_CUES)} AS failed, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL".replace("\\\\", "\\")
Q["answer_grounding"] = lambda s, d: passage_pairs(s, d).select("item_id", "doc_id", F.round(F.nanvl(evaluate.grounding(F.col("a"), F.col("b")), F.lit(-1.0)), 6).alias("grounding"))
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN (" + ", ".join(f"'{w}'" for w in evaluate.FILLER) + ")))"
S["answer_grounding"] = f"{_PASSAGES}, tt AS (SELECT item_id, doc_id, {_TERMS.format('a')} AS x, {_TERMS.format('b')} AS y FROM pt) SELECT item_id, doc_id, round(CASE WHEN len(x) < 8 THEN -1.0 ELSE len(list_intersect(x, y)) / len(x)::DOUBLE END, 6) AS grounding FROM tt"


def pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_extendedprice"), 0).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("a"), (F.col("l_suppkey") % 7).cast("double").alias("b"))


_PAIRS = "p AS (SELECT l_returnflag AS g, l_quantity::DOUBLE AS x, round(l_extendedprice)::DOUBLE AS y, l_linenumber::DOUBLE AS a, (l_suppkey % 7)::DOUBLE AS b FROM lineitem)"
Q["spearman"] = lambda s, d: evaluate.spearman(pairs(s, d), ["g"], "x", "y").select("g", F.round("rho", 6).alias("rho"))
S["spearman"] = f"WITH {_PAIRS}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM p) SELECT g, round(corr(rx, ry), 6) AS rho FROM r GROUP BY g"
Q["sign_test"] = lambda s, d: evaluate.sign_test(pairs(s, d)).select("wins", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("z", 6).alias("z"))
S["sign_test"] = f"WITH {_PAIRS}, c AS (SELECT count_if(a < b)::BIGINT AS wins, count_if(a <> b)::BIGINT AS n, avg(b - a) AS m FROM p) SELECT wins, n, round(m, 6) AS mean_diff, round((wins - n / 2) / sqrt(n / 4), 6) AS z FROM c"


def load(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select((F.col("user_id") % 4 * 10 + 10).alias("users"), (F.col("event_id") % 9 != 0).alias("ok"), F.lit(100.0).alias("wall_s"), F.when(F.col("event_id") % 9 == 0, (F.col("event_id") % 5) * 100 + 200).cast("int").alias("status"))


Q["load_summary"] = lambda s, d: evaluate.load_summary(load(s, d)).select("users", "requests", F.round("error_rate", 6).alias("error_rate"), F.round("throughput", 6).alias("throughput"))
S["load_summary"] = "SELECT user_id % 4 * 10 + 10 AS users, count(*) AS requests, round(avg((event_id % 9 = 0)::INT), 6) AS error_rate, round(count_if(event_id % 9 <> 0) / 100.0, 6) AS throughput FROM events GROUP BY 1"
Q["error_taxonomy"] = lambda s, d: table(s, d, "events").select(
    F.when(F.col("event_id") % 2 == 0, F.get(F.array(*map(F.lit, (429, 404, 500, 503, 200))), (F.col("event_id") % 5).cast("int"))).alias("status"),
    F.get(F.array(*map(F.lit, ("ReadTimeout", "ConnectTimeout", "PoolTimeout", "ConnectError", "ValueError"))), (F.col("event_id") % 5).cast("int")).alias("exception"),
).groupBy(evaluate.error_kind(F.col("status"), F.col("exception")).alias("kind")).agg(F.count("*").alias("n"))
S["error_taxonomy"] = """SELECT CASE WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_error' WHEN s >= 400 THEN 'other' WHEN e IN ('ReadTimeout', 'ConnectTimeout', 'PoolTimeout') THEN 'timeout' WHEN e = 'ConnectError' THEN 'connection' ELSE 'other' END AS kind, count(*) AS n
FROM (SELECT CASE WHEN event_id % 2 = 0 THEN [429, 404, 500, 503, 200][event_id % 5 + 1] END AS s, ['ReadTimeout', 'ConnectTimeout', 'PoolTimeout', 'ConnectError', 'ValueError'][event_id % 5 + 1] AS e FROM events) GROUP BY 1"""
Q["saturation"] = lambda s, d: evaluate.saturation(evaluate.load_summary(load(s, d)).withColumn("p95", F.col("users") / 3.0)).select("best_users", "plateau", "first_miss")
S["saturation"] = f"WITH l AS ({S['load_summary']}) SELECT arg_max(users, (throughput, -users)) AS best_users, coalesce((SELECT max(throughput) FROM l k WHERE k.users > (SELECT arg_max(users, (throughput, -users)) FROM l)) <= max(throughput), false) AS plateau, min(CASE WHEN users / 3.0 > 10 THEN users END) AS first_miss FROM l"
Q["workload"] = lambda s, d: evaluate.workload(table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("level"), (F.col("r_regionkey") * 10 + 10).cast("int").alias("users")), 3, 19).select(*[F.col(c).cast("long").alias(c) for c in ("level", "user", "request", "q_index")], "suffix")
S["workload"] = """SELECT r_regionkey::BIGINT AS level, u AS "user", q AS request, ((u * 3 + q + r_regionkey * 7) % 19)::BIGINT AS q_index, ' (ref ' || r_regionkey || '-' || u || '-' || q || ')' AS suffix FROM region, LATERAL (SELECT unnest(range(0, r_regionkey * 10 + 10)) AS u), (SELECT unnest(range(0, 3)) AS q)"""
Q["rate_limit"] = lambda s, d: streams.rate_limited(table(s, d, "events").select(F.col("user_id").alias("client"), "ts", "event_id"), 2, "1 hour").groupBy("client").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))
S["rate_limit"] = "SELECT user_id AS client, count_if(n <= 2)::BIGINT AS admitted, count_if(n > 2)::BIGINT AS rejected FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id"
Q["window_counts"] = lambda s, d: streams.window_counts(table(s, d, "events").select(F.col("user_id").alias("client"), "ts"), "1 hour")
S["window_counts"] = "SELECT user_id AS client, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2"
Q["null_frames"] = lambda s, d: streams.without_null_frames(table(s, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), F.concat(F.when(F.col("turn") % 2 == 0, F.lit(" data: null\r\n\r\n")).otherwise(F.lit("")), F.lit("data: x\r\n\n")).alias("text")))
S["null_frames"] = "SELECT conv_id AS stream, repeat('data: x' || chr(13) || chr(10) || chr(10), count(*)) AS text FROM conversations GROUP BY conv_id"
Q["cache_replay"] = lambda s, d: streams.cache_replay(table(s, d, "events").select(F.col("event_type").alias("cache"), F.unix_timestamp("ts").cast("double").alias("at"), F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("key")), 16, 3600.0)


def _run(s: SparkSession, d: str) -> ingest.Run:
    """All documents are ingested over a store that holds the multiples of three."""
    rows = articles(s, d).withColumn("updated_at", F.lit(2))
    stored = rows.filter("article_id % 3 = 0").select("article_id", "title", "url", "category", F.lit(1).alias("chunk_count"), F.col("text").alias("raw_content"), F.lit("old").alias("summary"), F.lit(1).alias("updated_at"), F.lit(None).cast("string").alias("llm_summary"), F.lit(None).cast("int").alias("llm_summary_at"))
    chunks = rows.select("article_id", F.explode(F.array(F.lit(0), F.lit(100_000))).alias("i")).select("article_id", F.concat(F.col("article_id").cast("string"), F.lit("_chunk_"), F.col("i").cast("string")).alias("chunk_id"))
    return ingest.run(rows, stored, chunks)


Q["ingest_report"] = lambda s, d: _run(s, d).report
Q["ingest_stale"] = lambda s, d: _run(s, d).stale.select("chunk_id")
S["ingest_stale"] = "SELECT doc_id || '_chunk_100000' AS chunk_id FROM documents WHERE trim(coalesce(text, '')) <> ''"
Q["store_summary"] = lambda s, d: ingest.store_summary(articles(s, d))
S["store_summary"] = "SELECT count(*) AS n, count(DISTINCT doc_id) AS articles, count(DISTINCT source) AS categories FROM documents"
Q["embed_texts"] = lambda s, d: table(s, d, "documents").select("doc_id", models.embedding(models.hashing_embedder())("text").alias("embedding"))
Q["pair_scores"] = lambda s, d: models.reranked(table(s, d, "benchmark").select(F.lit(0).alias("query_id"), F.col("item_id").alias("chunk_id"), F.array(F.lit("the on"), F.lit("and of")).alias("forms"), "text"), models.overlap_scorer)
Q["shared_words"] = lambda s, d: passage_pairs(s, d).select("item_id", "doc_id", F.size(evaluate.shared_words(F.col("a"), F.col("b"))).cast("long").alias("n"))
_WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 2)"
S["shared_words"] = f"{_PASSAGES} SELECT item_id, doc_id, len(list_distinct(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})))::BIGINT AS n FROM pt"
Q["little_law"] = lambda s, d: evaluate.little_law(table(s, d, "region").select((F.col("r_regionkey") * 10).cast("long").alias("users"), (F.col("r_regionkey") * 2).cast("double").alias("latency_s"))).select("users", F.round("throughput", 6).alias("throughput"))
S["little_law"] = "SELECT (r_regionkey * 10)::BIGINT AS users, CASE WHEN r_regionkey > 0 THEN round(r_regionkey * 10 / (r_regionkey * 2.0), 6) END AS throughput FROM region"


def _grid(s: SparkSession, d: str) -> DataFrame:
    rows = results(s, d).select("query_id", F.col("article_id").alias("chunk_id"), ((F.col("rank") * 37) % 11 / 11.0).alias("a"), ((F.col("rank") * 53) % 13 / 13.0).alias("b")).groupBy("query_id", "chunk_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    expected = cases(s, d).select("query_id", F.explode("expected").alias("chunk_id"))
    return evaluate.sweep(rows, expected, [0.0, 0.5, 1.0], 5)


Q["parameter_sweep"] = _grid
S["parameter_sweep"] = f"""WITH {_RESULTS}, c AS (SELECT query_id, article_id AS chunk_id, max(rank * 37 % 11 / 11.0) AS a, max(rank * 53 % 13 / 13.0) AS b FROM res GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY weight, query_id ORDER BY round(weight * a + (1 - weight) * b, 9) DESC, chunk_id) AS rank FROM c, (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS weight)),
h AS (SELECT weight, query_id, min(rank) AS first FROM m JOIN (SELECT query_id, unnest(expected) AS chunk_id FROM cas) e USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY ALL)
SELECT weight, count_if(first = 1)::BIGINT AS hits_at_1, count(*) AS hits_at_k FROM h GROUP BY weight"""
Q["score_parity"] = lambda s, d: evaluate.parity(table(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("item"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_quantity") + F.col("l_linenumber") * 1e-7).cast("double").alias("b"))).select(F.round("max_diff", 9).alias("max_diff"), "same_order", "ok")
S["score_parity"] = """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, (l_quantity + l_linenumber * 1e-7)::DOUBLE AS b FROM lineitem),
k AS (SELECT a, b, row_number() OVER (PARTITION BY l_orderkey ORDER BY a DESC, l_linenumber) AS ra, row_number() OVER (PARTITION BY l_orderkey ORDER BY b DESC, l_linenumber) AS rb FROM r)
SELECT round(max(abs(a - b)), 9) AS max_diff, bool_and(ra = rb) AS same_order, max(abs(a - b)) < 1e-5 AND bool_and(ra = rb) AS ok FROM k"""
