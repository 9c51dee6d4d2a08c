"""Queries of the catalogue, history, maintenance and metrics.

conversations are sessions and messages; documents are articles and chunks; events are measurements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as text_functions
from lodestone.operators import catalog, metrics

Q: dict = {}
S: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("turn").alias("created_at"), "role", F.coalesce("text", F.lit("")).alias("content"))


def sessions(s: SparkSession, d: str) -> DataFrame:
    return messages(s, d).groupBy("session_id").agg(F.max("message_id").alias("updated_at"), F.min_by("content", "created_at").alias("first")).select("session_id", "updated_at", F.when(F.col("session_id") % 3 == 0, F.lit("")).otherwise(text_functions.session_title(F.col("first"))).alias("title"))


_MESSAGES = "m AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, turn AS created_at, role, coalesce(text, '') AS content FROM conversations)"
_SESSIONS = _MESSAGES + """, s AS (SELECT session_id, max(message_id) AS updated_at, arg_min(content, created_at) AS f FROM m GROUP BY session_id),
ses AS (SELECT session_id, updated_at, CASE WHEN session_id % 3 = 0 THEN '' WHEN length(trim(f)) > 60 THEN regexp_replace(left(trim(f), 60), '(?s)^(.*) .*$', '\\1') || '…' ELSE trim(f) END AS title FROM s)"""

Q["session_transcript"] = lambda s, d: catalog.transcript(messages(s, d), 5).select("message_id", "role", "content")
S["session_transcript"] = f"WITH {_MESSAGES} SELECT message_id, role, content FROM m WHERE session_id = 5 ORDER BY created_at"
Q["session_titles"] = lambda s, d: sessions(s, d).select("session_id", "title")
S["session_titles"] = f"WITH {_SESSIONS} SELECT session_id, title FROM ses"
Q["recent_sessions"] = lambda s, d: catalog.recent_sessions(sessions(s, d), 20).select("session_id", "title", "updated_at")
S["recent_sessions"] = f"WITH {_SESSIONS} SELECT session_id, CASE WHEN title = '' THEN 'Chat session' ELSE title END AS title, updated_at FROM ses ORDER BY updated_at DESC LIMIT 20"
Q["history_window"] = lambda s, d: catalog.history_window(messages(s, d))
S["history_window"] = f"WITH {_MESSAGES} SELECT session_id, string_agg(role || ': ' || left(content, 500), chr(10) ORDER BY created_at) AS history FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS n FROM m) WHERE n <= 6 GROUP BY session_id"
Q["resolve_sessions"] = lambda s, d: catalog.resolved_sessions(table(s, d, "benchmark").select(F.col("item_id").alias("request_id"), (F.col("item_id") * 7 % 150).alias("session_id")), sessions(s, d))
S["resolve_sessions"] = "SELECT item_id AS request_id, CASE WHEN c.conv_id IS NULL THEN 'new-' || left(sha256(item_id::VARCHAR), 16) ELSE c.conv_id::VARCHAR END AS resolved_id, c.conv_id IS NULL AS created FROM benchmark b LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = b.item_id * 7 % 150"
def valid_messages(s: SparkSession, d: str) -> DataFrame:
    """Feedback and messages that may pass, and those that are put aside with the rules that they break."""
    rows = messages(s, d).select("message_id", "content", (F.col("message_id") % 7).alias("rating"))
    good, bad = catalog.quarantined(rows, ("length", catalog.valid_request(F.col("content"))), ("rating", catalog.valid_rating(F.col("rating"))))
    return good.groupBy(F.lit("").alias("broken")).agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n")))


Q["valid_messages"] = valid_messages
S["valid_messages"] = f"WITH {_MESSAGES} SELECT concat_ws(',', CASE WHEN length(content) NOT BETWEEN 1 AND 2000 THEN 'length' END, CASE WHEN message_id % 7 NOT BETWEEN 1 AND 5 THEN 'rating' END) AS broken, count(*) AS n FROM m GROUP BY 1"
Q["answer_stream"] = lambda s, d: messages(s, d).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("created_at", "content"))).getField("content"), "").alias("answer"))
S["answer_stream"] = f"WITH {_MESSAGES} SELECT session_id, string_agg(content, '' ORDER BY created_at) AS answer FROM m GROUP BY session_id"


def articles(s: SparkSession, d: str) -> DataFrame:
    """part as articles: brand as category (every seventh has none), size as the stated chunk count."""
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").cast("long").alias("article_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("category"), F.col("p_size").cast("long").alias("chunk_count"))


_ARTICLES = "a AS (SELECT p_partkey::BIGINT AS article_id, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS category, p_size::BIGINT AS chunk_count FROM part)"
Q["categories"] = lambda s, d: catalog.categories(articles(s, d))
S["categories"] = f"WITH {_ARTICLES} SELECT DISTINCT category FROM a WHERE category <> '' ORDER BY 1"
Q["article_page"] = lambda s, d: catalog.page(articles(s, d), ["title", "article_id"], 40, 20)[0].select("article_id", "title")
S["article_page"] = f"WITH {_ARTICLES} SELECT article_id, title FROM a ORDER BY title, article_id LIMIT 20 OFFSET 40"
Q["article_total"] = lambda s, d: catalog.page(articles(s, d), ["title"], 0, 20, F.col("category") == "Brand#13")[1]
S["article_total"] = f"WITH {_ARTICLES} SELECT count(*) AS total FROM a WHERE category = 'Brand#13'"
Q["batched_lookup"] = lambda s, d: catalog.lookup(articles(s, d), table(s, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").cast("long").alias("article_id")), "article_id").select("article_id", "title")
S["batched_lookup"] = f"WITH {_ARTICLES} SELECT article_id, title FROM a WHERE article_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"


def _stale(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("long").alias("article_id"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("x")).alias("llm_summary"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 0, F.expr("o_orderdate - interval 1 day")).otherwise(F.col("o_orderdate")).alias("llm_summary_at"),
    )
    return catalog.stale_summaries(rows).select("article_id")


Q["stale_summaries"] = _stale
S["stale_summaries"] = "SELECT o_orderkey::BIGINT AS article_id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 4 = 0"


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("chunk_id"), F.col("l_orderkey").cast("long").alias("article_id"))


Q["chunk_count_check"] = lambda s, d: catalog.chunk_counts(table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("article_id"), (F.col("o_orderkey") % 7 + 1).cast("long").alias("chunk_count")), _orders(s, d))
S["chunk_count_check"] = "SELECT o_orderkey::BIGINT AS article_id, (o_orderkey % 7 + 1)::BIGINT AS stated, coalesce(n, 0) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 7 + 1 <> coalesce(n, 0)"
Q["orphans"] = lambda s, d: catalog.orphans(_orders(s, d), table(s, d, "orders").filter("o_orderkey % 11 != 0").select(F.col("o_orderkey").cast("long").alias("article_id")), "article_id")
S["orphans"] = "WITH l AS (SELECT DISTINCT l_orderkey::BIGINT AS k FROM lineitem), r AS (SELECT o_orderkey::BIGINT AS k FROM orders WHERE o_orderkey % 11 <> 0) SELECT k AS article_id, 'left' AS side FROM l WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT k, 'right' FROM r WHERE k NOT IN (SELECT k FROM l)"
Q["stale_chunks"] = lambda s, d: catalog.stale_chunks(_orders(s, d), _orders(s, d).filter("article_id % 2 = 0 and chunk_id % 10 <= 3")).select("chunk_id")
S["stale_chunks"] = "WITH c AS (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS chunk_id, l_orderkey AS a FROM lineitem), r AS (SELECT * FROM c WHERE a % 2 = 0 AND chunk_id % 10 <= 3) SELECT chunk_id FROM c WHERE a IN (SELECT a FROM r) AND chunk_id NOT IN (SELECT chunk_id FROM r)"
Q["coverage_guard"] = lambda s, d: catalog.coverage_guard(_orders(s, d), _orders(s, d).filter("article_id % 3 = 0"))
S["coverage_guard"] = "SELECT count(DISTINCT l_orderkey) AS n_known, count(DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey END) AS n_run, count(DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey END) < 0.5 * count(DISTINCT l_orderkey) AS refused FROM lineitem"
Q["duplicate_bodies"] = lambda s, d: catalog.duplicates(table(s, d, "documents"), "doc_id", "text")
S["duplicate_bodies"] = "SELECT count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) - count(DISTINCT trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13))) AS duplicate_bodies, count_if(trim(coalesce(text, '')) = '')::BIGINT AS empty_bodies FROM documents"


def _upserted(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    cols = lambda f, extra: f.select(
        F.col("doc_id").alias("article_id"), F.col("lang").alias("title"), F.col("source").alias("url"), F.col("source").alias("category"), F.col("n_chars").alias("chunk_count"), F.col("text").alias("raw_content"), extra.alias("summary"), F.col("n_chars").alias("updated_at"),
        F.lit("kept").alias("llm_summary"), F.lit(1).alias("llm_summary_at"))
    # all documents are stored; a second crawl brings half of them again, and as many new ones
    old = cols(docs, F.lit("old"))
    new = cols(docs.withColumn("doc_id", F.col("doc_id") * 2).withColumn("lang", F.lit("new")), F.when(F.col("doc_id") % 4 == 0, "").otherwise("new"))
    return catalog.upsert_articles(old, new).select("article_id", "title", "summary", "llm_summary", F.char_length("raw_content").cast("long").alias("n"))


Q["upsert_articles"] = _upserted
S["upsert_articles"] = """WITH n AS (SELECT doc_id * 2 AS doc_id, text FROM documents)
SELECT coalesce(n.doc_id, o.doc_id) AS article_id, CASE WHEN n.doc_id IS NULL THEN o.lang ELSE 'new' END AS title, CASE WHEN n.doc_id % 4 <> 0 THEN 'new' WHEN o.doc_id IS NOT NULL THEN 'old' END AS summary,
 CASE WHEN o.doc_id IS NOT NULL THEN 'kept' END AS llm_summary, CASE WHEN n.doc_id IS NULL THEN length(o.text) ELSE least(50000, length(n.text)) END AS n FROM documents o FULL JOIN n ON o.doc_id = n.doc_id"""
Q["upsert_vectors"] = lambda s, d: catalog.upsert(
    table(s, d, "embeddings").select("vec_id", F.lit("old").alias("v"), F.lit(0).alias("at")),
    table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("vec_id"), F.concat(F.lit("new "), F.col("vec_id").cast("string")).alias("v"), F.col("vec_id").cast("int").alias("at")), "vec_id", "at", "text",
).select("vec_id", "v", "source_type")
S["upsert_vectors"] = "WITH n AS (SELECT vec_id // 2 AS vec_id, 'new ' || max(vec_id) AS v, 'text' AS source_type FROM embeddings GROUP BY 1) SELECT * FROM n UNION ALL SELECT vec_id, 'old', NULL FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n)"
Q["first_of_each"] = lambda s, d: catalog.first_of_each(table(s, d, "documents").select("source", "doc_id"), "source", "doc_id")
S["first_of_each"] = "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source"
Q["article_join"] = lambda s, d: catalog.with_article(
    table(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", (F.col("l_partkey") + 1).cast("long").alias("article_id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("own").alias("category"), F.lit("").alias("summary")),
    articles(s, d).select("article_id", "title", F.lit("url").alias("url"), "category", F.lit("s").alias("summary")),
).groupBy("category", "url", "summary").agg(F.count("*").alias("n"))
S["article_join"] = f"WITH {_ARTICLES} SELECT CASE WHEN a.article_id IS NULL OR a.category = '' THEN 'own' ELSE a.category END AS category, CASE WHEN a.article_id IS NULL THEN 'u' ELSE 'url' END AS url, CASE WHEN a.article_id IS NULL THEN '' ELSE 's' END AS summary, count(*) AS n FROM lineitem LEFT JOIN a ON a.article_id = l_partkey + 1 GROUP BY 1, 2, 3"


def _feedback(s: SparkSession, d: str) -> DataFrame:
    fb = table(s, d, "labels").select((F.col("doc_id") % 200 * 1000 + F.col("doc_id") % 10).alias("message_id"), (F.col("quality") * 4 + 1).alias("rating"))
    known, missing = catalog.feedback_events(fb, messages(s, d))
    return known.groupBy("event_type", "payload").agg(F.count("*").alias("n")).unionByName(missing.agg(F.lit("rejected").alias("event_type"), F.lit("").alias("payload"), F.count("*").alias("n")))


Q["feedback_events"] = _feedback
S["feedback_events"] = f"""WITH {_MESSAGES}, f AS (SELECT doc_id % 200 * 1000 + doc_id % 10 AS message_id, quality * 4 + 1 AS rating FROM labels)
SELECT 'feedback' AS event_type, '{{"rating":' || rating || '}}' AS payload, count(*) AS n FROM f JOIN m USING (message_id) GROUP BY rating
UNION ALL SELECT 'rejected', '', count(*) FROM f WHERE message_id NOT IN (SELECT message_id FROM m)"""


def measured(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


Q["counters"] = lambda s, d: metrics.counters(measured(s, d).select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("labels"), F.lit(1).alias("value"))).select("name", "labels", F.col("value").cast("long").alias("value"))
S["counters"] = """SELECT 'events_total' AS name, 'a="' || (user_id % 3) || '",type="' || event_type || '"' AS labels, count(*) AS value FROM events GROUP BY 1, 2"""
Q["gauges"] = lambda s, d: metrics.gauges(measured(s, d).select(F.lit("last").alias("name"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), F.round("value", 6).alias("value"), "ts", F.col("event_id").alias("seq")))
S["gauges"] = """SELECT 'last' AS name, 'type="' || event_type || '"' AS labels, arg_max(round(value, 6), (ts, event_id)) AS value FROM events GROUP BY event_type"""
Q["histogram"] = lambda s, d: metrics.histogram(measured(s, d), ["event_type"], "value").select("event_type", F.coalesce("le", F.lit(-1.0)).alias("le"), "cumulative", "count", F.round("sum", 3).alias("sum"))
S["histogram"] = f"""SELECT event_type, coalesce(le, -1.0)::DOUBLE AS le, count_if(le IS NULL OR value <= le)::BIGINT AS cumulative, count(value) AS count, round(sum(value), 3) AS sum
 FROM events, (SELECT unnest([{', '.join(map(str, metrics.BUCKETS))}, NULL])::DOUBLE AS le) WHERE value IS NOT NULL GROUP BY event_type, le"""
Q["histogram_p95"] = lambda s, d: metrics.interpolated_quantile(metrics.histogram(measured(s, d), ["event_type"], "value"), ["event_type"], 0.95).select("event_type", F.round("quantile", 6).alias("p95"))
S["histogram_p95"] = f"""WITH h AS (SELECT event_type, coalesce(le, 'inf'::DOUBLE) AS le, count_if(le IS NULL OR value <= le) AS c FROM events, (SELECT unnest([{', '.join(map(str, metrics.BUCKETS))}, NULL])::DOUBLE AS le) GROUP BY ALL),
 w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(c) OVER o, 0) AS under, max(c) OVER (PARTITION BY event_type) AS n FROM h WINDOW o AS (PARTITION BY event_type ORDER BY le))
 SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (0.95 * n - under) / (c - under) END, 6) AS p95 FROM w WHERE c >= 0.95 * n AND under < 0.95 * n"""
Q["metric_snapshot"] = lambda s, d: metrics.snapshot(measured(s, d), ["event_type"], "value").select("event_type", "count", F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"))
S["metric_snapshot"] = "SELECT event_type, count(value) AS count, round(sum(value), 3) AS sum, round(avg(value), 6) AS mean FROM events GROUP BY event_type"
_SORTED = "WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, round(v[greatest(1, least(n, {0}))], 6) AS percentile FROM l"
for _name, _f, _sql in (
    ("percentile_nearest", lambda r: metrics.percentile_nearest(r, ["event_type"], "value", 95), "round_even(0.95 * n + 0.5, 0)::BIGINT"),
    ("percentile_floor", lambda r: metrics.percentile_floor(r, ["event_type"], "value"), "floor(0.95 * n)::BIGINT + 1"),
    ("percentile_before", lambda r: metrics.percentile_before(r, ["event_type"], "value"), "floor(0.95 * n)::BIGINT"),
):
    Q[_name] = lambda s, d, f=_f: f(measured(s, d)).select("event_type", F.round("percentile", 6).alias("percentile"))
    S[_name] = _SORTED.format(_sql)
Q["percentile_linear"] = lambda s, d: metrics.percentile_linear(measured(s, d), ["event_type"], "value").select("event_type", F.round("percentile", 6).alias("percentile"))
S["percentile_linear"] = "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS percentile FROM events GROUP BY event_type"
Q["summary_statistics"] = lambda s, d: metrics.summary(measured(s, d), ["event_type"], "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev", "least", "most")])
S["summary_statistics"] = "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type"


def traces(s: SparkSession, d: str) -> DataFrame:
    value = F.coalesce("value", F.lit(0.0)).cast("double")
    return measured(s, d).select(
        F.when(F.col("event_id") % 4 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("event_type", F.lit("x"))).alias("intents"),
        (F.col("event_id") % 3 == 0).alias("cache_hit"), (F.col("event_id") % 5 != 0).alias("understood"), ((F.col("event_id") % 100) / 100.0 >= 0.35).alias("passed"),
        ((F.col("event_id") % 100) / 100.0).alias("confidence"), (F.col("event_id") % 9).alias("n_final"), value.alias("total_ms"),
        F.create_map(F.lit("vector"), value * 0.5, F.lit("rerank"), value * 0.25).alias("timings"))


def trace_fan_out(s: SparkSession, d: str) -> DataFrame:
    rows = metrics.trace_counters(traces(s, d)).unionByName(metrics.trace_observations(traces(s, d)))
    return rows.groupBy("name", "labels").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


Q["trace_fan_out"] = trace_fan_out
_TRACES = """t AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'none' ELSE event_type END AS i, CASE WHEN event_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS r, event_id % 5 <> 0 AS u, event_id % 100 / 100.0 >= 0.35 AS p,
  coalesce(value, 0)::DOUBLE AS ms, (event_id % 100 / 100.0)::DOUBLE AS conf, (event_id % 9)::DOUBLE AS k FROM events),
c AS (SELECT 'rag_queries_total' AS name, 'cache="' || r || '",intent="' || i || '"' AS labels, 1.0::DOUBLE AS value FROM t UNION ALL SELECT 'rag_cache_total', 'result="' || r || '"', 1.0 FROM t
  UNION ALL SELECT 'rag_query_understood_total', '', 1.0 FROM t WHERE u UNION ALL SELECT 'rag_below_threshold_total', 'intent="' || i || '"', 1.0 FROM t WHERE NOT p),
o AS (SELECT 'rag_request_duration_ms' AS name, 'intent="' || i || '"' AS labels, ms AS value FROM t UNION ALL SELECT 'rag_stage_duration_ms', 'stage="vector"', ms * 0.5 FROM t UNION ALL SELECT 'rag_stage_duration_ms', 'stage="rerank"', ms * 0.25 FROM t
  UNION ALL SELECT 'rag_confidence', '', conf FROM t UNION ALL SELECT 'rag_chunks_returned', '', k FROM t)"""
S["trace_fan_out"] = f"WITH {_TRACES} SELECT name, labels, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT * FROM c UNION ALL SELECT * FROM o) GROUP BY name, labels"


def exposition(s: SparkSession, d: str) -> DataFrame:
    return metrics.exposition(metrics.trace_counters(traces(s, d)).groupBy("name", "labels").agg(F.sum("value").alias("value")), None, metrics.trace_histograms(metrics.trace_observations(traces(s, d))), metrics.TRACE_HELP, 12.5)


Q["exposition"] = lambda s, d: exposition(s, d).select("kind", "name", "labels", "place", "line")
_HELP = " ".join(f"WHEN '{n}' THEN '{h}'" for n, h in metrics.TRACE_HELP.items())
_BOUNDS = " ".join(f"WHEN '{n}' THEN [{', '.join(map(str, b))}, 'inf'::DOUBLE]" for n, b in metrics.TRACE_BUCKETS.items())
_BRACED = "CASE WHEN {0} <> '' THEN '{{' || {0} || '}}' ELSE '' END"
S["exposition"] = f"""WITH {_TRACES}, cs AS (SELECT name, labels, sum(value) AS value FROM c GROUP BY ALL),
hb AS (SELECT name, labels, le, count(*) FILTER (WHERE value <= le) AS n FROM (SELECT o.*, unnest(CASE name {_BOUNDS} END) AS le FROM o) GROUP BY ALL),
hs AS (SELECT name, labels, sum(value) AS total, count(*) AS n FROM o GROUP BY ALL)
SELECT 0 AS kind, name, '' AS labels, -1 AS place, '# HELP ' || name || ' ' || CASE name {_HELP} END || chr(10) || '# TYPE ' || name || ' counter' AS line FROM (SELECT DISTINCT name FROM cs)
UNION ALL SELECT 0, name, labels, 0, name || {_BRACED.format('labels')} || ' ' || printf('%g', value) FROM cs
UNION ALL SELECT 2, name, '', -1, '# HELP ' || name || ' ' || CASE name {_HELP} END || chr(10) || '# TYPE ' || name || ' histogram' FROM (SELECT DISTINCT name FROM hs)
UNION ALL SELECT 2, name, labels, row_number() OVER (PARTITION BY name, labels ORDER BY le)::INT,
  name || '_bucket{{' || CASE WHEN labels <> '' THEN labels || ',' ELSE '' END || 'le="' || CASE WHEN isinf(le) THEN '+Inf' ELSE printf('%g', le) END || '"}} ' || n FROM hb
UNION ALL SELECT 2, name, labels, 1000, name || '_sum' || {_BRACED.format('labels')} || ' ' || printf('%g', total) FROM hs
UNION ALL SELECT 2, name, labels, 1001, name || '_count' || {_BRACED.format('labels')} || ' ' || n FROM hs
UNION ALL SELECT 3, 'rag_uptime_seconds', '', -1, '# HELP rag_uptime_seconds {metrics.UPTIME_HELP}' || chr(10) || '# TYPE rag_uptime_seconds gauge'
UNION ALL SELECT 3, 'rag_uptime_seconds', '', 0, 'rag_uptime_seconds 12.5'"""
Q["exposition_scan"] = lambda s, d: metrics.parse_exposition(exposition(s, d).filter("kind = 0").select(F.explode(F.split("line", "\n")).alias("value"))).select("series", F.col("value").cast("long").alias("value"))
S["exposition_scan"] = f"WITH {_TRACES} SELECT name || {_BRACED.format('labels')} AS series, count(*) AS value FROM c GROUP BY name, labels"


def users(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.col("c_name"), F.lit("@example.org")).alias("email"), (F.col("c_custkey") % 5 != 0).alias("is_active"))


Q["user_lookup"] = lambda s, d: catalog.users_by(users(s, d), table(s, d, "orders").select((F.col("o_custkey") * 2).alias("user_id")), "user_id").select("key", "email", "found", "active")
S["user_lookup"] = "SELECT w.k AS key, CASE WHEN c_custkey IS NOT NULL THEN c_name || '@example.org' END AS email, c_custkey IS NOT NULL AS found, coalesce(c_custkey % 5 <> 0, false) AS active FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders) w LEFT JOIN customer ON c_custkey = w.k"


def images(s: SparkSession, d: str) -> DataFrame:
    """Parts stand for images; their makers for articles."""
    return table(s, d, "part").select(F.col("p_partkey").alias("image_id"), F.concat("p_name", F.lit(".png")).alias("filename"), F.col("p_brand").alias("article_id"), F.col("p_type").alias("caption"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/i/"), F.col("p_name"))).alias("static_path"))


Q["image_page"] = lambda s, d: catalog.image_page(images(s, d), None, 20, 30)[0].select("image_id", "filename", "article_id")
S["image_page"] = "SELECT p_partkey AS image_id, p_name || '.png' AS filename, p_brand AS article_id FROM part ORDER BY p_partkey LIMIT 30 OFFSET 20"
Q["image_totals"] = lambda s, d: catalog.image_page(images(s, d), "Brand#1", 0, 5)[1].unionByName(catalog.image_page(images(s, d))[1])
S["image_totals"] = "SELECT count(*) AS total FROM part WHERE p_brand = 'Brand#1' UNION ALL SELECT count(*) FROM part"
Q["image_join"] = lambda s, d: catalog.with_image(
    table(s, d, "lineitem").select((F.col("l_partkey") * 2).alias("image_id"), F.lit("x.png").alias("filename"), F.lit("own").alias("caption"), F.lit(None).cast("string").alias("static_path")), images(s, d),
).groupBy("image_id", "filename", "caption", "static_path").agg(F.count("*").alias("n"))
S["image_join"] = """WITH i AS (SELECT p_partkey AS image_id, p_name || '.png' AS filename, p_type AS caption, CASE WHEN p_partkey % 3 = 0 THEN '/i/' || p_name END AS static_path FROM part), l AS (SELECT l_partkey * 2 AS image_id FROM lineitem)
SELECT l.image_id, coalesce(i.filename, 'x.png') AS filename, coalesce(i.caption, 'own') AS caption, coalesce(i.static_path, '/static/images/' || coalesce(i.filename, 'x.png')) AS static_path, count(*) AS n FROM l LEFT JOIN i USING (image_id) GROUP BY ALL"""
Q["fresh_images"] = lambda s, d: catalog.fresh_images(images(s, d).select((F.col("image_id") * 2).alias("image_id"), F.lit("local").alias("origin")), images(s, d).select("image_id", F.lit("crawled").alias("origin")))
S["fresh_images"] = "SELECT p_partkey AS image_id, 'crawled' AS origin FROM part UNION ALL SELECT p_partkey * 2, 'local' FROM part WHERE p_partkey * 2 NOT IN (SELECT p_partkey FROM part)"


def store_dimension(s: SparkSession, d: str) -> DataFrame:
    """Whether vectors have 64 numbers, 65 numbers, and what an empty store says."""
    rows = table(s, d, "embeddings")
    checks = catalog.dimension_check(rows, "embedding", 64).unionByName(catalog.dimension_check(rows, "embedding", 65)).unionByName(catalog.dimension_check(rows.filter("false"), "embedding", 64))
    return checks.select(F.coalesce(F.col("ok").cast("string"), F.lit("unknown")).alias("ok"))


Q["store_dimension"] = store_dimension
S["store_dimension"] = "SELECT (len(embedding) = 64)::VARCHAR AS ok FROM embeddings WHERE vec_id = 0 UNION ALL SELECT 'false' UNION ALL SELECT 'unknown'"
