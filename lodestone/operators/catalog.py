"""Catalogue, history and store maintenance: filters, pages, lookups, upserts, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import or_else, strip

# Fixed values of the catalogue.
RAW_CONTENT, PREVIEW, HISTORY_TURNS, HISTORY_CHARS = 50_000, 200, 6, 500
NO_HISTORY = "No previous conversation."
DEFAULT_TITLE, DEFAULT_CATEGORY = "Chat session", "General"
MIN_COVERAGE = 0.5


def transcript(messages: DataFrame, session: Column | int) -> DataFrame:
    return messages.filter(F.col("session_id") == session).orderBy("created_at", "message_id")


def recent_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The n sessions updated last; a top-k, so no full sort."""
    return sessions.withColumn("title", or_else(F.col("title"), F.lit(DEFAULT_TITLE))).orderBy(F.desc("updated_at"), "session_id").limit(min(n, 100))


def page(rows: DataFrame, order: list, offset: int, limit: int, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One page in order, and the one-row total of what it is a page of."""
    kept = rows if where is None else rows.filter(where)
    return kept.orderBy(*order).offset(offset).limit(min(limit, 200)), kept.agg(F.count("*").alias("total"))


def categories(articles: DataFrame) -> DataFrame:
    return articles.select("category").filter("category is not null and category != ''").distinct().orderBy("category")


def history_window(messages: DataFrame, turns: int = HISTORY_TURNS, chars: int = HISTORY_CHARS) -> DataFrame:
    """session_id, history: the newest turns in order, each `role: content` cut short."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    last = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= turns)
    line = F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, chars))
    return last.groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), line.alias("l")))).getField("l"), "\n").alias("history")
    )


def history_or_none(sessions: DataFrame, history: DataFrame) -> DataFrame:
    return sessions.select("session_id").join(history, "session_id", "left").select("session_id", or_else(F.col("history"), F.lit(NO_HISTORY)).alias("history"))


def stale_summaries(articles: DataFrame, ids: DataFrame | None = None, force: bool = False, limit: int | None = None) -> DataFrame:
    """Articles whose generated summary is missing or older than the article; or those named, or all."""
    if ids is not None:
        out = articles.join(ids, "article_id", "left_semi")
    elif force:
        out = articles
    else:
        out = articles.filter(F.col("llm_summary").isNull() | F.col("llm_summary_at").isNull() | (F.col("llm_summary_at") < F.col("updated_at")))
    out = out.orderBy(F.col("article_id").cast("string"))
    return out if limit is None else out.limit(limit)


def best_summary(llm: Column, extractive: Column) -> Column:
    return or_else(llm, extractive)


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the distinct, non-empty ids."""
    wanted = ids.select(F.col(key)).filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").distinct()
    return rows.join(wanted, key, "left_semi")


def with_article(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """chunks with the article's title, url, category and summary where it is known, their own values where not."""
    a = articles.select(F.col("article_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("title", "url", "category", "summary")])
    joined = chunks.join(a, F.col("article_id") == F.col("_id"), "left")
    known = F.col("_id").isNotNull()
    return joined.select(
        *[c for c in chunks.columns if c not in ("title", "url", "category", "summary")],
        F.when(known, F.col("_title")).otherwise(F.col("title")).alias("title"), F.when(known, F.col("_url")).otherwise(F.col("url")).alias("url"),
        F.when(known, or_else(F.col("_category"), F.col("category"))).otherwise(F.col("category")).alias("category"),
        F.when(known, F.coalesce("_summary", F.lit(""))).otherwise(F.lit("")).alias("summary"),
    )


def with_image(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """images with display fields; static_path falls back to the folder's convention."""
    m = metadata.select(F.col("image_id").alias("_id"), F.col("static_path").alias("_path"), F.col("caption").alias("_caption"), F.col("filename").alias("_name"))
    joined = images.join(m, F.col("image_id") == F.col("_id"), "left")
    name = F.coalesce("_name", "filename")
    return joined.select(*[c for c in images.columns if c not in ("static_path", "caption", "filename")], name.alias("filename"), F.coalesce("_caption", "caption").alias("caption"), or_else(F.col("_path"), F.concat(F.lit("/static/images/"), name)).alias("static_path"))


def image_path(static_path: Column, filepath: Column) -> Column:
    return or_else(static_path, filepath)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None, source_type: str | None = None) -> DataFrame:
    """new replaces old by key; of new rows with one key the last by `order` counts (any, without an order).

    source_type stamps the new rows.  Write the result to a new version, never over what it reads.
    """
    if order is None:
        once = new.dropDuplicates([key])
    else:
        once = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    stamped = once.withColumn("source_type", F.lit(source_type)) if source_type is not None else once
    return stamped.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def fresh_images(local: DataFrame, crawled: DataFrame) -> DataFrame:
    """All crawled images, and local ones that were not crawled."""
    return crawled.unionByName(local.join(crawled.select("image_id"), "image_id", "left_anti"), allowMissingColumns=True)


def image_page(images: DataFrame, article_id: str | None = None, skip: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of images in order of image_id, all or those of an article, and one row with their number."""
    chosen = images if article_id is None else images.filter(F.col("article_id") == article_id)
    return chosen.orderBy("image_id").offset(skip).limit(limit), chosen.agg(F.count("*").alias("total"))


def users_by(users: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, user_id, email, found, active of the wanted keys (`email` or `user_id`), each named once; e-mails are compared exactly."""
    u = users.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("user_id", "email", "is_active")])
    j = wanted.select(key).distinct().join(u, F.col(key) == F.col("_key"), "left")
    return j.select(F.col(key).alias("key"), F.col("_user_id").alias("user_id"), F.col("_email").alias("email"), F.col("_key").isNotNull().alias("found"), F.coalesce("_is_active", F.lit(False)).alias("active"))


def upsert_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Articles by article_id: raw content is cut, an empty new summary keeps the old one, generated summaries stay."""
    n = new.select("article_id", *[F.col(c).alias(f"n_{c}") for c in ("title", "url", "category", "chunk_count", "raw_content", "summary", "updated_at")], F.lit(True).alias("_new"))
    j = old.join(n, "article_id", "full_outer")
    took = F.col("_new").isNotNull()
    plain = ["title", "url", "category", "chunk_count", "updated_at"]
    return j.select(
        "article_id", *[F.when(took, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in plain],
        F.when(took, F.substring("n_raw_content", 1, RAW_CONTENT)).otherwise(F.col("raw_content")).alias("raw_content"),
        or_else(F.col("n_summary"), F.col("summary")).alias("summary"), "llm_summary", "llm_summary_at",
    )


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def stale_chunks(stored: DataFrame, run: DataFrame) -> DataFrame:
    """Stored chunks of articles that this run wrote, but that it did not write."""
    return stored.join(run.select("article_id").distinct(), "article_id", "left_semi").join(run.select("chunk_id"), "chunk_id", "left_anti")


def coverage_guard(known: DataFrame, run: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """One row: n_known, n_run, refused: a forced run that found nothing, or too few of the known articles."""
    k = known.agg(F.countDistinct("article_id").alias("n_known"))
    r = run.agg(F.countDistinct("article_id").alias("n_run"))
    return k.crossJoin(r).withColumn("refused", (F.col("n_run") == 0) | (F.col("n_run") < least * F.col("n_known")))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def duplicates(rows: DataFrame, id_: str, body: str) -> DataFrame:
    """One row: repeated ids, repeated stripped bodies, empty bodies.  Bodies are counted by their MD5 before the shuffle; a null id repeats another."""
    text = F.md5(strip(F.coalesce(F.col(body), F.lit(""))))
    keys = rows.select(F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col(id_).cast("string").alias("key")), F.struct(F.lit("body").alias("kind"), text.alias("key")))).alias("k")).select("k.*")
    counted = keys.groupBy("kind", "key").agg(F.count("*").alias("n"))
    again = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n") - F.when(F.col("key").isNull(), 0).otherwise(1))), F.lit(0))
    empty = F.coalesce(F.sum(F.when((F.col("kind") == "body") & (F.col("key") == F.md5(F.lit(""))), F.col("n"))), F.lit(0))
    return counted.agg(again("id").alias("duplicate_ids"), again("body").alias("duplicate_bodies"), empty.alias("empty_bodies"))


def chunk_counts(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """article_id, stated, actual where they differ."""
    actual = chunks.groupBy("article_id").agg(F.count("*").alias("actual"))
    j = articles.select("article_id", F.col("chunk_count").alias("stated")).join(actual, "article_id", "left").na.fill(0, ["actual"])
    return j.filter("stated != actual")


def feedback_events(feedback: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analytics rows of feedback on known messages, and the feedback that names none."""
    m = messages.select(F.col("message_id").alias("_m"), "session_id")
    known = feedback.join(m, F.col("message_id") == F.col("_m"))
    events = known.select(F.lit("feedback").alias("event_type"), "session_id", F.to_json(F.struct("rating")).alias("payload"))
    return events, feedback.join(m, F.col("message_id") == F.col("_m"), "left_anti")


def resolved_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests with resolved_id (a known session's or a new one derived from the request) and created."""
    s = sessions.select(F.col("session_id").alias("_s"))
    j = requests.join(s, F.col("session_id") == F.col("_s"), "left")
    fresh = F.concat(F.lit("new-"), F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 16))
    return j.select("request_id", F.coalesce(F.col("_s").cast("string"), fresh).alias("resolved_id"), F.col("_s").isNull().alias("created"))


def valid_request(message: Column) -> Column:
    return F.coalesce(F.char_length(message).between(1, 2000), F.lit(False))


def valid_rating(rating: Column) -> Column:
    return F.coalesce(rating.between(1, 5), F.lit(False))


def quarantined(rows: DataFrame, *rules: tuple[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that meet all rules, and the others with the names of the rules that they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return rows.filter(F.size(broken) == 0), rows.withColumn("broken", broken).filter(F.size("broken") > 0)


def chat_event(message: Column, confidence: Column) -> Column:
    return F.to_json(F.struct(F.substring(message, 1, PREVIEW).alias("message"), confidence.alias("confidence")))


def dimension_check(vectors: DataFrame, embedding: str, expected: int) -> DataFrame:
    """One row: ok, whether the store's vectors have the expected size; null for an empty store."""
    return vectors.agg(F.bool_and(F.size(embedding) == expected).alias("ok"))
