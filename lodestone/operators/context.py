"""From chosen chunks to cited, reading-order context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import or_else, strip

# The wording of the context.
NO_CONTEXT = (
    "No articles were retrieved from the knowledge base for this question — the retrieval step returned nothing. "
    "You have no context to answer from, so decline per rule 9."
)
IMAGES = (
    "These images are displayed to the user directly below your answer. Refer to them naturally where they help "
    '(e.g. "see the screenshot below"). Do NOT mention or promise any image that is not in this list.'
)
NO_IMAGES = "No images accompany this answer. Do not mention, promise, or refer to screenshots or images."
UNTITLED, GENERAL = "Untitled article", "General"
GAP = "[…]"
HEADER = r"^\[[^\]]*\]\n"


def citations(final: DataFrame) -> DataFrame:
    """The first chunk of each article in rank order (not the one with the best score)."""
    w = Window.partitionBy("query_id", "article_id").orderBy("final_rank")
    first = final.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.withColumn("citation", F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank")))


def group_adjacent(final: DataFrame) -> DataFrame:
    """Runs of neighbouring chunks of an article as one row, at the place and with the scores of its best member.

    Islands are found by index minus rank over distinct indices; a repeated index
    stays with its run's first member's text only once.
    """
    by = ["query_id", "article_id"]
    ranked = final.withColumn("_d", F.dense_rank().over(Window.partitionBy(*by).orderBy("chunk_index")))
    ranked = ranked.withColumn("_island", F.col("chunk_index") - F.col("_d"))
    w = Window.partitionBy(*by, "_island").orderBy("chunk_index", "final_rank")
    parts = ranked.withColumn("_n", F.row_number().over(w)).withColumn("_body", F.when(F.col("_n") == 1, F.col("text")).otherwise(F.regexp_replace("text", HEADER, "")))
    grouped = parts.groupBy(*by, "_island").agg(
        F.min("final_rank").alias("final_rank"), F.min_by("score", "final_rank").alias("score"), F.min("chunk_index").alias("chunk_index"),
        F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("_n", "_body"))).alias("p"),
    )
    kept = F.filter(F.col("p._body"), lambda t: strip(t) != "")
    return grouped.select(*by, "final_rank", "score", "chunk_index", "n_chunks", F.array_join(kept, "\n\n").alias("text"))


def _listed(*order: str):
    """The collected pieces of a group in order."""
    return F.array_sort(F.collect_list(F.struct(*order)))


def context_by_article(final: DataFrame) -> DataFrame:
    """query_id, context: articles by first appearance, their chunks by index, a gap mark where an index is missing."""
    by = Window.partitionBy("query_id", "article_id")
    placed = final.withColumn("_at", F.min("final_rank").over(by)).withColumn("_prev", F.lag("chunk_index").over(by.orderBy("chunk_index", "final_rank")))
    body = F.nullif(strip(F.regexp_replace("text", HEADER, "")), F.lit(""))
    gap = F.when(F.col("_prev").isNotNull() & (F.col("chunk_index") != F.col("_prev") + 1), F.lit(GAP))
    articles = placed.withColumn("_piece", F.concat_ws("\n\n", gap, body)).groupBy("query_id", "article_id", "_at").agg(
        *[F.min_by(c, F.struct("chunk_index", "final_rank")).alias(c) for c in ("title", "category", "url", "summary")],
        F.array_join(F.filter(_listed("chunk_index", "final_rank", "_piece").getField("_piece"), lambda p: p != ""), "\n\n").alias("body"),
    )
    numbered = articles.withColumn("_no", F.row_number().over(Window.partitionBy("query_id").orderBy("_at")))
    overview = F.when(or_else(F.col("summary"), F.lit(None)).isNotNull(), F.concat(F.lit("Overview: "), F.col("summary"), F.lit("\n\n"))).otherwise(F.lit(""))
    block = F.concat(
        F.lit("--- Article "), F.col("_no").cast("string"), F.lit(": "), or_else(F.col("title"), F.lit(UNTITLED)),
        F.lit("\nCategory: "), or_else(F.col("category"), F.lit(GENERAL)), F.lit("\n"), overview, F.col("body"),
        F.lit("\nSource: "), F.coalesce("url", F.lit("")), F.lit("\n---"),
    )
    return numbered.withColumn("_block", block).groupBy("query_id").agg(F.array_join(_listed("_no", "_block").getField("_block"), "\n").alias("context"))


def context_by_chunk(final: DataFrame) -> DataFrame:
    """query_id, context: chunks in rank order; an article's summary only at its first."""
    has = F.coalesce("summary", F.lit("")) != ""
    w = Window.partitionBy("query_id", "article_id").orderBy("final_rank")
    overview = F.when(has & (F.row_number().over(w) == 1), F.concat(F.lit("Article overview: "), F.col("summary"), F.lit("\n"))).otherwise(F.lit(""))
    block = F.concat(
        F.lit("---\nArticle: "), or_else(F.col("title"), F.lit(UNTITLED)), F.lit("\nCategory: "), or_else(F.col("category"), F.lit(GENERAL)),
        F.lit("\nSource: "), F.coalesce("url", F.lit("")), F.lit("\n"), overview, F.lit("Content: "), F.col("text"), F.lit("\n---"),
    )
    return final.select("query_id", "final_rank", block.alias("_block")).groupBy("query_id").agg(F.array_join(_listed("final_rank", "_block").getField("_block"), "\n").alias("context"))


def with_sentinel(queries: DataFrame, context: DataFrame) -> DataFrame:
    return queries.select("query_id").join(context, "query_id", "left").select("query_id", or_else(F.col("context"), F.lit(NO_CONTEXT)).alias("context"))


def image_context(images: DataFrame) -> DataFrame:
    """query_id, images: a note and one line an image; fillers of the ingest give way to the category."""
    caption = strip(F.coalesce(or_else(F.col("caption"), F.col("alt_text")), F.lit("")))
    filler = (caption == "") | F.lower(caption).startswith("image from article")
    shown = F.when(filler, F.concat(F.lit("Screenshot from "), or_else(F.col("category"), F.lit("the knowledge base")))).otherwise(caption)
    source = F.when(F.coalesce(F.col("article_id").cast("string"), F.lit("")) != "", F.concat(F.lit(" (from article "), F.col("article_id").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    lines = images.select("query_id", "rank", F.concat(F.lit("- "), shown, source).alias("_line")).groupBy("query_id").agg(_listed("rank", "_line").getField("_line").alias("l"))
    return lines.select("query_id", F.array_join(F.concat(F.array(F.lit(IMAGES), F.lit("")), F.col("l")), "\n").alias("images"))


def user_prompt(context: Column, images: Column, history: Column, question: Column, instruction: str = "") -> Column:
    """The user's message: what was retrieved, what is shown, what was said, what is asked."""
    parts = [
        F.concat(F.lit("Retrieved Knowledge Base Context:\n"), context), F.concat(F.lit("Images Shown To The User:\n"), or_else(images, F.lit(NO_IMAGES))),
        F.concat(F.lit("Conversation History:\n"), history), F.concat(F.lit("User Question: "), question),
    ]
    return F.concat_ws("\n\n", *parts, *([F.lit(instruction)] if instruction else []))


def single_prompt(system: Column, user: Column) -> Column:
    """For models that take no roles."""
    return F.concat_ws("\n\n", system, user)
