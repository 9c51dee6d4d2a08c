"""An ingest run as DataFrames: articles to chunks, summaries and vectors, what to write, what to prune, and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import catalog, chunking, models, summarize


@dataclass
class Run:
    """articles and chunks to write, stale chunks to remove, and one row of counters."""

    articles: DataFrame
    chunks: DataFrame
    stale: DataFrame
    report: DataFrame


def vector_records(chunks: DataFrame, load, kind: str = "text") -> DataFrame:
    """id, document, embedding and the few metadata that the vector store keeps."""
    return chunks.select(
        F.col("chunk_id").alias("id"), F.col("text").alias("document"), models.embedding(load)("text").alias("embedding"), F.col("article_id").cast("string").alias("article_id"),
        "chunk_index", F.coalesce(F.nullif("category", F.lit("")), F.lit(catalog.DEFAULT_CATEGORY)).alias("category"), F.lit(kind).alias("source_type"),
    )


def run(articles: DataFrame, stored_articles: DataFrame, stored_chunks: DataFrame, size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP) -> Run:
    """Plan of a run over crawled articles (article_id, title, category, url, text, updated_at)."""
    chunks = chunking.chunk_articles(articles, size, overlap)
    counts = chunks.groupBy("article_id").agg(F.count("*").alias("chunk_count"))
    short = summarize.summarize(articles.select(F.col("article_id").alias("doc_id"), "text", "title")).withColumnRenamed("doc_id", "article_id")
    rows = articles.join(counts, "article_id", "left").join(short, "article_id", "left").select(
        "article_id", "title", "url", "category", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.col("text").alias("raw_content"), "summary", "updated_at"
    )
    merged = catalog.upsert_articles(stored_articles, rows)
    stale = catalog.stale_chunks(stored_chunks, chunks)
    report = rows.agg(F.count("*").alias("articles"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")).crossJoin(stale.agg(F.count("*").alias("stale")))
    return Run(merged, chunks, stale, report)


def store_summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct articles and distinct categories of a store."""
    return chunks.agg(F.count("*").alias("n"), F.countDistinct("article_id").alias("articles"), F.countDistinct("category").alias("categories"))


def assistant_message(session_id: str, answer: str, sources: str, images: str, confidence: str) -> Column:
    """The stored row of an answer, with its metadata as JSON."""
    return F.struct(F.col(session_id).alias("session_id"), F.lit("assistant").alias("role"), F.col(answer).alias("content"), F.to_json(F.struct(F.col(sources).alias("sources"), F.col(images).alias("images"), F.col(confidence).alias("confidence"))).alias("metadata"))
