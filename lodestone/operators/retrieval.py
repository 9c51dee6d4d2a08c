"""Retrieval from query text to chosen chunks: understanding, BM25 and vectors of the same chunks, fusion, gates, selection.

Each step is an operator of its own module; this one says how they follow each other.
What several later steps read (candidates of a bounded number a query) is checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import fusion, index, lexical, models, scan, understanding, vector
from lodestone.operators.lineage import cut

# The least pool of a search, and chunks asked for.
LEAST_POOL, TOP_K = 40, 10
#: Most variants of a query.
VARIANTS = 16
#: Shortlisted pairs (some 60 bytes each) up to which they choose the chunks by a broadcast.
BROADCAST_PAIRS = 200_000


@dataclass(frozen=True)
class Retrieval:
    """Tables of one batch of queries, from first candidates to chosen chunks."""

    queries: DataFrame  # as `understanding.process` gives them
    rankings: DataFrame  # query_id, list (0 the query, 1.. its variants, -1 BM25), rank, chunk_id, score, weight
    candidates: DataFrame  # the shortlist with score, rerank_score, boost, is_lexical and the chunk's columns
    gated: DataFrame
    collected: DataFrame
    final: DataFrame


def retrieve(
    queries: DataFrame, chunks: DataFrame, knowledge: understanding.Knowledge, embed: Callable[[], models.Embed], score: Callable[[], models.Score] | None,
    top_k: int = TOP_K, aliases: DataFrame | None = None, fuzzy: bool = False, kept: index.Index | None = None, vectors: DataFrame | None = None,
    weighted: DataFrame | None = None,
) -> Retrieval:
    """queries: query_id, query and, if rows of one category only are wanted from vectors, category (BM25 sees all).

    chunks: chunk_id, text, article_id, chunk_index, category.  aliases: more words of a chunk (chunk_id, aliases) for BM25.
    fuzzy: query terms that no chunk has are joined by the closest that some has.
    weighted: the chunks' texts as BM25 sees them (chunk_id, text), or kept: an index of these.  vectors: stored vectors (chunk_id, category, embedding).
    With an index and vectors no chunk is tokenised or embedded here, and of the chunks' texts only those of candidates are read; without
    an index one scan counts terms for all queries, which is less work than building one.
    """
    pool = max(LEAST_POOL, 3 * top_k)
    asked = cut(understanding.process(queries, knowledge))
    vectors = cut(chunks.select("chunk_id", "category", models.embedding(embed)("text").alias("embedding"))) if vectors is None else vectors
    # one search for all variants of all queries; their numbers are packed into one
    forms = asked.select("query_id", F.posexplode(F.slice("variants", 1, VARIANTS)).alias("list", "form"), *(["category"] if "category" in queries.columns else []))
    packed = cut(forms.withColumn("query_id", F.col("query_id") * VARIANTS + F.col("list")).withColumn("q", models.embedding(embed)("form")))
    near = vector.nearest(vectors, packed, pool, "chunk_id").select(
        F.floor(F.col("query_id") / VARIANTS).alias("query_id"), F.pmod("query_id", F.lit(VARIANTS)).cast("int").alias("list"), "rank", "chunk_id", "score")
    terms = lexical.query_terms(asked.select("query_id", F.col("lexical").alias("query")))
    if weighted is not None:
        text = weighted
    elif kept is None:
        text = chunks if aliases is None else chunks.join(aliases, "chunk_id", "left").withColumn("text", lexical.weighted_text(F.col("text"), category=F.col("category"), aliases=F.col("aliases")))
    if fuzzy:
        close = understanding.closest_terms(terms.select("query_id", "term"), index.vocabulary(kept) if kept is not None else lexical.vocabulary(text))
        terms = close.join(terms, ["query_id", "term"], "left").groupBy("query_id", "term").agg(F.coalesce(F.max("qf"), F.lit(1)).alias("qf"))
    found = index.search(kept, None, pool, terms=terms) if kept is not None else scan.search(text, pool, terms)
    listed = near.unionByName(found.select("query_id", F.lit(-1).alias("list"), "rank", "chunk_id", F.lit(None).cast("double").alias("score")))
    rankings = cut(listed.withColumn("weight", fusion.list_weights(F.col("list"))))
    short = cut(fusion.shortlist(fusion.rrf(rankings)))
    short = F.broadcast(short) if short.count() <= BROADCAST_PAIRS else short
    hits = rankings.filter("list = -1").select("query_id", "chunk_id", F.lit(True).alias("is_lexical"))
    # chunks that BM25 alone found get their vector, and with it a score, here like all others
    primary = packed.filter("list = 0").select(F.floor(F.col("query_id") / VARIANTS).alias("query_id"), "q")
    # first the chunks that any query has: a semi join is pushed below what the texts are made by
    own = chunks.join(short.select("chunk_id"), "chunk_id", "left_semi")
    chosen = own.join(short, "chunk_id").join(hits, ["query_id", "chunk_id"], "left")
    paired = chosen.join(vectors.join(short.select("query_id", "chunk_id"), "chunk_id").select("query_id", "chunk_id", "embedding"), ["query_id", "chunk_id"]).join(primary, "query_id")
    about = asked.select("query_id", models.query_forms(F.col("variants")).alias("forms"), "boost_terms", "procedural", "understood")
    scored = cut(paired.join(about, "query_id").select(
        "query_id", "chunk_id", "rrf_score", "fused_rank", F.coalesce("is_lexical", F.lit(False)).alias("is_lexical"), "article_id", "chunk_index", "category", "text", "embedding",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), vector.dot(F.col("embedding"), F.col("q")))).alias("score"), fusion.intent_boost(F.col("text"), F.col("boost_terms")).alias("boost"), "forms", "procedural",
    ))
    candidates = cut(scored.join(models.reranked(scored.select("query_id", "chunk_id", "forms", "text"), score), ["query_id", "chunk_id"]).drop("forms"))
    gated = cut(fusion.blended(candidates).withColumn("drop_reason", fusion.drop_reason(F.col("is_lexical"))))
    collected = cut(fusion.distinct_texts(gated))
    return Retrieval(asked, rankings, candidates, gated, collected, cut(fusion.article_selection(fusion.adaptive(collected, F.col("procedural")))))
