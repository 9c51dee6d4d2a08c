"""Rank fusion, reranking order, gates and selection over (query_id, chunk_id) tables.

All are windows over one query's bounded candidate pool; every order ends in a
unique key, so results do not depend on partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Defaults of the retrieval settings.
RRF_K = 60
PRIMARY, VARIANT, VECTOR, LEXICAL = 1.0, 0.5, 0.6, 0.4
SHORTLIST, COLLECT, MAX_CONTEXT = 16, 10, 10
COSINE_FLOOR, RERANK_FLOOR, IMAGE_FLOOR = 0.25, -8.0, 0.30
INTENT_WEIGHT, BLEND_WEIGHT = 0.15, 0.5
ADAPTIVE = ((0.62, 3), (0.45, 5))
ADAPTIVE_ELSE, PROCEDURAL_EXTRA = 8, 2
MEAN_WEIGHT, TOP_ARTICLES, CHUNKS_PER_ARTICLE = 0.4, 3, 4
THRESHOLD_UNDERSTOOD, THRESHOLD_OTHER = 0.30, 0.35


def _ranked(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or ["query_id"])).orderBy(*order)))


def rrf(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf_score, first_list, first_rank from (query_id, list, rank from 1, chunk_id, weight); lists with no positive weight are skipped."""
    used = rankings.filter("weight > 0")
    return used.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("rrf_score"), F.min(F.struct("list", "rank")).alias("first")
    ).select("query_id", "chunk_id", "rrf_score", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))


def list_weights(list_: Column, hybrid: bool = True, n_lists: Column | None = None) -> Column:
    """Weight of list 0 (primary vector), -1 (lexical) or a variant; a single vector ranking counts fully."""
    vector = F.when(list_ == 0, PRIMARY).otherwise(VARIANT) * (VECTOR if hybrid else 1.0)
    if n_lists is not None and not hybrid:
        vector = F.when(n_lists == 1, 1.0).otherwise(vector)
    return F.when(list_ == -1, LEXICAL if hybrid else 0.0).otherwise(vector)


def shortlist_by(strategy: str, candidates: DataFrame, n: int) -> DataFrame:
    """The first n of each query's fused candidates (fused_rank, score, embedding) by strategy: rrf (fused order), cos (score) or mmr (diversity)."""
    if strategy == "mmr":
        from lodestone.operators.vector import diverse

        picked = diverse(candidates.select("query_id", "chunk_id", F.col("fused_rank").alias("ord"), "score", "embedding"), n)
        return candidates.join(picked, ["query_id", "chunk_id"])
    order = [F.col("fused_rank")] if strategy == "rrf" else [F.round("score", 9).desc(), F.col("fused_rank")]
    return _ranked(candidates, order, "picked").filter(F.col("picked") <= n)


def shortlist(fused: DataFrame, n: int = SHORTLIST) -> DataFrame:
    """The first n by fused score; ties by the list and rank where they were first seen."""
    order = [F.round("rrf_score", 12).desc(), F.col("first_list"), F.col("first_rank"), F.col("chunk_id")]
    return _ranked(fused, order, "fused_rank").filter(F.col("fused_rank") <= n)


def max_over_forms(scored: DataFrame) -> DataFrame:
    """query_id, chunk_id, rerank_score: best of all query forms, null if any form has none."""
    return scored.groupBy("query_id", "chunk_id").agg(F.when(F.count("form_score") == F.count("*"), F.max("form_score")).alias("rerank_score"))


def intent_boost(text: Column, terms: Column) -> Column:
    """Share of the boost terms that the lower-cased text contains; 0 without terms."""
    low = F.lower(text)
    hit = F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, hit / F.size(terms)).otherwise(F.lit(0.0))


def min_max(value: Column, by: list[str]) -> Column:
    """Value within 0 and 1 of its group's range; 0.5 where the range is nothing."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((value - low) / (high - low))


def blended(candidates: DataFrame, weight: float = BLEND_WEIGHT, boost: float = INTENT_WEIGHT) -> DataFrame:
    """candidates (rerank_score, rrf_score, score, boost, fused_rank) with order_score and ord."""
    bonus = boost * F.col("boost")
    if weight >= 1:
        mixed = F.col("rerank_score") + bonus
    else:
        mixed = weight * min_max(F.col("rerank_score"), ["query_id"]) + (1 - weight) * min_max(F.col("rrf_score"), ["query_id"]) + bonus
    everywhere = F.count("rerank_score").over(Window.partitionBy("query_id")) == F.count("*").over(Window.partitionBy("query_id"))
    scored = candidates.withColumn("order_score", F.when(everywhere, mixed).otherwise(F.col("score") + bonus))
    return _ranked(scored, [F.round("order_score", 9).desc(), F.col("fused_rank"), F.col("chunk_id")], "ord")


def drop_reason(is_lexical: Column, cosine_floor: float = COSINE_FLOOR, rerank_floor: float = RERANK_FLOOR) -> Column:
    """Why a candidate falls away, or null: weak cosine (unless a lexical hit), or a low rerank score."""
    return F.when(~is_lexical & (F.col("score") < cosine_floor), "cosine").when(F.col("rerank_score") < rerank_floor, "rerank")


def distinct_texts(candidates: DataFrame, limit: int = COLLECT) -> DataFrame:
    """The first `limit` candidates in order that pass the gates, one for each stripped, non-empty text."""
    from lodestone.functions.text import strip

    stripped = candidates.filter("drop_reason is null").withColumn("_text", strip(F.col("text"))).filter("_text != ''")
    first = _ranked(stripped, [F.col("ord")], "_n", ["query_id", "_text"]).filter("_n = 1").drop("_n", "_text")
    return _ranked(first, [F.col("ord")], "position").filter(F.col("position") <= limit)


def adaptive(collected: DataFrame, procedural: Column | None = None) -> DataFrame:
    """The first k of each query, where k depends on the mean score of what was collected."""
    mean = F.round(F.avg("score").over(Window.partitionBy("query_id")), 12)
    k = reduce(lambda otherwise, rule: F.when(mean >= rule[0], rule[1]).otherwise(otherwise), reversed(ADAPTIVE), F.lit(ADAPTIVE_ELSE))
    k = k + F.when(procedural, PROCEDURAL_EXTRA).otherwise(0) if procedural is not None else k
    return collected.withColumn("k", F.least(k, F.lit(MAX_CONTEXT))).filter(F.col("position") <= F.col("k")).drop("k")


def article_selection(chosen: DataFrame, method: str = "blend", articles: int = TOP_ARTICLES, chunks: int = CHUNKS_PER_ARTICLE) -> DataFrame:
    """The best chunks of the best articles, article by article.

    A chunk's rank score is n - position; an article has its peak, its mean, or both.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    scored = chosen.withColumn("rank_score", (n - F.col("position") + 1).cast("double"))
    own = Window.partitionBy("query_id", "article_id")
    peak, mean = F.max("rank_score").over(own), F.avg("rank_score").over(own)
    value = {"max": peak, "mean": mean, "blend": peak + MEAN_WEIGHT * mean}[method]
    scored = scored.withColumn("article_score", value).withColumn("_first", F.min("position").over(own))
    placed = scored.withColumn("article_rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.round("article_score", 9).desc(), "_first")))
    within = _ranked(placed, [F.col("position")], "article_position", ["query_id", "article_id"])
    kept = within.filter((F.col("article_rank") <= articles) & (F.col("article_position") <= chunks)).drop("_first")
    return _ranked(kept, [F.col("article_rank"), F.col("article_position")], "final_rank")


def confidence(queries: DataFrame, final: DataFrame) -> DataFrame:
    """query_id, confidence: mean score of the final chunks, 0 for none."""
    return queries.select("query_id").join(final.groupBy("query_id").agg(F.avg("score").alias("c")), "query_id", "left").select("query_id", F.coalesce("c", F.lit(0.0)).alias("confidence"))


def threshold(understood: Column) -> Column:
    return F.when(understood, THRESHOLD_UNDERSTOOD).otherwise(THRESHOLD_OTHER)


def funnel(stages: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """query_id and how many rows each stage has for it: one pass over all stages' ids."""
    ids = reduce(DataFrame.unionByName, [df.select("query_id", F.lit(name).alias("stage")) for name, df in stages.items()])
    counts = ids.groupBy("query_id").agg(*[F.count_if(F.col("stage") == name).alias(name) for name in stages])
    return queries.select("query_id").distinct().join(counts, "query_id", "left").na.fill(0)
