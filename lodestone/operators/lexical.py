"""Lexical retrieval: tokens, BM25 index and search (whole batches of queries at once).

The index is two tables, postings (chunk_id, term, tf) and lengths, derived from the
chunks; collection statistics are one row.  Searching joins query terms to postings,
so only postings of terms that occur in some query are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# They must equal the specification's for equal results.
STOPWORDS = (
    "a an and are as at be been but by can did do does for from had has have he her his how i if in into is it its me my "
    "not of on or our she so that the their them then there they this to up us was we were what when where which who why "
    "will with you your"
).split()
FIELD_WEIGHTS = {"title": 3, "category": 2, "summary": 1, "keywords": 2}
TOKEN = r"[a-z0-9]+(?:['-][a-z0-9]+)*"
TITLE_HEADER = r"^\s*\[([^\]]{1,200})\]"
K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens(text: Column) -> Column:
    """Lower-cased word tokens without stopwords, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda t: ~t.isin(STOPWORDS))


def weighted_text(text: Column, title: Column | None = None, category: Column | None = None, summary: Column | None = None, keywords: Column | None = None, aliases: Column | None = None) -> Column:
    """The text with its fields repeated by weight; the title falls back to the chunk's `[...]` header."""
    header = F.regexp_extract(text, TITLE_HEADER, 1)
    fields = {"title": F.coalesce(F.nullif(header, F.lit("")), title if title is not None else F.lit(None)), "category": category, "summary": summary, "keywords": keywords}
    parts = [text]
    for name, value in fields.items():
        if value is not None:
            trimmed = F.nullif(F.trim(value), F.lit(""))
            parts += [trimmed] * FIELD_WEIGHTS[name]
    if aliases is not None:
        parts.append(F.nullif(aliases, F.lit("")))
    return F.concat_ws(" ", *parts)


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunk_id, term, tf, dl: counted before the shuffle, so frequent terms are no skew."""
    listed = chunks.select("chunk_id", tokens(F.col(text)).alias("t"))
    terms = listed.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf"))


def collection(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs and avgdl; chunks without a token count."""
    return chunks.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


#: Distinct query terms (about 30 bytes each) up to which they filter the chunks' terms by a broadcast.
BROADCAST_TERMS = 200_000


def document_frequencies(chunks: DataFrame, text: str = "text") -> DataFrame:
    """term, df: counted a task before the shuffle, so a frequent term is no single task's work."""
    return chunks.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qf of queries (query_id, query)."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def search(chunks: DataFrame, queries: DataFrame, k: int, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the best k chunks with a positive score for each query (query_id, query, or terms: query_id, term, qf).

    Chunks' terms that no query has are dropped in the task that reads them; frequencies of all terms are needed
    only for the mean of their weights.
    """
    terms = query_terms(queries) if terms is None else terms
    wanted = terms.select("term").distinct()
    few = wanted.count() <= BROADCAST_TERMS
    shared = F.broadcast(wanted) if few else wanted
    stats = collection(chunks, text)
    df = document_frequencies(chunks, text)
    raw = df.crossJoin(F.broadcast(stats)).select("term", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))  # one row
    # one pass over the frequencies: the mean of all, and the wanted ones by name
    mean = raw.agg(F.avg("raw").alias("mean"))
    weights = raw.join(shared, "term", "left_semi").crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    listed = chunks.select("chunk_id", tokens(F.col(text)).alias("t"))
    found = listed.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).join(shared, "term", "left_semi")
    posts = found.groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf"))
    weighted = terms.join(weights, "term")
    hits = posts.join(F.broadcast(weighted) if few and weighted.count() <= BROADCAST_TERMS else weighted, "term").crossJoin(F.broadcast(stats))
    tf = F.col("tf").cast("double")
    part = F.col("qf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).filter("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def vocabulary(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Distinct tokens of at least three characters."""
    return chunks.select(F.explode(tokens(F.col(text))).alias("term")).filter(F.length("term") >= 3).distinct()


def alias_terms(titles: DataFrame, groups: DataFrame) -> DataFrame:
    """chunk_id, aliases: all terms of synonym groups (group_id, term) of which the title (chunk_id, title) holds a single-token term, but those present."""
    words = titles.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("word"))
    single = groups.select("group_id", F.lower("term").alias("word"))
    few = groups.count() <= BROADCAST_TERMS
    side = lambda df: F.broadcast(df) if few else df
    hit = words.join(side(single), "word").select("chunk_id", "group_id").distinct()
    terms = hit.join(side(groups), "group_id").select("chunk_id", F.lower("term").alias("term")).distinct()
    own = words.select("chunk_id", F.col("word").alias("term"))
    return terms.join(own, ["chunk_id", "term"], "left_anti").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("aliases"))
