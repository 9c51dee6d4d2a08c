"""Queries of lexical and vector retrieval, fusion, selection and context.

`documents` are the chunks: doc_id is chunk_id, article = doc_id div 5, index = doc_id mod 5,
source is the category.  `benchmark` is the query set, `embeddings` the vector store.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as text_functions
from lodestone.operators import context, evaluate, fusion, index, lexical, lineage, models, retrieval, understanding, vector
from lodestone.plans import kept
from lodestone.sources import versions

_STOP = ", ".join(f"'{w}'" for w in lexical.STOPWORDS)
_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[''-][a-z0-9]+)*'), lambda t: t NOT IN (" + _STOP + "))"
CORE: dict[str, str] = {}
Q: dict = {}
S: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / 5).alias("article_id"), (F.col("doc_id") % 5).alias("chunk_index"), F.col("source").alias("category"), "lang"
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25_sql(k: int, text: str = "coalesce(text, '')") -> str:
    return f"""
tok AS (SELECT doc_id AS chunk_id, {_TOKENS.format(text)} AS t FROM documents),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT chunk_id, term, dl, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stat),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term), stat GROUP BY query_id, chunk_id),
bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


def documents_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return kept.inverted_index(spark, f"{sf_dir}/documents.parquet", "texts", lambda: chunks(spark, sf_dir).select("chunk_id", "text"))


def _scores(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


Q["bm25_search"] = lambda s, d: _scores(index.search(documents_index(s, d), benchmark_queries(s, d), 10))
S["bm25_search"] = f"WITH {_bm25_sql(10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25"


Q["bm25_scan"] = lambda s, d: _scores(lexical.search(chunks(s, d), benchmark_queries(s, d), 10))
S["bm25_scan"] = S["bm25_search"]


def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search after an index of all documents' first lines is brought up to date: whole texts replace them, and copies of an earlier text are pruned."""
    rows, path = chunks(spark, sf_dir), f"{lineage.shared_folder(spark)}/lodestone-index-{uuid.uuid4().hex}"
    changing = index.build(rows.select("chunk_id", F.substring_index("text", "\n", 1).alias("text")), path)
    index.upsert(changing, rows)
    copies = rows.groupBy(F.sha2("text", 256).alias("same")).agg(F.min("chunk_id").alias("first"))
    index.prune(changing, rows.select("chunk_id").join(copies, F.col("chunk_id") == F.col("first"), "left_anti"))
    found = lineage.cut(_scores(index.search(changing, benchmark_queries(spark, sf_dir), 10)))
    versions.remove(spark, path)
    return found


Q["bm25_after_changes"] = bm25_after_changes
S["bm25_after_changes"] = "WITH " + _bm25_sql(10).replace("FROM documents", "FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY coalesce(text, ''))") + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25"


def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = lexical.postings(chunks(spark, sf_dir))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


Q["bm25_index"] = bm25_statistics
S["bm25_index"] = f"WITH {_bm25_sql(10)} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term"

Q["bm25_vocabulary"] = lambda s, d: lexical.vocabulary(chunks(s, d))
S["bm25_vocabulary"] = f"WITH {_bm25_sql(10)} SELECT DISTINCT term FROM post WHERE length(term) >= 3"


def fuzzy_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each benchmark text, every seventh word misspelt (its last two letters swapped), and their closest in all documents."""
    words = benchmark_queries(spark, sf_dir).select("query_id", F.posexplode(lexical.tokens(F.col("query"))).alias("at", "word"))
    misspelt = F.when(F.col("at") % 7 == 0, F.concat(F.expr("substring(word, 1, length(word) - 2)"), F.reverse(F.substring("word", -2, 2)))).otherwise(F.col("word"))
    terms = words.select("query_id", misspelt.alias("term")).distinct()
    return understanding.closest_terms(terms, lexical.vocabulary(chunks(spark, sf_dir)))


Q["fuzzy_query_terms"] = fuzzy_query_terms


def weighted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, df, cf of all documents indexed with category and aliases (their words of two small synonym groups)."""
    rows = chunks(spark, sf_dir)
    groups = spark.sql("select * from values (1, 'the'), (1, 'thand'), (2, 'on'), (2, 'onth'), (3, 'ering'), (3, 'ingly') as g(group_id, term)")
    aliases = lexical.alias_terms(rows.select("chunk_id", F.col("text").alias("title")), groups)
    joined = rows.join(aliases, "chunk_id", "left")
    text = lexical.weighted_text(F.col("text"), category=F.col("category"), aliases=F.col("aliases"))
    return lexical.postings(joined.select("chunk_id", text.alias("text"))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


Q["weighted_index"] = weighted_index


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_queries(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _knn_sql(k: int, where: str = "true") -> str:
    return f"""
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 20 = 0),
dots AS (SELECT query_id, vec_id, list_dot_product(v, embedding::DOUBLE[]) AS d, e.label FROM q, embeddings e WHERE {where}),
knn AS (SELECT * FROM (SELECT query_id, vec_id, least(1.0, greatest(0.0, d)) AS score, label, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9) DESC, vec_id) AS rank FROM dots) WHERE rank <= {k})"""


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return vector.nearest(rows, vector_queries(rows), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


Q["vector_knn"] = knn
S["vector_knn"] = f"WITH {_knn_sql(10)} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM knn"


def knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`vector_knn` by the kept inverted file of all vectors (approximate)."""
    rows, source = embeddings(spark, sf_dir), f"{sf_dir}/embeddings.parquet"

    def fitted() -> DataFrame:
        centres, probes = vector.cells(rows)
        return spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int")

    held = kept.table(spark, source, "centres", fitted).orderBy("cell").toPandas()  # MAX_CELLS at most
    centres = np.stack(held["centre"].to_list())
    stored = kept.table(spark, source, "cells", lambda: vector.with_cells(rows, centres, 1).select("vec_id", "embedding", "cell"), ["cell"])
    return vector.nearest_in_cells(stored, vector_queries(rows), 10, centres, int(held["probes"][0])).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


Q["vector_knn_cells"] = knn_by_cells


def image_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are label 0: twice k are fetched, weak ones dropped, k kept."""
    rows = embeddings(spark, sf_dir)
    found = vector.nearest(rows.filter("label = 0"), vector_queries(rows), 6).filter(F.col("score") >= fusion.IMAGE_FLOOR).filter("rank <= 3")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


Q["image_knn"] = image_knn
S["image_knn"] = f"WITH {_knn_sql(6, 'e.label = 0')} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM knn WHERE score >= 0.30 AND rank <= 3"

Q["vector_normalize"] = lambda s, d: embeddings(s, d).select("vec_id", F.round(vector.dot(vector.normalized(F.col("embedding")), F.col("embedding")), 6).alias("length"))
S["vector_normalize"] = "SELECT vec_id, round(CASE WHEN n > 0 THEN n2 / n ELSE 0 END, 6) AS length FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n2, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"

Q["vector_count_by_type"] = lambda s, d: embeddings(s, d).groupBy(F.col("label").cast("long").alias("source_type")).agg(F.count("*").alias("n"))
S["vector_count_by_type"] = "SELECT label::BIGINT AS source_type, count(*) AS n FROM embeddings GROUP BY label"

Q["vector_dimensions"] = lambda s, d: embeddings(s, d).agg(F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"), (F.count_if(F.size("embedding") != 64) == 0).alias("ok"))
S["vector_dimensions"] = "SELECT min(len(embedding))::BIGINT AS least, max(len(embedding))::BIGINT AS most, count_if(len(embedding) <> 64) = 0 AS ok FROM embeddings"


#: A small example of knowledge; the query's phrasings by intent are its variants.
INTENTS = understanding.Knowledge(intents=(
    understanding.Intent("ask", (r"\bth\w+ing\b",), ("how to ask",), ("thing", "ering"), True), understanding.Intent("be", (r"\bbe\b", r"\bbeen\b"), ("what to be",), ("be",)),
))


def titled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks that begin with their article's title."""
    rows = chunks(spark, sf_dir)
    return rows.select("chunk_id", F.concat(F.lit("[Title "), F.col("article_id").cast("string"), F.lit("]\n "), text_functions.strip(F.col("text")), F.lit(" ")).alias("text"), "article_id", "chunk_index", "category")


def retrieved(spark: SparkSession, sf_dir: str) -> retrieval.Retrieval:
    """The benchmark's passages as queries over all documents, by a scan of their weighted texts and their stored vectors."""
    rows, source = titled_chunks(spark, sf_dir), f"{sf_dir}/documents.parquet"
    weighted = rows.select("chunk_id", lexical.weighted_text(F.col("text"), category=F.col("category")).alias("text"))
    vectors = lambda: rows.select("chunk_id", "category", models.embedding(models.word_embedder(64))("text").alias("embedding"))
    return retrieval.retrieve(
        benchmark_queries(spark, sf_dir), rows, INTENTS, models.word_embedder(64), models.overlap_scorer,
        vectors=kept.table(spark, source, "vectors", vectors), weighted=weighted,
    )


_WEIGHTED = "concat_ws(' ', {0}, {1}, {1}, {1}, nullif(trim(source), ''), nullif(trim(source), ''))"
_TITLED = "'[Title ' || (doc_id // 5) || ']' || chr(10) || ' ' || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') || ' '"
_L, _R = r"(?i)(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_HASHED = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64)"
_COUNTED = "list_transform(range(0, 64), lambda x: len(list_filter(b, lambda y: y = x))::DOUBLE)"
_UNIT = "CASE WHEN list_dot_product(c, c) > 0 THEN list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) ELSE c END"
_SET = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_RANKINGS = f"""
{_bm25_sql(40, _WEIGHTED.format(_TITLED, "'Title ' || (doc_id // 5)"))},
q AS MATERIALIZED (SELECT *, regexp_matches(norm, '{_L}th[A-Za-z0-9_]+ing{_R}') AS ask, regexp_matches(norm, '{_L}be(en)?{_R}') AS be FROM (SELECT item_id AS query_id,
  array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s''-]+', ' ', 'g'), '\\s+'), lambda t: trim(lower(t), chr(39) || '-')), lambda t: t <> ''), ' ') AS norm FROM benchmark)),
forms AS (SELECT query_id, 0 AS list, norm AS form FROM q UNION ALL SELECT query_id, 1, CASE WHEN ask THEN 'how to ask' ELSE 'what to be' END FROM q WHERE ask OR be UNION ALL SELECT query_id, 2, 'what to be' FROM q WHERE ask AND be),
fe AS MATERIALIZED (SELECT query_id, list, {_UNIT} AS e FROM (SELECT query_id, list, {_COUNTED} AS c FROM (SELECT query_id, list, {_HASHED.format('form')} AS b FROM forms))),
de AS MATERIALIZED (SELECT chunk_id, {_UNIT} AS e FROM (SELECT chunk_id, {_COUNTED} AS c FROM (SELECT doc_id AS chunk_id, {_HASHED.format(_TITLED)} AS b FROM documents))),
dots AS MATERIALIZED (SELECT query_id, list, chunk_id, list_dot_product(fe.e, de.e) AS d FROM fe, de),
near AS (SELECT query_id, list, row_number() OVER (PARTITION BY query_id, list ORDER BY round(d, 9) DESC, chunk_id) AS rank, chunk_id, d FROM dots),
lists AS MATERIALIZED (SELECT *, CASE WHEN list = 0 THEN 0.6 ELSE 0.3 END AS weight FROM near WHERE rank <= 40 UNION ALL SELECT query_id, -1, rank, chunk_id, NULL, 0.4 FROM bm25),
fused AS (SELECT query_id, chunk_id, sum(weight / (60 + rank)) AS rrf_score, arg_min(list, list) AS first_list, arg_min(rank, list) AS first_rank FROM lists GROUP BY query_id, chunk_id),
short AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, first_list, first_rank, chunk_id) AS fused_rank FROM fused) WHERE fused_rank <= 16)"""

Q["candidate_pool"] = lambda s, d: vector.pooled(retrieved(s, d).rankings.filter("list >= 0").select("query_id", F.col("list").alias("variant"), "chunk_id", F.round("score", 6).alias("score"))).select(
    "query_id", "chunk_id", "score", F.col("first_variant").cast("long").alias("first_variant"), F.size("found_by").cast("long").alias("n_found"), "source")
S["candidate_pool"] = f"WITH {_RANKINGS} SELECT query_id, chunk_id, max(round(least(1.0, greatest(0.0, d)), 6)) AS score, min(list)::BIGINT AS first_variant, count(DISTINCT list) AS n_found, CASE WHEN min(list) = 0 THEN 'vector' ELSE 'variant' END AS source FROM lists WHERE list >= 0 GROUP BY query_id, chunk_id"

Q["rrf_fusion"] = lambda s, d: fusion.shortlist(fusion.rrf(retrieved(s, d).rankings)).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("fused_rank").cast("long").alias("fused_rank"))
S["rrf_fusion"] = f"WITH {_RANKINGS} SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, fused_rank FROM short"

_SCORED = _RANKINGS + f""",
body AS (SELECT doc_id AS chunk_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body, {_TITLED} AS text FROM documents WHERE doc_id IN (SELECT chunk_id FROM short)),
words AS (SELECT s.query_id, s.chunk_id, max(20 * len(list_intersect(x, y)) / len(x)::DOUBLE - 10) AS rerank_score FROM short s JOIN (SELECT chunk_id, {_SET.format('text')} AS y FROM body) USING (chunk_id)
  JOIN (SELECT query_id, {_SET.format('form')} AS x FROM forms WHERE list <= 1) f ON f.query_id = s.query_id GROUP BY ALL),
cand AS (SELECT s.query_id, s.chunk_id, rrf_score, fused_rank, l.chunk_id IS NOT NULL AS is_lexical, s.chunk_id // 5 AS article_id, s.chunk_id % 5 AS chunk_index, least(1.0, greatest(0.0, dots.d)) AS score, rerank_score,
  CASE WHEN ask OR be THEN len(list_filter(CASE WHEN ask AND be THEN ['be', 'ering', 'thing'] WHEN ask THEN ['ering', 'thing'] ELSE ['be'] END, lambda t: contains(lower(body.text), t))) / (CASE WHEN ask AND be THEN 3 WHEN ask THEN 2 ELSE 1 END)::DOUBLE ELSE 0 END AS boost,
  ask, body, s.chunk_id // 5 AS title
  FROM short s JOIN dots ON dots.query_id = s.query_id AND dots.chunk_id = s.chunk_id AND dots.list = 0 JOIN body ON body.chunk_id = s.chunk_id JOIN words w ON w.query_id = s.query_id AND w.chunk_id = s.chunk_id JOIN q ON q.query_id = s.query_id
  LEFT JOIN (SELECT * FROM lists WHERE list = -1) l ON l.query_id = s.query_id AND l.chunk_id = s.chunk_id),
norm AS (SELECT *, CASE WHEN max(rerank_score) OVER w - min(rerank_score) OVER w < 1e-9 THEN 0.5 ELSE (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w) END AS nce,
  CASE WHEN max(rrf_score) OVER w - min(rrf_score) OVER w < 1e-9 THEN 0.5 ELSE (rrf_score - min(rrf_score) OVER w) / (max(rrf_score) OVER w - min(rrf_score) OVER w) END AS nrrf FROM cand WINDOW w AS (PARTITION BY query_id)),
ordered AS (SELECT *, 0.5 * nce + 0.5 * nrrf + 0.15 * boost AS order_score FROM norm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(order_score, 9) DESC, fused_rank, chunk_id) AS ord,
  CASE WHEN NOT is_lexical AND score < 0.25 THEN 'cosine' WHEN rerank_score < -8.0 THEN 'rerank' END AS drop_reason FROM ordered),
uniq AS (SELECT *, row_number() OVER (PARTITION BY query_id, title, body ORDER BY ord) AS n FROM ranked WHERE drop_reason IS NULL),
coll AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY query_id ORDER BY ord) AS position FROM uniq WHERE n = 1) WHERE position <= 10),
adapt AS (SELECT * FROM (SELECT *, CASE WHEN round(avg(score) OVER (PARTITION BY query_id), 12) >= 0.62 THEN 3 WHEN round(avg(score) OVER (PARTITION BY query_id), 12) >= 0.45 THEN 5 ELSE 8 END + CASE WHEN ask THEN 2 ELSE 0 END AS k FROM coll) WHERE position <= least(k, 10)),
arts AS (SELECT *, max(rs) OVER a + 0.4 * avg(rs) OVER a AS article_score, min(position) OVER a AS first_pos, row_number() OVER (PARTITION BY query_id, article_id ORDER BY position) AS ap
  FROM (SELECT *, (count(*) OVER (PARTITION BY query_id) - position + 1)::DOUBLE AS rs FROM adapt) WINDOW a AS (PARTITION BY query_id, article_id)),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ar, ap) AS final_rank FROM
  (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY round(article_score, 9) DESC, first_pos) AS ar FROM arts) WHERE ar <= 3 AND ap <= 4)"""


Q["rerank_blend"] = lambda s, d: retrieved(s, d).gated.select("query_id", "chunk_id", F.round("order_score", 6).alias("order_score"), F.col("ord").cast("long").alias("ord"), "drop_reason")
S["rerank_blend"] = f"WITH {_SCORED} SELECT query_id, chunk_id, round(order_score, 6) AS order_score, ord, drop_reason FROM ranked"
Q["distinct_texts"] = lambda s, d: retrieved(s, d).collected.select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))
S["distinct_texts"] = f"WITH {_SCORED} SELECT query_id, chunk_id, position FROM coll"
Q["adaptive_k"] = lambda s, d: fusion.adaptive(retrieved(s, d).collected, F.col("procedural")).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))
S["adaptive_k"] = f"WITH {_SCORED} SELECT query_id, chunk_id, position FROM adapt"
Q["hybrid_search"] = lambda s, d: retrieved(s, d).final.select("query_id", "chunk_id", "article_id", F.round("article_score", 6).alias("article_score"), F.col("final_rank").cast("long").alias("final_rank"))
S["hybrid_search"] = f"WITH {_SCORED} SELECT query_id, chunk_id, article_id, round(article_score, 6) AS article_score, final_rank FROM fin"


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieved(spark, sf_dir)
    sure = fusion.confidence(found.queries, found.final).join(found.queries.select("query_id", "understood"), "query_id")
    return sure.select("query_id", F.round("confidence", 6).alias("confidence"), (F.col("confidence") >= fusion.threshold(F.col("understood"))).alias("passes"))


Q["confidence"] = confidence
S["confidence"] = f"WITH {_SCORED}, c AS (SELECT q.query_id, coalesce(avg(score), 0.0) AS confidence FROM q LEFT JOIN fin USING (query_id) GROUP BY q.query_id) SELECT query_id, round(confidence, 6) AS confidence, confidence >= CASE WHEN ask OR be THEN 0.30 ELSE 0.35 END AS passes FROM c JOIN q USING (query_id)"
Q["citations"] = lambda s, d: context.citations(retrieved(s, d).final).select("query_id", "article_id", "chunk_id", F.col("citation").cast("long").alias("citation"))
S["citations"] = f"WITH {_SCORED} SELECT query_id, article_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS citation FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY final_rank) AS n FROM fin) WHERE n = 1"
Q["group_adjacent"] = lambda s, d: context.group_adjacent(retrieved(s, d).final).select("query_id", "article_id", "chunk_index", "n_chunks", F.col("final_rank").cast("long").alias("final_rank"), F.round("score", 6).alias("score"), "text")
S["group_adjacent"] = f"""WITH {_SCORED}, isl AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, article_id ORDER BY chunk_index) AS island FROM fin),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_id, island ORDER BY chunk_index) AS m FROM isl)
SELECT query_id, article_id, min(chunk_index) AS chunk_index, count(*) AS n_chunks, min(final_rank) AS final_rank, round(arg_min(score, final_rank), 6) AS score,
 string_agg(CASE WHEN m = 1 THEN '[Title ' || title || ']' || chr(10) ELSE '' END || ' ' || body || ' ', chr(10) || chr(10) ORDER BY chunk_index) AS text FROM b GROUP BY query_id, article_id, island"""


def article_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieved(spark, sf_dir)
    rows = found.final.drop("category").select("*", F.concat(F.lit("Title "), F.col("article_id").cast("string")).alias("title"), F.concat(F.lit("u/"), F.col("article_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("category"), F.lit("").alias("summary"))
    return context.with_sentinel(found.queries, context.context_by_article(rows))


Q["article_context"] = article_context
S["article_context"] = f"""WITH {_SCORED}, p AS (SELECT *, lag(chunk_index) OVER (PARTITION BY query_id, article_id ORDER BY chunk_index) AS prev FROM fin),
a AS (SELECT query_id, article_id, min(final_rank) AS first_at, string_agg(CASE WHEN prev IS NOT NULL AND chunk_index <> prev + 1 THEN '{context.GAP}' || chr(10) || chr(10) ELSE '' END || body, chr(10) || chr(10) ORDER BY chunk_index) AS body FROM p GROUP BY query_id, article_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_at) AS no FROM a),
c AS (SELECT query_id, string_agg('--- Article ' || no || ': Title ' || article_id || chr(10) || 'Category: General' || chr(10) || body || chr(10) || 'Source: u/' || article_id || chr(10) || '---', chr(10) ORDER BY no) AS context FROM n GROUP BY query_id)
SELECT q.query_id, coalesce(context, '{context.NO_CONTEXT}') AS context FROM q LEFT JOIN c USING (query_id)"""



def retrieval_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieved(spark, sf_dir)
    images = vector.nearest(embeddings(spark, sf_dir).filter("label = 0"), vector_queries(embeddings(spark, sf_dir)), 6).filter(F.col("score") >= fusion.IMAGE_FLOOR).filter("rank <= 3")
    return fusion.funnel({
        "n_vector": found.rankings.filter("list = 0"), "n_lexical": found.rankings.filter("list = -1"), "n_fused": fusion.rrf(found.rankings),
        "n_after_rerank": found.gated.filter("drop_reason is null"), "n_final": found.final, "n_images": images,
    }, found.queries)


Q["retrieval_funnel"] = retrieval_funnel
S["retrieval_funnel"] = f"""WITH {_SCORED}, im AS (SELECT query_id FROM (SELECT a.vec_id AS query_id, list_dot_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
  FROM embeddings a, embeddings e WHERE a.vec_id % 20 = 0 AND e.label = 0) WHERE rank <= 3 AND d >= 0.30)
 SELECT query_id, (SELECT count(*) FROM lists l WHERE l.query_id = q.query_id AND list = 0) AS n_vector, (SELECT count(*) FROM lists l WHERE l.query_id = q.query_id AND list = -1) AS n_lexical,
 (SELECT count(*) FROM fused f WHERE f.query_id = q.query_id) AS n_fused, (SELECT count(*) FROM ranked r WHERE r.query_id = q.query_id AND drop_reason IS NULL) AS n_after_rerank, (SELECT count(*) FROM fin f WHERE f.query_id = q.query_id) AS n_final,
 (SELECT count(*) FROM im WHERE im.query_id = q.query_id) AS n_images FROM q"""


def shortlist_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, hits_at_1, hits_at_k, leaks of three ways to choose six candidates; a query's own passage is in documents that share eight words in a row with it."""
    found = retrieved(spark, sf_dir)
    items = benchmark_queries(spark, sf_dir)
    right = evaluate.contained(items.select(F.col("query_id").alias("left_id"), F.col("query").alias("text")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("right_id"), "text"), 0.0)
    expected = lineage.cut(right.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("chunk_id")))
    out = None
    for strategy in ("mmr", "rrf", "cos"):
        chosen = fusion.shortlist_by(strategy, found.candidates, 6)
        hit = chosen.join(expected.withColumn("right", F.lit(True)), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min(F.when(F.col("right"), F.col("picked"))).alias("first"))
        known = expected.select("query_id").distinct().withColumn("known", F.lit(True))
        row = hit.join(known, "query_id", "left").agg(
            F.count_if(F.col("first") == 1).alias("hits_at_1"), F.count("first").alias("hits_at_k"), F.count_if(F.col("known").isNull()).alias("leaks"),
        ).select(F.lit(strategy).alias("strategy"), "hits_at_1", "hits_at_k", "leaks")
        out = row if out is None else out.unionByName(row)
    return out


Q["shortlist_strategies"] = shortlist_strategies


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What retrieval found (query_id, article_id, rank), cases (query_id, kind, expected) and the found chunks.

    A passage expects the articles of documents that share eight words in a row with it; without any it is off topic.
    """
    found = retrieved(spark, sf_dir)
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("left_id"), "text")
    right = evaluate.contained(passages, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("right_id"), "text"), 0.0)
    expected = right.groupBy(F.col("left_id").alias("query_id")).agg(F.collect_set(F.expr("right_id div 5")).alias("expected"))
    cases = passages.select(F.col("left_id").alias("query_id")).join(expected, "query_id", "left").select(
        "query_id", F.when(F.col("expected").isNull(), "offtopic").otherwise("covered").alias("kind"), F.coalesce("expected", F.expr("cast(array() as array<bigint>)")).alias("expected")
    )
    final = lineage.cut(found.final.select("query_id", "article_id", "final_rank", "score"))
    return final.groupBy("query_id", "article_id").agg(F.min("final_rank").alias("rank")), lineage.cut(cases), final


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, cases, _ = judged(spark, sf_dir)
    return evaluate.quality(results, cases).select("query_id", "kind", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def retrieval_quality_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, cases, _ = judged(spark, sf_dir)
    return evaluate.quality_by_kind(evaluate.quality(results, cases)).select("kind", "n", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def retrieval_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the covered passages with an expected article among the first one, three and five."""
    results, cases, _ = judged(spark, sf_dir)
    covered = cases.filter("kind = 'covered'")
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    hits = evaluate.first_hits(ranked, covered.select("query_id", F.explode("expected").alias("article_id")))
    return evaluate.recall_at(hits, covered, (1, 3, 5)).select(*[F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in (1, 3, 5)])


def retrieval_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cases, final = judged(spark, sf_dir)
    return evaluate.separation(fusion.confidence(cases, final).join(cases, "query_id")).select(F.round("separation", 6).alias("separation"))


_JUDGED = _SCORED + r""",
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark)),
ex AS (SELECT DISTINCT item_id AS query_id, doc_id // 5 AS article_id FROM bg JOIN dg USING (g)),
ra AS (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY min(final_rank)) AS rank FROM fin GROUP BY query_id, article_id),
n AS (SELECT item_id AS query_id, (SELECT count(*) FROM ex WHERE ex.query_id = item_id) AS n_ex, (SELECT count(*) FROM ra WHERE ra.query_id = item_id) AS n_got,
  (SELECT count(*) FROM ra SEMI JOIN ex ON ra.query_id = ex.query_id AND ra.article_id = ex.article_id WHERE ra.query_id = item_id) AS hits FROM benchmark),
qual AS (SELECT query_id, CASE WHEN n_ex = 0 THEN 'offtopic' ELSE 'covered' END AS kind, CASE WHEN n_ex = 0 THEN (n_got = 0)::INT::DOUBLE ELSE hits / n_ex::DOUBLE END AS recall,
  CASE WHEN n_ex = 0 THEN (n_got = 0)::INT::DOUBLE WHEN n_got = 0 THEN 0.0 ELSE hits / n_got::DOUBLE END AS precision FROM n)"""
Q["retrieval_quality"] = retrieval_quality
S["retrieval_quality"] = f"WITH {_JUDGED} SELECT query_id, kind, round(recall, 6) AS recall, round(precision, 6) AS precision FROM qual"
Q["retrieval_quality_by_kind"] = retrieval_quality_by_kind
S["retrieval_quality_by_kind"] = f"WITH {_JUDGED} SELECT kind, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM qual GROUP BY kind"
Q["retrieval_recall_at_k"] = retrieval_recall_at_k
S["retrieval_recall_at_k"] = f"""WITH {_JUDGED}, f AS (SELECT query_id, (SELECT min(rank) FROM ra SEMI JOIN ex ON ra.query_id = ex.query_id AND ra.article_id = ex.article_id WHERE ra.query_id = qual.query_id) AS first FROM qual WHERE kind = 'covered')
SELECT {', '.join(f"round(avg(coalesce(first <= {k}, false)::INT), 6) AS recall_at_{k}" for k in (1, 3, 5))} FROM f"""
Q["retrieval_separation"] = retrieval_separation
S["retrieval_separation"] = f"""WITH {_JUDGED}, c AS (SELECT qual.query_id, kind, coalesce(avg(score), 0.0) AS confidence FROM qual LEFT JOIN fin ON fin.query_id = qual.query_id GROUP BY ALL)
SELECT round(avg(confidence) FILTER (kind = 'covered') - avg(confidence) FILTER (kind = 'offtopic'), 6) AS separation FROM c"""


def category_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every query vector, within the query's own label where its id is a multiple of 40."""
    rows = embeddings(spark, sf_dir).withColumn("category", F.col("label").cast("string"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.when(F.col("vec_id") % 40 == 0, F.col("category")).alias("category"))
    return vector.nearest(rows, asked, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


Q["category_search"] = category_search
S["category_search"] = """SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
 FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND (q.vec_id % 40 <> 0 OR q.label = e.label)) WHERE rank <= 10"""


def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    pool = vector.nearest(rows, vector_queries(rows), 20).join(rows.select("vec_id", "embedding"), "vec_id")
    return vector.diverse(pool.select("query_id", F.col("vec_id").alias("chunk_id"), F.col("rank").alias("ord"), "score", "embedding"), 5)


Q["mmr"] = mmr
