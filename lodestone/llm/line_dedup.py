"""Line removal by site-relative frequency (operator 5).

A line of a host is boilerplate when the share of the host's pages that contain it
exceeds RATIO with confidence: its lower limit at CONFIDENCE standard deviations
(n - 1 > RATIO * N + CONFIDENCE * sqrt(N * RATIO * (1 - RATIO)), the normal limit with continuity
correction) does.  The limit tightens by itself where pages are few: three pages of three are
boilerplate, four of nine, 13 of 100, 1,028 of 18,700; a line of a single page never is.  Pages
are counted once a line, however often it repeats inside.  For `documents` the host is the source.

Counting pre-aggregates (host, line hash) before the shuffle, so a host with most
pages or a line on most pages is no single task's work.  A host has at most
(mean lines a page / RATIO) boilerplate lines, since each takes a share RATIO of
its pages; they travel back as one array a host.

Defined results: lines are what stands between newlines; a line without a
character other than space, tab and carriage return never counts and always
stays; comparison is exact; null text stays null; a null host is a host; a document
of which nothing is left keeps an empty text; n_chars is that of the new text;
repeated rows count as pages of their own; extra columns pass through, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

#: Share of a host's pages, and standard deviations (99.9 %, one-sided) by which a line must exceed it.
RATIO, CONFIDENCE = 0.05, 3.09
#: Largest total of boilerplate hashes and hosts (about 8 and 40 bytes) that is broadcast; beyond it the hosts are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Parts that a host's rows are dealt into when hosts are joined by a shuffle.
SALTS = 64

_BLANK = r"^[ \t\r]*$"


def line_key(line: Column) -> Column:
    """64 bits of the line and its length; compared within a host only."""
    return F.xxhash64(line, F.length(line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, confidence: float = CONFIDENCE, min_pages: int = 2) -> DataFrame:
    """host, lines: hashes of each host's boilerplate lines (on min_pages pages at least)."""
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: ~x.rlike(_BLANK)), line_key))
    # the null line counts the pages themselves, so one pass serves both counts
    rows = pages.select(F.col(host).alias("host"), F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(lines, F.array().cast("array<bigint>")))).alias("line"))
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = common.checkpointed(counts.filter((F.col("n") > 1) | F.col("line").isNull()))
    totals = counts.filter("line is null").select(F.col("host").alias("of"), F.col("n").alias("total"))
    joined = counts.filter("line is not null").join(totals, F.col("host").eqNullSafe(F.col("of")))
    spread = F.sqrt(F.col("total") * F.lit(ratio) * F.lit(1 - ratio))
    return joined.filter((F.col("n") >= min_pages) & (F.col("n") - 1 > F.col("total") * F.lit(ratio) + F.lit(confidence) * spread)).groupBy("host").agg(F.collect_list("line").alias("lines"))


def remove_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, confidence: float = CONFIDENCE, min_pages: int = 2) -> DataFrame:
    """docs with the new text, n_chars where the table has it, and as last column _ld_dropped (lines removed; the next unused name if the table has that one)."""
    of, bad, salt, own, kept, dropped = (common.unused(f"_ld_{n}", docs.columns) for n in ("of", "bad", "salt", "own", "kept", "dropped"))
    found = common.checkpointed(boilerplate(docs, host, text, ratio, confidence, min_pages)).select(F.col("host").alias(of), F.col("lines").alias(bad))
    size = found.agg(F.coalesce(F.sum(F.size(bad) + 5), F.lit(0)).alias("n")).head().n
    same = F.col(host).eqNullSafe(F.col(of))
    if size <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(found), same, "left")
    else:
        salted = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn(own, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same & (F.col(own) == F.col(salt)), "left").drop(own, salt)
    lines = F.split(F.col(text), "\n")
    left = F.filter(lines, lambda x: x.rlike(_BLANK) | ~F.array_contains(F.col(bad), line_key(x)))
    touched = joined.withColumn(kept, F.when(F.col(bad).isNotNull() & F.col(text).isNotNull(), left))
    out = touched.withColumn(dropped, F.when(F.col(kept).isNull(), 0).otherwise(F.size(lines) - F.size(kept)))
    out = out.withColumn(text, F.when(F.col(dropped) > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, dropped)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_documents(spark, sf_dir)
    return remove_boilerplate(docs).select(
        "doc_id", F.col("_ld_dropped").cast("long").alias("n_dropped"), F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, u.pos AS pos, u.line AS line,
         regexp_full_match(u.line, '[ \\t\\r]*') AS blank
  FROM (SELECT doc_id, source, unnest(list_transform(range(1, len(l) + 1), lambda i: {{'pos': i, 'line': l[i]}})) AS u
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
), totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE NOT blank
  GROUP BY l.source, l.line, t.total HAVING count(DISTINCT doc_id) - 1 > t.total * {RATIO}::DOUBLE + {CONFIDENCE}::DOUBLE * sqrt(t.total * {RATIO}::DOUBLE * {1 - RATIO}::DOUBLE)
), kept AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line AND NOT l.blank
)
SELECT d.doc_id, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped,
       length(CASE WHEN k.n_dropped > 0 THEN k.new_text ELSE d.text END)::BIGINT AS n_chars,
       sha256(CASE WHEN k.n_dropped > 0 THEN k.new_text ELSE d.text END) AS text_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS new_text
  FROM kept GROUP BY doc_id) k ON d.doc_id = k.doc_id
"""
