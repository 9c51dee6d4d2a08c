"""Audit of how far the sources of a language diverge (operator 11).

A language keeps the terms that at least MIN_DOCUMENTS of its documents hold.  Each kept term becomes one wide
vector: an array with its count in every source of the language, in the order of the sources' names.  Shares are
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), for V kept terms and a source's N kept occurrences.
Higher-order functions turn a vector into the contributions |p - q| of all pairs of sources, which are summed
before they are shuffled, so what travels is a row a pair and task.  Terms over-used by a source against its
language are ranked behind a limit a group and task.

Terms are counted in Arrow batches and summed by (language, source, term) before the first shuffle, so a source with a third of the
documents or a word in all of them is no single task's work.  The wide table has as many rows as kept terms and is
the only thing that is read more than once; the languages' totals are broadcast up to BROADCAST_GROUPS sources in
all.  Pairs are the result itself: a language with S sources has S * (S - 1) of them.

Arithmetic is exact: the quotient is found three digits at a time, which holds for totals up to 9 * 10^15.

Defined results: null text, language and source are ''; a document without a term still makes its group, which then
has the share of an unseen term throughout; a language without kept terms has pairs of value 0 and no terms, one
with a single source has no pairs; repeated rows count as documents of their own; only A-Z are lower-cased; ties
in value go by the item's bytes; extra columns are ignored and an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

MIN_DOCUMENTS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Most sources, over all languages, whose totals are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: (source, term) counts that a task holds before it hands them on, and bytes of a long text that are taken at a time.
HELD, PIECE = 200_000, 1 << 22
#: A-Z lower-cased, and a blank for all of ASCII but letters.
_FOLD = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a long one's in several lists."""
    start = 0
    while start < len(raw):
        part = raw[start : start + PIECE].translate(_FOLD)
        if start + PIECE < len(raw):
            part = part[: part.rfind(b" ") + 1] or raw[start:].translate(_FOLD)
        yield part.split()
        start += len(part)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, c (occurrences), d (documents): summed over as many documents as HELD lets."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def summed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (c, d) in held.items():
            n = len(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())],
                names=["lang", "source", "term", "c", "d"],
            )

    for batch in batches:
        at, data = common.buffers(batch.column("text"))
        for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            c, d = held.setdefault(group, (Counter(), Counter()))
            before, own = len(c), set()
            for words in terms(data[at[i] : at[i + 1]].tobytes()):
                c.update(words)
                own.update(words)
            d.update(own)
            size += len(c) - before
        if size > HELD:
            yield from summed()
            held.clear()
            size = 0
    yield from summed()


def share(count: str, total: str, kept: str) -> str:
    """SQL of 1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), for a share of at most 1."""
    by = f"({total} + {PRIOR} * {kept})"
    rest, digits = f"({count} + {PRIOR}L)", []
    for _ in range(3):
        digits.append(f"({rest} * 1000) div {by}")
        rest = f"(({rest} * 1000) % {by})"
    return f"(1 + ({digits[0]}) * 1000000 + ({digits[1]}) * 1000 + ({digits[2]}))"


def wide_vectors(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, counts (map from source to occurrences): one row a kept term."""
    rows = common.in_batches(docs.select("lang", "source", "text"), _counted, "lang string, source string, term string, c long, d long")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    wide = counts.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "c"))).alias("counts"), F.sum("d").alias("documents"))
    return wide.filter(F.col("documents") >= min_documents).select("lang", "term", "counts")


def diverging(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Each source's distance to the others of its language, and the terms it over-uses most."""
    named = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(named("lang"), named("source"), named("text"))
    wide = common.checkpointed(wide_vectors(docs, min_documents))
    groups = docs.select("lang", "source").distinct()
    # N of each source and V of each language; sources without a kept term have N 0
    totals = wide.select("lang", F.explode("counts").alias("source", "c")).groupBy("lang", "source").agg(F.sum("c").alias("n"))
    kept = wide.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("v"))
    languages = (
        groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("s"))
        .join(kept, F.col("lang") == F.col("of"), "left").select(F.col("lang").alias("of"), F.col("s.source").alias("sources"), F.col("s.n").alias("totals"), F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    )
    languages = common.checkpointed(languages)
    n_groups = languages.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("n")).head().n
    side = F.broadcast(languages) if n_groups <= BROADCAST_GROUPS else languages
    vectors = wide.join(side, F.col("lang") == F.col("of")).select("lang", "term", "sources", "totals", "v", F.transform("sources", lambda s: F.coalesce(F.try_element_at("counts", s), F.lit(0)).cast("long")).alias("counts"))
    shares = vectors.withColumns({"p": F.expr(f"zip_with(counts, totals, (c, n) -> {share('c', 'n', 'v')})")})

    def pairs_of(array: str, value: str) -> Column:
        of_one = f"transform(slice({array}, i + 2, size({array})), (y, k) -> named_struct('i', i, 'j', i + 1 + k, 'value', {value}))"
        return F.expr(f"inline(flatten(transform({array}, (x, i) -> {of_one})))")

    sums = shares.select("lang", pairs_of("p", "abs(x - y)")).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(languages.filter("v = 0").select(F.col("of").alias("lang"), pairs_of("sources", "0L")))
    both = sums.select("lang", "value", F.inline(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in ("ij", "ji")])))
    pairs = both.join(side, F.col("lang") == F.col("of")).select("lang", F.get("sources", "i").alias("source"), F.lit("pair").alias("part"), F.get("sources", "j").alias("item"), "value")

    whole = [f"aggregate({a}, 0L, (a, x) -> a + x)" for a in ("counts", "totals")]
    against = shares.withColumn("q", F.expr(share("c", "n", "v").replace("(c ", f"({whole[0]} ").replace("(n ", f"({whole[1]} ")))
    over = "filter(transform(p, (x, i) -> named_struct('source', sources[i], 'value', if(counts[i] > 0 and x > q, x - q, 0L))), x -> x.value > 0)"
    used = against.select("lang", F.col("term").alias("item"), F.expr(f"inline({over})")).select("lang", "source", F.lit("term").alias("part"), "item", "value")

    def ranked(rows: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        best_first = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.row_number().over(best_first).alias("rank"))

    return ranked(pairs).unionByName(ranked(used).filter(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diverging(common.read_documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.term, count(w.k)::HUGEINT AS c FROM g JOIN kept ON g.lang = kept.lang
      LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = kept.term GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.c, 1 + ({SCALE} * (c.c + {PRIOR})) // (n.n + {PRIOR} * v.v)::HUGEINT AS p
      FROM c JOIN n ON c.lang = n.lang AND c.source = n.source JOIN v ON c.lang = v.lang),
q AS (SELECT x.lang, x.term, 1 + ({SCALE} * (x.c + {PRIOR})) // (y.n + {PRIOR} * v.v)::HUGEINT AS q
      FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY lang, term) x
      JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) y ON x.lang = y.lang JOIN v ON x.lang = v.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f
            ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
over AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM over) WHERE r <= {TOP})
SELECT lang, source, part, item, value::BIGINT AS value, r::INT AS rank FROM ranked
"""
