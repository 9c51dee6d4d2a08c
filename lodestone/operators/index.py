"""A kept inverted index: BM25 over tables that are written once, added to, and read by term.

`postings` has a row for each block of at most BLOCK postings of a term, the highest impacts first, with the largest
frequency and smallest length of the block; it is partitioned by a hash of the term, so a search opens the buckets of
its terms only.  A term's postings are dealt into parts of at most about PART chunks before they are sorted, so a word of
all chunks is no single task's work.  `forward` has each chunk's terms, `terms` the chunks of each term.
An upsert or prune adds a segment and names the rows of older segments that are dead; counts of the dead are taken
off in the same segment.  A state file, created without overwriting, makes it visible.

A search whose terms have few postings scores them all.  Else it takes two passes.  The first sums the first block of each term of a query and scores the best of these chunks
in whole: the k-th of their scores is a threshold that the k-th of all cannot be under.  By it a query's terms part into those that together cannot reach it and
the others; only blocks, and then postings, of the others that can still reach it are scored, and for what is left the rest of
its terms is looked up.  Results equal those of scoring every chunk that shares a term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import lexical
from lodestone.operators.lexical import BROADCAST_TERMS, EPSILON, K1, B
from lodestone.operators.lineage import cut
from lodestone.sources import versions

BLOCK, PART = 128, 1_000_000
#: Chunks for each bucket of terms; there are LEAST_BUCKETS at least.
CHUNKS_PER_BUCKET, LEAST_BUCKETS = 100_000, 8
#: Postings, counted for each query, up to which all are scored in one pass; the same results come from the two passes beyond.
DIRECT = 20_000_000
#: Chunks, times k, that set a query's threshold.
LIKELY = 4
#: Slack of a comparison with the threshold, for sums in another order.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    @property
    def state(self) -> dict:
        found = versions.latest(self.spark, f"{self.path}/states")[1]
        if found is None:
            raise ValueError(f"no index at {self.path}")
        return found

    def read(self, table: str, state: dict | None = None, segments: list[str] | None = None) -> DataFrame:
        """A table of the index's segments, with the column `segment`."""
        base = f"{self.path}/{table}"
        return self.spark.read.schema(_SCHEMAS[table]).option("basePath", base).parquet(*[f"{base}/segment={s}" for s in (segments or (state or self.state)["segments"])])


_SCHEMAS = {
    "postings": "term string, salt int, block int, n int, max_tf long, min_dl long, posts array<struct<chunk_id:bigint,tf:bigint,dl:bigint>>, segment string, bucket int",
    "terms": "term string, df long, segment string, bucket int",
    "forward": "chunk_id long, dl long, terms array<struct<term:string,tf:bigint>>, segment string",
}


def counted(rows: DataFrame, tokens: str) -> DataFrame:
    """rows with a column `terms`: the distinct elements of the sorted array `tokens` with their counts."""
    firsts = F.expr(f"array_compact(transform({tokens}, (x, i) -> if(i > 0 and x = get({tokens}, i - 1), null, i)))")
    each = f"transform(firsts, (a, k) -> named_struct('term', {tokens}[a], 'tf', cast(coalesce(get(firsts, k + 1), size({tokens})) - a as bigint)))"
    return rows.withColumn("firsts", firsts).withColumn("terms", F.expr(each)).drop("firsts")


def shape(tf: Column, dl: Column, avgdl: float) -> Column:
    """What a term's frequency and a chunk's length make of the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _bucket(state: dict) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(state["buckets"])).cast("int")


def _write(df: DataFrame, index: Index, table: str, segment: str, by: list[str] = ()) -> None:
    df.write.partitionBy(*by).parquet(f"{index.path}/{table}/segment={segment}")


def _add(index: Index, before: dict | None, number: int, chunks: DataFrame | None, gone: DataFrame | None, text: str) -> None:
    """A segment of the chunks' postings; gone: rows of `forward` (segment, chunk_id, dl, terms) that it replaces."""
    spark, segment = index.spark, uuid.uuid4().hex
    empty = spark.createDataFrame([], "chunk_id long, dl long, terms array<struct<term:string,tf:bigint>>")
    if chunks is None:
        rows = empty
    else:
        listed = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.sort_array(F.coalesce(lexical.tokens(F.col(text)), F.array().cast("array<string>"))).alias("t"))
        rows = counted(listed, "t").select("chunk_id", F.size("t").cast("long").alias("dl"), "terms")
    _write(rows, index, "forward", segment)
    own = index.read("forward", segments=[segment])
    sums = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).head()
    taken = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).head() if gone is not None else None
    state = dict(before) if before else {"segments": [], "n_docs": 0, "total_dl": 0, "dead": None, "buckets": max(LEAST_BUCKETS, sums.n // CHUNKS_PER_BUCKET), "text": text}
    state["segments"] = [*state["segments"], segment]
    state["n_docs"] += sums.n - (taken.n if taken else 0)
    state["total_dl"] += sums.dl - (taken.dl if taken else 0)
    avgdl = state["total_dl"] / max(1, state["n_docs"]) or 1.0
    salts = sums.n // PART + 1
    posts = own.select("chunk_id", "dl", F.inline("terms")).withColumns({"bucket": _bucket(state), "salt": F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int")})
    order = Window.partitionBy("bucket", "salt", "term").orderBy(shape(F.col("tf"), F.col("dl"), avgdl).desc(), "chunk_id")
    dealt = posts.repartition(state["buckets"] * salts, "bucket", "salt").withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
    blocks = dealt.groupBy("bucket", "salt", "term", "block").agg(
        F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "dl"))).alias("posts"))
    _write(blocks.select("term", "salt", "block", "n", "max_tf", "min_dl", "posts", "bucket"), index, "postings", segment, ["bucket"])
    df = index.read("postings", segments=[segment]).select("term", F.col("n").cast("long").alias("df"))
    if gone is not None:
        df = df.unionByName(gone.select(F.explode("terms.term").alias("term")).withColumn("df", F.lit(-1).cast("long")))
    df = df.groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0").withColumn("bucket", _bucket(state))
    _write(df.repartition(state["buckets"], "bucket"), index, "terms", segment, ["bucket"])
    if gone is not None:
        dead, name = gone.select("segment", "chunk_id"), uuid.uuid4().hex
        if state["dead"]:
            dead = dead.unionByName(spark.read.parquet(f"{index.path}/dead/{state['dead']}"))
        dead.write.parquet(f"{index.path}/dead/{name}")
        state["dead"] = name
    # the mean weight of all terms, for those that are in over half of the chunks
    raw = _raw(F.col("df"), state["n_docs"])
    state["mean"] = frequencies(index, state).agg(F.avg(raw).alias("m")).head().m or 0.0
    versions.publish(spark, f"{index.path}/states", number + 1, state)


def _raw(df: Column, n_docs: int) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5))


def frequencies(index: Index, state: dict | None = None) -> DataFrame:
    """term, df of the live chunks."""
    state = state or index.state
    return index.read("terms", state).groupBy("term", "bucket").agg(F.sum("df").alias("df")).filter("df > 0")


def build(chunks: DataFrame, path: str, text: str = "text") -> Index:
    """An index of chunks (chunk_id, text) at a new path; ids are one to a chunk."""
    index = Index(chunks.sparkSession, path.rstrip("/"))
    _add(index, None, 0, chunks, None, text)
    return index


def _live(index: Index, state: dict, rows: DataFrame) -> DataFrame:
    if not state["dead"]:
        return rows
    return rows.join(index.spark.read.parquet(f"{index.path}/dead/{state['dead']}"), ["segment", "chunk_id"], "left_anti")


def upsert(index: Index, chunks: DataFrame) -> None:
    """Add chunks; those whose id the index has are replaced."""
    number, state = versions.latest(index.spark, f"{index.path}/states")
    chunks = cut(chunks.select("chunk_id", state["text"]))
    gone = cut(_live(index, state, index.read("forward", state)).join(chunks.select("chunk_id"), "chunk_id", "left_semi"))
    _add(index, state, number, chunks, gone, state["text"])


def prune(index: Index, ids: DataFrame) -> None:
    """Take the chunks (chunk_id) out."""
    number, state = versions.latest(index.spark, f"{index.path}/states")
    gone = cut(_live(index, state, index.read("forward", state)).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    _add(index, state, number, None, gone, state["text"])


def vocabulary(index: Index) -> DataFrame:
    """Distinct tokens of at least three characters."""
    return frequencies(index).filter(F.length("term") >= 3).select("term")


def search(index: Index, queries: DataFrame | None, k: int, terms: DataFrame | None = None) -> DataFrame:
    """What `lexical.search` finds in the chunks of the index: query_id, chunk_id, score, rank."""
    state, spark = index.state, index.spark
    avgdl, dead = state["total_dl"] / max(1, state["n_docs"]) or 1.0, bool(state["dead"])
    asked = cut((lexical.query_terms(queries) if terms is None else terms).withColumn("bucket", _bucket(state)))
    wanted = asked.select("term", "bucket").distinct()
    few = asked.count() <= BROADCAST_TERMS
    side = lambda df: F.broadcast(df) if few else df  # noqa: E731  as many rows as the queries have terms, at most
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # a number a bucket
    found = lambda t: index.read(t, state).filter(F.col("bucket").isin(buckets))
    df = found("terms").join(side(wanted.select("term")), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    raw = _raw(F.col("df"), state["n_docs"])
    weights = cut(asked.join(side(df), "term").select("query_id", "term", "df", (F.col("qf") * F.when(raw < 0, EPSILON * state["mean"]).otherwise(raw)).alias("w")))
    blocks = found("postings")

    def posted(rows: DataFrame) -> DataFrame:
        """The blocks' live postings; further columns stay."""
        each = rows.select(*[c for c in rows.columns if c != "posts"], F.explode("posts").alias("p")).select("*", "p.chunk_id", "p.tf", "p.dl").drop("p")
        return _live(index, state, each) if dead else each

    part = F.col("w") * shape(F.col("tf"), F.col("dl"), avgdl)

    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    ranked = lambda parts: parts.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score")).filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if (weights.agg(F.sum("df").alias("n")).head().n or 0) <= DIRECT:
        return ranked(posted(blocks.select("segment", "term", "posts").join(side(weights), "term")).select("query_id", "chunk_id", part.alias("s")))

    def parts_of(pairs: DataFrame, by: DataFrame) -> DataFrame:
        """query_id, chunk_id, s: a row for each term of `by` (query_id, term, w) that a pair's chunk has; pairs are checkpointed."""
        chosen = pairs.select("chunk_id").distinct()
        chosen = F.broadcast(chosen) if pairs.count() <= BROADCAST_TERMS else chosen
        own = posted(blocks.select("segment", "term", "posts").join(side(by.select("term").distinct()), "term", "left_semi")).join(chosen, "chunk_id", "left_semi")
        return own.select("term", "chunk_id", "tf", "dl").join(pairs.select("query_id", "chunk_id").join(side(by), "query_id"), ["term", "chunk_id"]).select("query_id", "chunk_id", part.alias("s"))

    best = Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk_id")
    if state["mean"] > 0:
        first = posted(blocks.filter("block = 0").select("segment", "term", "posts").join(side(weights), "term")).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("s"))
        likely = cut(first.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= LIKELY * k).select("query_id", "chunk_id"))
        full = parts_of(likely, weights).groupBy("query_id", "chunk_id").agg(F.sum("s").alias("s"))
        kth = full.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("s")).otherwise(0.0).alias("least"))
    else:  # weights may be negative, so a part is no bound: every posting is scored
        kth = weights.select("query_id").distinct().withColumn("least", F.lit(float("-inf")))
    top = blocks.select("term", shape(F.col("max_tf"), F.col("min_dl"), avgdl).alias("most")).join(side(wanted.select("term")), "term", "left_semi").groupBy("term").agg(F.max("most").alias("most"))
    rising = Window.partitionBy("query_id").orderBy("u", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("query_id")
    bounds = weights.join(side(top), "term").join(kth, "query_id").withColumn("u", F.col("w") * F.col("most"))
    bounds = bounds.withColumns({"upto": F.sum("u").over(rising), "others": F.sum("u").over(whole) - F.col("u")}).withColumn("least", F.col("least") - SLACK)
    bounds = bounds.withColumn("minor", F.col("upto") < F.col("least"))  # all chunks that have only such terms are out
    bounds = cut(bounds.withColumn("minors", F.sum(F.when(F.col("minor"), F.col("u")).otherwise(0.0)).over(whole)).select("query_id", "term", "w", "least", "others", "minor", "minors"))
    reach = blocks.select("segment", "term", "max_tf", "min_dl", "posts").join(side(bounds.filter("not minor")), "term").filter(F.col("w") * shape(F.col("max_tf"), F.col("min_dl"), avgdl) + F.col("others") >= F.col("least"))
    parts = posted(reach).withColumn("part", part).filter(F.col("part") + F.col("others") >= F.col("least"))
    # a chunk with a posting that is passed over here is out; all others have their parts of these terms together
    able = cut(parts.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("s"), F.first("least").alias("least"), F.first("minors").alias("minors")).filter(F.col("s") + F.col("minors") >= F.col("least")).drop("least", "minors"))
    rest = parts_of(able, bounds.filter("minor").select("query_id", "term", "w"))
    return ranked(able.unionByName(rest))
