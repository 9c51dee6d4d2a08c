"""Counters, gauges, cumulative histograms, exposition text, and four kinds of percentile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Milliseconds.
BUCKETS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)
# Bounds of what is no duration, and what the series of a trace mean.
TRACE_BUCKETS = {
    "rag_request_duration_ms": BUCKETS, "rag_stage_duration_ms": BUCKETS, "rag_confidence": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
    "rag_chunks_returned": (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0),
}
TRACE_HELP = {
    "rag_queries_total": "Total retrieval requests processed.",
    "rag_cache_total": "Retrieval cache lookups by outcome.",
    "rag_query_understood_total": "Queries where preprocessing detected an entity, intent, correction or synonym expansion.",
    "rag_below_threshold_total": "Queries whose confidence fell below the gating threshold.",
    "rag_request_duration_ms": "End-to-end retrieval latency in milliseconds.",
    "rag_stage_duration_ms": "Per-stage retrieval latency in milliseconds.",
    "rag_confidence": "Retrieval confidence score.",
    "rag_chunks_returned": "Chunks returned to the LLM after all filtering.",
}
UPTIME_HELP = "Seconds since the metrics registry started."


def labels_key(labels: Column) -> Column:
    """A map's entries in order of their names, as `a="x",b="y"`; order of writing doesn't matter."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), ",")


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name", labels_key(F.col("labels")).alias("labels")).agg(F.sum("value").alias("value"))


def gauges(rows: DataFrame) -> DataFrame:
    """The last write by (ts, seq)."""
    return rows.groupBy("name", labels_key(F.col("labels")).alias("labels")).agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def histogram(rows: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """by, le (null for +Inf), cumulative count, count and sum: one aggregate for all bounds, then one row a bound."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"c{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*aggs, F.count(value).alias("n"), F.sum(value).alias("total"))
    listed = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"c{i}").alias("c")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("c")))
    return wide.select(*by, F.explode(listed).alias("b"), "n", "total").select(*by, "b.le", F.col("b.c").alias("cumulative"), F.col("n").alias("count"), F.col("total").alias("sum"))


def snapshot(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))


def _sample(name: str, value: Column, **labels: Column) -> Column:
    pairs = [x for k, v in sorted(labels.items()) for x in (F.lit(k), v)]
    keyed = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(name).alias("name"), labels_key(keyed).alias("labels"), value.cast("double").alias("value"))


def trace_counters(traces: DataFrame) -> DataFrame:
    """name, labels, value: what each trace (intents, cache_hit, understood, passed) adds to counters."""
    intent = F.coalesce(F.try_element_at("intents", F.lit(1)), F.lit("none"))
    outcome = F.when(F.col("cache_hit"), "hit").otherwise("miss")
    one = F.lit(1)
    none = F.lit(None)
    every = F.array(
        _sample("rag_queries_total", one, intent=intent, cache=outcome), _sample("rag_cache_total", one, result=outcome),
        F.when(F.col("understood"), _sample("rag_query_understood_total", one)).otherwise(none),
        F.when(~F.col("passed"), _sample("rag_below_threshold_total", one, intent=intent)).otherwise(none),
    )
    return traces.select(F.explode(F.array_compact(every)).alias("s")).select("s.*")


def trace_observations(traces: DataFrame) -> DataFrame:
    """name, labels, value: what each trace (intents, total_ms, timings, confidence, n_final) adds to histograms."""
    intent = F.coalesce(F.try_element_at("intents", F.lit(1)), F.lit("none"))
    stages = F.transform(F.map_entries("timings"), lambda e: _sample("rag_stage_duration_ms", e["value"], stage=e["key"]))
    rest = F.array(_sample("rag_request_duration_ms", F.col("total_ms"), intent=intent), _sample("rag_confidence", F.col("confidence")), _sample("rag_chunks_returned", F.col("n_final")))
    return traces.select(F.explode(F.concat(rest, F.coalesce(stages, F.slice(rest, 1, 0)))).alias("s")).select("s.*")


def trace_histograms(observations: DataFrame) -> DataFrame:
    """name, labels, le, cumulative, count, sum: each series with the bounds of its name."""
    by_bounds: dict[tuple[float, ...], list[str]] = {}
    for name, bounds in TRACE_BUCKETS.items():
        by_bounds.setdefault(bounds, []).append(name)
    parts = [histogram(observations.filter(F.col("name").isin(names)), ["name", "labels"], "value", bounds) for bounds, names in by_bounds.items()]
    return reduce(DataFrame.unionByName, parts)


def general(value: Column) -> Column:
    """A number with six significant digits and without needless zeros, as C's `%g` prints it."""
    scientific = F.format_string("%.5e", value.cast("double"))
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).cast("int")
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    out = F.concat(trimmed(F.regexp_extract(scientific, r"^(.*)e", 1)), F.regexp_extract(scientific, r"(e[+-]\d+)$", 1))
    for e in range(-4, 6):
        out = F.when(exponent == e, trimmed(F.format_string(f"%.{5 - e}f", value.cast("double")))).otherwise(out)
    return F.when(value == 0, "0").otherwise(out)


def exposition(counted: DataFrame | None, gauged: DataFrame | None = None, histograms: DataFrame | None = None, help_: dict[str, str] | None = None, uptime_s: float = 0.0) -> DataFrame:
    """kind, name, labels, place, line: samples of counters and gauges (name, labels, value) and histograms in the text format's order.

    kind is 0 for counters, 1 gauges, 2 histograms, 3 uptime; a name's HELP and TYPE have place -1.
    """
    known = help_ or {}
    parts = []

    def braced(*inner: Column) -> Column:
        joined = F.concat_ws(",", *[F.nullif(c, F.lit("")) for c in inner])
        return F.when(joined != "", F.concat(F.lit("{"), joined, F.lit("}"))).otherwise(F.lit(""))

    def heads(names: DataFrame, kind: int, type_: str) -> DataFrame:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")
        text = F.try_element_at(table, F.col("name"))
        line = F.concat(F.when(text.isNotNull(), F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), text, F.lit("\n"))).otherwise(F.lit("")), F.lit("# TYPE "), F.col("name"), F.lit(f" {type_}"))
        return names.select("name").distinct().select(F.lit(kind).alias("kind"), "name", F.lit("").alias("labels"), F.lit(-1).alias("place"), line.alias("line"))

    for kind, type_, df in ((0, "counter", counted), (1, "gauge", gauged)):
        if df is not None:
            parts += [heads(df, kind, type_), df.select(F.lit(kind).alias("kind"), "name", "labels", F.lit(0).alias("place"), F.concat("name", braced(F.col("labels")), F.lit(" "), general(F.col("value"))).alias("line"))]
    if histograms is not None:
        bound = F.when(F.col("le").isNull(), "+Inf").when(F.col("le") == F.floor("le"), F.col("le").cast("long").cast("string")).otherwise(general(F.col("le")))
        place = F.row_number().over(Window.partitionBy("name", "labels").orderBy(F.col("le").asc_nulls_last()))  # a dozen bounds
        buckets = histograms.select(
            F.lit(2).alias("kind"), "name", "labels", place.alias("place"),
            F.concat("name", F.lit("_bucket"), braced(F.col("labels"), F.concat(F.lit('le="'), bound, F.lit('"'))), F.lit(" "), F.col("cumulative").cast("string")).alias("line"),
        )
        whole = histograms.filter("le is null")
        ends = [
            whole.select(F.lit(2).alias("kind"), "name", "labels", F.lit(at).alias("place"), F.concat("name", F.lit(f"_{what}"), braced(F.col("labels")), F.lit(" "), value).alias("line"))
            for at, what, value in ((1000, "sum", general(F.col("sum"))), (1001, "count", F.col("count").cast("string")))
        ]
        parts += [heads(histograms, 2, "histogram"), buckets, *ends]
    spark = (counted if counted is not None else gauged if gauged is not None else histograms).sparkSession
    up = spark.range(1).select(F.lit(3).alias("kind"), F.lit("rag_uptime_seconds").alias("name"), F.lit("").alias("labels"))
    parts += [
        up.select("*", F.lit(-1).alias("place"), F.lit(f"# HELP rag_uptime_seconds {UPTIME_HELP}\n# TYPE rag_uptime_seconds gauge").alias("line")),
        up.select("*", F.lit(0).alias("place"), F.concat(F.lit("rag_uptime_seconds "), general(F.lit(float(uptime_s)))).alias("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_exposition(lines: DataFrame, path: str) -> None:
    """The lines in order as a text file."""
    lines.repartition(1).sortWithinPartitions("kind", "name", F.col("place") != -1, "labels", "place").select("line").write.mode("overwrite").text(path)


def parse_exposition(lines: DataFrame) -> DataFrame:
    """series, value: samples of exposition text (value: one line a row); comments and what can't be read are skipped."""
    parts = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.regexp_extract("value", r"^(.*) (\S+)\s*$", 1).alias("series"), F.expr(r"try_cast(regexp_extract(value, '^(.*) (\\S+)\\s*$', 2) as double)").alias("value"))
    return parts.filter("series != '' and value is not null")


def histogram_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """le, count: observations between two scrapes of (le, cumulative), summed over label sets."""
    sums = lambda d, name: d.groupBy(F.coalesce("le", F.lit(float("inf"))).alias("le")).agg(F.sum("cumulative").alias(name))
    j = sums(after, "a").join(sums(before, "b"), "le", "left")
    return j.select("le", (F.col("a") - F.coalesce("b", F.lit(0))).alias("cumulative"))


def interpolated_quantile(cumulative: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, quantile: linear inside the bucket that holds the q-th observation; in +Inf, the bound before it."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = cumulative.withColumn("le", F.coalesce("le", F.lit(float("inf")))).withColumns({
        "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "under": F.coalesce(F.lag("cumulative").over(w), F.lit(0)), "n": F.max("cumulative").over(Window.partitionBy(*by)),
    })
    hit = rows.filter((F.col("n") > 0) & (F.col("cumulative") >= q * F.col("n")) & (F.col("under") < q * F.col("n")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("n") - F.col("under")) / (F.col("cumulative") - F.col("under"))
    return hit.select(*by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


#: Parts that values are dealt into to find a place.
PARTS = 64


def ranked_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, v, n (rows with the value), before (rows of the group with a smaller value), all (rows of the group).

    Equal values are counted before any shuffle, and the distinct ones are dealt into PARTS ranges
    of about as many; running counts are taken inside a range and carried over a table of ranges, so a
    group with most rows is no single task's work.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    same = lambda mark: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{mark}_{c}")) for c in by])
    edges = counted.groupBy(*[F.col(c).alias(f"e_{c}") for c in by]).agg(F.array_distinct(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 10_000)).alias("edges"))
    # as many rows as groups, 64 values each
    parted = counted.join(edges, same("e")).select(*by, "v", "n", F.size(F.filter("edges", lambda e: e <= F.col("v"))).alias("part"))
    sums = parted.groupBy(*by, "part").agg(F.sum("n").alias("t"))
    over = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(c).alias(f"s_{c}") for c in by], F.col("part").alias("s_part"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("base"), F.sum("t").over(Window.partitionBy(*by)).alias("all"))
    inside = Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    running = parted.withColumn("run", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return running.join(carried, same("s") & (F.col("part") == F.col("s_part"))).select(*by, "v", "n", (F.col("run") + F.col("base")).alias("before"), "all")


def _place(rows: DataFrame, by: list[str], value: str, index: Column, name: str) -> DataFrame:
    """The value at a 0-based place of each group's order (index: of `n`, the group's rows)."""
    ranked = ranked_counts(rows, by, value).select(*by, "v", F.col("n").alias("own"), "before", F.col("all").alias("n"))
    at = F.greatest(F.lit(0), F.least(F.col("n") - 1, index))
    return ranked.filter((F.col("before") <= at) & (at < F.col("before") + F.col("own"))).select(*by, F.col("v").alias(name))


def percentile_nearest(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """Nearest rank with ties to even."""
    return _place(rows, by, value, F.bround(F.lit(p / 100.0) * F.col("n") + 0.5).cast("long") - 1, "percentile")


def percentile_floor(rows: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Index int(share * n)."""
    return _place(rows, by, value, F.floor(F.lit(share) * F.col("n")), "percentile")


def percentile_before(rows: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Index int(share * n) - 1."""
    return _place(rows, by, value, F.floor(F.lit(share) * F.col("n")) - 1, "percentile")


def percentile_linear(rows: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Linear between the two places around share * (n - 1); null for a group without values."""
    ranked = ranked_counts(rows, by, value).withColumn("at", F.lit(share) * (F.col("all") - 1))
    stands = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    low, high = F.floor("at"), F.ceil("at")
    ends = ranked.filter(stands(low) | stands(high)).groupBy(*by, "at").agg(F.max(F.when(stands(low), F.col("v"))).alias("a"), F.max(F.when(stands(high), F.col("v"))).alias("b"))
    found = ends.select(*[F.col(c).alias(f"p_{c}") for c in by], F.when(low == high, F.col("a").cast("double")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b")).alias("percentile"))
    groups = rows.select(*by).distinct()
    return groups.join(found, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in by]), "left").select(*by, "percentile")


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, median, stdev (sample; 0 for one), least and most."""
    middle = percentile_linear(rows, by, value, 0.5).select(*[F.col(c).alias(f"m_{c}") for c in by], F.col("percentile").alias("median"))
    rest = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.min(value).alias("least"), F.max(value).alias("most"))
    return rest.join(middle, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in by])).select(*by, "mean", "median", "stdev", "least", "most")
