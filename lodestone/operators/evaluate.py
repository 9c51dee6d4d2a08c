"""Evaluation: recall and precision by class, stability, overlap, agreement, load and profile analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import jaccard
from lodestone.operators.metrics import ranked_counts

# Fixed values.
DECLINE_CUES = (
    "isn't covered", "is not covered", "not covered", "outside the scope", "outside my scope", "not able to", "don't have information",
    "do not have information", "no information", "cannot help with", "can't help with", "not something i can", "unrelated to",
    "not related to", "i don't have", "not in the knowledge base", "no relevant articles", "doesn't appear in", "does not appear in",
    "isn't something", "beyond what", "not part of",
)
# The site's own address belongs here as well; callers pass it.
HELP_DESK = ("help desk", "knowledge base")
FAILURE_CUES = ("could not generate an answer", "not a gap in the knowledge base", "check the server logs")
STEP = r"(?i)(^|\n)\s*(?:\d+[.)]|step\s+\d)"
FILLER = """
the a an and or but if then than that this these those is are was were be been being to of in on at for with from by as it its
you your we our they their i me my will can could should would may might do does did have has had not no yes please here there
how what when where which who why step steps click select open go see use using need want help also any all more most some other
into out up down after before once each both about
""".split()
# Names of the exceptions that a client raises.
TIMEOUTS, REFUSED = ("ReadTimeout", "ConnectTimeout", "PoolTimeout"), ("ConnectError",)
TARGET_S = 10.0
SHINGLE, CONTAINED = 8, 0.15
#: Shingles (some 30 bytes each, with their text's id and size) of the left side that are broadcast.
BROADCAST_SHINGLES = 1_000_000
MIN_TERM, MIN_TERMS = 4, 8


def quality(results: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, kind, recall, precision: results (query_id, rank, article_id) against cases (query_id, kind, expected array).

    A case that expects nothing is right when nothing is found.
    """
    got = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id"))).getField("article_id").alias("got"))
    j = cases.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.expr("cast(array() as array<bigint>)")))
    hits = F.size(F.array_intersect("got", "expected"))
    right = F.size(F.filter("got", lambda a: F.array_contains("expected", a)))
    none = F.size("expected") == 0
    nothing = (F.size("got") == 0).cast("double")
    return j.select("query_id", "kind", F.when(none, nothing).otherwise(hits / F.size("expected")).alias("recall"), F.when(none, nothing).when(F.size("got") == 0, 0.0).otherwise(right / F.size("got")).alias("precision"))


def quality_by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))


def separation(rows: DataFrame) -> DataFrame:
    """Mean confidence of covered questions minus that of off-topic ones."""
    return rows.agg((F.avg(F.when(F.col("kind") == "covered", F.col("confidence"))) - F.avg(F.when(F.col("kind") == "offtopic", F.col("confidence")))).alias("separation"))


def stability(results: DataFrame) -> DataFrame:
    """group, n_queries, mean and least overlap of two phrasings, agree (all have the same first article), spread of confidence.

    results: group, phrasing, articles (distinct, in order), confidence.  A group is the handful of phrasings of one question.
    """
    top = F.try_element_at("articles", F.lit(1))
    whole = results.groupBy("group").agg(
        F.count("*").alias("n_queries"), ((F.countDistinct(top) == 1) & (F.count(top) == F.count("*"))).alias("agree"),
        (F.max("confidence") - F.min("confidence")).alias("spread"), F.array_sort(F.collect_list(F.struct("phrasing", "articles"))).alias("p"),
    )
    at = lambda i: F.get("p", i)["articles"]
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda j: j > i), lambda j: jaccard(at(i), at(j)))))
    got = whole.select("group", "n_queries", "agree", "spread", pairs.alias("o"))
    mean = F.aggregate("o", F.lit(0.0), lambda x, y: x + y) / F.size("o")
    return got.select("group", "n_queries", F.when(F.size("o") > 0, mean).otherwise(0.0).alias("mean_overlap"), F.coalesce(F.array_min("o"), F.lit(0.0)).alias("least_overlap"), "agree", "spread")


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, first_rank: of the first expected article (expected: query_id, article_id)."""
    return results.join(expected, ["query_id", "article_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))


def recall_at(hits: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    j = queries.select("query_id").join(hits, "query_id", "left")
    return j.agg(*[F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")).alias(f"recall_at_{k}") for k in ks])


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("query", F.col("recall").alias("before")).join(after.select("query", F.col("recall").alias("after")), "query").filter("after < before")


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller of two sets; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the runs of n words, made of the words' hashes."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), lambda x: F.xxhash64(x))  # noqa: PLW0108 - a lambda names its variable

    def runs(w: Column) -> Column:
        of = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), of))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def contained(left: DataFrame, right: DataFrame, least: float = CONTAINED) -> DataFrame:
    """left_id, right_id, shared, share of the pairs (left_id, text; right_id, text) whose shingles' containment exceeds `least`.

    Shingles meet as 64-bit hashes.  Up to BROADCAST_SHINGLES of the left side go to the right side's rows, so a shingle
    that half of them hold is nobody's single task and only counts of pairs are shuffled; beyond, both sides are shuffled.
    """
    a = left.select("left_id", shingle_hashes(F.col("text")).alias("s")).select("left_id", F.size("s").alias("a"), F.explode("s").alias("g"))
    b = right.select("right_id", shingle_hashes(F.col("text")).alias("s")).select("right_id", F.size("s").alias("b"), F.explode("s").alias("g"))
    if a.count() <= BROADCAST_SHINGLES:
        a = F.broadcast(a)
    pairs = a.join(b, "g").groupBy("left_id", "right_id").agg(F.count("*").alias("shared"), F.first("a").alias("a"), F.first("b").alias("b"))
    return pairs.withColumn("share", F.col("shared") / F.least("a", "b")).filter(F.col("share") > least).select("left_id", "right_id", "shared", "share")


def distinctive(text: Column) -> Column:
    """Distinct lower-cased words of at least MIN_TERM characters that are no filler."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= MIN_TERM) & ~t.isin(FILLER)))


def grounding(answer: Column, sources: Column) -> Column:
    """Share of the answer's distinctive words that the sources hold; NaN for too few words, 0 without sources."""
    a = distinctive(answer)
    return F.when(F.size(a) < MIN_TERMS, F.lit(float("nan"))).otherwise(F.size(F.array_intersect(a, distinctive(F.coalesce(sources, F.lit(""))))) / F.size(a))


def _holds(text: Column, cues: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, cues)), lambda m: F.contains(F.lower(text), m))


def llm_failed(answer: Column) -> Column:
    """The answer is the service's own error message."""
    return _holds(answer, FAILURE_CUES)


def declined(answer: Column, help_desk: tuple[str, ...] = HELP_DESK) -> Column:
    """Says so, or only points to the help desk: no numbered step and short."""
    return _holds(answer, DECLINE_CUES) | (_holds(answer, help_desk) & ~answer.rlike(STEP) & (F.char_length(answer) < 700))


def answers_by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.when(~F.isnan("grounding"), F.col("grounding"))).alias("grounding"), F.avg(F.when(F.col("graded"), (F.col("declined") == F.col("should_decline")).cast("double"))).alias("decline_accuracy"))


def consistency(repeats: DataFrame) -> DataFrame:
    """query, unstable: repeats that disagree on declining, or differ by half in length."""
    return repeats.groupBy("query").agg(((F.countDistinct("declined") > 1) | ((F.max("length") - F.min("length")) / F.avg("length") > 0.5)).alias("unstable"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties; 1 where it is undefined.

    Equal pairs are counted first; ranks come from `metrics.ranked_counts`, which no group's size makes one task's work.
    """
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("k"))

    def ranks(c: str) -> DataFrame:
        got = ranked_counts(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x if c == "x" else y)
        return got.select(*[F.col(b).alias(f"{c}_{b}") for b in by], F.col("v").alias(f"{c}_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    same = lambda c: reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{c}_{b}")) for b in by]) & (F.col(c) == F.col(f"{c}_v"))
    ranked = pairs.join(ranks("x"), same("x")).join(ranks("y"), same("y")).select(*by, F.col("k").cast("double").alias("k"), "rx", "ry")
    n = F.sum("k")
    middle = (n + 1) / 2  # the mean rank, whatever the ties
    spread = lambda a, b: F.sum(F.col("k") * F.col(a) * F.col(b)) / n - middle * middle
    got = ranked.groupBy(*by).agg(spread("rx", "ry").alias("xy"), spread("rx", "rx").alias("xx"), spread("ry", "ry").alias("yy"))
    return got.select(*by, F.when((F.col("xx") > 1e-9) & (F.col("yy") > 1e-9), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(1.0).alias("rho"))


def sign_test(pairs: DataFrame) -> DataFrame:
    """wins, n (ties left out), z of paired values (a, b), and the mean difference."""
    r = pairs.agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") != F.col("b")).alias("n"), F.avg(F.col("b") - F.col("a")).alias("mean_diff"))
    return r.withColumn("z", F.when(F.col("n") > 0, (F.col("wins") - F.col("n") / 2) / F.sqrt(F.col("n") / 4)).otherwise(0.0))


def error_kind(status: Column, exception: Column) -> Column:
    """rate_limited, server_error, timeout, connection or other, from a status or else the name of the exception."""
    name = F.coalesce(exception, F.lit(""))
    return (
        F.when(status == 429, "rate_limited").when(status >= 500, "server_error").when(status >= 400, "other")
        .when(name.isin(*TIMEOUTS), "timeout").when(name.isin(*REFUSED), "connection").otherwise("other")
    )


def load_summary(rows: DataFrame) -> DataFrame:
    """users, requests, error_rate, throughput (good ones by the wall time)."""
    return rows.groupBy("users").agg(F.count("*").alias("requests"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"), (F.count_if("ok") / F.max("wall_s")).alias("throughput"))


def saturation(levels: DataFrame) -> DataFrame:
    """best_users, plateau (there are later levels and none is faster), first_miss (fewest users with p95 above TARGET_S)."""
    w = Window.orderBy("users").rowsBetween(1, Window.unboundedFollowing)  # a handful of levels
    later = levels.withColumn("later", F.max("throughput").over(w))
    top = later.agg(F.max_by("users", F.struct("throughput", -F.col("users"))).alias("best_users"), F.max("throughput").alias("best"), F.min(F.when(F.col("p95") > TARGET_S, F.col("users"))).alias("first_miss"))
    return later.join(F.broadcast(top), F.col("users") == F.col("best_users")).select("best_users", F.coalesce(F.col("later") <= F.col("best"), F.lit(False)).alias("plateau"), "first_miss")


def passes(p95: Column, error_rate: Column) -> Column:
    """A level meets the target: fast enough and without an error."""
    return (p95 <= TARGET_S) & (error_rate == 0)


def stage_means(traces: DataFrame) -> DataFrame:
    """level, stage, mean_ms over all traces of the level; a missing stage counts as 0."""
    n = traces.groupBy("level").agg(F.count("*").alias("n"))
    sums = traces.select("level", F.explode("timings").alias("stage", "ms")).groupBy("level", "stage").agg(F.sum("ms").alias("ms"))
    return sums.join(n, "level").select("level", "stage", (F.col("ms") / F.col("n")).alias("mean_ms"))


def residual(total: Column, timings: Column) -> Column:
    return F.greatest(F.lit(0.0), total - F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, x: a + x))


def stage_shares(calls: DataFrame, wall: DataFrame) -> DataFrame:
    """stage, total, per_query, calls_per_query, share of calls (stage, query_id, ms) in the wall time (one row: wall_ms, n)."""
    g = calls.groupBy("stage").agg(F.sum("ms").alias("total"), F.count("*").alias("calls"))
    return g.crossJoin(F.broadcast(wall)).select("stage", "total", (F.col("total") / F.col("n")).alias("per_query"), (F.col("calls") / F.col("n")).alias("calls_per_query"), (F.col("total") / F.col("wall_ms")).alias("share"))


def dominant_stage(shares: DataFrame, wall: DataFrame) -> DataFrame:
    """One row of `stage_shares`: the stage with most time, its share, and all stages' time by the wall time."""
    top = shares.agg(F.max_by("stage", F.struct("total", "stage")).alias("stage"), F.max("share").alias("share"), F.sum("total").alias("all"))
    return top.crossJoin(F.broadcast(wall)).select("stage", "share", (F.col("all") / F.col("wall_ms")).alias("covered"))  # one row each


def workload(levels: DataFrame, requests: int, n_questions: int, unique: bool = True) -> DataFrame:
    """level, user, request, q_index, suffix (levels: level, users); the suffix makes each message miss the cache, unless not unique."""
    rows = levels.select("level", F.explode(F.sequence(F.lit(0), F.col("users") - 1)).alias("user")).select("*", F.explode(F.sequence(F.lit(0), F.lit(requests - 1))).alias("request"))
    suffix = F.concat(F.lit(" (ref "), F.concat_ws("-", F.col("level").cast("string"), F.col("user").cast("string"), F.col("request").cast("string")), F.lit(")")) if unique else F.lit("")
    return rows.withColumns({"q_index": F.pmod(F.col("user") * 3 + F.col("request") + F.col("level") * 7, F.lit(n_questions)), "suffix": suffix})


def token_usage(usage: Column) -> Column:
    """(input, output) of a provider's JSON; the first name with a count."""
    n = lambda k: F.nullif(F.get_json_object(usage, f"$.{k}").cast("long"), F.lit(0))
    return F.struct(F.coalesce(n("input_tokens"), n("prompt_tokens"), F.lit(0)).alias("input"), F.coalesce(n("output_tokens"), n("completion_tokens"), F.lit(0)).alias("output"))


def cleaning_probe(text: Column, markers: list[str]) -> Column:
    """(split_words: a letter, a blank and one to three small letters; leaked: markers of the chrome that are left)."""
    return F.struct(F.regexp_count(text, F.lit(r"\b([A-Za-z]) ([a-z]{1,3})\b")).alias("split_words"), F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(text), m))).alias("leaked"))


def eval_set_faults(cases: DataFrame, known: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """fault, n: repeated queries, unknown ids, expectations that don't fit the kind, and groups (group, query) with fewer than two phrasings."""
    repeated = cases.groupBy("query").count().filter("count > 1").agg(F.lit("repeated").alias("fault"), F.count("*").alias("n"))
    unknown = cases.select(F.explode("expected").alias("article_id")).join(known, "article_id", "left_anti").agg(F.lit("unknown").alias("fault"), F.count("*").alias("n"))
    unfit = cases.filter((F.col("kind") == "offtopic") != (F.size("expected") == 0)).agg(F.lit("unfit").alias("fault"), F.count("*").alias("n"))
    out = repeated.unionByName(unknown).unionByName(unfit)
    if groups is not None:
        lone = groups.groupBy("group").agg(F.countDistinct("query").alias("k")).filter("k < 2")
        out = out.unionByName(lone.agg(F.lit("lone").alias("fault"), F.count("*").alias("n")))
    return out


def checks(*named: tuple[str, DataFrame]) -> DataFrame:
    """label, ok of one-row DataFrames with a column ok."""
    out = None
    for label, df in named:
        row = df.select(F.lit(label).alias("label"), "ok")
        out = row if out is None else out.unionByName(row)
    return out


def little_law(levels: DataFrame) -> DataFrame:
    """users, latency_s with the throughput that they imply."""
    return levels.withColumn("throughput", F.when(F.col("latency_s") > 0, F.col("users") / F.col("latency_s")))


def shared_words(a: Column, b: Column) -> Column:
    """Distinct words of more than two letters that two texts share."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))
    return F.array_sort(F.array_intersect(words(a), words(b)))


def sweep(candidates: DataFrame, expected: DataFrame, weights: list[float], k: int) -> DataFrame:
    """weight, hits_at_1, hits_at_k: the blend of two scores (a, b in 0 to 1) under each weight, in one job."""
    grid = F.explode(F.array(*map(F.lit, weights))).alias("weight")
    mixed = candidates.select("query_id", "chunk_id", "a", "b", grid).withColumn("mixed", F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b"))
    order = Window.partitionBy("weight", "query_id").orderBy(F.round("mixed", 9).desc(), "chunk_id")
    ranked = mixed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    hit = ranked.join(expected, ["query_id", "chunk_id"], "left_semi").groupBy("weight", "query_id").agg(F.min("rank").alias("first"))
    return hit.groupBy("weight").agg(F.count_if(F.col("first") == 1).alias("hits_at_1"), F.count("*").alias("hits_at_k"))


def parity(pairs: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """max_diff, same_order, ok of two scores (item, a, b); each query_id is ordered on its own."""
    rank = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "item"))
    r = pairs.withColumns({"ra": rank("a"), "rb": rank("b")})
    return r.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"), F.bool_and(F.col("ra") == F.col("rb")).alias("same_order")).withColumn("ok", (F.col("max_diff") < tolerance) & F.col("same_order"))


def drift(opening: Column, closing: Column, most: float = 0.25) -> Column:
    """Whether a run's closing time stayed near its opening time."""
    return F.when(opening > 0, F.abs(closing - opening) / opening <= most).otherwise(F.lit(False))
