"""Quality rules with robust multivariate outliers (operator 8), DataFrame functions only.

Each document has a few counts, and from them a vector of transformed statistics.
For each (language, source) the minimum covariance determinant gives a centre and
scatter that a minority of bad documents cannot move.  Several starts (quartiles, all
documents, and small random sets) are concentrated side by side: all documents'
distances, then the mean and covariance of the closest CORE of them, whose determinant
falls with each step.  After START_STEPS the start with the smallest determinant goes on, for
as many steps as its group's determinant falls; a group that has converged is left alone.  A document is rejected when its squared
Mahalanobis distance exceeds CUT, the chi-square quantile that REJECTED of normal
documents pass.

Every group is judged: its centre and scatter are drawn towards those of its language
with the weight of SHRINKAGE documents, and these towards those of all documents, so a
group of a few documents has nearly its language's estimate and a large one its own.
Scatter has a floor (FLOORS), since most documents share the value zero in some
statistics.

At scale: texts are read once and never shuffled; the statistics (a hundred bytes
a document) are checkpointed.  Quantiles come from fixed bins, counted before the
shuffle; of the bin at the boundary every document counts with the share that makes the
core exact.  Moments are plain sums, so a group with most rows is no single task's work,
and the results do not depend on partitions beyond rounding.  Centres are broadcast only
when there are at most BROADCAST_GROUPS of them.

Defined results: null or empty texts have no words and fail the base rules; null
language and source are groups like others; repeated rows count as rows; extra
columns are ignored; an empty table gives no rows; a document alone in its table is kept
if it passes the base rules.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common

MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words in repeated three-word windows
#: Share of a group that the scatter is taken from, and of normal documents beyond CUT.
CORE, REJECTED = 0.75, 2e-5
#: Random starts, about how many documents each is taken from, and steps before the best start is chosen.
STARTS, START_SIZE, START_STEPS = 3, 24, 2
#: A group whose determinant falls by a smaller share has converged.
CONVERGED = 1e-3
#: Documents that a group's language (a language's corpus) counts as in its estimate.
SHRINKAGE = 50
BROADCAST_GROUPS = 20_000
#: Least standard deviation of each statistic.
FLOORS = {"s_words": 0.5, "s_length": 0.05, "s_symbols": 0.7, "s_lines": 0.25, "s_repeats": 0.2}
_P = len(FLOORS)
_SPACE = r"[\x20\x09-\x0D]+"
#: Bins of a distance's logarithm, and of a statistic.
_LOG_BINS, _BINS = 64, 256


def chi_square_beyond(x: float, degrees: int) -> float:
    """Share of chi-square values of an odd number of degrees of freedom beyond x."""
    term, tail = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erfc(math.sqrt(x / 2))
    for k in range(1, degrees // 2 + 1):
        tail += term
        term *= x / (2 * k + 1)
    return tail


def chi_square_quantile(beyond: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_beyond(middle, degrees) > beyond else (low, middle)
    return high


CUT = chi_square_quantile(REJECTED, _P)
#: What makes the scatter of the closest CORE that of all, for normal statistics.
CONSISTENCY = CORE / (1 - chi_square_beyond(chi_square_quantile(1 - CORE, _P), _P + 2))
_M = [f"m_{i}" for i in range(_P)]
_C = [f"c_{i}_{j}" for i in range(_P) for j in range(i + 1)]
_L = [f"l_{i}_{j}" for i in range(_P) for j in range(i + 1)]


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word)."""
    text = common.text_column(docs)
    # each select makes an array that the next reads several times, so it is computed once
    first = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.filter(F.split(text, _SPACE), lambda x: x != "").alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    keep = ["doc_id", "lang", "source", "n_symbols"]
    second = first.select(
        *keep, F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        F.when(
            F.size("w") >= 3,
            F.sort_array(F.transform(
                F.sequence(F.lit(0), F.size("w") - 3),
                lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")),
            )),
        ).alias("s"),
    )
    keep += ["n_words", "word_chars", "n_dup_lines", "n_lines"]
    third = second.select(
        *keep, "s",
        F.when(
            F.size("s") >= 2,
            F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda k: F.get("s", k)["h"] == F.get("s", k - 1)["h"]),
        ).alias("k"),
    )
    fourth = third.select(
        *keep,
        F.sort_array(F.array_distinct(F.flatten(F.transform("k", lambda k: F.array(F.get("s", k - 1)["i"], F.get("s", k)["i"]))))).alias("at"),
    )
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("at") - 1), F.lit(3).cast("long"),
        lambda total, j: total + F.least(F.lit(3), F.get("at", j) - F.get("at", j - 1)),
    )
    # at least two windows are equal, or none
    return fourth.select(*keep, F.when(F.size("at") >= 2, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def statistics(counted: DataFrame) -> DataFrame:
    """counted with base_failed and the statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.log1p(F.col("n_words").cast("double")).alias("s_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("s_length"),
        F.log1p(100.0 * F.col("n_symbols") / n).alias("s_symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("s_lines"),
        F.asin(F.sqrt(F.col("n_repeat_words") / n)).alias("s_repeats"),
    )


def _quantiles(rows: DataFrame, by: list[str], bin_: Column, shares: dict[str, float]) -> DataFrame:
    """For each group the bins at which the given shares of its rows are reached."""
    binned = rows.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("bin")
    running = binned.select(*by, "bin", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("all"))
    return running.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))).alias(name) for name, q in shares.items()])


def _held(df: DataFrame, few: bool) -> DataFrame:
    """A checkpointed table of groups, in a few parts if it is small."""
    return common.checkpointed(df.coalesce(4) if few else df)


def _joined(rows: DataFrame, groups: DataFrame, on: Column, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, on)


# The following build SQL text: as column objects, the thousands of terms of all steps take longer to build than to run.
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def with_cholesky(params: DataFrame, scale: float) -> DataFrame:
    """grp, start, m_i, l_i_j (Cholesky factor of scatter * scale plus floors) and log_det from m_i and c_i_j."""
    out = params
    for j, floor in enumerate(FLOORS.values()):
        taken = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        out = out.selectExpr("*", f"sqrt(greatest(greatest(c_{j}_{j} * {scale}D, {floor**2}D){taken}, {floor**2 / 4}D)) AS l_{j}_{j}")
        out = out.selectExpr("*", *[
            f"(c_{i}_{j} * {scale}D" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j)) + f") / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, _P)
        ])
    return out.selectExpr("grp", "start", *_M, *_L, " + ".join(f"2 * ln(l_{i}_{i})" for i in range(_P)) + " AS log_det")


def distances(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """rows with start and d2, a row for each start of params (checkpointed) of its group; by forward substitution.

    few: params has at most BROADCAST_GROUPS rows.
    """
    out = _joined(rows, params.select(F.col("grp").alias("p_grp"), "start", *_M, *_L), F.col("grp") == F.col("p_grp"), few)
    for i, name in enumerate(FLOORS):
        out = out.selectExpr("*", f"({name} - m_{i}" + "".join(f" - l_{i}_{j} * z_{j}" for j in range(i)) + f") / l_{i}_{i} AS z_{i}")
    return out.selectExpr(*rows.columns, "start", " + ".join(f"z_{i} * z_{i}" for i in range(_P)) + " AS d2")


def moments(rows: DataFrame, weight: str) -> DataFrame:
    """grp, tongue, start, w (sum of weights), m_i and c_i_j of the rows."""
    names = list(FLOORS)
    sums = [f"sum(({weight}) * {n}) AS s_{i}" for i, n in enumerate(names)] + [f"sum(({weight}) * {names[i]} * {names[j]}) AS e_{i}_{j}" for i, j in _PAIRS]
    got = rows.groupBy("grp", "tongue", "start").agg(F.expr(f"sum({weight}) AS w"), *map(F.expr, sums)).filter("w > 0")
    return got.selectExpr("grp", "tongue", "start", "w", *[f"s_{i} / w AS m_{i}" for i in range(_P)], *[f"e_{i}_{j} / w - (s_{i} / w) * (s_{j} / w) AS c_{i}_{j}" for i, j in _PAIRS])


def shrunk(own: DataFrame, few: bool) -> DataFrame:
    """grp, tongue, start, m_i, c_i_j of moments (checkpointed), drawn towards the language's and these towards all documents'."""
    sums = [f"sum(w * m_{i}) AS s_{i}" for i in range(_P)] + [f"sum(w * (c_{i}_{j} + m_{i} * m_{j})) AS e_{i}_{j}" for i, j in _PAIRS]

    def pooled(by: list[str], mark: str) -> DataFrame:
        """w, m, c of all the groups' rows together, named with a mark."""
        got = own.groupBy(*by).agg(F.expr("sum(w) AS n"), *map(F.expr, sums))
        return got.selectExpr(
            *[f"{c} AS {mark}{c}" for c in by], f"n AS {mark}w", *[f"s_{i} / n AS {mark}m_{i}" for i in range(_P)],
            *[f"e_{i}_{j} / n - (s_{i} / n) * (s_{j} / n) AS {mark}c_{i}_{j}" for i, j in _PAIRS])

    def drawn(w: str, a: str, b: str, name: str) -> str:
        return f"({w} * {a} + {float(SHRINKAGE)}D * {b}) / ({w} + {float(SHRINKAGE)}D) AS {name}"

    tongues, every = pooled(["tongue", "start"], "t"), pooled(["start"], "a")
    # one row a start
    tongues = tongues.join(F.broadcast(every), F.expr("tstart = astart")).selectExpr("ttongue", "tstart", *[drawn("tw", f"t{c}", f"a{c}", f"t{c}") for c in (*_M, *_C)])
    joined = _joined(own, tongues, F.expr("tongue = ttongue and start = tstart"), few)
    return joined.selectExpr("grp", "tongue", "start", *[drawn("w", c, f"t{c}", c) for c in (*_M, *_C)])


def starts(rows: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """Moments of each group's starts (sizes: n_grp, n): 0 from quartiles, 1 of all rows, the others of about START_SIZE random rows each."""
    stacked = rows.select("grp", "tongue", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(n).alias("x")) for i, n in enumerate(FLOORS)])).alias("v")).select("grp", "tongue", "v.*")
    found = _quantiles(stacked, ["grp", "tongue", "which"], F.floor(F.col("x") * _BINS), {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    quartiles = found.groupBy("grp", "tongue").agg(
        *[F.max(F.when(F.col("which") == i, (F.col("q2") + 0.5) / _BINS)).alias(f"m_{i}") for i in range(_P)],
        *[F.max(F.when(F.col("which") == i, F.pow((F.col("q3") - F.col("q1")) / _BINS / 1.349, F.lit(2)))).alias(f"c_{i}_{i}") for i in range(_P)],
    )
    quartiles = _joined(quartiles, sizes, F.col("grp") == F.col("n_grp"), few).withColumn("w", F.col("n").cast("double")).withColumn("start", F.lit(0))
    quartiles = quartiles.withColumns({f"c_{i}_{j}": F.lit(0.0) for i in range(_P) for j in range(i)})
    sized = _joined(rows, sizes, F.col("grp") == F.col("n_grp"), few)
    share = F.greatest(F.lit(1), F.floor(F.col("n") / START_SIZE))
    chosen = F.filter(F.sequence(F.lit(1), F.lit(1 + STARTS)), lambda s: (s == 1) | (F.pmod(F.xxhash64("doc_id", "s_words", "s_length", s), share) == 0))
    drawn = moments(sized.select("grp", "tongue", *FLOORS, F.explode(chosen).alias("start")), "1.0D")
    names = ["grp", "tongue", "start", "w", *_M, *_C]
    return quartiles.select(names).unionByName(drawn.select(names))


def concentrated(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Moments of the closest CORE of each group's rows, for each start of params (checkpointed)."""
    binned = distances(rows, params, few).withColumn("bin", F.floor(_LOG_BINS * F.log(F.col("d2") + 1e-6)))
    counted = binned.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("grp", "start").orderBy("bin")  # some hundred bins a group
    running = counted.select("*", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), (CORE * F.sum("n").over(Window.partitionBy("grp", "start"))).alias("core"))
    at = running.filter((F.col("upto") >= F.col("core")) & (F.col("upto") - F.col("n") < F.col("core")))
    limits = at.select(F.col("grp").alias("l_grp"), F.col("start").alias("l_start"), F.col("bin").alias("limit"), ((F.col("core") - F.col("upto") + F.col("n")) / F.col("n")).alias("part"))
    closest = _joined(binned, limits, (F.col("grp") == F.col("l_grp")) & (F.col("start") == F.col("l_start")), few).filter(F.col("bin") <= F.col("limit"))
    return moments(closest, "if(bin < limit, 1.0D, part)")


def estimates(rows: DataFrame) -> tuple[DataFrame, bool]:
    """grp, start, m_i, l_i_j, log_det: each group's minimum-covariance-determinant estimate (checkpointed), and whether they are few.

    rows: checkpointed, with grp, tongue (the language's group) and the statistics.
    """
    sizes = common.checkpointed(rows.groupBy(F.col("grp").alias("n_grp")).agg(F.count("*").alias("n")))
    few = sizes.count() * (2 + STARTS) <= BROADCAST_GROUPS
    fitted = lambda held, scale: _held(with_cholesky(shrunk(held, few), scale), few)
    own = _held(starts(rows, sizes, few), few)
    params = fitted(own, 1.0)
    for _ in range(START_STEPS):
        own = _held(concentrated(rows, params, few), few)
        params = fitted(own, CONSISTENCY)
    best = Window.partitionBy("grp").orderBy(F.round("log_det", 6), "start")  # 2 + STARTS rows a group
    params = params.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")
    own, params = _held(own.join(params.select("grp", "start"), ["grp", "start"]).withColumn("start", F.lit(0)), few), _held(params.withColumn("start", F.lit(0)), few)
    # a group whose determinant no longer falls keeps its estimate and is done; each step lowers some, and all are bounded below by FLOORS
    moving = params
    while True:
        moved = _held(concentrated(rows, moving, few), few)
        after = fitted(moved.unionByName(own.join(moved.select("grp"), "grp", "left_anti").select(moved.columns)), CONSISTENCY)
        fallen = after.join(moving.select("grp", F.col("log_det").alias("before")), "grp").filter(F.col("before") - F.col("log_det") > CONVERGED)
        fallen = _held(fallen.select(params.columns), few)
        if fallen.isEmpty():
            return params, few
        own = _held(moved.join(fallen.select("grp"), "grp", "left_semi").unionByName(own.join(fallen.select("grp"), "grp", "left_anti").select(moved.columns)), few)
        params = _held(fallen.unionByName(params.join(fallen.select("grp"), "grp", "left_anti")), few)
        moving = fallen


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared; null where the base rules fail) and kept."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  null is a name of its own
    stats = statistics(counts(docs)).select("*", F.xxhash64(named("lang"), F.lit("|"), named("source")).alias("grp"), F.xxhash64(named("lang")).alias("tongue"))
    stats = common.checkpointed(stats)
    rows = stats.filter("not base_failed")
    found = distances(rows, *estimates(rows)).drop("start")
    failed = stats.filter("base_failed").withColumn("d2", F.lit(None).cast("double"))
    return found.unionByName(failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("d2").alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(True))).alias("kept"),
    )


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.read_documents(spark, sf_dir))
