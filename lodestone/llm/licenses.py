"""Licence scan by ordered signature rules (operator 4), DataFrame functions only.

A text that holds none of a few gate strings is done after plain substring searches.
For the others, a rule's regex is tried only if one of its keywords occurs.  Both are
searched in the lower-cased text with every run of white space made one blank, so that
names and notices may be broken over lines.

Where a rule matches follows from what stands between its matches, by running sums over
rows of (text, rule).  Overlaps are settled from the highest priority down: a detection
is dropped if it overlaps a kept one of a higher priority, or lies within another of its
own (of equal ones the rule with the smaller number stays).  With a text's detections
sorted by begin, both are questions about the furthest end before and the next begin
behind, so the work is that of sorting, however many detections a text has.

Beside the rules, places where the words of BASE phrases follow each other are
counted exactly.  Texts are scanned in one projection, which is checkpointed without
them; only detections (a few numbers each) are shuffled, by text.

Defined results: null text counts as empty; a text without a detection has empty
labels, null first_word and last_word, and score 0; the score is the priority of
the strongest detection (BASE_SCORE at least where a base phrase stands), over 100;
repeated rows give repeated results; very long texts are scanned whole; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.license_phrases import keyword, phrases, stretches
from lodestone.llm.license_rules import Rule, rules

_WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORDS = rf"[{_WORD}]+"
#: label -> words of the phrase
BASE = {"apache": ("apache", "license"), "gpl": ("general", "public", "license"), "mit": ("mit", "license")}
BASE_SCORE = 60
#: What names, identifiers and addresses of FAMILIES need, and what most sentences need: one of these strings (in the lower-cased text with single blanks).
_GATE = (
    "licen|spdx|permission|warrant|hereby grants|redistribution|public domain|attribution|apache|bsd|gpl|perl itself|wtfpl|eupl|ms-pl|ms-rl|sspl|cecill|cc0|"
    "creative|odbl|rail|lppl|proprietary|prohibited|gnu.org|mozilla.org|eclipse.org|joinup.ec|opendatacommons|sil.org|mariadb|w3.org|unicode.org|"
    "latex-project|firstdonoharm|cdla.dev|polyform|commonsclause|commons clause|historical permission|nasa open|gemma|curl.se|software|copyright|distribut|be liable|"
    "modified|notice|source code|the program|entity|exception|the library|disclaim|hereby|shall not|disclose|copy of|this document|purpose"
).split("|")
#: With the keywords of the sentences that hold none of them.
GATE = [*_GATE, *sorted({keyword(r) for _, r in phrases() if not any(g in s for s in stretches(r) for g in _GATE)})]
#: White space that is not one blank.
WRAPS = r"\s{2,}|[^\S ]"
GATE_REGEX = r"\b(?:cc[\s-]+(?:by|zero)|mpl\b)"


def phrase_regex(words: tuple[str, ...] | None = None) -> str:
    """A phrase's words one after the other, as whole words; all base phrases if none is named."""
    gap = rf"[^{_WORD}]+"
    forms = [words] if words else list(BASE.values())
    return rf"(?i)(?<![{_WORD}])(?:{'|'.join(gap.join(w) for w in forms)})(?![{_WORD}])"


def _matches(text: Column, rule: Column) -> Column:
    """number, label, priority of a rule, and lengths of its matches and of what stands before each."""

    def measured(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, rule["regex"], -1), F.lit(1), F.size(hits)), F.char_length)
        return F.struct(
            rule["number"].alias("number"), rule["label"].alias("label"), rule["priority"].alias("priority"),
            F.when(F.size(hits) > 0, F.transform(hits, F.char_length)).alias("lengths"), F.when(F.size(hits) > 0, gaps).alias("gaps"),
        )

    # the matches are a lambda's variable, so the regex runs once, and the split only where it matched
    return F.get(F.transform(F.array(F.regexp_extract_all(text, rule["regex"], F.lit(0))), measured), F.lit(0))


def placed(found: DataFrame) -> DataFrame:
    """row_id, number, label, priority, begin, end of every match of found (row_id, matches: array of `_matches`)."""
    one = found.select("row_id", F.explode("matches").alias("m")).repartition("row_id")
    rows = one.select("row_id", "m.number", "m.label", "m.priority", F.posexplode(F.arrays_zip("m.lengths", "m.gaps")).alias("k", "s"))
    upto = Window.partitionBy("row_id", "number").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.select("row_id", "number", "label", "priority", F.col("s.lengths").alias("n"), F.sum(F.col("s.lengths") + F.col("s.gaps")).over(upto).alias("end"))
    return ends.select("row_id", "number", "label", "priority", (F.col("end") - F.col("n")).alias("begin"), "end")


def strongest(detections: DataFrame, priorities: list[int]) -> DataFrame:
    """The detections (row_id, number, label, priority, begin, end) that no stronger one overlaps or holds."""
    before = Window.partitionBy("row_id").orderBy("begin", F.desc("end"), "number").rowsBetween(Window.unboundedPreceding, -1)
    out = detections.withColumn("kept", F.lit(False))
    for p in sorted(priorities, reverse=True):
        own = F.col("priority") == p
        # kept are those of higher priorities so far
        seen = out.withColumn("reach", F.max(F.when(F.col("kept"), F.col("end"))).over(before)).withColumn(
            "next", F.expr("lead(if(kept, begin, null)) ignore nulls over (partition by row_id order by begin, `end` desc, number)")
        )
        free = seen.withColumn("free", own & (F.coalesce("reach", F.lit(-1)) <= F.col("begin")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
        wider = free.withColumn("wider", F.max(F.when(F.col("free"), F.col("end"))).over(before))
        out = wider.withColumn("kept", F.col("kept") | (F.col("free") & (F.coalesce("wider", F.lit(-1)) < F.col("end")))).drop("reach", "next", "free", "wider")
    return out.filter("kept").drop("kept")


def scan(docs: DataFrame, signatures: list[Rule] | None = None, gated: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels (array) and detections (array by place; null for none) of every document.

    gated: False tries every regex on every text.
    """
    known = rules() if signatures is None else signatures
    table = F.array(*[
        F.struct(F.lit(r.number).alias("number"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.regex).alias("regex"))
        for r in known
    ])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    lowered = rows.select("*", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"), F.regexp_replace(F.lower("text"), WRAPS, " ").alias("low"))
    gate = reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(g)) for g in GATE] + [F.col("low").rlike(GATE_REGEX)])
    lowered = lowered.select("*", (gate if gated else F.lit(True)).alias("gate"))
    tried = lowered.select(
        "*",
        F.when(F.col("gate"), F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("low"), k)) if gated else F.lit(True))).alias("tried"),
        F.when(F.col("gate") & F.contains(F.col("low"), F.lit("license")), F.regexp_count("text", F.lit(phrase_regex()))).otherwise(F.lit(0)).cast("long").alias("n_base"),
    )

    def words_before(lazy: str) -> Column:
        # the rest of the flags stand in the phrase's regex
        before = F.regexp_extract("text", rf"(?s)^(.*{lazy}){phrase_regex()}", 1)
        return F.when(F.col("n_base") > 0, F.regexp_count(before, F.lit(WORDS)).cast("long"))

    base = F.array(*[F.when(F.col("text").rlike(phrase_regex(w)), F.lit(label)) for label, w in BASE.items()])
    read = common.checkpointed(tried.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_words", "n_base", words_before("?").alias("first_word"), words_before("").alias("last_word"),
        F.when(F.col("n_base") > 0, F.array_compact(base)).otherwise(F.array().cast("array<string>")).alias("base_labels"),
        F.filter(F.transform("tried", lambda r: _matches(F.col("text"), r)), lambda m: m["lengths"].isNotNull()).alias("matches"),
    ))
    some, out = F.coalesce(F.size("matches"), F.lit(0)) > 0, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    kept = strongest(placed(read.filter(some)), sorted({r.priority for r in known}))
    own = F.struct(F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "number", "label", "priority")
    listed = kept.groupBy("row_id").agg(F.array_sort(F.collect_list(own)).alias("detections"))
    none = read.filter(~some).select(*out, F.lit(None).cast(listed.schema["detections"].dataType).alias("detections"))
    return read.filter(some).join(listed, "row_id").select(*out, "detections").unionByName(none)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read_documents(spark, sf_dir))
    own = F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", own)), ",").alias("labels"),
        (F.greatest(best, F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0)) / 100.0).alias("score"),
        F.coalesce(F.size("detections"), F.lit(0)).cast("long").alias("n_detections"),
    )
