"""Generated summaries: a model is asked about each article that needs one, and a call that fails is a row, not an end.

The model's answers are neither cheap nor repeatable, so the pass runs once: its rows are written to the shared folder
and everything that is returned (outcomes, articles, counters) reads them there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import or_else, strip
from lodestone.operators import lineage
from lodestone.operators.summarize import strip_preamble

#: Characters of an article that the model is shown, and the fewest of an answer that is taken.
MOST_INPUT, LEAST_ANSWER = 12_000, 60
#: Times an article is asked about, and errors that the counters list.
ATTEMPTS, LISTED = 2, 10
#: Articles a call.
BATCH = 16
PROMPT = "Summarise this help article in one paragraph.\nTitle: {title}\nCategory: {category}\n\n{text}"

#: Answers to prompts, as many and in their order.
Complete = Callable[[list[str]], list[str]]


@dataclass
class Enrichment:
    """outcomes: article_id, outcome, summary, error, attempts; articles: all, with the new summaries; report: one row of counters."""

    outcomes: DataFrame
    articles: DataFrame
    report: DataFrame


def prompts(articles: DataFrame, template: str = PROMPT) -> DataFrame:
    """article_id, prompt; the prompt of an article without text is null."""
    text = strip(F.coalesce("raw_content", F.lit("")))
    values = {"title": or_else(F.col("title"), F.lit("Untitled")), "category": or_else(F.col("category"), F.lit("General")), "text": F.substring(text, 1, MOST_INPUT)}
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return articles.select("article_id", F.when(text != "", F.concat(*parts, F.lit(rest))).alias("prompt"))


def asked(rows: DataFrame, load: Callable[[], Complete], attempts: int = ATTEMPTS, batch: int = BATCH) -> DataFrame:
    """rows (article_id, prompt) with answer, error (`Type: message`) and attempts.

    `load` makes the model once a task.  A call that fails is repeated article by article, so one bad prompt costs its
    batch no answers; an article that fails `attempts` calls of its own keeps its last error.  A model that answers
    fewer or more prompts than it was asked has failed.
    """

    def call(complete: Complete, of: list[str]) -> list[str]:
        answers = complete(of)
        if len(answers) != len(of):
            raise ValueError(f"{len(answers)} answers to {len(of)} prompts")
        return answers

    def alone(complete: Complete, prompt: str) -> tuple[str | None, str | None, int]:
        error = None
        for n in range(1, attempts + 1):
            try:
                return call(complete, [prompt])[0], None, n
            except Exception as e:  # noqa: BLE001 - whatever a client raises becomes the row's error
                error = f"{type(e).__name__}: {e}"
        return None, error, attempts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                of = list(part["prompt"])
                try:
                    found = [(a, None, 1) for a in call(complete, of)]
                except Exception:  # noqa: BLE001 - each is asked again by itself, where its error is kept
                    found = [alone(complete, p) for p in of]
                part["answer"], part["error"], part["attempts"] = (list(x) for x in zip(*found, strict=True))
                yield part

    kind = rows.schema["article_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"article_id {kind}, prompt string, answer string, error string, attempts int")


def outcome(answer: Column, error: Column) -> Column:
    """failed (an error), skipped (nothing asked, or an answer too short to be a summary) or enriched."""
    return F.when(error.isNotNull(), "failed").when(F.char_length(strip_preamble(answer)) >= LEAST_ANSWER, "enriched").otherwise("skipped")


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: considered, enriched, skipped, failed, and the first LISTED errors (`article: error`) by article_id."""
    counts = outcomes.agg(F.count("*").alias("considered"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("enriched", "skipped", "failed")])
    first = outcomes.filter("outcome = 'failed'").select("article_id", F.concat(F.col("article_id").cast("string"), F.lit(": "), F.col("error")).alias("e")).orderBy("article_id").limit(LISTED)
    errors = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("article_id", "e"))), lambda x: x["e"]).alias("errors"))
    return counts.crossJoin(errors)  # one row each


def enriched(articles: DataFrame, candidates: DataFrame, load: Callable[[], Complete], stamp: Column | None = None, template: str = PROMPT, attempts: int = ATTEMPTS) -> Enrichment:
    """Ask about the candidates (`catalog.stale_summaries` finds them) and put the summaries into the articles.

    articles and candidates: article_id (unique), title, category, raw_content, llm_summary, llm_summary_at, updated_at.
    An article whose call failed or whose answer is too short keeps the summary it had.  llm_summary_at and updated_at
    of an enriched one are the same instant, so it is not stale at once.
    """
    kept = candidates.select("article_id", "title", "category", "raw_content")
    rows = prompts(kept, template)
    called = asked(rows.filter("prompt IS NOT NULL"), load, attempts)
    empty = rows.filter("prompt IS NULL").select("*", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    judged = called.unionByName(empty).select("article_id", outcome(F.col("answer"), F.col("error")).alias("outcome"), "answer", "error", "attempts")
    summary = F.when(F.col("outcome") == "enriched", strip_preamble(F.col("answer")))
    outcomes = lineage.cut(judged.select("article_id", "outcome", summary.alias("summary"), "error", "attempts"))
    when = F.current_timestamp() if stamp is None else stamp
    new = outcomes.filter("outcome = 'enriched'").select(F.col("article_id").alias("_id"), F.col("summary").alias("_summary"))
    hit = F.col("_id").isNotNull()
    merged = articles.join(new, F.col("article_id") == F.col("_id"), "left").withColumns(
        {"llm_summary": F.coalesce("_summary", "llm_summary"), "llm_summary_at": F.when(hit, when).otherwise(F.col("llm_summary_at")), "updated_at": F.when(hit, when).otherwise(F.col("updated_at"))}
    )
    return Enrichment(outcomes, merged.select(*articles.columns), counters(outcomes))
