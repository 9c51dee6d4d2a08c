"""Pluggable models: embedders and pair scorers as Arrow-batched functions, and two deterministic stand-ins.

A model is a factory that a worker calls once; it returns a function from lists of
texts to arrays.  The stand-ins (feature hashing, word overlap) exist so that plans
can run without weights; thresholds of real models do not hold for them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestone.functions.words import md5_digits, words

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[list[str], list[str]], np.ndarray]
_WORD = re.compile(r"\w+")


def hashing_embedder(size: int = 64) -> Callable[[], Embed]:
    """Signed feature hashing of lower-cased words, L2-normalised; a text without words is the zero vector."""

    def load() -> Embed:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), np.float32)
            for i, t in enumerate(texts):
                for w in _WORD.findall((t or "").lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % size] += 1 if h & 0x80000000 else -1
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, length, out=out, where=length > 0)

        return embed

    return load


def word_embedder(size: int = 64) -> Callable[[], Embed]:
    """Counts of the words `[a-z0-9]+` by their hash (the first eight digits of MD5), L2-normalised: any engine can compute the same."""

    def load() -> Embed:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for found, of in words(((t or "").encode() for t in texts), joined=False):
                if len(of):
                    each = found.dictionary_encode()
                    place = (md5_digits(each.dictionary) % size).astype(np.int64)[each.indices.to_numpy()]
                    first, last = of[0], of[-1] + 1
                    out[first:last] += np.bincount((of - first) * size + place, minlength=(last - first) * size).reshape(-1, size)
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, length, out=out, where=length > 0)

        return embed

    return load


def overlap_scorer() -> Score:
    """Share of the query's words that the passage holds, from -10 to 10."""

    def score(queries: list[str], passages: list[str]) -> np.ndarray:
        sets = [(set(_WORD.findall((q or "").lower())), set(_WORD.findall((p or "").lower()))) for q, p in zip(queries, passages, strict=True)]
        return np.array([20 * len(q & p) / len(q) - 10 if q else -10.0 for q, p in sets])

    return score


def embedding(load: Callable[[], Embed]):
    """A column function: text -> vector; the model is loaded once a task, rows keep their order."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for texts in batches:
            yield pd.Series(list(embed(texts.fillna("").tolist())))

    return run


def pair_score(load: Callable[[], Score] | None):
    """A column function: (query, passage) -> score; null when there is no model."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load() if load is not None else None
        for q, p in batches:
            yield pd.Series(score(q.tolist(), p.tolist()) if score is not None else [None] * len(q), dtype="float64")

    return run


def query_forms(variants: Column, forms: int = 2) -> Column:
    """The first variants that differ but in case, at most `forms`."""
    first = F.aggregate(
        F.coalesce(variants, F.expr("cast(array() as array<string>)")), F.expr("cast(array() as array<string>)"),
        lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))),
    )
    return F.slice(first, 1, forms)


def reranked(candidates: DataFrame, load: Callable[[], Score] | None) -> DataFrame:
    """query_id, chunk_id, rerank_score of candidates (query_id, chunk_id, forms, text): the best score of the query's forms."""
    from lodestone.operators.fusion import max_over_forms

    pairs = candidates.select("query_id", "chunk_id", F.explode("forms").alias("form"), "text")
    return max_over_forms(pairs.withColumn("form_score", pair_score(load)("form", "text")))
