"""Language identification by rank-order profiles (operator 7).

A profile is a language's PROFILE most frequent character n-grams (1 to 3 letters;
everything else is one blank) in order.  A document's own most frequent n-grams
are compared with each profile: an n-gram costs the difference of its two ranks,
one that the profile lacks costs PROFILE places.  The language with the smallest
sum wins; the score is one minus the mean cost an n-gram, as a share of PROFILE.

Profiles count all training documents.  What reaches the driver is PROFILE rows a
language.

Defined results: null text, or text without a letter, is `und` with score 0; with
no training text at all everything is `und`; ties go to the language first in
alphabetical order, and to the smaller n-gram within a ranking; very long texts are
counted whole; repeated rows train and score as rows; extra columns pass through
`identify`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm import common

PROFILE = 300
UNKNOWN = "und"
_BLANK = 0x20
#: Counted n-grams that a training task holds before it merges equal ones.
MERGE_AT = 4_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> lower-case letter, or a blank."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a letter) of the 1- to 3-grams of the texts, text after text, and where each text's begin."""
    units = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    c = letters()[units]
    blank = c == _BLANK
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    edges = np.zeros(len(c) + 1, bool)
    edges[ends[:-1] - 1] = True  # the newlines between texts
    keep |= edges[:-1]
    c = c.astype(np.uint64)
    c[edges[:-1]] = 0  # no n-gram reaches across
    kept = np.concatenate(([0], np.cumsum(keep)))
    at = kept[np.concatenate(([0], ends[:-1], [len(keep)]))]
    c = c[keep]
    bits = np.uint64(21)
    n = len(c)
    table = np.zeros((n, 3), np.uint64)
    ok = np.zeros((n, 3), bool)
    table[:, 0], ok[:, 0] = c, (c != 0) & (c != _BLANK)
    if n > 1:
        table[:-1, 1] = (c[:-1] << bits) | c[1:]
        ok[:-1, 1] = (c[:-1] != 0) & (c[1:] != 0)
    if n > 2:
        table[:-2, 2] = (table[:-2, 1] << bits) | c[2:]
        ok[:-2, 2] = ok[:-2, 1] & (c[2:] != 0)
    ok[:, 2] &= ok[:, 1]
    flat = ok.ravel()
    before = np.concatenate(([0], np.cumsum(flat)))
    return table.ravel()[flat], before[3 * at]


def _counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    at, _ = common.buffers(batch.column("text"))
    for a, b in common.blocks(at, common.BLOCK_BYTES // 2):
        yield a, b, batch.column("text").slice(a, b - a).to_pylist()


def profiles(docs: DataFrame, train: Column, size: int = PROFILE) -> dict[str, list[int]]:
    """The most frequent n-grams of each language of the training rows, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        weight = 0

        def merged() -> None:
            for lang, parts in held.items():
                held[lang] = [_counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, texts in _texts(batch):
                codes, at = grams(texts)
                mine: dict[str, list] = {}
                for i in range(a, b):
                    mine.setdefault(langs[i], []).append(codes[at[i - a] : at[i - a + 1]])
                for lang, parts in mine.items():
                    held.setdefault(lang, []).append(_counted(np.concatenate(parts)))
                    weight += len(held[lang][-1][0])
            if weight > MERGE_AT:
                merged()
                weight = 0
        merged()
        for lang, [(codes, counts)] in held.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(codes), "gram": codes.astype(np.int64), "n": counts.astype(np.int64)})

    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = common.in_batches(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= size).collect()
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.place)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Ranker:
    """Distances of a text's ranking to each profile."""

    def __init__(self, known: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(known), size
        self.codes = np.unique(np.array([g for p in known.values() for g in p], np.uint64))
        self.place = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.codes, np.array(known[lang], np.uint64)), j] = np.arange(len(known[lang]))

    def judge(self, codes: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own, counts = np.unique(codes, return_counts=True)
        if len(own) > self.size:  # all that can be among the first; then exactly in order
            least = np.partition(counts, -self.size)[-self.size]
            own, counts = own[counts >= least], counts[counts >= least]
        own = own[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        place = self.place[np.where(self.codes[at] == own, at, len(self.codes))]
        cost = np.where(place < 0, self.size, np.minimum(np.abs(place - np.arange(len(own))[:, None]), self.size)).sum(axis=0)
        best = int(cost.argmin())
        return self.langs[best], 1.0 - float(cost[best]) / (self.size * len(own))


def identify(docs: DataFrame, known: dict[str, list[int]]) -> DataFrame:
    """docs with _lang_pred and _lang_score as last columns (under the next unused names if the table has these)."""
    names = [common.unused("_lang_pred", docs.columns), common.unused("_lang_score", docs.columns)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(known)
        for batch in batches:
            for a, b, texts in _texts(batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").fill_null(""))):
                codes, at = grams(texts)
                found = [ranker.judge(codes[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    [*batch.schema.names, *names],
                )

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return common.in_batches(docs, work, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_documents(spark, sf_dir)
    known = profiles(docs, ~common.held_out())
    found = identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", common.held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))
