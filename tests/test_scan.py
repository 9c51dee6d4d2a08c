"""BM25 by a scan against `lexical.search`, the words it counts against regular expressions, and what retrieval derives from the texts."""

import hashlib
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as text_functions
from lodestone.functions import words
from lodestone.operators import index, lexical, scan, vector
from lodestone.plans import kept, retrieval_queries

SF = os.environ.get("LODESTONE_SF", "/root/testdata/sf0.001")
ODD = ["", " ", "-", "don't DON'T 'tis rock-'n'-roll a--b -x- --", "Kelvin aK K-K", "İstanbul xİy", "café-bar naïve ſ", "x" * 70 + "-" + "y" * 70, "a'b-c'd-", "1-2 3'4 -5", "\x00a\tb\nc"]
ODD += [text_functions._SPACES + " in " + text_functions._SPACES, "​ zero ﻿"]


def found(df):
    return sorted((r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in df.collect())


def of_texts(texts, joined):
    out = [[] for _ in texts]
    for found_, of in words.words([t.encode() for t in texts], joined):
        for word, i in zip(found_.to_pylist(), of.tolist(), strict=True):
            out[i].append(word.decode())
    return out


@pytest.mark.parametrize("piece", [1, 5, 1 << 21])
def test_words(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices("aZ09-' \nKİé", k=rng.randint(0, 60))) for _ in range(400)] + [" ".join(ODD)]
    for joined, token in ((True, lexical.TOKEN), (False, "[a-z0-9]+")):
        assert of_texts(texts, joined) == [re.findall(token, t.lower()) for t in texts]


def test_words_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", F.regexp_extract_all(F.lower("t"), F.lit(lexical.TOKEN), F.lit(0)).alias("w")).collect()
    assert of_texts([r.t for r in rows], True) == [r.w for r in rows]


def test_md5_digits():
    each = [b"", b"a", b"x" * 54, b"x" * 55, b"x" * 56, b"y" * 300, *[str(i).encode() for i in range(100)]]
    want = [int(hashlib.md5(w).hexdigest()[:8], 16) for w in each]
    assert words.md5_digits(pa.array(each, pa.binary()), 7).tolist() == want
    assert words.md5_digits(pa.array(each, pa.binary())[3:]).tolist() == want[3:]


def test_strip(spark):
    rows = spark.createDataFrame([(t,) for t in ODD + [f"{a}{b} x {b}{a}" for a in text_functions._SPACES + "᠎​" for b in "\n　."]], "t string")
    assert all(r.s == r.t.strip() for r in rows.select("t", text_functions.strip(F.col("t")).alias("s")).collect())


@pytest.mark.parametrize("limits", [(1 << 14, 1 << 20), (2, 1 << 20), (1 << 14, 5)])
def test_equals_scoring_by_joins(spark, monkeypatch, limits):
    monkeypatch.setattr(scan, "MAX_QUERIES", limits[0])
    monkeypatch.setattr(scan, "MAX_PAIRS", limits[1])
    rng = random.Random(11)
    names = [f"{a}{b}" for a in ("port", "mail", "scan", "pass", "don't", "a-b") for b in ("", "al", "er", "9")]
    texts = [" ".join(rng.choices(names, [1 / (i + 1) for i in range(len(names))], k=rng.randint(0, 40))) for _ in range(500)]
    texts += texts[:60] + ODD + ["port " * 450_000 + "mail netword", None]  # copies, odd ones, one in pieces
    rows = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "mail"), (2, "passal netword port"), (3, " ".join(names)), (4, "unknown"), (5, ""), (6, "mail mail don't"), (1 << 40, "kelvin a-b")], "query_id long, query string")
    terms = lexical.query_terms(queries)
    for k in (1, 1000) if limits == (1 << 14, 1 << 20) else (7,):
        assert found(scan.search(rows, k, terms)) == found(lexical.search(rows.fillna(""), None, k, terms=terms))


def test_frequencies(spark):
    texts = [*ODD, "port " * 450_000 + "mail port don't", "mail", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    terms = lexical.query_terms(spark.createDataFrame([(1, "mail")], "query_id long, query string"))
    assert sorted(map(tuple, scan.frequencies(rows, "text").collect())) == sorted(map(tuple, lexical.document_frequencies(rows).collect()))
    assert scan.search(rows.limit(0), 5, terms).count() == scan.search(rows, 5, terms.limit(0)).count() == 0


def test_weights_below_zero(spark):
    """Words of most chunks weigh what all words weigh on average, which may be negative."""
    for texts in (["mail port", "mail port scan", "mail port scan net"], ["mail a1", "mail a2", "mail a3 port", "mail a4"]):
        rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
        terms = lexical.query_terms(spark.createDataFrame([(1, "mail net"), (2, "mail a3")], "query_id long, query string"))
        assert found(scan.search(rows, 5, terms)) == found(lexical.search(rows, None, 5, terms=terms))


def test_equal_scores_are_ordered_by_id(spark):
    """Products that differ beyond the ninth digit are equal, within a task too."""
    rows = spark.createDataFrame([(i, [1.0 + 1e-13 * i]) for i in range(50)], "vec_id long, embedding array<double>").coalesce(1)
    near = vector.nearest(rows, spark.createDataFrame([(1, [0.5])], "query_id long, q array<double>"), 3)
    assert [r.vec_id for r in near.orderBy("rank").collect()] == [0, 1, 2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_retrieval_builds_no_index(spark, monkeypatch):
    """A batch of queries reads the texts once or twice; sorted postings of all of their words took most of its time."""
    def refuse(*_):
        raise AssertionError("an index is built")

    monkeypatch.setattr(index, "build", refuse)
    monkeypatch.setattr(kept, "FORMAT", -1)  # nothing that was kept before
    assert retrieval_queries.Q["distinct_texts"](spark, SF).count() > 0
