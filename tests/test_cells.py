"""The inverted file of vectors against all products, and products of a category's rows only."""

import os

import numpy as np
import pytest

from lodestone.operators import vector
from lodestone.plans import retrieval_queries

SF = os.environ.get("LODESTONE_SF", "/root/testdata/sf0.001")


def frame(spark, x, extra=None):
    rows = [(i, [float(a) for a in v], *([extra[i]] if extra is not None else [])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + (", category string" if extra is not None else ""))


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.select("query_id", "vec_id").collect()}


def test_recall_over_all_queries(spark):
    """At least 0.9 of the ten nearest, of clustered and of unclustered vectors, and the fewer cells the more they cluster."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(25, 16)) * 3
    read = []
    for x in (middle[rng.integers(0, 25, 1500)] + rng.normal(size=(1500, 16)) * 0.4, rng.normal(size=(1500, 16))):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows = frame(spark, x)
        centres, probes = vector.cells(rows)
        asked = rows.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as q")
        stored = vector.with_cells(rows, centres, 1).cache()
        assert stored.count() == 1500
        exact = pairs(vector.nearest(rows, asked, 10))
        assert len(pairs(vector.nearest_in_cells(stored, asked, 10, centres, probes)) & exact) >= 0.9 * len(exact) == 0.9 * 750
        assert pairs(vector.nearest_in_cells(stored, asked, 10, centres, len(centres))) == exact
        read.append(probes / len(centres))
    assert read[0] < 0.3 < read[1]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = frame(spark, np.eye(4)[:n])
    centres, probes = vector.cells(rows)
    if n:
        asked = rows.selectExpr("vec_id as query_id", "embedding as q")
        assert pairs(vector.nearest_in_cells(vector.with_cells(rows, centres, 1), asked, 2, centres, probes)) >= {(i, i) for i in range(n)}


@pytest.mark.parametrize("most", [50_000, 7])
def test_queries_of_a_category(spark, monkeypatch, most):
    monkeypatch.setattr(vector, "MAX_QUERIES", most)
    rng = np.random.default_rng(5)
    x, kinds = rng.normal(size=(90, 6)), [None if i % 11 == 0 else "abc"[i % 3] for i in range(90)]
    rows = frame(spark, x, kinds)
    asked = spark.createDataFrame([(i, [float(a) for a in x[i]], ["a", "b", None, "zz"][i % 4]) for i in range(30)], "query_id long, q array<double>, category string")
    want = set()
    for i in range(30):
        c = ["a", "b", None, "zz"][i % 4]
        able = [j for j in range(90) if c is None or kinds[j] == c]
        want |= {(i, j, r + 1) for r, j in enumerate(sorted(able, key=lambda j: (-round(float(x[i] @ x[j]), 9), j))[:5])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in vector.nearest(rows, asked, 5).collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_query(spark):
    exact, found = (pairs(retrieval_queries.Q[q](spark, SF)) for q in ("vector_knn", "vector_knn_cells"))
    assert len(exact & found) >= 0.9 * len(exact)
