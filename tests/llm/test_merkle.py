"""Operator 12 against a tree built in Python and its SQL."""

import hashlib
import os
import random
import zlib

import duckdb
import pytest

from lodestone.llm import merkle

SF = os.environ.get("LODESTONE_SF", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, key long, node string, path string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "n", "p") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def sides(tree, i):
    for level in tree[:-1]:
        run = i - i % 3
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 3])
        i //= 3


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, own, r) in enumerate(by[s]):
            path = [*sides(trees[s], i), *sides(top, k)]
            node = own
            if doc_id is not None and r[1] is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                node = leaf(r[0], r[1].replace("\n", ""), *r[2:])
            for a, b in path:
                node = sha(a + node + b)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r))


def odd_rows():
    rng = random.Random(11)
    rows = [(rng.choice([i, -i, i << 20, i << 40, (i << 50) - 7]), rng.choice(["one\ntwo", "é\n日", "plain", "", None]), rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", None, "é", ""]), rng.choice([0, 9, None])) for i in range(400)]
    rows += rows[:7] + [(5, "x\n", "en", "ties", 1), (5, "y\n", "en", "ties", 1), (None, "z\n", "en", "ties", 1), (None, None, None, None, None), (2**63 - 1, "a", "en", "a", 1), (-(2**63), "a", "en", "a", 1)]
    return [*rows, (8, "long\n" * 40_000, "en", "lone", 200_000), *[(7, "hot\n", "en", "hot", 4)] * 300, *[(i, "t\nt", "en", f"s{i}", 3) for i in range(260)]]


def test_against_python(spark):
    rows = odd_rows()
    got = merkle.manifest(documents(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert ordered(got) == ordered(expected(rows))
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 243, 244, 1000])
def test_sizes(spark, n):
    rows = [(3 * i, f"t\n{i}", "en", "s", 3) for i in range(n)]
    assert ordered(map(tuple, merkle.manifest(documents(spark, rows)).collect())) == ordered(expected(rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(merkle.ORACLE_SQL).fetchall()
    rows = con.sql("select doc_id, text, lang, source, n_chars from documents").fetchall()
    assert ordered(map(tuple, merkle.op12_merkle_manifest(spark, SF).collect())) == ordered(want) == ordered(expected(rows))
