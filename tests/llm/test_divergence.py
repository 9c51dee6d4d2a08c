"""Operator 11 against integer arithmetic in Python and its SQL."""

import collections
import os
import random
import re

import duckdb
import pytest

from lodestone.llm import divergence as dv

SF = os.environ.get("LODESTONE_SF", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, term string, counts string, p long, v int, n int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "t", "c", 1, 2, 3) for i, (t, lang, source) in enumerate(rows)], SCHEMA)


def counted(rows, least, top):
    count, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        count.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        n = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))  # noqa: E731, B023
        p = {s: {w: share(count[lang, s, w], n[s]) for w in kept} for s in sources}
        q = {w: share(sum(count[lang, s, w] for s in sources), sum(n.values())) for w in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            used = [(p[s][w] - q[w], w) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", used)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def odd_rows():
    rng = random.Random(7)
    words = ["the", "The", "a-b", "Été", "été", "日本", "x1y", "\U0001f600", "zebra", "İ", "ſ"]
    rows = [(" ".join(rng.choice(words[: rng.randint(2, 11)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "é", "Z", None, "src"])) for _ in range(150)]
    return [*rows, *rows[:9], (None, "en", "no text"), ("123 !", "fr", "only"), ("", "xx", "one"), (None, "xx", "two"), ("rare words here", "xx", "three"), ("word " * 20_000, "en", "long"), ("\x00a\x7fb", "en", "a")]


@pytest.mark.parametrize(("least", "top", "limit"), [(30, 50, None), (3, 2, None), (1, 5, 0)])
def test_against_integers(spark, monkeypatch, least, top, limit):
    if limit is not None:
        for name, value in (("BROADCAST_GROUPS", limit), ("HELD", 3), ("PIECE", 7)):
            monkeypatch.setattr(dv, name, value)
    rows = odd_rows()
    got = dv.diverging(documents(spark, rows), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == counted(rows, least, top)


def test_empty_table(spark):
    assert dv.diverging(documents(spark, [])).count() == 0


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (7, 10**9, 3), (9 * 10**14, 9 * 10**14 + 1, 10), (123_456_789_012_345, 987_654_321_098_765, 54_321)]
    df = spark.createDataFrame(cases, "c long, n long, v long").selectExpr("c", "n", "v", f"{dv.share('c', 'n', 'v')} as p")
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(dv.ORACLE_SQL).df()
    got = dv.op11_source_divergence(spark, SF).toPandas()
    assert sorted(got[want.columns].values.tolist()) == sorted(want.values.tolist())
