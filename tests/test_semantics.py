"""Operators against plain Python versions and small fixtures."""

import base64
import difflib
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import html
from lodestone.operators import catalog, chunking, evaluate, fusion, lexical, metrics, models, retrieval, summarize, understanding, vector
from lodestone.sources import files
from lodestone.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_general_numbers(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, 100.0, 12.5, 1e5, 999999.5, 1e6, 123456789.0, 0.0001, 0.00001234, -2.5, 1 / 3] + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.g for r in df.select(metrics.general(F.col("v")).alias("g")).collect()] == [f"{v:g}" for v in values]


def test_exposition_text(spark, tmp_path):
    traces = spark.createDataFrame(
        [(["a", "b"], True, True, True, 12.0, {"vector": 4.0}, 0.5, 3), ([], False, False, False, 7000.0, {"vector": 20.0, "rerank": 1.0}, 0.05, 0)],
        "intents array<string>, cache_hit boolean, understood boolean, passed boolean, total_ms double, timings map<string,double>, confidence double, n_final int",
    )
    counted = metrics.trace_counters(traces).groupBy("name", "labels").agg(F.sum("value").alias("value"))
    lines = metrics.exposition(counted, None, metrics.trace_histograms(metrics.trace_observations(traces)), metrics.TRACE_HELP, 3.5)
    metrics.write_exposition(lines, str(tmp_path / "x"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    for line in (
        "# HELP rag_queries_total Total retrieval requests processed.", "# TYPE rag_queries_total counter", 'rag_queries_total{cache="hit",intent="a"} 1', 'rag_queries_total{cache="miss",intent="none"} 1',
        "rag_query_understood_total 1", 'rag_below_threshold_total{intent="none"} 1', 'rag_cache_total{result="hit"} 1', 'rag_request_duration_ms_bucket{intent="none",le="10000"} 1',
        'rag_request_duration_ms_bucket{intent="none",le="+Inf"} 1', 'rag_request_duration_ms_sum{intent="none"} 7000', 'rag_stage_duration_ms_count{stage="vector"} 2', 'rag_stage_duration_ms_bucket{stage="vector",le="5"} 1',
        'rag_confidence_bucket{le="0.1"} 1', "rag_confidence_sum 0.55", 'rag_chunks_returned_bucket{le="3"} 2', "rag_uptime_seconds 3.5",
    ):
        assert line in text.split("\n"), line
    order = [x for x in text.split("\n") if x.startswith("# TYPE")]
    assert order == sorted(order[:4]) + sorted(order[4:8]) + order[8:]


def test_percentiles_and_ranks_of_large_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.choice([rng.randint(0, 20), rng.random() * 1000])), float(rng.randint(0, 30))) for _ in range(3000)] + [("c", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").cache()
    counts = {(r.g, r.v): (r.n, r.before, r["all"]) for r in metrics.ranked_counts(df, ["g"], "x").collect()}
    for g in "abc":
        xs = sorted(r[1] for r in rows if r[0] == g)
        for v, n in Counter(xs).items():
            assert counts[g, v] == (n, sum(x < v for x in xs), len(xs))
        at = min(len(xs) - 1, max(0, round(95 / 100.0 * len(xs) + 0.5) - 1))
        assert metrics.percentile_nearest(df.filter(F.col("g") == g), ["g"], "x", 95).head().percentile == xs[at]
        assert metrics.percentile_floor(df.filter(F.col("g") == g), ["g"], "x").head().percentile == xs[min(len(xs) - 1, int(0.95 * len(xs)))]

    def ranks(v):
        v = np.array(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    got = {r.g: r.rho for r in evaluate.spearman(df, ["g"], "x", "y").collect()}
    for g in "ab":
        x, y = zip(*[(r[1], r[2]) for r in rows if r[0] == g], strict=True)
        assert got[g] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert got["c"] == 1.0


def test_plans_have_no_sort_by_the_whole_group(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([("a", 1.0, "t")], "g string, v double, text string")
    texts = plan(summarize.summarize(df.select(F.lit(1).alias("doc_id"), "text", F.col("g").alias("title"))))
    assert "Exchange" not in texts and "Python" not in texts
    assert "hashpartitioning(g#" in plan(metrics.percentile_floor(df, ["g"], "v")) and "part#" in plan(metrics.percentile_floor(df, ["g"], "v"))


@pytest.mark.parametrize(("answer", "says", "failed"), [
    ("That isn't covered here.", True, False), ("I could not generate an answer right now; check the server logs", False, True), ("Please ask the Help Desk.", True, False),
    ("1. Open it\n2. Ask the help desk", False, False), ("Step 1 open it, else ask the help desk", False, False), ("The help desk knows. " + "x" * 700, False, False), ("Open the settings.", False, False),
])
def test_declined_and_failed(spark, answer, says, failed):
    assert one(spark, evaluate.declined(F.lit(answer))) is says and one(spark, evaluate.llm_failed(F.lit(answer))) is failed


def test_grounding(spark):
    answer = "Please click settings password portal network browser account security browser reset these steps"
    got = one(spark, evaluate.grounding(F.lit(answer), F.lit("The password portal and network of the account")))
    assert got == pytest.approx(4 / 8)
    assert math.isnan(one(spark, evaluate.grounding(F.lit("click settings"), F.lit("settings")))) and one(spark, evaluate.grounding(F.lit(answer), F.lit(""))) == 0.0


def test_errors_levels_and_probe(spark):
    rows = spark.createDataFrame([(429, None), (503, None), (404, None), (None, "PoolTimeout"), (None, "ConnectError"), (None, "ValueError"), (None, None), (200, "ReadTimeout")], "s int, e string")
    assert [r.k for r in rows.select(evaluate.error_kind(F.col("s"), F.col("e")).alias("k")).collect()] == ["rate_limited", "server_error", "other", "timeout", "connection", "other", "other", "timeout"]
    levels = lambda *t: spark.createDataFrame([(10 * (i + 1), x, p) for i, (x, p) in enumerate(t)], "users int, throughput double, p95 double")
    assert tuple(evaluate.saturation(levels((1.0, 5.0), (3.0, 9.0), (2.0, 11.0))).head()) == (20, True, 30)
    assert tuple(evaluate.saturation(levels((1.0, 5.0), (2.0, 6.0))).head()) == (20, False, None)
    assert one(spark, evaluate.passes(F.lit(10.0), F.lit(0.0))) is True and one(spark, evaluate.passes(F.lit(10.0), F.lit(0.1))) is False
    probe = one(spark, evaluate.cleaning_probe(F.lit("T ype the windo w and r edi r; go back"), ["go back", "skip"]))
    assert probe.leaked == 1 and probe.split_words == len(re.findall(r"\b([A-Za-z]) ([a-z]{1,3})\b", "T ype the windo w and r edi r; go back")) == 3
    calls = spark.createDataFrame([("v", 1, 30.0), ("v", 2, 10.0), ("r", 1, 20.0)], "stage string, query_id int, ms double")
    wall = spark.createDataFrame([(100.0, 2)], "wall_ms double, n int")
    assert tuple(evaluate.dominant_stage(evaluate.stage_shares(calls, wall), wall).head()) == ("v", 0.4, 0.6)
    cases = spark.createDataFrame([("q", "covered", [1]), ("q", "offtopic", [9])], "query string, kind string, expected array<int>")
    groups = spark.createDataFrame([("g", "a"), ("g", "a"), ("h", "a"), ("h", "b")], "group string, query string")
    faults = {r.fault: r.n for r in evaluate.eval_set_faults(cases, spark.createDataFrame([(1,)], "article_id int"), groups).collect()}
    assert faults == {"repeated": 1, "unknown": 1, "unfit": 1, "lone": 1}


def test_stability(spark):
    rows = [("g", 1, [1, 2], 0.5), ("g", 2, [1, 3], 0.9), ("g", 3, [1], 0.7), ("h", 1, [], 0.0), ("h", 2, [4], 0.1), ("k", 1, [5], 0.3)]
    got = {r.group: r for r in evaluate.stability(spark.createDataFrame(rows, "group string, phrasing int, articles array<int>, confidence double")).collect()}
    assert got["g"].mean_overlap == pytest.approx((1 / 3 + 1 / 2 + 1 / 2) / 3) and got["g"].least_overlap == pytest.approx(1 / 3) and got["g"].agree and got["g"].spread == pytest.approx(0.4)
    assert not got["h"].agree and (got["k"].n_queries, got["k"].mean_overlap, got["k"].agree) == (1, 0.0, True)


def test_preambles(spark):
    for answer, want in (
        ("Summary: a  b", "a b"), ("overview:\nx", "x"), ("Here's the summary: y", "y"), ("Summary: Overview: z", "z"), ("Sure, here: a", "Sure, here: a"), ("Here is a text: b", "Here is a text: b"),
        ("```text\nSummary: a\n```", "a"), ("a\n```\nb", "a ``` b"), ("  ", ""),
    ):
        assert one(spark, summarize.strip_preamble(F.lit(answer))) == want, answer


def test_null_frames_by_definition(spark):
    rng = random.Random(5)

    def filtered(text):
        lines, out, drop = text.split("\n"), [], False
        for line in lines[:-1]:
            bare = line.strip(" \t\r\x0b\x0c")
            if bare == "data: null":
                drop = True
                continue
            if drop:
                drop = False
                if not bare:
                    continue
            out.append(line + "\n")
        return "".join(out) + ("" if lines[-1].strip(" \t\r\x0b\x0c") == "data: null" else lines[-1])

    texts = ["".join(rng.choice(["data: null", " data: null\r", "\n", "\r\n", "\n\n", "data: x", " "]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    rows = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate([t[: len(t) // 2], t[len(t) // 2 :]])]
    got = {r.stream: r.text for r in streams.without_null_frames(spark.createDataFrame(rows, "stream long, seq int, text string")).collect()}
    assert got == {i: filtered(t) for i, t in enumerate(texts)}


def test_summaries(spark):
    rng = random.Random(6)
    pool = ["the", "password", "reset", "click", "portal", "and", "network", "printer", "select", "menu"]
    texts = [" ".join(" ".join(rng.choice(pool) for _ in range(rng.randint(3, 12))).capitalize() + rng.choice([".", "!", "?"]) for _ in range(rng.randint(0, 14))) for _ in range(40)] + [None, "", "short."]
    df = spark.createDataFrame([(i % 20, t, "Password reset") for i, t in enumerate(texts)], "doc_id long, text string, title string")
    got = summarize.summarize(df).collect()
    assert len(got) == len(texts)
    parts = df.select("text", summarize.sentences(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r, p in zip(got, parts, strict=True):
        best = p.s
        if len(p.s) > summarize.MAX_SENTENCES:
            split = [[w for w in re.findall("[a-z0-9']+", x.lower()) if len(w) > 2 and w not in summarize.STOPWORDS] for x in p.s]
            often = Counter(w for x in split for w in x)
            scores = {
                i: round(np.mean([1 + np.log(often[w]) for w in x]) * (1.5 - 0.5 * i / len(split)) * (1.15 if {"password", "reset"} & set(x) else 1) * (1.2 if set(summarize.CUES) & set(x) else 1), 9)
                for i, x in enumerate(split) if x
            }
            first = sorted(sorted(scores, key=lambda i: (-scores[i], i))[: summarize.MAX_SENTENCES])
            best = [p.s[i] for i in first] or p.s
        text = " ".join(best)
        assert r.summary == (text if len(text) <= summarize.MAX_CHARS else text[: len(r.summary)])


@pytest.mark.parametrize("cutoff", [0.82, 0.6, 0.95])
def test_closest_terms_against_every_pair(spark, cutoff):
    """No close word is lost: against the closest of all words by difflib, with words of all lengths, repeats and swapped, missing and doubled letters."""
    rng = random.Random(17)
    words = {"".join(rng.choice("aabcdeilnorst-'9") for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 15, 30, 64, 150]))) for _ in range(500)}

    def bent(w):
        letters = list(w)
        for _ in range(rng.randint(0, 1 + len(w) // 7)):
            i = rng.randrange(len(letters) + 1)
            letters[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "a", "ee"])
        return "".join(letters)

    terms = [(i % 7, bent(rng.choice(sorted(words)))) for i in range(250)] + [(0, "abc"), (1, "")]
    table = spark.createDataFrame([(w,) for w in words], "term string").repartition(3)
    got = Counter((r.query_id, r.term) for r in understanding.closest_terms(spark.createDataFrame(terms, "query_id long, term string"), table, cutoff).collect())
    want = Counter(terms)
    for q, t in terms:
        if len(t) >= 4 and t not in words:
            ratio, near = max((difflib.SequenceMatcher(None, w, t).ratio(), w) for w in words)
            if ratio >= cutoff:
                want[q, near] += 1
    assert got == want and sum(want.values()) > len(terms) + 20


def test_chunk_stretches():
    rng = random.Random(9)
    for _ in range(300):
        lengths, budget, glue = [rng.randint(1, 30) for _ in range(rng.randint(0, 15))], 30, rng.randint(1, 2)
        starts = sorted(rng.sample(range(len(lengths)), min(len(lengths), rng.randint(0, 4))))
        want, at, size = [], 0, 0
        for i, n in enumerate(lengths):
            if i > at and (size + n + glue > budget or i in starts and size > budget // 2):
                want.append((at, i))
                at, size = i, 0
            size += n + glue
        assert list(chunking.stretches(lengths, budget, glue, starts)) == want + ([(at, len(lengths))] if lengths else [])


def test_chunk_table_function(spark):
    rng = random.Random(12)
    paragraph = lambda: rng.choice(["STEP 1: do it", "What is this?", "x" * 700, " ".join(rng.choice(["Word", "go.", "Then", "it: Yes", "end!"]) for _ in range(rng.randint(1, 200)))])
    rows = [(str(i), f"T{i}", "Cat" if i % 2 else None, "u", "\n \n".join(paragraph() for _ in range(rng.randint(0, 6)))) for i in range(30)] + [("n", None, None, None, None)]
    articles = spark.createDataFrame(rows + rows[:5], "article_id string, title string, category string, url string, text string")
    once = sorted(map(repr, chunking.chunk_articles(articles.dropDuplicates(["article_id"])).collect()))
    both = [sorted(map(repr, f(articles).collect())) for f in (chunking.chunk_articles, chunking.chunk_rows)]
    assert both[0] == both[1] and set(both[0]) == set(once) and len(both[0]) > len(once) > 40
    for f in (chunking.chunk_articles, chunking.chunk_rows):
        assert "Exchange" not in f(articles)._jdf.queryExecution().executedPlan().toString()
    chunking.register(spark)
    assert [tuple(r) for r in spark.sql("select * from chunks('One. Two.', 200)").collect()] == [(0, "One. Two.", None)]
    with pytest.raises(Exception, match="budget"):
        spark.sql("select * from chunks('a', 'b')").collect()


def test_rewrite_query(spark):
    run = understanding.rewrite_query({"smwol": "SMOWL"}, ["smowl", "password", "moodle"], {"moodle", "the", "how"}, ("smowl",))
    df = spark.createDataFrame([("SMWOL how",), ("pasword, the",), ("smowll",), ("the  moodle",), ("ab",), (None,), (" ",)], "q string")
    assert [r.x for r in df.select(run("q").alias("x")).collect()] == ["SMOWL how", "password the", "SMOWL", "the  moodle", "ab", None, " "]


def test_stages_of_understanding(spark):
    knowledge = understanding.Knowledge((understanding.Group("pw", "Password", "object", ("password", "passcode")),), (understanding.Intent("reset", ("reset",), ("how to reset",), ("x",)),), spelling={"pasword": "password"})
    df = spark.createDataFrame([(1, "reset my PASWORD")], "query_id long, query string")
    every = understanding.process(df, knowledge).head()
    assert every.normalized == "reset my password" and every.lexical.endswith("passcode") and every.intents == ["reset"] and len(every.variants) > 1
    none = understanding.process(df, knowledge, stages=frozenset()).head()
    assert none.normalized == none.lexical == "reset my PASWORD" and none.intents == [] and none.variants == ["reset my PASWORD"] and not none.understood


def test_upsert_quarantine_users_images(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, at int")
    assert sorted((r.id, r.v, r.source_type) for r in catalog.upsert(old, new, "id", "at", "text").collect()) == [(1, "a", None), (2, "d", "text"), (3, "e", "text")]
    rows = spark.createDataFrame([("m", 5), ("", 0), (None, None)], "message string, rating int")
    good, bad = catalog.quarantined(rows, ("length", catalog.valid_request(F.col("message"))), ("rating", catalog.valid_rating(F.col("rating"))))
    assert good.count() == 1 and [r.broken for r in bad.collect()] == [["length", "rating"]] * 2
    users = spark.createDataFrame([(1, "a@x", True), (2, "b@x", None)], "user_id long, email string, is_active boolean")
    got = {r.key: (r.found, r.active) for r in catalog.users_by(users, spark.createDataFrame([("a@x",), ("b@x",), ("A@x",)], "email string"), "email").collect()}
    assert got == {"a@x": (True, True), "b@x": (True, False), "A@x": (False, False)}


PNG = base64.b64encode(b"\x89PNG not really").decode()
PAGE = f"""<html><body><h2>Printing</h2><p>First press the green button on the front.</p><div><img src="/i/one.png" alt="Button"></div>
<figure><img src="//cdn.example.org/two.jpg"><figcaption>The tray</figcaption></figure><p>Then close the lid and wait for the light.</p>
<div><img src="x/three.gif"></div><img src="/img/logo.png"><img src=""><img src="data:text/plain;base64,AAAA"><img src="data:image/png;base64,{PNG}" alt="Inline"></body></html>"""


def test_images_of_pages(spark):
    pages = spark.createDataFrame([("7", "Printing", "Office", PAGE)], "article_id string, title string, category string, html string")
    got = {r.src.split("/")[-1][:9]: r for r in html.image_records(pages, "https://example.org/").collect()}
    assert len(got) == 4 and got["one.png"].src == "https://example.org/i/one.png" and got["two.jpg"].src == "https://cdn.example.org/two.jpg" and got["three.gif"].src == "https://example.org/x/three.gif"
    assert got["one.png"].caption == "Button" and got["two.jpg"].caption == "The tray" and got["three.gif"].caption == "Then close the lid and wait for the light."
    assert "First press the green button on the front." in got["one.png"].context and got["one.png"].keywords == "7,Office,Printing,Button"
    assert got["one.png"].embed_text.split(" | ")[:2] == ["Printing", "Button"] and got["one.png"].embed_text.endswith("Office | screenshot")
    assert got["one.png"].image_id == hashlib.sha256(b"https://example.org/i/one.png").hexdigest()[:16]
    raw = base64.b64decode(PNG)
    inline = next(r for r in got.values() if r.src.startswith("data:"))
    assert inline.image_id == hashlib.sha256(hashlib.sha256(raw).hexdigest().encode()).hexdigest()[:16]
    decoded = files.inline_images(spark.createDataFrame([(f"data:image/png;base64,{PNG}",), ("data:image/weird;base64,QUJD",), ("data:image/png;base64,!!",), ("data:image/png,abc",), ("/x.png",)], "src string")).collect()
    assert {(bytes(r.data), r.extension) for r in decoded} == {(raw, ".png"), (b"ABC", ".png")} and {r.image_id for r in decoded} > {inline.image_id}


def test_image_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.PNG", "y.jpg", "z.txt"):
        (tmp_path / name).write_bytes(b"1")
    side = spark.createDataFrame([("y.jpg", "id7", "Cap", "alt", "12", "Office", None)], "filename string, image_id string, caption string, alt_text string, article_id string, category string, keywords string")
    got = {r.filename: r for r in files.image_folder(spark, str(tmp_path), side).collect()}
    assert sorted(got) == ["x.PNG", "y.jpg"]
    assert got["x.PNG"].image_id == hashlib.sha256(str(tmp_path / "a/x.PNG").encode()).hexdigest()[:16] and got["x.PNG"].embed_text == "x.PNG |  |  | article "
    assert got["y.jpg"].image_id == "id7" and got["y.jpg"].embed_text == "Cap | alt | Office | article 12" and got["y.jpg"].static_path == "/static/images/y.jpg"


def test_nearest_in_a_category(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 6))
    rows = spark.createDataFrame([(i, [float(x) for x in r], "ab"[i % 2]) for i, r in enumerate(v)], "vec_id long, embedding array<double>, category string")
    asked = rows.filter("vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.when(F.col("vec_id") < 4, F.lit("a")).alias("category"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in vector.nearest(rows, asked, 3).collect()}
    for i in range(6):
        order = [j for j in np.argsort(-(v @ v[i]), kind="stable") if i >= 4 or j % 2 == 0]
        assert [got[i, r] for r in (1, 2, 3)] == [int(j) for j in order[:3]]
    assert one(spark, fusion.list_weights(F.lit(0), False, F.lit(1))) == 1.0 and one(spark, fusion.list_weights(F.lit(1), False, F.lit(1))) == 1.0 and one(spark, fusion.list_weights(F.lit(1), False, F.lit(2))) == 0.5


def test_retrieval(spark):
    texts = ["reset your password in the portal", "the printer on the second floor", "network access from home with a client", "lost password and account recovery", "printer paper and toner", "holiday calendar of the office"]
    chunks = spark.createDataFrame([(i, t, i // 2, i % 2, "ab"[i % 2]) for i, t in enumerate(texts)], "chunk_id long, text string, article_id long, chunk_index long, category string")
    knowledge = understanding.Knowledge((understanding.Group("vpn", "VPN", "system", ("vpn", "network access")),), (understanding.Intent("reset", ("password",), ("account recovery",), ("portal",), True),))
    asked = spark.createDataFrame([(1, "password reset", None), (2, "printr toner", None), (3, "vpn", None), (4, "printer", "a"), (5, "", None)], "query_id long, query string, category string")
    got = retrieval.retrieve(asked, chunks, knowledge, models.word_embedder(64), models.overlap_scorer, fuzzy=True)
    first = {r.query_id: r.chunk_id for r in got.final.filter("final_rank = 1").collect()}
    assert first[1] == 0 and first[2] == 4 and first[3] == 2
    seen = {(r.query_id, r.chunk_id) for r in got.rankings.filter("list = -1").collect()}
    assert (2, 1) in seen and (3, 2) in seen  # by the closest term, and by a synonym
    assert {r.chunk_id for r in got.rankings.filter("query_id = 4 and list >= 0").collect()} == {0, 2, 4}  # vectors of category a only
    assert (4, 1) in seen  # BM25 sees all, and what it alone found has a score
    alone = got.candidates.filter("query_id = 4 and chunk_id = 1").head()
    assert alone.is_lexical and alone.score > 0 and alone.boost == 0.0 and got.candidates.filter("query_id = 1 and chunk_id = 0").head().boost == 1.0
    assert got.final.filter("query_id = 5").count() == 0 or got.gated.filter("query_id = 5 and score > 0").count() == 0
    plain = {r.chunk_id: r.score for r in lexical.search(chunks, asked.filter("query_id = 1").select("query_id", "query"), 5).collect()}
    assert set(plain) == {0, 3}
