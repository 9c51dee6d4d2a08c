"""Golden cases of single operators."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import html, text
from lodestone.operators import catalog, chunking, context, evaluate, fusion, lexical, metrics, summarize, understanding, vector
from lodestone.sources import files
from lodestone.streaming import streams


def one(spark, value, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(value.alias("v")).head().v


def test_clean_html(spark):
    clean = lambda h: one(spark, html.clean_html(F.col("h")), h=h)
    assert clean("<html><script>alert('x')</script><body><p>Hello World</p></body></html>") == "Hello World"
    assert "Menu" not in clean("<nav>Menu</nav><main><p>Article content here</p></main>")
    assert clean("<p>a<span>b</span>c</p><p>Home</p><p>|</p><p>abc</p><p>ABC</p>") == "abc"
    assert clean("<div class='x breadcrumb'>crumb</div><p>Category: LMS</p><p>body\u00a0text</p>") == "body text"


def test_title(spark):
    title = lambda h: one(spark, html.extract_title(F.col("h")), h=h)
    assert title("<title>Reset Password - Help Desk</title>") == "Reset Password"
    assert title("<title>Article Details</title><h1>Real</h1>") == "Real"
    assert title("<h2>Article Details</h2><h3>abc</h3><h4>Longer</h4>") == "Longer"
    assert title("<p>none</p>") is None


def test_images():
    page = "<p>Click the button that is shown below</p><p><img src='/a.png'></p><img src='logo.png'><figure><img src='http://x/b.png' alt='alt'><figcaption>Cap</figcaption></figure><img src='data:text/plain,x'>"
    got = html.page_images(page, "https://e.org/")
    assert [(i["src"], i["caption"]) for i in got] == [("https://e.org/a.png", "Click the button that is shown below"), ("http://x/b.png", "Cap")]


def test_links(spark):
    page = '<a href="knowledgebase.php?article=11">x</a> Knowledgebase.php?category=2'
    assert one(spark, files.linked_ids(F.col("h")), h=page) == ["11"]
    assert one(spark, files.linked_ids(F.col("h"), files.CATEGORY_LINK), h=page) == ["2"]


def test_chunks(spark):
    rows = [("1", "Test Article", "LMS", "u", "This is a test sentence. " * 200), ("2", "T", None, "u", "  ")]
    got = chunking.chunk_articles(spark.createDataFrame(rows, "article_id string, title string, category string, url string, text string")).orderBy("chunk_index").collect()
    assert len(got) > 1 and got[0].chunk_id == "1_chunk_0" and {r.article_id for r in got} == {"1"}
    assert all(r.text.startswith("[LMS — Test Article]\n") for r in got)
    assert chunking.pieces("a\n\nSTEP 1: x\n\n" + "b" * 30, 40) == ["a\n\nSTEP 1: x", "b" * 30]


def test_summary(spark):
    t = "Click the reset button to set a new password now. " + " ".join(f"Some{i} thing{i} that other{i} people{i} wrote{i} once." for i in range(8))
    got = summarize.summarize(spark.createDataFrame([(1, t, "Password"), (2, "short", None), (3, None, None)], "doc_id long, text string, title string"))
    by = {r.doc_id: r.summary for r in got.collect()}
    assert by[1].startswith("Click the reset button") and by[2] == "" and by[3] == ""
    assert one(spark, summarize.join_within(F.array(F.lit("word " * 20)), 12)) == "word word"


def test_intent_boost(spark):
    boost = lambda t, *terms: one(spark, fusion.intent_boost(F.lit(t), F.array(*map(F.lit, terms))))
    assert boost("To reset your password, go to the login portal", "password", "reset", "login", "portal") == 1.0
    assert abs(boost("Your PASSWORD has expired", "password", "reset", "credentials") - 1 / 3) < 1e-12


FINAL = "query_id long, article_id string, chunk_index int, text string, score double, final_rank int"


def test_group_adjacent(spark):
    run = lambda rows: [(r.article_id, r.text, r.score) for r in context.group_adjacent(spark.createDataFrame([(1, a, i, f"[T]\n{t}", s, k) for k, (a, i, t, s) in enumerate(rows)], FINAL)).orderBy("final_rank").collect()]
    got = run([("1", 1, "step two", 0.9), ("4", 0, "x", 0.8), ("1", 2, "step three", 0.7), ("1", 0, "step one", 0.6)])
    assert got == [("1", "[T]\nstep one\n\nstep two\n\nstep three", 0.9), ("4", "[T]\nx", 0.8)]
    assert len(run([("1", 0, "a", 0.5), ("1", 4, "b", 0.4)])) == 2
    assert run([("1", 9, "b", 0.9), ("1", 8, "a", 0.3)]) == [("1", "[T]\na\n\nb", 0.9)]


def test_citations(spark):
    rows = [(1, "a1", 0, "t", s, k) for k, s in enumerate((0.55, 0.81, 0.74))]
    got = context.citations(spark.createDataFrame(rows, FINAL)).collect()
    assert [(r.article_id, r.score) for r in got] == [("a1", 0.55)]


def test_histogram_and_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 7, 30, 300, 99999)], "v double").withColumn("g", F.lit(1))
    got = {r.le: r.cumulative for r in metrics.histogram(df, ["g"], "v").collect()}
    assert (got[5.0], got[10.0], got[50.0], got[500.0], got[None]) == (1, 2, 3, 4, 5)
    ten = spark.range(20).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    assert metrics.percentile_nearest(ten, ["g"], "v", 50).head().percentile == 9.0
    assert metrics.percentile_floor(ten, ["g"], "v").head().percentile == 19.0
    assert metrics.percentile_before(ten, ["g"], "v").head().percentile == 18.0


def test_labels(spark):
    rows = spark.createDataFrame([("c", {"a": "1", "b": 'he said "hi"\\ok'}, 1), ("c", {"b": 'he said "hi"\\ok', "a": "1"}, 1)], "name string, labels map<string,string>, value long")
    got = metrics.counters(rows).collect()
    assert len(got) == 1 and got[0].value == 2 and got[0].labels == 'a="1",b="he said \\"hi\\"\\\\ok"'


def test_null_frames(spark):
    def run(*parts):
        return streams.without_null_frames(spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "stream long, seq int, text string")).head().text

    assert run('data: {"a":1}\n\n', "data: nu", 'll\n\ndata: {"b":2}\n\n') == 'data: {"a":1}\n\ndata: {"b":2}\n\n'
    assert "null" not in run('data: {"a":1}\n\ndata: null')


def test_rate_limit_and_cache(spark):
    rows = spark.createDataFrame([("c", i, i % 3) for i in range(9)], "cache string, seq long, key long").withColumn("at", F.col("seq").cast("double"))
    got = streams.cache_replay(rows, 2).head()
    assert (got.hits, got.misses) == (0, 9)
    got = streams.cache_replay(rows, 3).head()
    assert (got.hits, got.misses) == (6, 3)


KNOWLEDGE = understanding.Knowledge(
    (understanding.Group("lms", "Moodle LMS", "system", ("LMS", "Moodle", "Learning Management System", "learning portal")), understanding.Group("pw", "Password", "object", ("password", "passcode"))),
    (understanding.Intent("password_reset", (r"forgot.*password",), ("reset my password",), ("Password", "reset"), True),),
    {"uni": "university"}, {"mfa": "MFA"}, {"moddle": "moodle"},
)


def test_process_query(spark):
    df = spark.createDataFrame([(1, "I forgot my MODDLE password!"), (2, "learning management system"), (3, ""), (4, None), (5, "mfa"), (6, "pasword help")], "query_id long, query string")
    got = {r.query_id: r for r in understanding.process(df, KNOWLEDGE, ["password", "moodle"]).collect()}
    assert got[1].normalized == "i forgot my moodle password" and got[1].corrections == {"MODDLE": "moodle"}
    assert got[1].intents == ["password_reset"] and got[1].procedural and got[1].entities == ["Moodle LMS"]
    assert got[1].boost_terms == ["password", "reset"] and got[1].variants[1] == "reset my password"
    assert got[2].entities == ["Moodle LMS"] and len(got[2].matches) == 1 and got[2].lexical.endswith("LMS Moodle learning portal")
    assert got[3].normalized == got[4].normalized == "" and got[3].variants == []
    assert got[5].normalized == "MFA" and got[5].variants[1:] == ["How do I use MFA?", "What is MFA?"]
    assert got[6].normalized == "password help"


def test_overlay(tmp_path):
    f = tmp_path / "k.yaml"
    f.write_text("synonyms:\n  lms: {canonical: L, kind: system, terms: [x]}\nintents:\n  a: {patterns: ['(', 'ok']}\nacronyms: {ID: ID}\n")
    got = understanding.load_knowledge(str(f), KNOWLEDGE)
    assert got.groups[0].terms == ("x",) and got.intents[-1].patterns == ("ok",) and got.acronyms == {"mfa": "MFA", "id": "ID"}
    assert understanding.load_knowledge("/nowhere.yaml", KNOWLEDGE) is KNOWLEDGE


def test_mmr(spark):
    rows = [(1, i, i, s, v) for i, (s, v) in enumerate([(0.9, [1.0, 0.0]), (0.89, [1.0, 0.01]), (0.5, [0.0, 1.0])])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, ord int, score double, embedding array<double>")
    assert [r.chunk_id for r in vector.diverse(df, 2, 0.5).orderBy("picked").collect()] == [0, 2]


def test_strings(spark):
    assert one(spark, text.strip(F.lit("\u2003\x1c a \n"))) == "a"
    assert one(spark, text.session_title(F.lit("word " * 30))).endswith("…")
    assert one(spark, text.markdown_html(F.lit("**a** <b>"))) == "<strong>a</strong> &lt;b&gt;"
    assert one(spark, text.jaccard(F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<string>)"))) == 1.0


def test_requests_and_upsert(spark):
    assert one(spark, catalog.valid_request(F.lit(""))) is False and one(spark, catalog.valid_request(F.lit("x" * 2000))) is True
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, catalog.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_store(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "s"))
    store.write(spark.range(3))
    store.write(store.read().filter("id > 0"))
    assert store.read().count() == 2


def test_evaluation_helpers(spark):
    assert one(spark, evaluate.declined(F.lit("Sorry, I don't have that."))) is True
    assert one(spark, evaluate.declined(F.lit("1. Contact the help desk"))) is False
    assert one(spark, evaluate.token_usage(F.lit('{"prompt_tokens": 5, "completion_tokens": 7}'))).asDict() == {"input": 5, "output": 7}


def test_nearest_of_many_queries(spark, monkeypatch):
    """More queries than are searched at once give what one search gives."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = {(i, int(j), r + 1) for i in range(1, 120, 2) for r, j in enumerate(np.argsort(-(vectors @ vectors[i]), kind="stable")[:5])}
    for most in (1000, 60, 7):
        monkeypatch.setattr(vector, "MAX_QUERIES", most)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in vector.nearest(rows, queries, 5).collect()} == want


def test_closest_terms(spark):
    words = ["password", "passport", "network", "printer", "pointer"]
    terms = spark.createDataFrame([(1, "pasword"), (1, "network"), (2, "prinnter"), (2, "zzzzzz"), (2, "pri")], "query_id long, term string")
    table = spark.createDataFrame([(w,) for w in words], "term string").repartition(3)
    got = sorted((r.query_id, r.term) for r in understanding.closest_terms(terms, table).collect())
    assert (1, "password") in got and (2, "printer") in got


def test_contained(spark):
    text = " ".join(f"w{i}" for i in range(40))
    left = spark.createDataFrame([(1, " ".join(text.split()[:20])), (2, "no such words at all in the other text of ours")], "left_id long, text string")
    right = spark.createDataFrame([(7, text), (8, " ".join(text.split()[12:])), (9, None)], "right_id long, text string")
    got = {(r.left_id, r.right_id): (r.shared, r.share) for r in evaluate.contained(left, right).collect()}
    assert got == {(1, 7): (13, 1.0)}


def test_weighted_text_and_aliases(spark):
    groups = spark.createDataFrame([(1, "vpn"), (1, "remote access"), (2, "mail")], "group_id long, term string")
    titles = spark.createDataFrame([(1, "VPN setup"), (2, "other")], "chunk_id long, title string")
    assert [(r.chunk_id, r.aliases) for r in lexical.alias_terms(titles, groups).collect()] == [(1, "remote access")]
    text = lexical.weighted_text(F.col("t"), category=F.lit("cat"), aliases=F.lit("remote access"))
    assert one(spark, text, t="[Head]\nbody") == "[Head]\nbody Head Head Head cat cat remote access"
