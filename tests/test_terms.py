"""Terms of the knowledge in a text, and variants of a query, against their definitions."""

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import understanding as u


def by_definition(knowledge, text):
    owners, tokens, taken, found = knowledge.owners(), text.lower().split(), set(), []
    for phrase in knowledge.phrases():
        for i in range(len(tokens)):
            span = range(i, i + len(phrase))
            if " ".join(phrase) in owners and tuple(tokens[i : i + len(phrase)]) == phrase and not taken & set(span):
                taken |= set(span)
                found.append((i, len(phrase)))
    found += [(i, 1) for i, t in enumerate(tokens) if i not in taken and t in owners]
    return [(" ".join(tokens[i : i + n]), owners[" ".join(tokens[i : i + n])].id, i, n) for i, n in sorted(found)]


def test_terms_of_random_dictionaries():
    rng = random.Random(5)
    for _ in range(300):
        words = [f"w{i}" for i in range(rng.randint(1, 6))]
        phrase = lambda: rng.choice(" - ").join(rng.choice(words) for _ in range(rng.randint(1, 4)))  # noqa: B023, E731
        knowledge = u.Knowledge(tuple(u.Group(str(g), phrase(), "object", tuple(phrase() for _ in range(rng.randint(0, 5)))) for g in range(4)), (), {}, {}, {})
        terms = u.Terms(knowledge)
        for _ in range(10):
            text = " ".join(rng.choice([*words, "other", "W1"]) for _ in range(rng.randint(0, 30)))
            assert terms.found(text) == by_definition(knowledge, text), (knowledge, text)


def test_steps_do_not_follow_the_number_of_terms():
    """Many phrases cost no more steps: those of a text that begins none are one look-up a token."""

    class Counting(dict):
        looked = 0

        def get(self, *args):
            Counting.looked += 1
            return super().get(*args)

    for n in (10, 10_000):
        terms = u.Terms(u.Knowledge((u.Group("g", "g", "object", tuple(f"a{i} b{i}" for i in range(n))),), (), {}, {}, {}))
        terms.tree, Counting.looked = Counting(terms.tree), 0
        assert terms.found("x " * 1000) == [] and Counting.looked == 1000


def test_variants_quote_terms_and_replacements(spark):
    knowledge = u.Knowledge(
        (u.Group("a", "A", "system", ("VPN $1\\x", "vpn", "virtual network")), u.Group("b", "B", "object", ("alone",))), (u.Intent("ask", ("help",), ("get help", "GET HELP")),), {}, {}, {}
    )
    rows = spark.createDataFrame([(1, "vpn"), (2, "help with my vpn today please"), (3, "what is vpn"), (4, "alone with my things here"), (5, ""), (6, None)], "query_id int, query string")
    got = {r.query_id: r.variants for r in u.process(rows, knowledge, most=10).collect()}
    assert got[1] == ["vpn", "VPN $1\\x", "virtual network", "How do I use vpn?", "What is vpn?"]
    assert got[2] == ["help with my vpn today please", "get help", "help with my VPN $1\\x today please", "help with my virtual network today please"]
    assert got[3] == ["what is vpn", "what is VPN $1\\x", "what is virtual network"]
    assert got[4] == ["alone with my things here"] and got[5] == got[6] == []
    assert u.process(rows, knowledge, most=1).filter("query_id = 1").head().variants == ["vpn", "VPN $1\\x"]


def test_a_term_is_replaced_as_a_whole_word(spark):
    knowledge = u.Knowledge((u.Group("a", "A", "object", ("new", "on")),), (), {}, {}, {})
    got = spark.createDataFrame([(1, "On only on-site, won ON it is a long one")], "query_id int, query string")
    row = u.process(got, knowledge).select("normalized", F.get("variants", 1).alias("v")).head()
    assert row.normalized != row.v == re.sub(r"\bon\b", "new", row.normalized, flags=re.I)
