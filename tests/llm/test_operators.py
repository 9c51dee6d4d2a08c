"""Training-data operators against brute force, exact round trips and planted cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, common, langid, licenses, line_dedup, minhash, packing, quality, syncmers, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key string"
LOWER = {i: i + 32 for i in range(65, 91)}
SPACE = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, texts, langs=None, sources=None, ids=None):
    """Documents with columns that clash with the operators' own names."""
    rows = [
        (i if ids is None else ids[i], t, (langs or [None] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), "b", "k") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=None):
    words = words or [f"{a}{b}" for a in ("an", "the", "re", "in", "tion", "er", "or") for b in ("", "ly", "ed", "ing", "ou", "st")]
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [None, "", " \n\t", "a", "Word", "\u65e5\u672c\u8a9e \U0001f600 text", "same text here", "same text here"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.02 else "zzz" for w in base[i].split()) for i in range(12)]
    return ODD + base + near + base[:5] + [prose(rng, 20_000)]


def test_syncmers(spark, texts):
    ids = [10 * i for i in range(len(texts))]
    got = {r.doc_id: r for r in syncmers.fingerprint(documents(spark, texts, ids=ids), 5).collect()}
    plain = [t or "" for t in texts]
    assert sorted(got) == ids
    for k, t in enumerate(plain):
        r, after = got[10 * k], plain[(k + 1) % len(plain)]
        changed = syncmers.edited(t, after)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        one = lambda x: syncmers.encode(*syncmers.anchors([x])[:2])
        assert (r.fingerprint, r.edited_fingerprint) == (one(t), one(changed))
        a, b = (collections.Counter(syncmers.decode(x)[0].tolist()) for x in (one(t), one(changed)))
        kinds = {i for i, (_, _, least, below) in enumerate(syncmers.KINDS) if least <= min(len(t), len(changed)) and max(len(t), len(changed)) < below} | {3}
        a, b = (collections.Counter({h: n for h, n in x.items() if h % 4 in kinds}) for x in (a, b))
        total = sum(a.values()) + sum(b.values())
        assert r.near_edited == pytest.approx(2 * sum((a & b).values()) / total if total else float(not t and not changed))
    assert got[10 * texts.index("same text here")].near_next == 1.0


@pytest.mark.parametrize("size", [5, 31, 32, 90, 1023, 1024, 3000])
def test_syncmer_anchors_by_definition(texts, size):
    text = texts[-1][:size]
    whole = lambda t: common.mix64(common.prefix_hashes(np.array([ord(c) for c in t], np.uint32))[-1:])[0]
    code, place, _ = syncmers.anchors([text])
    for kind, (k, s, least, below) in enumerate(syncmers.KINDS):
        inner = [int(whole(text[i : i + s])) for i in range(len(text) - s + 1)]
        want = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
        assert place[code % 4 == kind].tolist() == (want if least <= size < below else [])
    moved = "unlike. " + text
    if not any(size < below <= size + 8 for *_, below in syncmers.KINDS):
        assert set(code.tolist()) <= set(syncmers.anchors([moved])[0].tolist())
        assert all(b - a == 8 for a, b in syncmers.align(syncmers.encode(code, place), syncmers.encode(*syncmers.anchors([moved])[:2])))


def near(*pair):
    code, _, cut = syncmers.anchors(list(pair))
    return float(syncmers._likeness(code, cut, np.array([len(t) for t in pair]), np.array([0]), np.array([1]))[0])


def test_texts_of_any_length_are_like_their_edited_text():
    rng = random.Random(21)
    for n in (*range(4, 40), 50, 64, 95, 96, 120, 150, 191, 192, 250, 400, 1000, 1023, 1024, 1100, 2000):
        for k in range(8):
            text = prose(rng, 500)[k : n + k]
            for after in ("", prose(rng, 3), "Q!x" * 2000):
                found = near(text, syncmers.edited(text, after))
                assert (0.2 if n <= 12 or n > 40 else 0.1) < found <= 1, (n, after, found)


def test_likeness_does_not_depend_on_limits():
    rng = random.Random(22)
    for short, long in ((69, 339), (20, 60), (31, 33), (100, 1000), (1000, 1100), (500, 2000), (31, 100), (40, 1500)):
        shares = []
        for _ in range(20):
            text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(long))
            shares.append(near(text[:short], text))
        assert sum(shares) / 20 == pytest.approx(2 * short / (short + long), abs=0.12), (short, long)
    assert near("a", "a") == 1.0 and near("", "") == 1.0 and near("", "a") == 0.0 and near("a", "b") == 0.0
    for text in ("a" * 5, "a" * 40, "word " * 600, "ab", "x" * 1023, "x" * 1024):
        assert near(text, text) == 1.0


def test_buckets_of_ranges(spark):
    edges = sorted({k * k for k in range(1, 60)})
    ids = [-5, 0, 1, 2, 3, 4, 100, 101, 3481, 9999, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", syncmers._bucket(edges, F.col("doc_id")).alias("b"))
    assert {r.doc_id: r.b for r in df.collect()} == {i: 0 if i is None else sum(e <= i for e in edges) for i in ids}


def test_empty_tables(spark):
    none = documents(spark, [])
    path = pytest.importorskip("public_tokenizers").path
    assert syncmers.fingerprint(none).count() == 0 and packing.packed_with_crc(none, path("word_bpe_49k.json")).count() == 0
    assert licenses.scan(none).count() == 0 and line_dedup.remove_boilerplate(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0 and quality.judged(none).count() == 0
    assert langid.identify(none, langid.profiles(none, F.lit(True))).count() == 0
    model = toxicity.train(none, spark.createDataFrame([], "doc_id long, quality long, toxic long"), F.lit(True))
    assert toxicity.score(none, model).count() == 0


def test_packing(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    many = texts + [f"{t} {i}" for i, t in enumerate(texts * 3) if t]
    got = packing.packed_with_crc(documents(spark, many), path).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert sorted(pieces) == list(range(len(many)))
    for i, t in enumerate(many):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    tokens = padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.05 * tokens + 4096


@pytest.mark.parametrize("sizes", [(1, 8), (1, 300), (1, 4096), (4000, 9000), (64, 64)])
def test_packing_leaves_little_padding(spark, sizes):
    rng = random.Random(sizes[1])
    n = 20_000 if sizes[1] < 100 else 4000
    tokens = [rng.randint(*sizes) for _ in range(n)]
    measured = spark.createDataFrame([(i, i % 7 or None, 5, t) for i, t in enumerate(tokens)], "row_id long, doc_id long, text_hash long, doc_tokens long").cache()
    got = packing.pack(measured)[0].collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.row_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(tokens):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == t
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
    assert 4096 * len(sequences) - sum(tokens) <= 0.02 * sum(tokens) + 4096


def test_nnls_against_least_squares():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 12)), np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-5)
    histogram = np.zeros(257, np.int64)
    np.add.at(histogram, rng.integers(1, 257, 20_000), 1)
    left = histogram.copy()
    for combo, n in packing.recipes(histogram):
        assert sum(combo) == 256
        for c in combo:
            left[c] -= n
    assert (left >= 0).all() and left.sum() < 0.1 * histogram.sum()


def test_tokenizer_memo():
    public = pytest.importorskip("public_tokenizers")
    own = packing.Ids(public.path("word_bpe_49k.json"))
    rng = random.Random(3)
    pool = ["a", "B", "\u00c9", "\u0130", " ", "\n", "\x1c", "\x85", "\u65e5", "\U0001f600", "1", "\u00b2", "'s", "'", "ing", "!!", "e\u0301", "\u03a3", "<|endoftext|>", "<|", "\u00df", "\u00d7", "-", "_", "\x00", "\u00ad"]
    for _ in range(500):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert own.of([t])[0] == np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_tokenizer_of_every_latin_letter():
    """Each character below U+0250 within a word, new and remembered; some have small letters beyond (Latin B with hook, A with stroke)."""
    public = pytest.importorskip("public_tokenizers")
    own = packing.Ids(public.path("word_bpe_49k.json"))
    texts = [t for c in map(chr, range(0x250)) for t in (f"a{c}b", f"x{c} {c}{c}y 1{c}")]
    want = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [t for t, x, y in zip(texts, own.of(texts), want, strict=True) if x != y] == []
    assert own.of(texts) == want


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "a\\b <|user|> |> \\<|end|>\n"), (1, 0, "user", None), (1, 2, "user", chat.TRICKY), (1, 3, "assistant", ""),
        (2, 0, "odd|>role", "x"), (None, None, None, None), (3, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", "r"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    formatted = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = {(r.conv_id, r.example): r for r in chat.expand(formatted).collect()}
    first = examples[1, 0]
    assert chat.unescape(first.text[first.target_begin : first.target_end]) == rows[0][3] and first.text.count("<|assistant|>") == 1
    assert examples[1, 1].text.startswith(first.text)


def test_chat_examples_are_written_and_read_back(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(4):
        turns = [(conv, k, "end" if k % 5 == 4 else ("assistant" if k % 2 else "user"), "\n|> <| \\ \u65e5" * rng.randint(0, 3) + prose(rng, rng.randint(0, 9))) for k in range((0, 1, 41, 60)[conv])]
        rows += turns
        text, loss, written = "", [], []
        for _, _, role, t in turns:
            escape = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")
            text += f"<|{role}|>{escape(t)}<|end|>\n"
            if role == "assistant":
                loss.append(t)
                written.append(text)
        want[conv] = (turns, loss, written, len(text))
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ordered = formatted.orderBy("conv_id", "position").toArrow().to_batches(max_chunksize=7)
    parts = list(chat._examples(iter(ordered), part=50, held=100))
    got = collections.defaultdict(list)
    for r in (r for batch in parts for r in batch.to_pylist()):
        assert len(r["text"]) <= 50 and r["part"] == len(got[r["conv_id"], r["example"]])
        got[r["conv_id"], r["example"]].append(r)
    digests = {r["conv_id"]: r for batch in chat._digests(iter(parts)) for r in batch.to_pylist()}
    assert digests == {r.conv_id: r.asDict() for r in chat.read_back(formatted).collect()}
    assert {(r.conv_id, r.example): r.text for r in chat.expand(formatted).collect()} == {(c, e): x for c, w in want.items() for e, x in enumerate(w[2])}
    for conv, (turns, loss, written, chars) in want.items():
        if not turns:
            continue
        for e, x in enumerate(written):
            text = "".join(r["text"] for r in got[conv, e])
            assert text == x and chat.unescape(text[got[conv, e][0]["target_begin"] : got[conv, e][0]["target_end"]]) == loss[e]
        r = digests[conv]
        assert (r["n_examples"], r["expanded_chars"], r["formatted_chars"], r["n_turns"]) == (len(written), sum(map(len, written)), chars, len(turns))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, _, a, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(loss).encode()).hexdigest()
    # an example whose context lost a turn, or whose mask is off by one, is noticed
    whole = [r for batch in chat._examples(iter(ordered)) for r in batch.to_pylist() if r["conv_id"] == 3]
    schema = parts[0].schema
    cut = [dict(r, text=r["text"][r["text"].index("<|end|>\n") + 8 :]) if r["example"] == 5 else r for r in whole]
    moved = [dict(r, target_end=r["target_end"] - 1) if r["example"] == 5 else r for r in whole]
    for broken in (cut, moved):
        with pytest.raises(ValueError, match="example 5"):
            import pyarrow as pa

            list(chat._digests(iter([pa.RecordBatch.from_pylist(broken, schema=schema)])))


def test_licenses(spark, texts):
    more = ["Released under the MIT License.", "xmit license; MIT  license mit\nLICENSE", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3 and general-public/license",
            "SPDX-License-Identifier: BSD-3-Clause", "Licensed under CC BY-NC 4.0.", "\u00e9mit license mit license\u00e9", "permit license"]
    all_ = texts + more
    got = {r.doc_id: r for r in licenses.scan(documents(spark, all_)).collect()}
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, t in enumerate(all_):
        w = words.findall((t or "").translate(LOWER))
        at = [(k, label) for label, p in licenses.BASE.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert sorted(r.base_labels) == sorted({x for _, x in at})
    own = lambda text: {d.label for d in got[all_.index(text)].detections or []}
    assert own(more[2]) == {"apache-2.0"} and "gpl-3.0" in own(more[3]) and own(more[4]) == {"bsd-3-clause"} and own(more[5]) == {"cc-by-nc"}


def test_wrapped_licenses(spark):
    gnu = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version."""
    wanted = [
        (gnu.format("", 2), {"gpl", "gpl-2.0"}), (gnu.format("", 3), {"gpl", "gpl-3.0"}), (gnu.format("", 3).replace("License", "Licence"), {"gpl", "gpl-3.0"}),
        (gnu.format("Affero ", 3), {"agpl-3.0"}), (gnu.format("Lesser ", 3), {"lgpl"}), (gnu.format("Library ", 2), {"lgpl-2.0"}),
        ("Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n", {"mit"}),
        ("You may not use this file\n   except in compliance with the License.", {"apache-2.0"}),
        ("Each Contributor hereby\ngrants to You a perpetual,\nworldwide, non-exclusive, no-charge", {"apache-2.0"}),
        ("Redistribution and use in source and binary\nforms, with or without\nmodification, are permitted", {"bsd-2-clause"}),
        ("Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or\nwithout fee is hereby granted", {"isc"}),
        ("released into the public\r\n\tdomain", {"public-domain"}), ("under the same terms as Perl\n itself", {"perl"}),
        ("This Source Code Form is\nsubject to the terms of the Mozilla Public\nLicense", {"mpl-2.0"}),
        *[(name.replace(" ", gap), {label}) for gap in ("\n", "  ", "\r\n  ") for name, label in (
            ("GNU Free Documentation License", "gfdl"), ("Common Development and Distribution License", "cddl-1.0"), ("Common Public License", "cpl-1.0"),
            ("Academic Free License", "afl-3.0"), ("Open Software License", "osl-3.0"), ("SIL Open Font License", "ofl-1.1"), ("Business Source License", "bsl-1.1"),
            ("Blue Oak Model License", "blueoak-1.0.0"), ("Universal Permissive License", "upl-1.0"), ("Open Data Commons Attribution License", "odc-by-1.0"),
            ("All rights reserved", "proprietary"), ("The software shall be used for Good, not Evil", "json"))],
    ]
    got = {r.doc_id: {d.label for d in r.detections or []} for r in licenses.scan(documents(spark, [t for t, _ in wanted])).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(wanted)] == wanted


def sample_of(regex):
    """A text that the regex matches: first branches, least repeats."""
    import re._constants as c
    import re._parser as parser

    def walk(tree):
        out = ""
        for op, arg in tree:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.NOT_LITERAL or op is c.ANY:
                out += "x"
            elif op is c.IN:
                kind, value = arg[0]
                out += chr(value) if kind is c.LITERAL else chr(value[0]) if kind is c.RANGE else {c.CATEGORY_SPACE: " ", c.CATEGORY_DIGIT: "1"}.get(value, "w")
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += walk(arg[2]) * arg[0]
            elif op is c.SUBPATTERN:
                out += walk(arg[3])
            elif op is c.BRANCH:
                out += walk(arg[1][0])
        return out

    return walk(parser.parse(regex.replace(r"\s{1,9}", r"\s")))


def test_every_rule_has_a_match_that_passes_gate_and_keyword(spark):
    from lodestone.llm.license_rules import _NOT_OTHER_GPL, rules

    known = rules()
    assert len({r.regex for r in known}) == len(known)
    samples = [sample_of(r.regex.replace(_NOT_OTHER_GPL.replace(" ", r"\s+"), "")) for r in known]
    from lodestone.llm.license_phrases import phrases

    assert len({x for _, x in phrases()}) == len(phrases()) >= 250
    docs = documents(spark, [f"Some words; {x.upper() if i % 2 else x} and more" for i, x in enumerate(samples)])
    low = F.regexp_replace(F.lower("text"), licenses.WRAPS, " ")
    table = spark.createDataFrame([(r.number, r.regex, list(r.keywords)) for r in known], "doc_id long, regex string, keywords array<string>")
    gate = [F.contains(low, F.lit(g)) for g in licenses.GATE] + [low.rlike(licenses.GATE_REGEX)]
    rows = docs.join(table, "doc_id").select(
        "regex", F.regexp_count("text", F.col("regex")).alias("n"), F.exists("keywords", lambda k: F.contains(low, k)).alias("word"), F.greatest(*gate).alias("gate"))
    assert [r for r in rows.collect() if not (r.n and r.word and r.gate)] == []


def test_license_gate_changes_nothing(spark, texts):
    from lodestone.llm.license_rules import rules

    rng = random.Random(15)
    known = rules()
    mixed = ["\n".join(sample_of(r.regex) for r in rng.sample(known, 3)).replace(" ", rng.choice([" ", "\n", "  "])) for _ in range(60)]
    docs = documents(spark, texts[:40] + mixed)
    plain = lambda gated: {r.doc_id: r for r in licenses.scan(docs, gated=gated).collect()}
    assert plain(True) == plain(False)


def test_strongest_detections(spark):
    rng = random.Random(16)
    rows = []
    for text in range(60):
        for _ in range(rng.randint(1, 25)):
            begin = rng.randint(0, 60)
            rows.append((text, rng.randint(0, 9), "x", rng.choice([50, 80, 90, 100]), begin, begin + rng.randint(1, 20)))
    rows = sorted({(r[0], r[1], r[4]): r for r in rows}.values())
    want = set()
    for text in range(60):
        kept = []
        for d in sorted((r for r in rows if r[0] == text), key=lambda r: (-r[3], r[4] - r[5], r[4], r[1])):
            if not any((k[4] <= d[4] and d[5] <= k[5] and k[3] >= d[3]) or (k[3] > d[3] and k[4] < d[5] and d[4] < k[5]) for k in kept):
                kept.append(d)
        want |= set(kept)
    df = spark.createDataFrame(rows, "row_id long, number int, label string, priority int, begin int, end int")
    got = {tuple(r) for r in licenses.strongest(df, [50, 80, 90, 100]).select("row_id", "number", "label", "priority", "begin", "end").collect()}
    assert got == want


def test_many_detections_in_one_text(spark):
    n = 100_000
    text = "".join(f"Licensed under the MIT License {i}. " for i in range(n))
    began = time.time()
    r = licenses.scan(documents(spark, [text])).collect()[0]
    assert len(r.detections) == n == r.n_base and time.time() - began < 60
    assert all(re.match("licensed under the mit license$", text[d.begin : d.end], re.I) for d in r.detections[:50] + r.detections[-50:])


def test_line_dedup(spark):
    rng = random.Random(1)
    pages = [f"menu\n{prose(rng, 12)} {i}\n\n\ncopyright {i % 2}" for i in range(60)] + [None, "", "menu\nmenu", "menu"]
    sources = ["a"] * 30 + ["b"] * 30 + ["a", "b", None, "b"]
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(documents(spark, pages, sources=sources), ratio=0.3, confidence=1.0).collect()}
    count, total = collections.Counter(), collections.Counter(sources)
    for p, s in zip(pages, sources, strict=True):
        count.update((s, x) for x in {x for x in (p or "").split("\n") if x.strip(" \t\r")})
    for i, (p, s) in enumerate(zip(pages, sources, strict=True)):
        want = p
        if p is not None:
            kept = [x for x in p.split("\n") if not x.strip(" \t\r") or not (count[s, x] - 1 > 0.3 * total[s] + (0.3 * 0.7 * total[s]) ** 0.5)]
            want = "\n".join(kept)
        assert got[i].text == want
        assert want is None or got[i].n_chars == len(want)


def test_boilerplate_of_small_hosts(spark):
    """A host of few pages has boilerplate too, and a line of its only page is none."""
    pages, sources = [], []
    for host, n, share in (("one", 1, 1), ("two", 2, 2), ("three", 3, 3), ("nine", 9, 3), ("ninth", 9, 4), ("hundred", 100, 12), ("more", 100, 13)):
        pages += [f"{'menu' if i < share else 'none'}\nown {host} {i}" for i in range(n)]
        sources += [host] * n
    got = line_dedup.remove_boilerplate(documents(spark, pages, sources=sources)).collect()
    assert {r.source for r in got if r._ld_dropped and "menu" not in r.text and pages[r.doc_id].startswith("menu")} == {"three", "ninth", "more"}


def brute_components(texts, ids, size, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = SPACE.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("large", "huge", "small"), [(2048, 16, 500_000), (3, 16, 0), (3, 1, 0)])
def test_minhash(spark, texts, large, huge, small, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "HUGE", huge)
    monkeypatch.setattr(minhash, "SMALL_LINKS", small)
    rng = random.Random(9)
    base = prose(rng, 150).split()
    chain = []
    for k in range(12):  # each like the one before it, the ends unlike
        base = [w if rng.random() > 0.04 else f"w{k}{j}" for j, w in enumerate(base)]
        chain.append(" ".join(base))
    all_ = texts + chain
    for size in (2, 5):
        want = brute_components(all_, list(range(len(all_))), size, 80)
        got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, all_), size).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize(("large", "shingles", "huge"), [(25, 1 << 21, 16), (25, 1 << 21, 1), (1000, 20_000, 16)])
def test_minhash_groups_are_bounded(spark, large, shingles, huge, monkeypatch):
    """Pages of one template share buckets without being links; some pairs among them are links."""
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "LARGE_SHINGLES", shingles)
    monkeypatch.setattr(minhash, "HUGE", huge)
    rng = random.Random(12)
    template = [f"t{i}" for i in range(100)]
    pages = [template + [f"u{k}x{i}" for i in range(30)] for k in range(400)]
    for k in range(0, 60, 3):  # the second and third of these are alike, and neither is like the first
        pages[k + 2] = pages[k + 1][:-3] + [f"v{k}x{i}" for i in range(3)]
    rng.shuffle(pages)
    docs = documents(spark, [" ".join(p) for p in pages])
    reps = minhash.sketches(docs, 2, 80).select(F.col("doc_id").alias("node"), "n_shingles", "sig", "keys").cache()
    buckets = minhash.star_buckets(reps)
    assert buckets.agg(F.max("n")).head()[0] >= min(10 * large, 250)
    groups = minhash.open_groups(buckets, reps, spark.createDataFrame([], "node long, component long")).join(reps, "node").groupBy("g")
    most = groups.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).agg(F.max("n"), F.max("w")).head()
    assert most[0] <= large and most[1] <= shingles
    want = brute_components([" ".join(p) for p in pages], list(range(400)), 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) == 380


@pytest.mark.parametrize(("large", "huge"), [(2048, 16), (40, 1), (3, 1), (2, 1)])
def test_minhash_links_of_a_star_do_not_depend_on_its_size(spark, large, huge, monkeypatch):
    """All texts share one bucket and no other, as a linked pair may; a star above HUGE * LARGE nodes tells the same links."""
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "HUGE", huge)
    whole = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda *a: whole(*a).withColumn("keys", F.when(F.col("n_shingles") > 0, F.array(F.lit(7).cast("long")))))
    rng = random.Random(17)
    template = [f"t{i}" for i in range(100)]
    texts = [template[: rng.randint(80, 100)] + [f"u{k}x{i}" for i in range(rng.randint(8, 45))] for k in range(90)]
    for k in range(0, 60, 3):  # near the threshold, from either side
        texts[k + 2] = texts[k + 1][: -(k // 3)] + [f"v{k}x{i}" for i in range(rng.randint(0, 4))]
    texts += [["one"], ["one", "two"], ["one", "two", "three"], [f"s{i}" for i in range(6)], [f"s{i}" for i in range(5)], template, template]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    want = brute_components(texts, list(range(len(texts))), 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == want and 30 < len({c for _, c in want.values()}) < 95


def test_shared_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-50, 50, n)) for n in (1, 3, 40, 80, 200)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets[1:]]
    assert minhash.shared_counts(sets[1:], sets, 7).tolist() == want


@pytest.mark.parametrize("percent", [30, 50, 90, 100])
def test_minhash_thresholds(spark, percent):
    rng = random.Random(percent)
    base = [prose(rng, 60, [f"w{i}" for i in range(400)]).split() for _ in range(15)]
    texts = [" ".join(w if rng.random() > change else f"x{rng.random()}" for w in b) for b in base for change in (0, 0.02, 0.1, 0.2, 0.3)]
    want = brute_components(texts, list(range(len(texts))), 2, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts), 2, percent).collect()}
    assert got == want
    assert (1 - (percent / 100) ** minhash.rows_a_band(percent)) ** (minhash.BINS // minhash.rows_a_band(percent)) <= minhash.MISS
    with pytest.raises(ValueError, match="percent"):
        minhash.rows_a_band(5)


def test_minhash_ids(spark):
    got = minhash.near_duplicates(documents(spark, ["a b c", "a b c", "a b c", "x y"], ids=[5, 5, None, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 7, True)]
    kept = minhash.one_of_each(documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], ids=[5, 5, 9, 11]), 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 11] and kept.columns == documents(spark, []).columns


@pytest.mark.parametrize("small", [500_000, 0])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_LINKS", small)
    rng = random.Random(3)
    links = [(i + 1, i) for i in range(40)] + [(100, 102), (101, 102)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
    low = {x: x for e in links for x in e}
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    linked = {x for a, b in links for x in (a, b) if a != b}
    assert {x: got[x] for x in linked} == {x: low[x] for x in linked}


def test_language_id(spark):
    rng = random.Random(2)
    vocab = {"aa": ["the", "and", "ing", "tion", "ther"], "bb": ["\u00fcber", "und", "schen", "ver", "keit"]}
    langs = [rng.choice(["aa", "bb"]) for _ in range(80)]
    rows = [prose(rng, 40, vocab[x]) for x in langs]
    docs = documents(spark, [*rows, None, "", "12 3!", "the"], [*langs, "aa", None, "bb", None])
    known = langid.profiles(docs, ~common.held_out())
    brute = collections.Counter()
    for i, (t, x) in enumerate(zip(rows, langs, strict=True)):
        if x == "aa" and zlib.crc32(str(i).encode()) % 4 != 2:
            u = re.sub(r"[^a-z\u00e0-\u00ff]+", " ", t.lower())
            brute.update(g for n in (1, 2, 3) for k in range(len(u) - n + 1) if (g := u[k : k + n]) != " ")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    assert known["aa"] == [c for c, _ in sorted(((code(g), n) for g, n in brute.items()), key=lambda x: (-x[1], x[0]))][: langid.PROFILE]
    got = {r.doc_id: r for r in langid.identify(docs, known).collect()}
    assert all(got[i]._lang_pred == x and 0 <= got[i]._lang_score <= 1 for i, x in enumerate(langs))
    assert [got[i]._lang_pred for i in (80, 81, 82, 83)] == ["und", "und", "und", "aa"]


def test_language_distance_by_definition(spark):
    """Predictions and scores against a plain rank-order comparison, with ties and repeated rows."""
    rng = random.Random(31)
    vocab = {"aa": ["the", "and", "ing", "tion"], "bb": ["und", "schen", "ver"], "cc": ["les", "aux", "tre"]}
    train = [(prose(rng, 30, vocab[x]), x) for x in ("aa", "bb", "cc") for _ in range(8)] * 2
    tests = [prose(rng, rng.randint(1, 40), vocab[rng.choice(["aa", "bb", "cc"])]) for _ in range(30)] + ["a", "zz", "Q1 q", prose(rng, 40_000, vocab["bb"]), "the und les"]
    known = langid.profiles(documents(spark, [t for t, _ in train], [x for _, x in train]), F.lit(True))

    def ranking(texts):
        found = collections.Counter()
        for t in texts:
            u = "".join(c.lower() if c.isalpha() else " " for c in t)
            u = re.sub(" +", " ", u)
            found.update(g for n in (1, 2, 3) for k in range(len(u) - n + 1) if (g := u[k : k + n]) != " ")
        code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
        return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], code(x[0])))][: langid.PROFILE]

    profiles = {x: {g: k for k, g in enumerate(ranking([t for t, y in train if y == x]))} for x in vocab}
    got = {r.doc_id: r for r in langid.identify(documents(spark, tests), known).collect()}
    for i, t in enumerate(tests):
        own = ranking([t])
        cost = {x: sum(min(abs(p[g] - k), langid.PROFILE) if g in p else langid.PROFILE for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[i]._lang_pred == best, (t[:40], cost)
        assert got[i]._lang_score == pytest.approx(1 - cost[best] / (langid.PROFILE * len(own)))


def test_quality_counts(spark, texts):
    more = ["a b c a b c a b c", "x\nx\n \n\nx y\nx", "# $ * | <>", "a a a a", "one two three", "a b c x a b c"]
    all_ = texts + more
    got = {r.doc_id: r for r in quality.judged(documents(spark, all_)).collect()}
    for i, t in enumerate(all_):
        w = SPACE.findall(t or "")
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def test_quality_outliers(spark):
    rng = random.Random(4)
    clean = [prose(rng, rng.randint(80, 300)) for _ in range(150)]
    junk = [" ".join(w + "%%%" for w in prose(rng, 120).split()) for _ in range(30)]
    few = [prose(rng, rng.randint(80, 300)) for _ in range(5)] + [" ".join(w + "%%%" for w in prose(rng, 120).split())]
    sources = ["s"] * 180 + ["small"] * 6
    got = {r.doc_id: r for r in quality.judged(documents(spark, clean + junk + few, sources=sources)).collect()}
    assert not any(got[i].kept for i in range(150, 180)) and sum(got[i].kept for i in range(150)) >= 149
    # a group of a few documents is judged too, by its language
    assert all(r.base_failed or r.distance is not None for r in got.values())
    assert [got[i].kept for i in range(180, 186)] == [True] * 5 + [False]
    alone = quality.judged(documents(spark, clean[:1])).collect()
    assert [r.kept for r in alone] == [True]


def stat_rows(spark, groups):
    rows = [(1000 * g + i, g, g % 2, *map(float, r)) for g, x in groups.items() for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id long, grp long, tongue long, " + ", ".join(f"{n} double" for n in quality.FLOORS)).cache()


def test_cholesky_distance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * 3
    rows = stat_rows(spark, {1: x})
    params = quality.with_cholesky(quality.moments(rows.withColumn("start", F.lit(0)), "1.0D"), 1.0)
    got = np.array([r.d2 for r in quality.distances(rows, params, True).collect()])
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
    want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    assert np.allclose(np.sort(got), np.sort(want), rtol=1e-6)
    assert params.head().log_det == pytest.approx(np.linalg.slogdet(cov)[1])


def test_chi_square():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400_000, 5)) ** 2).sum(axis=1)
    for q in (1.0, 5.0, 9.0):
        assert quality.chi_square_beyond(q, 5) == pytest.approx((x > q).mean(), abs=0.004)
    assert quality.chi_square_quantile(0.05, 5) == pytest.approx(11.0705, abs=1e-4) and quality.chi_square_quantile(0.05, 7) == pytest.approx(14.0671, abs=1e-4)


def test_shrinkage(spark):
    rng = np.random.default_rng(2)
    groups = {g: rng.normal(size=(n, 5)) + g for g, n in ((0, 300), (2, 8), (1, 40), (3, 1))}
    own = quality.moments(stat_rows(spark, groups).withColumn("start", F.lit(0)), "1.0D").cache()
    got = {r.grp: r for r in quality.shrunk(own, True).collect()}
    k = quality.SHRINKAGE

    def both(x):
        return len(x), x.mean(axis=0), np.cov(x.T, bias=True) if len(x) > 1 else np.zeros((5, 5))

    def drawn(a, b):
        return [(a[0] * u + k * v) / (a[0] + k) for u, v in zip(a[1:], b[1:], strict=True)]

    every = both(np.concatenate(list(groups.values())))
    for g, x in groups.items():
        tongue = both(np.concatenate([y for h, y in groups.items() if h % 2 == g % 2]))
        mean, cov = drawn(both(x), (None, *drawn(tongue, every)))
        assert np.allclose([got[g][f"m_{i}"] for i in range(5)], mean)
        assert np.allclose([got[g][f"c_{i}_{j}"] for i in range(5) for j in range(i + 1)], [cov[i, j] for i in range(5) for j in range(i + 1)])


def test_minimum_covariance_determinant(spark, monkeypatch):
    """The estimate of contaminated groups against the smallest determinant of many plain concentrations, and against all rows'."""
    monkeypatch.setattr(quality, "SHRINKAGE", 0.0)
    rng = np.random.default_rng(3)
    groups = {}
    for g in (0, 1):
        clean = rng.normal(size=(400, 5)) @ np.diag([2.0, 1.5, 3.0, 1.0, 1.2]) + 5
        groups[g] = np.concatenate([clean, rng.normal(size=(90, 5)) * 0.3 + [30, 5, 5, -20, 5]])
    rows = stat_rows(spark, groups)
    params, few = quality.estimates(rows)
    got = {r.grp: r for r in params.collect()}
    further = quality.with_cholesky(quality.shrunk(common.checkpointed(quality.concentrated(rows, params, few)), few), quality.CONSISTENCY)
    assert all(got[r.grp].log_det - r.log_det <= quality.CONVERGED for r in further.collect())  # no group would move on
    for g, x in groups.items():
        h = int(quality.CORE * len(x))
        best = np.inf
        for _ in range(60):
            core = rng.choice(len(x), 12, replace=False)
            for _ in range(30):
                mean, cov = x[core].mean(axis=0), np.cov(x[core].T, bias=True) + 1e-9 * np.eye(5)
                core = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))[:h]
            best = min(best, np.linalg.slogdet(np.cov(x[core].T, bias=True) * quality.CONSISTENCY)[1])
        assert got[g].log_det <= best + 0.15
        assert np.allclose([got[g][f"m_{i}"] for i in range(5)], x[:400].mean(axis=0), atol=0.5)


def test_bpe(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    codec = bpe.codec(path, public.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(7)
    pool = ["a", "b", " ", "\n", "\t", "\x1c", "\u00e9", "\u65e5\u672c", "\U0001f600", "1", "'s", "ing", "the", "!!", "\u0301", "aaaa", "    ", "<|endoftext|>"]
    all_ = texts + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for r in bpe.round_trip(documents(spark, all_), path, public.PATTERN).collect():
        t = all_[r.doc_id] or ""
        assert r.decoded == t.encode() and r.ids == np.array(library.encode_ordinary(t), "<u4").tobytes()


def test_toxicity(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfghjklmn" for b in ("ala", "ene", "oro", "umu")]
    texts, toxic = [], []
    for i in range(600):
        w = prose(rng, rng.randint(20, 60), words).split()
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "vileness", "scumbag"]))
        texts.append(" ".join(w))
        toxic.append(int(i % 3 == 0))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality long, toxic long")
    model = toxicity.train(docs, labels, ~common.held_out())
    got = {r.doc_id: r._tox_score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(toxic[i]) for i in held) / len(held)
    assert right >= 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == 602


def test_toxicity_forward_pass_and_gradient():
    """Scores against plain loops, and the direction of a training step against numeric differences."""
    rng = np.random.default_rng(7)
    kept = np.arange(5, 45, dtype=np.int32)
    n = 1 + len(toxicity.PREFIXES)
    model = toxicity.Model(
        kept, rng.normal(size=(len(kept) + 2, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.3, 0.5,
    )
    model.embed[toxicity.PAD] = 0
    docs = [rng.integers(0, 42, (k, n)).astype(np.int32) for k in (0, 1, 2, 3, 17)]
    want = []
    for d in docs:
        rows = np.vstack([d, np.zeros((max(toxicity.WIDTHS) - 1 + (len(d) == 0), n), np.int32)])
        x = model.embed[rows].sum(axis=1)
        pooled = []
        for w, b in zip(model.conv, model.bias, strict=True):
            windows = [sum(x[i + k] @ w[k] for k in range(len(w))) + b for i in range(len(rows) - len(w) + 1)]
            pooled.append(np.max(windows, axis=0))
        want.append(np.maximum(np.concatenate(pooled), 0) @ model.out + model.out_bias)
    assert np.allclose(model.logits(docs), want, rtol=1e-3, atol=1e-3)
    assert np.allclose(model.logits(docs[3:]), want[3:], rtol=1e-3, atol=1e-3)
    y = np.array([1, 0, 1, 0, 1], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-model.logits(docs)))
        return float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())

    before = loss()
    toxicity._train(model, docs, y, np.random.default_rng(1), 60)
    assert loss() < 0.5 * before


def test_toxicity_threshold_is_the_best_f1():
    rng = np.random.default_rng(8)
    for _ in range(20):
        p, y, w = rng.random(40).round(1), (rng.random(40) < 0.4).astype(float), np.where(rng.random(40) < 0.5, 1.0, 3.0)
        if not y.sum():
            continue
        f1 = lambda t: 2 * (w * y * (p >= t)).sum() / ((w * (p >= t)).sum() + (w * y).sum())
        assert f1(toxicity._threshold(p, y, w)) == pytest.approx(max(f1(t) for t in p))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 5)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 6)
    monkeypatch.setattr(toxicity, "MAX_BYTES", 60)
    docs = documents(spark, ["x" * (12 if i else 100) for i in range(40)] + [None])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(41)] + [(3, 1, 1), (None, 1, 1), (5, 1, None), (7, 1, 9)], "doc_id long, quality long, toxic long")
    rows, weight = toxicity.sampled(docs, labels, F.lit(True))
    got = rows.collect()
    for kind, most in ((0, 5), (1, 5)):
        own = [r for r in got if r.toxic == kind]
        assert 0 < len(own) <= most and sum(len(r.text) for r in own) <= 60
    assert weight == pytest.approx((21 / 6) / (21 / 5))


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _lang_pred string, _Tox_Score double, _ld_own int, _ld_bad string, gone int"


def test_very_long_repeated_and_clashing_rows(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    long = prose(random.Random(2), 150_000)
    rows = [(i, t, "aa" if i % 2 else "bb", "s", 1, "p", 0.5, i, "b", 1) for i, t in enumerate([*ODD, long, long, texts[20], texts[20]])]
    docs = spark.createDataFrame(rows + rows[-2:], CLASH)
    found = langid.identify(docs, langid.profiles(docs, F.lit(True)))
    assert found.count() == 14 and found.columns[:-2] == docs.columns and len({r[-2:] for r in found.filter("doc_id in (8, 9)").collect()}) == 1
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality long, toxic long")
    scored = toxicity.score(docs, toxicity.train(docs, labels, F.lit(True)))
    assert scored.columns[:-1] == docs.columns and scored.count() == 14
    assert len({round(r[-1], 9) for r in scored.filter("doc_id in (8, 9)").collect()}) == 1  # equal texts have equal scores
    cleaned = line_dedup.remove_boilerplate(docs, ratio=0.1, min_pages=2)
    assert cleaned.columns[:-1] == docs.columns and cleaned.count() == 14
    assert minhash.one_of_each(docs, 5, 80).columns == docs.columns
    judged = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert judged[8].n_words == 150_000 and judged[8].kept == judged[9].kept
    coded = bpe.round_trip(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).filter("doc_id >= 8").collect()
    assert all(r.decoded.decode() == rows[r.doc_id][1] for r in coded) and len(coded) == 6
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_turns(talk)).head()
    assert (r.n_turns, r.loss_chars) == (3, 2 * len(long))


def test_empty_conversations_and_codec(spark):
    public = pytest.importorskip("public_tokenizers")
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, piece string")
    assert chat.read_back(chat.format_turns(none)).count() == 0 and chat.expand(chat.format_turns(none)).count() == 0
    assert bpe.round_trip(documents(spark, []), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0


def test_toxicity_with_labels_in_one_fold_only():
    """Where the calibrating fifth has all toxic ones it trains too; where it has none, all of the sample calibrates."""
    rng = random.Random(31)
    texts = [prose(rng, 20, ["calm", "nice", "kind"] if i % 4 else ["vile", "foul"]) for i in range(40)]
    at, data = common.buffers(pa.array(texts))
    docs, y = toxicity.buckets(at, data), np.array([int(i % 4 == 0) for i in range(40)])
    for folds in (np.where(y == 1, 0, 1), np.where(y == 1, 1, 0), np.ones(40, int)):
        model = toxicity.fit(docs, y, [None] * 40, folds)
        table = model.table()
        p = np.array(model.scores([model.numbered(d, table) for d in docs]))
        assert p[y == 1].min() > toxicity.THRESHOLD > p[y == 0].max()


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b", "c d"])
    model = toxicity.train(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality long, toxic long"), F.lit(True))
    assert [r._tox_score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
