"""Operator 13 against counting every window, and its rounds against sorted suffixes."""

import collections
import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, anchor long, key string, ranges int"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, 1, "k", 2) for i, t in enumerate(texts)], SCHEMA)


def counted(texts):
    raw = [(t or "").encode() for t in texts]
    found = collections.Counter(b[i : i + sd.LENGTH] for b in raw for i in range(len(b) - sd.LENGTH + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - sd.LENGTH + 1):
            if found[b[i : i + sd.LENGTH]] > 1:
                gone[i : i + sd.LENGTH] = b"\1" * sd.LENGTH
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return "".join(rng.choice("abcdefgh é日") for _ in range(n))


def odd_texts():
    rng = random.Random(3)
    passage, exact, short = prose(rng, 700), "x" + "".join(rng.choice("abc") for _ in range(398)) + "y", "".join(rng.choice("abc") for _ in range(399))
    own = [prose(rng, rng.randint(0, 900)) for _ in range(30)]
    twice = prose(rng, 150) + passage + prose(rng, 30) + passage[:450]
    return [
        None, "", "a", "same", "same", *own, *own[:4], own[5] + "!", "!" + own[5], prose(rng, 50) + passage + prose(rng, 60), passage, passage[3:], twice,
        "q" + exact, exact + "r", short + "1", "2" + short, "z" * 399, "z" * 400, "w" * 401, "v" * 3000, "menu of the site\n" * 90, "menu of the site\n" * 20 + "end",
        exact[:200] + "\x00" + exact[200:], "\x00" * 500, passage[:399] + "#" + passage[400:],
    ]


@pytest.mark.parametrize("most", [sd.MAX_STRINGS, 2, 0])
def test_against_every_window(spark, most):
    texts = odd_texts()
    got = {r.doc_id: tuple(r)[1:] for r in sd.remove_repeats(documents(spark, texts), most).collect()}
    assert [got[i] for i in range(len(texts))] == counted(texts)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1000)
    monkeypatch.setattr(sd, "STRINGS", 3)
    rng = random.Random(8)
    long = prose(rng, 9000)
    texts = [long, prose(rng, 2500) + long[2000:7100], prose(rng, 5000), long[:399]]
    at, data = np.array([0, len(long.encode())]), np.frombuffer(long.encode(), np.uint8)
    assert len(list(sd._pieces(at))) > 5
    cuts = [sd.segments(p, data) for _, p in sd._pieces(at)]
    assert sum(int(c[2].sum()) for c in cuts) == len(data) - sd.LENGTH + 1
    got = {r.doc_id: tuple(r)[1:] for r in sd.remove_repeats(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == counted(texts)


def test_no_rows_repeated_rows_and_null_ids(spark):
    assert sd.remove_repeats(documents(spark, [])).count() == 0
    text = "".join(random.Random(2).choice("abc") for _ in range(500))
    rows = sd.remove_repeats(documents(spark, [text, text, "short", "short"], [None, None, 7, 7])).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in rows) == [(0, 500, 1), (0, 500, 1), (7, 0, 0), (7, 0, 0)]


def test_segments_hold_every_window_once_and_windows_choose_their_anchor():
    rng = random.Random(4)
    texts = [prose(rng, n).encode() for n in (10, 399, 400, 2500, 401)] + [b"ab" * 700, b"c" * 450]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    owner, first, windows, lead, anchor = sd.segments(offsets, np.frombuffer(b"".join(texts), np.uint8))
    seen, of = collections.Counter(), {}
    for o, f, n, a, h in zip(owner.tolist(), first.tolist(), windows.tolist(), lead.tolist(), anchor.tolist(), strict=True):
        for i in range(n):
            seen[o, f - int(offsets[o]) + i] += 1
            window = texts[o][f - int(offsets[o]) + i :][: sd.LENGTH]
            assert 0 <= a - i < sd.WIDTH and of.setdefault(window, (h, a - i)) == (h, a - i)
    assert seen == {(o, i): 1 for o, t in enumerate(texts) for i in range(len(t) - sd.LENGTH + 1)}


def test_rounds_order_suffixes_and_share_prefixes():
    rng = np.random.default_rng(6)
    strings = [bytes(rng.integers(97, 99, sd.COLUMNS).tolist()) for _ in range(40)]
    strings += [strings[0][:500] + strings[1][500:], strings[3], strings[3]]
    columns = np.ascontiguousarray(np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), -1).T)
    before = np.arange(len(strings))
    for c, transform, order, shared in sd.rounds(columns):
        assert bytes(transform) == bytes(strings[i][c] for i in before)
        if c % 97 == 0:
            suffixes = [strings[i][c:] for i in order]
            assert suffixes == sorted(suffixes)
            for a, b, n in zip(suffixes, suffixes[1:], shared[1:].tolist(), strict=False):
                assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or a == b
        before = order


def test_text_and_spans_that_stay(spark):
    rng = random.Random(11)
    passage, few = [" ".join("".join(rng.choice("abcdefghij") for _ in range(k)) for _ in range(n)) for k, n in ((9, 60), (5, 55))]  # 599 and 329 bytes, both over 50 words
    clean = prose(rng, 500)
    accents = ["é" * 3 + passage, passage + "à" * 3]
    texts = [f"first {passage} end", f"{passage} second", f"third {few}", f"{few} fourth", clean, None, "", "日" + passage + "語", *accents, "本" + passage + "誤"]
    rows = {r.doc_id: r for r in sd.without_repeats(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, (size, removed, spans, digest) in enumerate(counted(texts)):
        row, raw = rows[i], (texts[i] or "").encode()
        at = [0, *(x for s in row.spans for x in s), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
        assert (row.n_bytes, sum(s.b - s.a for s in row.spans), len(row.spans)) == (size, removed, spans)
        assert bytes(row.kept) == kept and hashlib.sha256(kept).hexdigest() == digest
        assert passage not in row.text and row.text.encode() in (kept, kept.decode("utf-8", "ignore").encode())
    assert rows[0].text.startswith("first") and rows[0].text.endswith("end")
    assert all(rows[i].text == (texts[i] or "") and not rows[i].spans for i in (2, 3, 4, 5, 6))  # under 400 bytes, clean, empty


def test_a_character_split_by_a_cut_is_left_out(spark):
    rng = random.Random(12)
    body = "".join(rng.choice("abc") for _ in range(450))
    # é and ã share their first byte, é and ĩ their second: the repeated run ends and begins within characters
    texts = ["1é" + body + "é2", "3ĩ" + body + "ã4"]
    rows = {r.doc_id: r for r in sd.without_repeats(documents(spark, texts)).collect()}
    assert [rows[i].text for i in (0, 1)] == ["12", "34"] and [bytes(rows[i].kept) for i in (0, 1)] == [b"1\xc3\xa92", b"3\xc4\xa34"]


def test_query_gives_digests_then_text_and_spans(spark):
    got = sd.op13_suffix_array_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans"]
    for r in got.collect():
        assert r.n_removed == sum(s.b - s.a for s in r.spans) and r.n_spans == len(r.spans)
        assert 0 <= r.n_bytes - r.n_removed - len(r.text.encode()) <= 6 * r.n_spans
