"""Removal of repeated byte strings by column-wise Burrows-Wheeler construction (operator 13).

A byte is removed when some string of LENGTH bytes that covers it also starts elsewhere, in the same
or another document.  The method builds, for a collection of strings, the order of all suffixes and their
common prefixes without a suffix array: each round inserts one symbol of every string, from the last column
to the first; the symbols in the order of the round before are that column of the Burrows-Wheeler transform, a
stable distribution by them is the new order, and running minima give the new common prefixes.
A round reads the round before from front to back and writes its own, as with files that are only read and
written in sequence; a collection is bounded, so those files are arrays, and nothing is written to local disk.
What is external is Spark's: the strings of a collection come in sorted order from a shuffle.

Collections: of the LENGTH - K + 1 K-mers in a window of LENGTH bytes the one with the smallest hash (the first
of equals) is its anchor.  Equal windows have equal anchors at equal places.  So a text is cut into segments,
the runs of windows with one anchor, and only segments with the same anchor can share a window.  They form one
collection, aligned at the anchor: windows that are equal begin in the same column, so a column is ordered by
itself, not merged into those after it.  Equal segments are one string with a count.  An anchor that occurs
once holds no repeat and is not built.  An anchor with more than MAX_STRINGS distinct segments is cut further:
each of its distinct windows is a collection of one string, whose count tells.

Segments are identified by two hashes of 64 bits (anchor, segment), texts by MD5; whether different segments
share a window is read from their bytes.  What is shuffled: identities (some 40 bytes for 170 of text), the texts
once or twice, and the bytes of one segment of each kind whose anchor repeats.

Defined results: a null or empty text has no bytes; texts under LENGTH bytes are kept whole; repeated rows are
documents of their own, so copies of LENGTH bytes or more lose everything; null ids pass through; very long texts
are worked on in pieces that overlap by LENGTH - 1 bytes; extra columns are ignored, an empty table gives no rows.
Cuts fall on bytes, so what stays is given as bytes (kept) and as text without the characters that a cut splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

LENGTH, K = 400, 64
#: K-mers of a window, which is the largest number of windows with one anchor.
WIDTH = LENGTH - K + 1
#: Columns of an aligned collection; windows begin in the first WIDTH.
COLUMNS = WIDTH - 1 + LENGTH
#: Strings that are built together (collections are not parted), and the largest collection.
STRINGS, MAX_STRINGS = 8192, 32_768
#: Bytes of a long text that are cut into segments at a time.
PIECE = 1 << 19
#: No byte of UTF-8 text; fills the columns that a string does not have.
ABSENT = 0xFF

_SEGMENTS = "key binary, anchor long, segment long, start long, windows int, lead int"
_STRINGS = "anchor long, segment long, n long, windows int, lead int, bytes binary"
_REPEATS = "anchor long, segment long, first int, last int"
_WINDOWS = "window long, anchor long, segment long, place int, n long"
SCHEMA = "doc_id long, n_bytes long, kept binary, text string, spans array<struct<a: long, b: long>>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours, by doubling."""
    have, out = 1, v
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def segments(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text's number, first window (in `data`), windows, place of the anchor in it, hash of the anchor."""
    base, end = int(offsets[0]), int(offsets[-1])
    part = data[base:end]
    n = len(part)
    if n < LENGTH:
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    sums = common.prefix_hashes(part)
    _, down = common.powers(n + 1)
    mer = common.mix64((sums[K:] - sums[:-K]) * down[: n - K + 1])
    least = _least(mer, WIDTH)
    m = len(least)
    at = offsets - base
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:m]
    whole = np.arange(m) + LENGTH <= at[owner + 1]
    new = np.ones(m, bool)
    new[1:] = (least[1:] != least[:-1]) | (mer[: m - 1] == least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(new | ~whole)
    stop = np.append(stop, m)[np.searchsorted(stop, first, "right")]
    lead = np.zeros(len(first), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(mer, WIDTH)
    for i in range(0, len(first), 4096):
        lead[i : i + 4096] = view[first[i : i + 4096]].argmin(axis=1)
    return owner[first], first + base, stop - first, lead, mer[first + lead]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of texts (number of the first, their offsets); a text over PIECE bytes in pieces of its own."""
    for a, b in common.blocks(offsets, PIECE):
        if b - a > 1 or offsets[b] - offsets[a] <= 2 * PIECE:
            yield a, offsets[a : b + 1]
        else:
            for at in range(int(offsets[a]), int(offsets[b]) - LENGTH + 1, PIECE):
                yield a, np.array([at, min(at + PIECE + LENGTH - 1, int(offsets[b]))], np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = common.buffers(batch.column("text"))
        keys, raw = batch.column("key"), memoryview(data)
        for row, at in _pieces(offsets):
            owner, first, windows, lead, anchor = segments(at, data)
            owner += row
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(owner)), pa.array(anchor.view(np.int64)),
                    pa.array(np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + windows + LENGTH - 1).tolist(), strict=True)), np.uint64, len(first)).view(np.int64)),
                    pa.array(first - offsets[owner]), pa.array(windows.astype(np.int32)), pa.array(lead.astype(np.int32)),
                ],
                names=["key", "anchor", "segment", "start", "windows", "lead"],
            )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[dict]]]:
    """Texts and their wanted segments; of neighbours with equal texts one (others are dropped where they meet)."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > 100_000:
            seen.clear()
        for i, key in enumerate(batch.column("key").to_pylist()):
            if key not in seen:
                seen.add(key)
                yield batch.column("text")[i].as_py().encode("utf-8", "surrogatepass"), batch.column("wanted")[i].as_py()


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "segment", "n", "windows", "lead"]
    for text, wanted in _listed(batches):
        for i in range(0, len(wanted), 4096):
            part = wanted[i : i + 4096]
            columns = [[w[c] for w in part] for c in names]
            columns.append([text[w["start"] : w["start"] + w["windows"] + LENGTH - 1] for w in part])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*names, "bytes"])


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for text, wanted in _listed(batches):
        for w in wanted:
            n, raw = w["windows"], memoryview(text)
            seed = w["anchor"] & (2**64 - 1)
            # a window's hash holds its anchor and the anchor's place
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + LENGTH], (seed + w["lead"] - s + w["start"]) & (2**64 - 1)) for s in range(w["start"], w["start"] + n)), np.uint64, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes.view(np.int64)), pa.array(np.full(n, w["anchor"], np.int64)), pa.array(np.full(n, w["segment"], np.int64)),
                    pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, w["n"], np.int64)),
                ],
                names=["window", "anchor", "segment", "place", "n"],
            )


def aligned(strings: list[bytes], leads: np.ndarray) -> np.ndarray:
    """One row a column, one column a string: anchors meet in row WIDTH - 1."""
    out = np.full((len(strings), COLUMNS), ABSENT, np.uint8)
    for i, (s, lead) in enumerate(zip(strings, leads.tolist(), strict=True)):
        out[i, WIDTH - 1 - lead : WIDTH - 1 - lead + len(s)] = np.frombuffer(s, np.uint8)
    return np.ascontiguousarray(out.T)


def rounds(columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Column by column from the last: its place, symbols in the order of the round before (its part of the transform),
    the strings ordered by what begins here, and how many columns each shares with the one before it."""
    width, n = columns.shape
    order, until = np.arange(n), np.full(n, width, np.int16)
    until[:1] = 0
    for c in range(width - 1, -1, -1):
        transform = columns[c][order]
        moved = np.argsort(transform, kind="stable")
        symbols = transform[moved]
        after = until[moved]
        after[0] = c
        other = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        after[other] = c
        low, high = moved[:-1] + 1, moved[1:]
        apart = np.flatnonzero((high > low) & (symbols[1:] == symbols[:-1]))  # others of their symbol have no strings between
        if len(apart):
            low, high = low[apart], high[apart]
            level = (np.frexp((high - low + 1).astype(np.float64))[1] - 1).astype(np.int64)
            table = [until]
            for k in range(int(level.max())):
                table.append(np.minimum(table[k][: -(1 << k)], table[k][1 << k :]))
            least = np.empty(len(apart), np.int16)
            for k in np.unique(level).tolist():
                one = level == k
                least[one] = np.minimum(table[k][low[one]], table[k][high[one] - (1 << k) + 1])
            after[apart + 1] = least
        order, until = order[moved], after
        yield c, transform, order, until - np.int16(c)


def repeated(strings: list[bytes], counts: np.ndarray, windows: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the windows that occur more than once: string's number, first and last window."""
    n = len(strings)
    hit = np.zeros((WIDTH + 1, n + 1), np.int8)
    for c, _, order, shared in rounds(aligned(strings, leads)):
        if c < WIDTH:
            same = shared >= LENGTH
            same[:-1] |= same[1:]
            hit[c, order[same]] = 1
    hit[:-1, :-1] |= (counts > 1).astype(np.int8)
    place = np.arange(WIDTH)[:, None] - (WIDTH - 1 - leads)
    hit[:-1, :-1] &= (place >= 0) & (place < windows)
    flat = hit.T  # a string after the other, each with a column of zeros behind
    edge = np.diff(flat, axis=1, prepend=0)
    owner, first = np.nonzero(edge[:-1] == 1)
    _, stop = np.nonzero(edge[:-1] == -1)
    shift = WIDTH - 1 - leads[owner]
    return owner, first - shift, stop - 1 - shift


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and segment; equal segments that come twice are one."""
    held: list[tuple] = []

    def done() -> Iterator[pa.RecordBatch]:
        anchor, segment, n, windows, lead, strings = zip(*held, strict=True)
        owner, first, last = repeated(list(strings), np.array(n), np.array(windows), np.array(lead))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(anchor, np.int64)[owner]), pa.array(np.array(segment, np.int64)[owner]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
            names=["anchor", "segment", "first", "last"],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "n", "windows", "lead", "bytes")), strict=True):
            if held and held[-1][:2] == row[:2]:
                continue
            if len(held) >= STRINGS and held[-1][0] != row[0]:
                yield from done()
                held = []
            held.append(row)
    if held:
        yield from done()


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, kept, texts, spans = [], [], [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            raw = (batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            pieces = [raw[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(raw)], strict=True)]
            sizes.append(len(raw))
            kept.append(b"".join(pieces))
            texts.append("".join(p.decode("utf-8", "ignore") for p in pieces))  # by piece: bytes that meet at a cut are no character
            spans.append([{"a": a, "b": b} for a, b in runs])
        columns = [pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(spans, _SPANS)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "kept", "text", "spans"])


def repeats(texts: DataFrame, max_strings: int = MAX_STRINGS) -> DataFrame:
    """key, ranges (array of a, b: bytes from a to before b): what `texts` (key, text) repeat; texts without repeats have no row."""
    spark = texts.sparkSession
    cut = common.written(common.in_batches(texts, _cut, _SEGMENTS))
    kinds = cut.groupBy("anchor", "segment").agg(F.count("*").alias("n"))
    anchors = kinds.groupBy(F.col("anchor").alias("of")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1").select("of", "kinds")
    twice = kinds.join(anchors, F.col("anchor") == F.col("of")).select("anchor", "segment", "n", "kinds")
    found = common.written(cut.join(twice, ["anchor", "segment"]).dropDuplicates(["key", "start"]).select("key", "start", "windows", "lead", "anchor", "segment", "n", "kinds"))
    common.removed(cut)

    of_key = F.struct("start", "windows", "lead", "n")
    one = found.groupBy("anchor", "segment", "kinds").agg(F.min(F.struct("key", of_key.alias("w"))).alias("m"))
    one = one.select(F.col("m.key").alias("key"), "kinds", F.struct("m.w.start", "m.w.windows", "m.w.lead", "m.w.n", "anchor", "segment").alias("w"))

    def spelled(which, work, schema) -> DataFrame:
        lists = one.filter(which).groupBy("key").agg(F.collect_list("w").alias("wanted"))
        return common.in_batches(texts.join(lists, "key").select("key", "text", "wanted"), work, schema)

    strings = spelled(F.col("kinds") <= max_strings, _spelled, _STRINGS)
    dealt = strings.repartition(common.shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor", "segment")
    runs = common.in_batches(dealt, _built, _REPEATS)
    each = None
    if not found.filter(F.col("kinds") > max_strings).isEmpty():
        each = spelled(F.col("kinds") > max_strings, _each_window, _WINDOWS).dropDuplicates(["anchor", "segment", "place"])
        each = common.written(each)
        often = each.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1").select("window")
        runs = runs.unionByName(each.join(often, "window").select("anchor", "segment", F.col("place").alias("first"), F.col("place").alias("last")))
    runs = common.checkpointed(runs)
    if each is not None:
        common.removed(each)
    ranges = found.join(runs, ["anchor", "segment"]).select("key", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + LENGTH).alias("b"))
    return ranges.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def without_repeats(docs: DataFrame, max_strings: int = MAX_STRINGS) -> DataFrame:
    """One row a document: n_bytes before, kept (the bytes that stay), text (their characters; one that a cut splits is left out)
    and spans (the removed runs, in order: bytes from a to before b)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    keyed = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    found = repeats(keyed.select("key", "text"), max_strings)
    return common.in_batches(keyed.join(found, "key", "left").select("doc_id", "text", "ranges"), _without, SCHEMA)


def _digests() -> list[Column]:
    removed, spans = F.col("n_bytes") - F.octet_length("kept"), F.size("spans").cast("long")
    return [F.col("doc_id"), F.col("n_bytes"), removed.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def remove_repeats(docs: DataFrame, max_strings: int = MAX_STRINGS) -> DataFrame:
    """One row a document: bytes, removed bytes and runs, and the SHA-256 of what stays."""
    return without_repeats(docs, max_strings).select(*_digests())


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, then the text that stays and the removed runs."""
    return without_repeats(common.read_documents(spark, sf_dir)).select(*_digests(), "text", "spans")
