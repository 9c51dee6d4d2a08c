"""Packing documents into token windows by non-negative least squares (operator 2).

Steps, none of which gathers documents on the driver:

1. Every document is tokenised once.  Its full windows are sequences of their
   own; what is left is its tail.
2. Tails are counted by length class (QUANTUM tokens a class): the histogram has
   WINDOW / QUANTUM entries however many documents and partitions there are.
3. The driver enumerates the combinations of at most DEPTH classes that fill a
   window exactly, solves for repeat counts that reproduce the histogram by
   non-negative least squares, and rounds them to counts that the histogram holds.
4. Tails that the rounded recipes leave over are packed greedily: laid end to end,
   token by token, from the longest class down, and cut where a window is full.
5. A tail's number within its class decides its recipe, place and sequence.  Numbers
   and running sums are taken within (class, salt), so that a class with most of the
   rows is numbered by many tasks, and carried over a table of one row a (class, salt).

Only rows of a few dozen bytes are shuffled.  Tails that step 4 cuts are tokenised
a second time to give their parts' ids; there is at most one for each window of
step 4.  Windows of recipes lack (QUANTUM - 1) / 2 tokens a piece in the mean, those of
step 4 lack none but the last.

Defined results: a null or empty text is the end-of-document id alone; repeated
rows are documents of their own; a null doc_id is kept; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common

WINDOW, QUANTUM, DEPTH = 4096, 16, 3
END_OF_DOCUMENT = 2
#: Strings kept in a worker's memo, and the longest one that is kept.
MEMO_SIZE, MEMO_CHARS = 400_000, 48
#: Cut tails up to this many are found again by a broadcast of their keys (24 bytes each).
BROADCAST_CUTS = 200_000


_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = "\\t-\\r\\x1c-\\x20\\x85\xa0"
#: The pretokens of a lower-cased text of Latin letters (below U+0250), as the tokenizer's own pattern finds them; the usual ones are tried first.
_PRETOKENS = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{_BLANK}{_LETTER}{_NUMBER}]+").findall
#: Texts with these take the tokenizer's own pattern: other scripts, its special tokens, and separators that are no white space there.
_FOREIGN = re.compile("[\\x1c-\\x1f\u0250-\U0010ffff]|<\\|").search
#: The same for texts below U+0100.
_MARKS = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Bytes that the vocabulary's tokens show as themselves; the others stand as characters from U+0100 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTES = [chr(b if b in _SHOWN else 0x100 + _HIDDEN.index(b)) for b in range(256)]
#: The same for each character below U+0250, which is all that plain texts have.
_SPELLED = {chr(c): "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0x250)}


class _Memo(dict):
    """Ids of words by `encode`, as little-endian 32-bit bytes; words up to MEMO_CHARS are remembered."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_CHARS:
            self[word] = raw
        return raw


class Ids:
    """Ids by the word-end BPE of a `tokenizers` file, as little-endian 32-bit bytes.

    That tokenizer lower-cases, drops white space and encodes each pretoken alone, so
    pretokens are encoded once, by the tokenizer's model, and remembered.  Texts beyond
    plain Latin are cut at blanks only, and what stands between is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.model.tokenize

        def pretoken(word: str) -> list[int]:
            if not (word.isascii() and word.isprintable()):
                word = "".join([_SPELLED[c] for c in word])
            return [t.id for t in tokens(word)]

        self.plain = _Memo(pretoken)
        self.foreign = _Memo(lambda words: self.tokenizer.encode(words, add_special_tokens=False).ids)

    def of(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for t in texts:
            try:
                t.encode("latin-1")
                foreign = any(m in t for m in _MARKS)
            except UnicodeEncodeError:  # some letters below U+0250 have small ones above
                foreign = _FOREIGN(t) is not None or _FOREIGN(t.lower()) is not None
            memo = self.foreign if foreign else self.plain
            if len(memo) > MEMO_SIZE:
                memo.clear()
            words = t.replace("\n", " ").replace("\t", " ").split(" ") if foreign else _PRETOKENS(t.lower())
            out.append(b"".join(map(memo.__getitem__, words)))
        return out


@lru_cache(maxsize=2)
def ids_by(path: str) -> Ids:
    return Ids(path)


_END = np.array([END_OF_DOCUMENT], "<u4").tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text (with it, the key of a document's ids), text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return rows.select("doc_id", F.xxhash64("text", F.crc32(F.col("text").cast("binary"))).alias("text_hash"), "text")


def measure(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, doc_tokens, and CRC-32 of each window's ids (the last is the tail's, if any)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = ids_by(path), 4 * window
        for batch in batches:
            at, _ = common.buffers(batch.column("text"))
            for a, b in common.blocks(at):
                part = batch.slice(a, b - a)
                ids = [x + _END for x in own.of(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "text_hash": part.column("text_hash"),
                    "doc_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "crcs": pa.array([[zlib.crc32(x[i : i + step]) for i in range(0, len(x), step)] for x in ids], pa.list_(pa.int64())),
                })

    return common.in_batches(keyed(docs), work, "doc_id long, text_hash long, doc_tokens long, crcs array<long>")


def piece_ids(docs: DataFrame, pieces: DataFrame, path: str, few: bool = False) -> DataFrame:
    """The pieces (doc_id, text_hash, start, length and others) with their ids (array of integers).

    few: the pieces' keys are known to be small enough to broadcast.
    """
    rows = keyed(docs)
    keys = pieces.select(F.col("doc_id").alias("k_doc"), F.col("text_hash").alias("k_hash")).distinct()
    same = rows.doc_id.eqNullSafe(F.col("k_doc")) & (rows.text_hash == F.col("k_hash"))
    wanted = rows.join(F.broadcast(keys) if few else keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids_by(path)
        for batch in batches:
            at, _ = common.buffers(batch.column("text"))
            for a, b in common.blocks(at):
                part = batch.slice(a, b - a)
                ids = [np.frombuffer(x + _END, "<u4").astype(np.int32) for x in own.of(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "k_doc": part.column("doc_id"), "k_hash": part.column("text_hash"),
                    "all_ids": pa.array(ids, pa.list_(pa.int32())),
                })

    coded = common.in_batches(wanted, work, "k_doc long, k_hash long, all_ids array<int>")
    same = pieces.doc_id.eqNullSafe(F.col("k_doc")) & (pieces.text_hash == F.col("k_hash"))
    found = pieces.join(coded, same).drop("k_doc", "k_hash")
    return found.withColumn("ids", F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))).drop("all_ids")


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets."""
    n = a.shape[1]
    right, ridge = a.T @ b, 1e-9  # the ridge keeps dependent columns solvable
    x, active = np.zeros(n), np.zeros(n, bool)
    limit = 1e-7 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(steps):
        gain = right - a.T @ (a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax()) if n else 0
        if not n or gain[best] <= limit:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.solve(a[:, on].T @ a[:, on] + ridge * np.eye(len(on)), right[on])
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            t = (x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)).min()
            x[on] += t * (z - x[on])
            gone = on[(x[on] <= 1e-12) & low]
            if not len(gone):
                gone = on[low]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def recipes(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of classes that fill a window, with repeat counts that the histogram covers.

    histogram[c]: tails of class c, 1 <= c <= len - 1; a window holds len - 1 units.
    """
    full = len(histogram) - 1
    have = np.flatnonzero(histogram[1:]) + 1
    combos = [
        c
        for a in have.tolist()
        for c in [(a,)] + [(a, b) for b in have[have <= a].tolist()] + ([(a, b, full - a - b) for b in have[have <= a].tolist()] if depth >= 3 else [])
        if sum(c) == full and c[-1] >= 1 and c == tuple(sorted(c, reverse=True)) and histogram[c[-1]] > 0
    ]
    if not combos:
        return []
    matrix = np.zeros((full + 1, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            matrix[k, j] += 1
    counts = nnls(matrix[have], histogram[have].astype(float))
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-counts, kind="stable"):
        need = matrix[:, j].astype(np.int64)
        on = need > 0
        n = min(int(round(counts[j])), int((left[on] // need[on]).min()))
        if n > 0:
            left -= n * need
            out.append((combos[j], n))
    return out


def _carried(table: DataFrame, sums: dict[str, str], bases: dict[int, dict[str, int]]) -> DataFrame:
    """class, salt and for each name of `sums` what stands before: that class's base and the column's sum over smaller salts.

    table: a row a (class, salt).
    """
    spark = table.sparkSession
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    names = list(sums)
    base = spark.createDataFrame([(c, *(b[n] for n in names)) for c, b in bases.items()] or [(-1, *(0 for _ in names))], "b_class int, " + ", ".join(f"b_{n} long" for n in names))
    # at most WINDOW / QUANTUM + 1 rows
    joined = table.join(F.broadcast(base), F.col("class") == F.col("b_class"))
    return joined.select(F.col("class").alias("c_class"), F.col("salt").alias("c_salt"), *[(F.coalesce(F.sum(col).over(before), F.lit(0)) + F.col(f"b_{n}")).alias(n) for n, col in sums.items()])


def pack(measured: DataFrame, window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH) -> tuple[DataFrame, int]:
    """Pieces (row_id, doc_id, text_hash, start, length, part, doc_tokens, sequence_id, offset, cut), and how many tails can be cut.

    measured: doc_id, text_hash, doc_tokens and a unique row_id (its lineage cut, so that reading it again gives the same).
    part: number of the window within the document; `cut` tells pieces of tails that were cut.
    """
    spark: SparkSession = measured.sparkSession
    units = window // quantum
    salts = max(16, common.shuffle_partitions(spark))
    tail = F.pmod("doc_tokens", F.lit(window))
    rows = measured.select(
        "row_id", "doc_id", "text_hash", "doc_tokens",
        (F.col("doc_tokens") - tail).alias("tail_start"), tail.alias("tail"),
        F.ceil(tail / quantum).cast("int").alias("class"),
        F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int").alias("salt"),
        F.floor(F.col("doc_tokens") / window).alias("windows"),
    )
    counted = common.checkpointed(rows.groupBy("class", "salt").agg(F.count("*").alias("n"), F.sum("windows").alias("w")))
    totals = {r["class"]: r for r in counted.groupBy("class").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()}  # at most units + 1 rows
    histogram, whole, bases = np.zeros(units + 1, np.int64), 0, {}
    for c in sorted(totals):
        bases[c] = {"base": 0, "window_base": whole}
        histogram[c] = totals[c].n if c else 0
        whole += totals[c].w
    segments: list[tuple[int, int, int, int, int]] = []  # class, first and end rank, first sequence, slot
    used, sequence = np.zeros(units + 1, np.int64), whole
    for combo, n in recipes(histogram, depth):
        for slot, c in enumerate(combo):
            segments.append((c, int(used[c]), int(used[c]) + n, sequence, slot))
            used[c] += n
        sequence += n
    order = Window.partitionBy("class", "salt").orderBy("doc_id", "text_hash", "row_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.get(F.array(*[F.lit(int(x)) for x in used]), F.col("class"))
    ranked = rows.join(_carried(counted, {"base": "n", "window_base": "w"}, bases), (F.col("class") == F.col("c_class")) & (F.col("salt") == F.col("c_salt"))).select(
        *rows.columns, (F.row_number().over(order) - 1 + F.col("base")).alias("rank"),
        (F.sum("windows").over(upto) - F.col("windows") + F.col("window_base")).alias("first_window"),
    )
    ranked = common.checkpointed(ranked.withColumn("over", (F.col("class") > 0) & (F.col("rank") >= taken)))
    keep = ["row_id", "doc_id", "text_hash", "doc_tokens"]
    full = ranked.filter("windows > 0").select(
        *keep, F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("part", "w"), "first_window"
    ).select(
        *keep, (F.col("w") * window).alias("start"), F.lit(window).cast("long").alias("length"), "part",
        (F.col("first_window") + F.col("w")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("cut"),
    )
    part: Column = F.floor(F.col("tail_start") / window).cast("int")
    pieces = full
    if segments:
        # as many rows as recipes: at most three for each combination that the solution uses, of which there are at most as many as classes
        places = spark.createDataFrame(segments, "s_class int, low long, high long, sequence long, slot int")
        inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        by_recipe = ranked.filter("class > 0 and not over").join(
            F.broadcast(places), (F.col("class") == F.col("s_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
        ).withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("low"))
        pieces = pieces.unionByName(by_recipe.select(
            *keep, F.col("tail_start").alias("start"), F.col("tail").alias("length"), part.alias("part"), "sequence_id",
            (F.sum("tail").over(inside) - F.col("tail")).alias("offset"), F.lit(False).alias("cut"),
        ))
    rest = ranked.filter("over")
    left = common.checkpointed(rest.groupBy("class", "salt").agg(F.sum("tail").alias("t")))
    at, bases = 0, {}
    for r in sorted(left.groupBy("class").agg(F.sum("t").alias("t")).collect(), key=lambda r: -r["class"]):  # at most units rows
        bases[r["class"]] = {"at_base": at}
        at += r.t
    if not at:
        return pieces, 0
    laid = rest.join(_carried(left, {"at_base": "t"}, bases), (F.col("class") == F.col("c_class")) & (F.col("salt") == F.col("c_salt")))
    laid = laid.withColumn("at", F.col("at_base") + F.sum("tail").over(upto) - F.col("tail"))
    place = F.pmod("at", F.lit(window))
    room = window - place
    first = F.struct(F.col("tail_start").alias("start"), F.least("tail", room).alias("length"), F.lit(0).alias("k"), place.alias("offset"), (F.col("tail") > room).alias("cut"))
    second = F.struct((F.col("tail_start") + room).alias("start"), (F.col("tail") - room).alias("length"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("cut"))
    greedy = laid.withColumn("p", F.explode(F.when(F.col("tail") > room, F.array(first, second)).otherwise(F.array(first)))).select(
        *keep, "p.start", "p.length", part.alias("part"), (F.lit(sequence) + F.floor(F.col("at") / window) + F.col("p.k")).alias("sequence_id"), "p.offset", "p.cut",
    )
    return pieces.unionByName(greedy), -(-at // window)


def packed_with_crc(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of all documents with the CRC-32 of their ids."""
    measured = common.checkpointed(measure(docs, path).withColumn("row_id", F.monotonically_increasing_id()))
    pieces, cuts = pack(measured.select("row_id", "doc_id", "text_hash", "doc_tokens"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    crcs = measured.select(F.col("row_id").alias("m_row"), "crcs")
    kept = pieces.filter("not cut").join(crcs, F.col("row_id") == F.col("m_row")).withColumn("ids_crc32", F.col("crcs")[F.col("part")])
    if not cuts:
        return kept.select(out)
    split = piece_ids(docs, pieces.filter("cut"), path, few=cuts <= BROADCAST_CUTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in batch.column("ids")]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"ids_crc32": pa.array(crc, pa.int64())}).select(out)

    schema = ", ".join(f"{n} long" for n in out)
    return kept.select(out).unionByName(common.in_batches(split.select("ids", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"), work, schema))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_with_crc(common.read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
