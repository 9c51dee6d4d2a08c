"""Document fingerprints from closed syncmers (operator 1).

A k-mer is kept when the smallest hash among its inner s-mers stands at its
first or last place.  Whether a k-mer is kept depends on its own K characters
only, so an edit moves or removes just the anchors that overlap it, and anchors
of two texts can be matched by position.

There are three kinds of anchors (KINDS), all closed syncmers.  Every text has the coarse ones; texts
under a length have finer ones as well, where coarse ones would be too few.  The two lowest bits of
an anchor's hash name its kind.  Two texts are compared on the kinds that both their lengths have, so
what a text is like does not depend on which side of a limit it is on: lengths without a common kind
(below 32 and from 1,024 code points) differ so much that their share could not exceed 6 %.

A fingerprint is a string of eight characters an anchor (base64 of four bytes
hash and two bytes distance from the anchor before it, capped at 65535).  The
anchors follow the text, so equal texts have equal fingerprints.

Defined results: a null or empty text has the empty fingerprint; a text of one code point has one
anchor, its hash.  Likeness is the Dice share of anchors with equal hashes, counted with multiplicity;
two empty fingerprints are alike (1.0), texts without common kinds or of which one is empty are unlike (0.0).
Repeated doc_ids are ordered by text; null ids come first.  Extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

#: k, s, and the code points from and below which a text has anchors of the kind.
KINDS = ((32, 8, 32, 1 << 62), (8, 3, 8, 1024), (2, 1, 1, 32))
_KIND_BITS = 2
#: Code points that one block of numpy work covers.
BLOCK_CHARS = 1 << 20
_ANCHOR = np.dtype([("hash", ">u4"), ("gap", ">u2")])

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, n_anchors long"
)


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours, by doubling."""
    have, out = 1, v
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def syncmers(texts: list[str], k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (32 bits), places and texts' numbers of the closed syncmers of all texts."""
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(units)
    if n < k:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = common.prefix_hashes(units)
    _, down = common.powers(n + 1)
    inner = common.mix64((h[s:] - h[:-s]) * down[: n - s + 1])
    least = _window_min(inner, k - s + 1)
    m = n - k + 1
    place = np.flatnonzero((inner[:m] == least) | (inner[k - s : k - s + m] == least))
    owner = np.searchsorted(at, place, "right") - 1
    whole = place + k <= at[owner + 1]
    place, owner = place[whole], owner[whole]
    code = common.mix64((h[place + k] - h[place]) * down[place] + np.uint64(k)) >> np.uint64(32)
    return code.astype(np.uint32), place - at[owner], owner


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (32 bits, the lowest of which are the kind) and places of the anchors of all texts, and where each text's begin (one more at the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = []
    for kind, (k, s, least, below) in enumerate(KINDS):
        chosen = np.flatnonzero((lengths >= least) & (lengths < below))
        code, place, owner = syncmers([texts[i] for i in chosen], k, s)
        parts.append((code >> np.uint32(_KIND_BITS) << np.uint32(_KIND_BITS) | np.uint32(kind), place, chosen[owner]))
    alone = np.flatnonzero(lengths == 1)
    code = common.mix64(np.array([ord(texts[i]) for i in alone], np.uint64)) >> np.uint64(32)
    parts.append((code.astype(np.uint32) | np.uint32((1 << _KIND_BITS) - 1), np.zeros(len(alone), np.int64), alone))
    code, place, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((code & np.uint32((1 << _KIND_BITS) - 1), place, owner))
    return code[order], place[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))


def encode(code: np.ndarray, place: np.ndarray) -> str:
    rows = np.empty(len(code), _ANCHOR)
    rows["hash"] = code
    rows["gap"] = np.minimum(np.diff(place, prepend=0), 65535)
    return base64.b64encode(rows.tobytes()).decode("ascii")


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (exact while no gap passes 65535) of a fingerprint."""
    rows = np.frombuffer(base64.b64decode(fingerprint), _ANCHOR)
    return rows["hash"].astype(np.uint32), np.cumsum(rows["gap"].astype(np.int64))


def align(left: str, right: str) -> list[tuple[int, int]]:
    """Places (left, right) of the anchors whose hash occurs once in either fingerprint."""
    (a, pa_), (b, pb) = decode(left), decode(right)
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    common_, x, y = np.intersect1d(ua[ca == 1], ub[cb == 1], return_indices=True)
    return sorted(zip(pa_[ia[ca == 1][x]].tolist(), pb[ib[cb == 1][y]].tolist(), strict=True))


def _likeness(code: np.ndarray, cut: np.ndarray, lengths: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dice share for pairs of texts of one block, on the kinds of anchors that both have."""
    shared = np.stack([(np.minimum(lengths[left], lengths[right]) >= least) & (np.maximum(lengths[left], lengths[right]) < below) for _, _, least, below in KINDS] + [np.ones(len(left), bool)], axis=1)

    def keyed(which: np.ndarray) -> np.ndarray:
        n = np.diff(cut)[which]
        first = np.repeat(cut[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else np.zeros(0, np.int64)
        pair = np.repeat(np.arange(len(which), dtype=np.uint64), n)
        own = code[first + np.arange(len(pair))]
        use = shared[pair.astype(np.int64), (own & np.uint32((1 << _KIND_BITS) - 1)).astype(np.int64)]
        return np.sort((pair[use] << np.uint64(32)) | own[use].astype(np.uint64))

    (a, na), (b, nb) = (np.unique(keyed(x), return_counts=True) for x in (left, right))
    both, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    of = lambda keys, n: np.bincount((keys >> np.uint64(32)).astype(np.int64), n, minlength=len(left))
    hit, total = of(both, np.minimum(na[x], nb[y])), of(a, na) + of(b, nb)
    none = (lengths[left] == 0) & (lengths[right] == 0)
    return np.where(none, 1.0, 2 * hit / np.maximum(total, 1))


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """texts holds one more than ids: the one after the last."""
    n = len(ids)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    code, place, cut = anchors(texts + changed)
    prints = [encode(code[a:b], place[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    one, lengths = np.arange(n), np.array([len(t) for t in texts + changed])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": pa.array(prints[:n], pa.string()),
        "edited_fingerprint": pa.array(prints[n + 1 :], pa.string()),
        "near_edited": _likeness(code, cut, lengths, one, one + n + 1),
        "near_next": _likeness(code, cut, lengths, one, one + 1),
        "n_anchors": pa.array(np.diff(cut)[:n], pa.int64()),
    })


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted within a bucket; the last of a bucket (look) only serves the row before it."""
    ids: list = []
    texts: list[str] = []
    held, bucket, done = 0, None, False
    for batch in batches:
        for b, i, t, look in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "look")), strict=True):
            if b != bucket:
                bucket, ids, texts, held, done = b, [], [], 0, False
            if done:
                continue
            texts.append(t)
            held += len(t)
            if not look:
                ids.append(i)
            done = look
            if done or held >= BLOCK_CHARS:
                n = len(texts) - 1
                if n:
                    yield _rows(ids[:n], texts)
                ids, texts, held = ids[n:], texts[n:], len(texts[-1])


def _bucket(edges: list[int], of: Column) -> Column:
    """How many edges (ascending) are at most the column's value; two short searches in place of one long."""
    if not edges:
        return F.lit(0)
    step = int(len(edges) ** 0.5) or 1
    listed = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    blocks = [edges[i : i + step] for i in range(0, len(edges), step)]
    block = F.size(F.filter(listed([b[0] for b in blocks]), lambda e: e <= of))
    inside = F.size(F.filter(F.get(F.array(*map(listed, blocks)), block - 1), lambda e: e <= of))
    return F.when(of.isNull() | (block == 0), 0).otherwise((block - 1) * step + inside)


def fingerprint(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row a document: its fingerprint, its edited text's, and how alike they and the next document's are.

    Texts are shuffled once, into ranges of doc_id, a range a partition; the first document of a range
    is sent to the range before it as well, so that each task has every `next`.
    Only the ranges' bounds (as many as partitions) reach the driver.
    """
    spark: SparkSession = docs.sparkSession
    n = buckets or common.shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    quantiles = [i / n for i in range(1, n)]
    edges = rows.agg(F.percentile_approx("doc_id", quantiles, 20 * n).alias("e")).head().e if quantiles else []
    number = _bucket(sorted(set(edges or [])), F.col("doc_id"))
    first = {
        r.bucket: r.first
        for r in rows.groupBy(number.alias("bucket"))
        .agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("m"))
        .select("bucket", F.col("m.doc_id").alias("first")).collect()
    }
    order = sorted(first)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    # each bucket's first id, and the bucket in front of it
    firsts = F.create_map(*[F.lit(x) for b in order if first[b] is not None for x in (b, first[b])]) if any(v is not None for v in first.values()) else F.create_map().cast("map<int,bigint>")
    fronts = F.create_map(*[F.lit(x) for b in order for x in (b, before[b])]) if order else F.create_map().cast("map<int,int>")
    bucketed = rows.withColumn("bucket", number)
    leads = F.col("doc_id").eqNullSafe(F.try_element_at(firsts, F.col("bucket")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("look"))
    ahead = F.struct(F.try_element_at(fronts, F.col("bucket")).alias("bucket"), F.lit(True).alias("look"))
    sent = bucketed.select("doc_id", "text", F.explode(F.when(leads, F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    dealt = sent.select(F.col("to.bucket").alias("bucket"), "doc_id", "text", F.col("to.look").alias("look"))
    sorted_ = dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "look", F.col("doc_id").asc_nulls_first(), "text")
    return common.in_batches(sorted_, _fingerprints, SCHEMA)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(common.read_documents(spark, sf_dir))
