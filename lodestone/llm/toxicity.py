"""Toxicity by a convolutional text classifier (operator 10).

Words (A-Z lower-cased) and their first PREFIXES bytes are hashed into 2^22 buckets;
buckets that enough training documents hold have an embedding, other words share
one, and a word's vector is the sum of its own and its beginnings'.  Filters of several
widths slide over the embeddings, each keeps its largest value in the whole text,
and a logistic layer joins them.  Everything is trained here, in numpy, in one task,
from a bounded sample: at most MAX_POSITIVE toxic and MAX_NEGATIVE other labelled
documents, those with the smallest hash of doc_id, of either kind while their texts
come to MAX_BYTES.  Only the model reaches the driver.

A bucket has an embedding when MIN_SHARE of the training documents hold it, or MIN_DOCUMENTS
of them where the sample has more than MIN_DOCUMENTS / MIN_SHARE.

A fifth of the sample is not trained on but sets a threshold for each language, at
which F1 is best (in log odds, drawn towards that of all languages by a weight of
CALIBRATION toxic documents); scores are shifted so that every language's threshold is
THRESHOLD.  The language is guessed from the words themselves (naive
Bayes over the same buckets), so a score depends on the text alone.

Defined results: null and empty texts are scored like a text of unknown words of
length zero; without labels of both kinds all scores are the share of toxic ones
(0 without any); if all toxic ones (or all others) of the sample fall into the fifth that calibrates, that
fifth trains as well, and if it has none of a kind, all of the sample calibrates; labels other than 0 and 1 and null ids don't train; a document
that is labelled twice trains twice; a labelled text over MAX_BYTES does not train;
very long texts are scored whole; equal texts have equal scores; extra columns pass
through `score`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm import common

MAX_POSITIVE, MAX_NEGATIVE, MAX_BYTES = 4000, 8000, 16 << 20
THRESHOLD = 0.3
BITS = 22
#: Training documents that must hold a bucket for it to have its own embedding: this share of them, and no more than so many.
MIN_SHARE, MIN_DOCUMENTS = 0.02, 8
WIDTHS, FILTERS, DIM = (1, 2, 3), 24, 16
EPOCHS, BATCH, RATE = 5, 64, 0.01
#: Bytes of text that one block of scoring covers.
SCORE_BYTES = 1 << 18
#: Toxic validation documents at which a language's own threshold counts as much as the common one.
CALIBRATION = 20
#: Inflected words share their beginnings.
PREFIXES = (4, 5, 7)
PAD, OTHER = 0, 1
_TAIL = max(WIDTHS) - 1


def buckets(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Hash buckets of each text of a block: a row a word, of it and of its beginnings (-1 for none)."""
    words, counts, *parts = common.word_hashes(offsets, data, common.NON_WORD, PREFIXES)
    shift = np.uint64(64 - BITS)
    columns = [(words >> shift).astype(np.int32)] + [np.where(p == 0, -1, (p >> shift).astype(np.int32)) for p in parts]
    return np.split(np.stack(columns, axis=1).astype(np.int32), np.cumsum(counts)[:-1])


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Model:
    """kept[i] is the bucket of embedding i + 2; 0 pads, 1 stands for all other buckets."""

    kept: np.ndarray
    embed: np.ndarray
    conv: list[np.ndarray]  # of each width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    prior: float
    constant: bool = False
    langs: list[str] = field(default_factory=list)
    lang_words: np.ndarray | None = None  # log probability of kept buckets, by language
    shift: np.ndarray | None = None  # log odds to add, by language

    def table(self) -> np.ndarray:
        """Bucket -> embedding; the last entry stands for no bucket."""
        out = np.full((1 << BITS) + 1, PAD, np.int32)
        out[self.kept] = np.arange(len(self.kept), dtype=np.int32) + 2
        return out

    @staticmethod
    def numbered(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = table[rows]
        out[:, 0][out[:, 0] == PAD] = OTHER
        return out

    def lay_out(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Embedding numbers of all texts, each followed by padding, and where each begins."""
        lengths = np.array([max(len(d), 1) + _TAIL for d in docs])
        at = np.concatenate(([0], np.cumsum(lengths)))
        ids = np.zeros((at[-1], 1 + len(PREFIXES)), np.int32)
        for d, a in zip(docs, at[:-1].tolist(), strict=True):
            ids[a : a + len(d)] = d
        return ids, at

    def features(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Filter outputs before pooling, by width, and the embedded words."""
        x = self.embed[ids].sum(axis=1)
        out = []
        for w, bias in zip(self.conv, self.bias, strict=True):
            width = len(w)
            z = x @ w[0]
            for k in range(1, width):
                z[:-k] += x[k:] @ w[k]
            if width > 1:  # windows that would reach the next text
                for k in range(1, width):
                    z[at[1:] - k] = -np.inf
            out.append(z + bias)
        return out, x

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        ids, at = self.lay_out(docs)
        z, _ = self.features(ids, at)
        pooled = np.concatenate([np.maximum.reduceat(a, at[:-1], axis=0) for a in z], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def language(self, docs: list[np.ndarray]) -> np.ndarray:
        """Number of each text's likeliest language."""
        ids, at = self.lay_out(docs)
        return np.add.reduceat(self.lang_words[ids[:, 0]], at[:-1], axis=0).argmax(axis=1)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.constant or not docs:
            return np.full(len(docs), self.prior)
        return 1 / (1 + np.exp(-(self.logits(docs) + self.shift[self.language(docs)]).astype(float)))


def _train(model: Model, docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    """Adam for the filters and the last layer, Adagrad for the embeddings that a batch touches."""
    params = [*model.conv, *model.bias, model.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    seen = np.full(len(model.embed), 1e-6, np.float32)
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))).astype(np.float32)
    step, b_m, b_v = 0, 0.0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            ids, at = model.lay_out([docs[j] for j in pick])
            z, x = model.features(ids, at)
            n = len(pick)
            where = [np.stack([a[p:q].argmax(axis=0) + p for p, q in zip(at[:-1], at[1:], strict=True)]) for a in z]
            pooled = np.concatenate([np.take_along_axis(a, w, axis=0) for a, w in zip(z, where, strict=True)], axis=1)
            hidden = np.maximum(pooled, 0)
            mask = (rng.random(hidden.shape) > 0.3).astype(np.float32) / 0.7
            dropped = hidden * mask
            p = 1 / (1 + np.exp(-(dropped @ model.out + model.out_bias)))
            d = ((p - y[pick]) * weight[pick] / n).astype(np.float32)
            grads_out = dropped.T @ d
            dh = np.outer(d, model.out) * mask * (pooled > 0)
            grads_w, grads_b, rows, values = [], [], [], []
            for c, w in enumerate(model.conv):
                dz = dh[:, c * FILTERS : (c + 1) * FILTERS]
                g = np.zeros_like(w)
                for k in range(len(w)):
                    spot = where[c] + k
                    g[k] = np.einsum("bf,bfd->df", dz, x[spot])
                    hit = dz != 0
                    one = dz[hit][:, None] * w[k].T[np.nonzero(hit)[1]]
                    for part in ids[spot[hit]].T:
                        rows.append(part)
                        values.append(one)
                grads_w.append(g)
                grads_b.append(dz.sum(axis=0))
            step += 1
            for q, (par, g) in enumerate(zip(params, [*grads_w, *grads_b, grads_out], strict=True)):
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.999 * v[q] + 0.001 * g * g
                par -= (RATE / 2) * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
            b_m, b_v = 0.9 * b_m + 0.1 * float(d.sum()), 0.999 * b_v + 0.001 * float(d.sum()) ** 2
            model.out_bias -= RATE / 2 * (b_m / (1 - 0.9**step)) / ((b_v / (1 - 0.999**step)) ** 0.5 + 1e-8)
            touched = np.concatenate(rows)
            live = touched != PAD
            unique, inverse = np.unique(touched[live], return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(values)[live])
            seen[unique] += (total**2).mean(axis=1)
            model.embed[unique] -= 5 * RATE * total / np.sqrt(seen[unique])[:, None]


def _threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The probability at which weighted F1 is best, halfway to the next smaller one."""
    order = np.argsort(-p)
    p, hit, miss = p[order], np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + hit[-1])
    last = np.append(p[1:] < p[:-1], True)
    best = int(np.where(last, f1, -1).argmax())
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)


def fit(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], folds: np.ndarray, negative_weight: float = 1.0, epochs: int = EPOCHS) -> Model:
    """Model from hashed documents; fold 0 of 5 calibrates. negative_weight: how many others one sampled negative stands for."""
    rng = np.random.default_rng(20240117)
    y = labels.astype(np.float32)
    total = float(y.sum() + negative_weight * (1 - y).sum())
    prior = float(y.sum()) / total if total else 0.0
    constant = not (0 < y.sum() < len(y))
    train = folds != 0
    if not (0 < y[train].sum() < train.sum()):
        train[:] = True
    spread = np.concatenate([np.unique(d[d >= 0]) for d, t in zip(docs, train, strict=True) if t] or [np.zeros(0, np.int32)])
    kept, n = np.unique(spread, return_counts=True)
    kept = kept[n >= min(MIN_DOCUMENTS, max(1, int(MIN_SHARE * train.sum())))]
    embed = rng.normal(0, 0.1, (len(kept) + 2, DIM)).astype(np.float32)
    embed[PAD] = 0
    conv = [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(kept, embed, conv, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, prior, constant)
    if constant:
        return model
    table = model.table()
    docs = [model.numbered(d, table) for d in docs]
    _train(model, [d for d, t in zip(docs, train, strict=True) if t], y[train], rng, epochs)
    names = sorted({x for x in langs if x is not None}) or [""]
    counts = np.ones((len(embed), len(names)))
    for d, lang, t in zip(docs, langs, train, strict=True):
        if t and lang is not None:
            np.add.at(counts[:, names.index(lang)], d[:, 0], 1)
    model.langs = names
    model.lang_words = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    model.lang_words[[PAD, OTHER]] = 0
    check = np.flatnonzero(folds == 0)
    if not (0 < y[check].sum() < len(check)):
        check = np.arange(len(docs))
    p, guess = [], []
    for i in range(0, len(check), 256):
        part = [docs[j] for j in check[i : i + 256]]
        p.append(1 / (1 + np.exp(-model.logits(part).astype(float))))
        guess.append(model.language(part))
    p, guess, truth = np.concatenate(p), np.concatenate(guess), y[check]
    w = np.where(truth == 1, 1.0, negative_weight)
    common_threshold = _threshold(p, truth, w)
    base = _logit(common_threshold)
    at = []
    for j in range(len(names)):
        own = guess == j
        n = float(truth[own].sum())
        at.append(base + (n / (n + CALIBRATION) * (_logit(_threshold(p[own], truth[own], w[own])) - base) if n else 0.0))
    model.shift = _logit(THRESHOLD) - np.array(at)
    return model


def sampled(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[DataFrame, float]:
    """doc_id, toxic, lang, text of the labelled documents to train on, and how many others one sampled negative stands for."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [own.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    chosen = common.checkpointed(parts[0].unionByName(parts[1]))  # at most 12,000 rows of 12 bytes
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"), lang.alias("lang"))
    joined = texts.join(F.broadcast(chosen), "doc_id").withColumn("size", F.octet_length("text").cast("long")).filter(F.col("size") <= MAX_BYTES)
    joined = common.checkpointed(joined.select("doc_id", "toxic", "lang", "text", "size"))
    # a window over the sampled rows only: their sizes decide which of them fit
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = joined.withColumn("upto", F.sum("size").over(order)).filter(F.col("upto") <= MAX_BYTES).select("doc_id", "toxic", "lang", "text")
    # a sampled negative stands for so many, a sampled positive for as many fewer
    share = {c: counts.get(c, 0) / max(1, min(counts.get(c, 0), most)) for c, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))}
    return rows, (share[0] or 1.0) / (share[1] or 1.0)


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """Model from the labelled documents among `docs` for whose doc_id `usable` holds, fitted in one task."""
    rows, weight = sampled(docs, labels, usable)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, langs, texts = [], [], [], []
        for batch in batches:
            at, data = common.buffers(batch.column("text"))
            for a, b in common.blocks(at):
                texts += [x.copy() for x in buckets(at[a : b + 1], data)]
            ids += batch.column("doc_id").to_pylist()
            y += batch.column("toxic").to_pylist()
            langs += batch.column("lang").to_pylist()
        folds = common.mix64(np.array(ids, np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(5)
        model = fit(texts, np.array(y, np.int64), langs, folds, weight)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    ordered = rows.coalesce(1).sortWithinPartitions("doc_id", "toxic", "lang", "text")
    found = common.in_batches(ordered, fitted, "model binary").head()
    return pickle.loads(found.model) if found is not None else fit([], np.zeros(0, np.int64), [], np.zeros(0, np.uint64), weight)


def score(docs: DataFrame, model: Model, name: str = "_tox_score") -> DataFrame:
    """docs with the score as last column, under the name or, if the table has that one, the next unused."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by the training sample
    name = common.unused(name, docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in batches:
            at, data = common.buffers(batch.column("text"))
            for a, b in common.blocks(at, SCORE_BYTES):
                found = own.scores([own.numbered(x, table) for x in buckets(at[a : b + 1], data)])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return common.in_batches(docs, work, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~common.held_out())
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", common.held_out().alias("held_out"), F.col("_tox_score").alias("score"), (F.col("_tox_score") >= THRESHOLD).cast("int").alias("predicted"))
