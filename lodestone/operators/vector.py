"""Vector retrieval: exact nearest neighbours of a batch of queries, normalisation, diversity.

A stated query set is compared with all rows in blocks: the queries' matrix goes to
every task, each block of rows is one matrix product, and a task keeps only its k best
per query, so what is shuffled is k rows a query and task.  A query set that is not
small is dealt into blocks, which are searched one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lineage import cut

#: Most query vectors that are searched at once, most numbers in them, and numbers that a block of scores holds.
MAX_QUERIES, MAX_NUMBERS, BLOCK = 50_000, 1 << 23, 1 << 22
#: Of an inverted file: rows that its cells are fitted on, rounds of k-means, most cells (else the root of the rows).
SAMPLE, ROUNDS, MAX_CELLS = 50_000, 8, 4096
#: Share of the nearest NEAR that the cells read for a query are to hold, as measured on CHECKED sampled rows.
RECALL, NEAR, CHECKED = 0.95, 10, 500
#: Slack of a comparison with the k-th score, as scores are ordered by nine digits.
SLACK = 2e-9


def score_of_distance(distance: Column) -> Column:
    """1 - cosine distance, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double")), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", embedding: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """query_id, <id_>, score (clamped dot product), rank: the k best rows for each query (query_id, q).

    Queries with a column `category` that is not null see rows of that category only.
    """
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).head()
    most = max(1, min(MAX_QUERIES, MAX_NUMBERS // max(1, width)))
    if n <= most:
        return _nearest(rows, queries, n, k, id_, embedding, exclude_self)[0]
    # an eighth more blocks than needed, as hashing does not deal evenly
    count = 9 * n // (8 * most) + 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(count))
    found: DataFrame | None = None
    for b in range(count):
        part = queries.filter(block == b)
        near, shared = _nearest(rows, part, part.count(), k, id_, embedding, exclude_self)
        done = cut(near)
        if shared is not None:
            shared.destroy()
        found = done if found is None else found.unionByName(done)
    return found


def best_places(query: np.ndarray, ids: np.ndarray, dots: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best by descending dot product of nine digits, then id."""
    order = np.lexsort((ids, -np.round(dots, 9), query))
    sorted_ = query[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]


def _nearest(rows: DataFrame, queries: DataFrame, n: int, k: int, id_: str, embedding: str, exclude_self: bool) -> tuple[DataFrame, Broadcast | None]:
    """`nearest` for n queries that fit the driver, and the broadcast that it reads."""
    if not n:
        return rows.select(F.lit(0).cast("long").alias("query_id"), F.col(id_).cast("long").alias(id_), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0), None
    filtered = "category" in queries.columns
    held = queries.select("query_id", "q", *(["category"] if filtered else [])).toPandas()
    ids = held["query_id"].to_numpy(np.int64)
    matrix = np.stack([np.asarray(v, np.float64) for v in held["q"]])
    wanted = None
    if filtered:  # the queries of each category, and those of none, which see all
        asked = held["category"].to_numpy(object)
        free = np.array([w is None or w != w for w in asked], bool)
        wanted = {c: np.flatnonzero(free | (asked == c)) for c in set(asked[~free])}, np.flatnonzero(free)
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix, wanted))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, q, wanted = shared.value
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        waiting, held = [], 0

        def merged(parts: list[tuple]) -> tuple:
            every = [np.concatenate(c) for c in zip(*parts, strict=True)]
            at = best_places(*every, k)
            return tuple(c[at] for c in every)

        def take(q_at: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> None:
            nonlocal top, waiting, held
            for start in range(0, len(own), max(1, BLOCK // len(q_at))) if len(q_at) else ():
                part = own[start : start + max(1, BLOCK // len(q_at))]
                score = q[q_at] @ matrix[start : start + len(part)].T
                if exclude_self:
                    score[query[q_at][:, None] == part[None, :]] = -np.inf
                m = min(k, score.shape[1])
                # ties beyond the k-th place are settled by id, so take all of them
                least = -np.partition(-score, m - 1, axis=1)[:, m - 1]
                r, c = np.nonzero((score >= least[:, None] - SLACK) & np.isfinite(score))
                waiting.append((query[q_at[r]], part[c].astype(np.int64), score[r, c]))
                held += len(r)
                if held > BLOCK:
                    top, waiting, held = merged([top, *waiting]), [], 0

        everyone = np.arange(len(query))
        for batch in batches:
            if not batch.num_rows:
                continue
            own, matrix = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            if wanted is None:
                take(everyone, own, matrix)
                continue
            kinds = np.array(batch.column(2).to_pylist(), object)
            for kind in set(kinds):  # only what can match is multiplied
                at = kinds == kind if kind is not None else np.array([x is None for x in kinds])
                take(wanted[0].get(kind, wanted[1]), own[at], matrix[at])
        top = merged([top, *waiting]) if waiting else top
        if len(top[0]):
            yield pa.RecordBatch.from_pydict({"query_id": top[0], id_: top[1], "dot": top[2]})

    near = rows.select(F.col(id_).cast("long").alias(id_), embedding, *(["category"] if filtered else [])).mapInArrow(best, f"query_id long, {id_} long, dot double")
    order = Window.partitionBy("query_id").orderBy(F.round("dot", 9).desc(), id_)
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", id_, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dot"))).alias("score"), "rank"), shared


def pooled(candidates: DataFrame) -> DataFrame:
    """One row a query and chunk from hits per variant (query_id, variant, chunk_id, score): best score, first finder, source."""
    return candidates.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"), F.min("variant").alias("first_variant"), F.array_sort(F.collect_set("variant")).alias("found_by")
    ).withColumn("source", F.when(F.col("first_variant") == 0, "vector").otherwise("variant"))


def diverse(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance for each query (query_id, chunk_id, ord, score, embedding): picked (1..k) for the chosen rows.

    Candidates of a query are a bounded pool (some dozens), so a query is one group.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        n = len(pdf)
        if n <= k:
            order = list(range(n))
        else:
            e = np.stack(pdf["embedding"].to_list()).astype(float)
            relevance, likeness = pdf["score"].to_numpy(float), e @ e.T
            order, closest = [int(relevance.argmax())], likeness[int(relevance.argmax())].copy()
            free = np.ones(n, bool)
            free[order[0]] = False
            while len(order) < k:
                gain = np.where(free, weight * relevance - (1 - weight) * closest, -np.inf)
                j = int(gain.argmax())
                order.append(j)
                free[j] = False
                closest = np.maximum(closest, likeness[j])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[order], "chunk_id": pdf["chunk_id"].iloc[order], "picked": np.arange(1, len(order) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id long, picked int")


def cells(rows: DataFrame, embedding: str = "embedding", count: int | None = None, id_: str = "vec_id") -> tuple[np.ndarray, int]:
    """Unit centres of k-means, and how many cells to read for a query.

    Both are fitted on the SAMPLE rows with the smallest hash of their id; the driver holds no more than those.  Of CHECKED
    of them the nearest among the others are known exactly, and so the number of cells that holds RECALL of these: few
    where vectors cluster, most where they do not.
    """
    count = count or int(min(MAX_CELLS, max(1, rows.count() ** 0.5)))
    sample = rows.orderBy(F.xxhash64(id_), id_).limit(SAMPLE).select(embedding).toPandas()[embedding]
    x = np.stack([np.asarray(v, np.float64) for v in sample]) if len(sample) else np.zeros((1, 1))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    closest = lambda centres: np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(unit, len(x) // 4096 + 1)])
    rng = np.random.default_rng(7)
    centres = unit[rng.permutation(len(x))[:count]]
    for _ in range(ROUNDS):
        total = np.zeros_like(centres)
        np.add.at(total, closest(centres), unit)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, total / np.maximum(length, 1e-12), centres)
    cell, places = closest(centres), []
    for i in range(min(CHECKED, len(x))):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(NEAR, len(x) - 1))[:NEAR] if len(x) > 1 else np.zeros(1, int)
        rank = np.empty(len(centres), int)
        rank[np.argsort(-(centres @ x[i]), kind="stable")] = np.arange(len(centres))
        places.append(rank[cell[best]])
    return centres, int(np.quantile(np.concatenate(places), RECALL, method="higher")) + 1


def with_cells(rows: DataFrame, centres: np.ndarray, most: int, embedding: str = "embedding") -> DataFrame:
    """rows with `cell`, a row for each of the `most` centres closest to it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # MAX_CELLS vectors at most

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        likeness = np.stack([np.asarray(x, np.float64) for x in v]) @ shared.value.T
        return pd.Series(list(np.argsort(-likeness, axis=1, kind="stable")[:, :most].astype(np.int32)))

    return rows.withColumn("cell", F.explode(near(embedding)))


def nearest_in_cells(stored: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, probes: int, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`nearest`, of the rows in the cells that are closest to each query: approximate, unless all cells are probed.

    stored: rows with `cell`, partitioned by it; cells that no query probes are not read.
    """
    asked = cut(with_cells(queries.select("query_id", "q"), centres, probes, "q"))
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # MAX_CELLS at most
    rows = stored.filter(F.col("cell").isin(wanted)).withColumn("category", F.col("cell"))
    return nearest(rows, asked.withColumnRenamed("cell", "category"), k, id_, embedding)
