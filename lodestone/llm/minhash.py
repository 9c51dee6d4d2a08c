"""Near-duplicates by one-permutation MinHash (operator 6).

1. A document's set is its distinct word shingles.  Documents with the same set
   form a class; one node stands for it from here on, so copies cost nothing.
2. One pass over a node's set fills BINS bins with their smallest hashes; an empty
   bin takes the value of a bin that its own probing sequence finds (optimal
   densification).  Bands of a few bins are bucket keys; `rows_a_band` takes as many
   bins as keep the chance that a pair at the threshold shares no bucket below 1e-6.
3. In each bucket every node is a candidate with the bucket's smallest node only (a
   star), so there are at most as many candidates as bands a node.
4. Candidates whose sizes and signatures allow a link are confirmed as joined rows,
   each with both full sets: no group of nodes ever meets in one task.  Confirmed
   links are contracted to components.
5. A star alone misses links between two nodes that are both unlike its centre.  So
   the stars whose nodes are not in one component yet are gone through once more: all
   nodes of such a star meet with their full sets, and only pairs of different
   components are compared.  A group holds LARGE nodes and LARGE_SHINGLES shingles at
   most.  Larger stars are dealt into blocks of which any two meet, the largest by rare
   shingles first.  Either way any two nodes of a star that can be linked meet, so what is
   found does not depend on the star's size.  A group tells only links that join two of
   its parts, fewer than it has nodes.

Defined results: null or empty texts have no shingles and link with nothing; rows
with equal doc_id are one document; a null doc_id is its own component (null) and
kept; repeated rows stay repeated; extra columns are ignored; an empty table gives
no rows; a percentage below LEAST_PERCENT is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common

BINS = 128
#: Largest chance that a pair at the threshold shares no bucket, and the smallest threshold at which single bins can keep it.
MISS, LEAST_PERCENT = 1e-6, 12
#: Most nodes and shingles (8 bytes each) of a group that meets in one task; two sets that alone have more meet all the same.
LARGE, LARGE_SHINGLES = 2048, 1 << 21
#: Stars with more than so many times LARGE nodes are dealt by rare shingles before they are dealt into blocks.
HUGE = 16
#: Node lists up to this many (8 bytes each) may be broadcast.
BROADCAST_NODES = 200_000
#: Links up to this many (16 bytes each) are contracted by one task.
SMALL_LINKS = 500_000

_SHIFT = np.uint64(64 - 7)
_PROBES = (common.mix64(np.arange(256 * BINS, dtype=np.uint64) + np.uint64(0xC0FFEE)) % np.uint64(BINS)).astype(np.int64).reshape(256, BINS)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the `size`-word shingles of each text of a block."""
    words, counts = common.word_hashes(offsets, data, common.SPACES)
    at = np.concatenate(([0], np.cumsum(counts)))
    n = len(words)
    code = np.zeros(n, np.uint64)
    for i in range(size):  # code[j] covers words j .. j + size - 1
        code[: max(n - i, 0)] = common.mix64(code[: max(n - i, 0)] * np.uint64(0x100000001B3) + words[i:])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(code[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for w in words[a:b]:
                whole = common.mix64(whole * np.uint64(0x100000001B3) + w)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS values of a sorted, non-empty set: the smallest hash of each bin, empty bins densified."""
    bins = (hashes >> _SHIFT).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]] = hashes[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(empty):
            break
        donor = probe[empty]
        hit = full[donor]
        out[empty[hit]] = out[donor[hit]]
        empty = empty[~hit]
    if len(empty):  # a few shingles and long bad luck: the next full bin
        have = np.flatnonzero(full)
        out[empty] = out[have[np.searchsorted(have, empty) % len(have)]]
    return out


def rows_a_band(percent: int) -> int:
    """Most bins a band with which a pair at the threshold is missed with a chance of MISS at most."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie within {LEAST_PERCENT} and 100")
    return max(r for r in range(1, 9) if r == 1 or (1 - (percent / 100) ** r) ** (BINS // r) <= MISS)


def signature_floor(percent: int) -> float:
    """Least share of equal bins of a pair that can reach the threshold: six standard deviations below."""
    p = percent / 100
    return p - 6.2 * (p * (1 - p) / BINS) ** 0.5


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A bucket key for each band of `rows` bins."""
    n = BINS // rows
    key = common.mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))
    for column in sig[: n * rows].reshape(n, rows).T:
        key = common.mix64(key * np.uint64(0x100000001B3) + column)
    return key


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (together the set's identity), sig (a byte a bin), keys (bands)."""
    rows_ = rows_a_band(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = common.buffers(batch.column("text"))
            for a, b in common.blocks(at):
                n, one, two, sigs, keys = [], [], [], [], []
                for s in shingle_sets(at[a : b + 1], data, size):
                    n.append(len(s))
                    one.append(common.mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    two.append(common.mix64(s + np.uint64(0x1234567887654321)).sum(dtype=np.uint64))
                    sig = signature(s) if len(s) else None
                    sigs.append(common.mix64(sig).astype(np.uint8).tobytes() if len(s) else None)
                    keys.append(bands(sig, rows_).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "n_shingles": pa.array(n, pa.int64()),
                    "set_a": pa.array(np.array(one, np.uint64).view(np.int64)), "set_b": pa.array(np.array(two, np.uint64).view(np.int64)),
                    "sig": pa.array(sigs, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return common.in_batches(rows, work, "doc_id long, n_shingles long, set_a long, set_b long, sig binary, keys array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int, few: bool) -> DataFrame:
    """node, shingles (sorted array) of the documents that `nodes` (node) names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = common.buffers(batch.column("text"))
            for a, b in common.blocks(at):
                sets = [s.view(np.int64) for s in shingle_sets(at[a : b + 1], data, size)]
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(a, b - a), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), common.text_column(docs).alias("text"))
    return common.in_batches(rows.join(F.broadcast(nodes) if few else nodes, "node", "left_semi"), work, "node long, shingles array<long>")


def _allowed(percent: int, n_a: Column, n_b: Column) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def star_buckets(reps: DataFrame) -> DataFrame:
    """key, node, hub (the bucket's smallest node) and n (its nodes) of buckets with more than one node; checkpointed."""
    placed = reps.select("node", F.explode("keys").alias("key"))
    # written first, so that the join below has an exchange on both sides and a hot bucket's can be split
    hubs = common.checkpointed(placed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    return common.checkpointed(placed.join(hubs, "key"))


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures allow a link."""
    floor = signature_floor(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sig_u", "sig_v"))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= floor))

    own = lambda c: reps.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    joined = pairs.join(own("v"), "v").join(own("u"), "u").filter(_allowed(percent, F.col("n_u"), F.col("n_v")))
    return common.in_batches(joined.select("u", "v", "sig_u", "sig_v"), work, "u long, v long")


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v; checkpointed) that are links on full sets: a row a pair, which holds both sets."""
    nodes = common.checkpointed(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "node"))
    few = nodes.count() <= BROADCAST_NODES
    sets = common.checkpointed(full_sets(docs, nodes, size, few).withColumn("n", F.size("shingles").cast("long")))
    of = lambda c, s: sets.select(F.col("node").alias(c), F.col("shingles").alias(s))
    # of either node of a pair, one row: the larger side can be split where a node has many pairs
    joined = pairs.join(of("v", "b"), "v").join(of("u", "a"), "u")
    both = joined.select("u", "v", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size(F.array_intersect("a", "b")).alias("both"))
    return both.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("u", "v")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links (u, v) that one task reads."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts or not (links := sum(len(u) for u, _ in parts)):
        return
    nodes, ends = np.unique(np.concatenate([p[i] for i in (0, 1) for p in parts]), return_inverse=True)
    u, v = ends[:links], ends[links:]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        for side in (u, v):  # the root of either end hangs below the smaller label
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (next_ := label[label]).tolist() != label.tolist():
            label = next_
        if (label == before).all():
            break
    yield pa.RecordBatch.from_pydict({"node": nodes, "component": nodes[label]})


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes with links (u, v; checkpointed).

    Up to SMALL_LINKS links are contracted by one task.  More are by alternating two
    contractions until nothing changes: every node hangs its larger neighbours on the
    smallest one around, then its smaller neighbours.  Each round at least halves long
    chains; lineage is cut each round.
    """
    if links.count() <= SMALL_LINKS:
        return common.in_batches(links.select("u", "v").coalesce(1), _contracted, "node long, component long")
    edges = common.checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.unionByName(low.filter("m != u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = common.checkpointed(small)
        before, state = state, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).head()
        if state == before:
            break
    own = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())


def _blocks(groups: DataFrame) -> DataFrame:
    """g, node, block (0 if the group is whole) of groups (g, node, n_shingles; checkpointed), none larger than LARGE and LARGE_SHINGLES.

    What is larger is dealt into blocks, and any two of them make a group.  Blocks are so small that two of them
    stay below LARGE by six standard deviations.
    """
    sizes = groups.groupBy("g").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight")).filter("size > 1")
    sized = groups.join(common.checkpointed(sizes), "g")
    fits = (F.col("size") <= LARGE) & (F.col("weight") <= LARGE_SHINGLES) | (F.col("size") == 2)
    count = F.ceil(F.greatest(F.col("size") / ((9 + LARGE / 2) ** 0.5 - 3) ** 2, 3 * F.col("weight") / LARGE_SHINGLES))
    own = F.pmod(F.xxhash64("node", "g"), count)
    dealt = sized.filter(~fits).select("g", "node", own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("with"))
    dealt = dealt.select(F.xxhash64("g", F.least("block", "with"), F.greatest("block", "with")).alias("g"), "node", (F.col("block") + 1).alias("block"))
    return sized.filter(fits).select("g", "node", F.lit(0).cast("long").alias("block")).unionByName(dealt)


def rare_groups(docs: DataFrame, stars: DataFrame, size: int, percent: int) -> DataFrame:
    """g, node, n_shingles of stars (g, node, c; checkpointed): any two nodes of a star that are a link between components meet in some group.

    Read two linked sets in one order.  All that they must have in common follows their first common shingle, so it is
    among the first n - ceil(percent / 100 * n) + 1 of either, and of the smaller set even among the first
    n - ceil(2 * percent / (100 + percent) * n) + 1 (`soon`).  The order is from the star's seldom shingles to its frequent
    ones: what a template gives to all of its pages comes last.  Nodes that share a shingle with more than LARGE others
    meet once, in one group a star.
    """
    nodes = common.checkpointed(stars.select("node").distinct())
    sets = full_sets(docs, nodes, size, nodes.count() <= BROADCAST_NODES)
    sets = sets.select("node", F.size("shingles").cast("long").alias("n"), F.xxhash64("shingles").alias("of"), "shingles").dropDuplicates(["node", "of"])
    each = common.checkpointed(stars.join(sets, "node")).select("g", "node", "of", "n", "c", F.explode("shingles").alias("s"))
    often = common.checkpointed(each.groupBy("g", "s").agg(F.count("*").alias("often")).filter("often > 1"))
    own = Window.partitionBy("g", "node", "of")
    # shingles that no other node has come first and need no row
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "s"))
    ahead = each.join(often, ["g", "s"]).withColumn("place", place).filter(f"place <= n - ({percent} * n + 99) div 100 + 1")
    soon = F.expr(f"place <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    ahead = common.checkpointed(ahead.select("g", "s", "node", "n", "c", soon.alias("soon")))
    met = ahead.groupBy("g", "s").agg(
        F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("soon").alias("soon"),
        F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"),
    ).filter("soon and low != high")
    met = common.checkpointed(met.groupBy("g", "size", "one", "two").agg(F.min("s").alias("s")).select("g", "s", "size"))  # of equal groups one
    meets = F.when(F.col("size") <= LARGE, F.xxhash64("g", "s")).otherwise(F.col("g"))
    return ahead.join(met, ["g", "s"]).select(meets.alias("g"), "node", F.col("n").alias("n_shingles")).distinct()


def open_groups(buckets: DataFrame, reps: DataFrame, comps: DataFrame, docs: DataFrame | None = None, size: int = 2, percent: int = 80) -> DataFrame:
    """g, node, block, c (component): the nodes of stars that are not in one component yet, in bounded groups; checkpointed.

    Any two nodes of one bucket that can be linked meet in some group.  Without `docs` the largest stars too are dealt into blocks only.
    """
    stars = buckets.select("hub", "node").distinct().join(comps, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("c"))
    stars = common.checkpointed(stars)
    mixed = stars.groupBy("hub").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).filter("low != high").select("hub", "size")
    mixed = common.checkpointed(mixed)
    most = HUGE * LARGE
    huge = docs is not None and not mixed.filter(F.col("size") > most).isEmpty()
    rows = stars.join(mixed.filter(F.col("size") <= most) if huge else mixed, "hub")
    groups = rows.join(reps.select("node", "n_shingles"), "node").select(F.col("hub").alias("g"), "node", "n_shingles")
    if huge:
        large = common.checkpointed(stars.join(mixed.filter(F.col("size") > most), "hub").select(F.col("hub").alias("g"), "node", "c"))
        groups = groups.unionByName(rare_groups(docs, large, size, percent))
    dealt = _blocks(common.checkpointed(groups))
    return common.checkpointed(dealt.join(stars.select("node", "c").distinct(), "node").select("g", "node", "block", "c"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many elements each of the left sets shares with each of the right ones: products of 0-1 matrices, some columns at a time."""
    known = np.unique(np.concatenate(left))
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(known, every), len(known) - 1)
        hit = known[at] == every
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    (a, i), (b, j) = places(left), places(right)
    for first in range(0, len(known), columns):
        dense = []
        for at, row, n in ((a, i, len(left)), (b, j, len(right))):
            part = slice(*np.searchsorted(at, [first, first + columns]))
            m = np.zeros((n, columns), np.float32)
            m[row[part], at[part] - first] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T  # whole numbers below 2^24 are exact
    return out.astype(np.int64)


def group_links(nodes: list[int], part: list[int], block: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the parts of one group that connect what is connected; in a group of two blocks, from block to block only."""
    part, block, size = np.array(part), np.array(block), np.array([len(x) for x in sets])
    names, n = np.unique(part, return_counts=True)
    rest = np.flatnonzero(part != names[n.argmax()])
    two, out = block.min() != block.max(), []
    for first in range(0, len(rest), 256):
        some = rest[first : first + 256]
        # a link joins sets of nearly one size
        near = np.flatnonzero((100 * size >= percent * size[some].min()) & (100 * size[some].max() >= percent * size))
        both = shared_counts([sets[i] for i in some], [sets[i] for i in near])
        linked = 100 * both >= percent * (size[some][:, None] + size[near][None, :] - both)
        if two:
            linked &= block[some][:, None] != block[near][None, :]
        for i, j in zip(*np.nonzero(linked), strict=True):
            u, v = some[i], near[j]
            if part[u] != part[v]:
                out.append((int(nodes[u]), int(nodes[v])))
                part[part == part[v]] = part[u]
    return out


def group_confirmed(docs: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v; u < v) between the components of groups (g, node, block, c; checkpointed), on full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sets = None, [], []

        def found() -> pa.RecordBatch | None:
            links = group_links(*(list(x) for x in zip(*held, strict=True)), sets, percent) if len(held) > 1 else []
            return pa.RecordBatch.from_pydict({"u": [min(x) for x in links], "v": [max(x) for x in links]}) if links else None

        for batch in batches:
            at = batch.column("shingles").offsets.to_numpy()
            flat = batch.column("shingles").values.to_numpy(zero_copy_only=False)
            for i, (g, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "node", "c", "block")), strict=True)):
                if g != now:
                    if (links := found()) is not None:
                        yield links
                    now, held, sets = g, [], []
                held.append(row)
                sets.append(flat[at[i] : at[i + 1]].copy())
        if (links := found()) is not None:
            yield links

    nodes = common.checkpointed(groups.select("node").distinct())
    sets = full_sets(docs, nodes, size, nodes.count() <= BROADCAST_NODES)
    rows = groups.join(sets, "node").select("g", "node", "c", "block", "shingles").repartition("g").sortWithinPartitions("g", "node")
    return common.in_batches(rows, work, "u long, v long").distinct()


def node_components(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of the nodes (node, n_shingles, sig, keys; checkpointed) that link with another; checkpointed."""
    buckets = star_buckets(reps)
    stars = buckets.filter("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    tried = common.checkpointed(plausible(stars, reps, percent))
    links = common.checkpointed(confirmed(docs, tried, size, percent))
    comps = common.checkpointed(components(links))
    groups = open_groups(buckets, reps, comps, docs, size, percent)
    more = common.checkpointed(group_confirmed(docs, groups, size, percent))
    return comps if more.isEmpty() else common.checkpointed(components(common.checkpointed(links.unionByName(more))))


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sketch = common.checkpointed(sketches(docs, size, percent))
    solid = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = solid.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "keys")).alias("r"))
    classes = common.checkpointed(classes.select("set_a", "set_b", F.col("r.doc_id").alias("node"), "r.n_shingles", "r.sig", "r.keys"))
    comps = node_components(docs, classes.select("node", "n_shingles", "sig", "keys"), size, percent)
    node_of = classes.select("set_a", "set_b", "node").join(comps, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    found = solid.select("doc_id", "n_shingles", "set_a", "set_b").join(node_of, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = sketch.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """docs without the rows of documents that near_duplicates does not keep; of rows with one doc_id, one stays."""
    found = common.checkpointed(near_duplicates(docs, size, percent))
    gone = common.unused("gone", docs.columns)
    dropped = found.filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    few = dropped.count() <= BROADCAST_NODES
    left = docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col(gone), "left_anti")
    twice = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if twice.isEmpty():
        return left
    return left.filter("doc_id is null").unionByName(left.filter("doc_id is not null").dropDuplicates(["doc_id"]))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_documents(spark, sf_dir))
