"""Merkle manifest of a dataset (operator 12).

Each row is a leaf, the SHA-256 of its fields; a source's leaves in order of doc_id form a tree of fan-out FAN, and the
sources' roots in order of source form another above them.  A row's proof is the digests of its siblings on every
level, from which anyone who holds the row can fold up to the root.

Ranks come without a sort of a whole source: doc_id is four digits of 16 bits.  A histogram of each digit under its
prefix, all sources in one aggregation, gives by sums over at most 65,536 siblings how many ids of the source lie
before a prefix; the ids under one prefix of 48 bits, again 65,536 at most, are numbered in place.  Rows
that are equal in all fields are one row with a count until then, so a repeated id is no large group.

A rank written in base FAN is the key of a leaf in a trie, and a prefix of it the key of a node.  Nodes are
reduced from the longest prefix to the shortest, LEVELS digits a shuffle: at most FAN ^ LEVELS digests meet in
one row and are hashed there, level by level.  What is kept of each step serves to hand siblings back down: a
node's path (the siblings left and right on all levels above) is joined to the nodes under it, by the prefix.
Texts are hashed where they are read and never shuffled.

Defined results: a null field is `-`; null ids come first, equal ids go by their leaf, equal rows are leaves of
their own; a null source is a source of its own and comes first; a row without an id is not tampered with, nor is a
null text; extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common

FAN, LEVELS = 3, 5
#: Bits of a digit of doc_id; four digits are an id.
DIGIT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields: `-` for null, else its size in bytes, a colon and the value."""
    plain = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in plain]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, seen: the leaf of the row as it is and as the check sees it (without newlines where crc32 of the id is even)."""
    own = [F.col(c) for c in FIELDS]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & (F.instr("text", "\n") > 0)
    seen = F.when(tampered, digest(*own[:-1], F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    return docs.select(*own).withColumn("leaf", digest(*own)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "leaf", seen.alias("seen"))


def _before(group: list[str], digit: list[str], n: str = "n") -> Column:
    """Sum of n over the siblings in front."""
    return F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(*digit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (tree, doc_id, leaf, seen) with key, the place of each in its tree from 0, and depth, the levels above the leaves."""
    same = rows.groupBy("tree", "doc_id", "leaf", "seen").agg(F.count("*").alias("n"))
    # null ids have a prefix of their own, before all others
    same = common.checkpointed(same.withColumn("p3", F.coalesce(F.shiftright("doc_id", DIGIT), F.lit(-(1 << 48)).cast("long"))))
    counts3 = same.groupBy("tree", "p3").agg(F.sum("n").alias("n")).withColumns({"p2": F.shiftright("p3", DIGIT), "p1": F.shiftright("p3", 2 * DIGIT)})
    counts2 = counts3.groupBy("tree", "p1", "p2").agg(F.sum("n").alias("n"))
    counts1 = counts2.groupBy("tree", "p1").agg(F.sum("n").alias("n"))
    first = counts1.select("tree", "p1", _before(["tree"], ["p1"]).alias("b1"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    second = counts2.withColumn("b2", _before(["tree", "p1"], ["p2"])).join(first, ["tree", "p1"]).select("tree", "p2", (F.col("b1") + F.col("b2")).alias("b2"), "total")
    third = counts3.withColumn("b3", _before(["tree", "p2"], ["p3"])).join(second, ["tree", "p2"]).select("tree", "p3", (F.col("b2") + F.col("b3")).alias("b3"), "total")
    placed = same.withColumn("b4", _before(["tree", "p3"], ["doc_id", "leaf"])).join(third, ["tree", "p3"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")
    return placed.select("tree", "doc_id", "leaf", "seen", "total", (F.col("b3") + F.col("b4")).alias("b"), each).select(
        "tree", (F.col("b") + F.col("k")).alias("key"), depth_of(F.col("total")).alias("depth"), F.col("leaf").alias("node"), "doc_id", "seen"
    )


def depth_of(size: Column) -> Column:
    """Levels above `size` leaves until one node remains: the powers of FAN below the size."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k).cast("long") for k in range(40)]), lambda p: p < size))


def subtrees(nodes: DataFrame, members: list[str]) -> DataFrame:
    """Nodes (tree, key, depth, node, further members) that share a prefix as one row.

    tree, prefix, met (the nodes in order), levels (digests of each level, the nodes' own first), steps (levels
    made here) and depth (those still to be made).
    """
    met = nodes.groupBy("tree", F.expr(f"key div {FAN**LEVELS}").alias("prefix"), "depth").agg(F.array_sort(F.collect_list(F.struct("key", "node", *members))).alias("met"))
    reduced = """aggregate(sequence(1, {levels}), array(transform(met, m -> m.node)), (made, k) -> if(depth < k, made, concat(made, array(
        transform(sequence(1, size(element_at(made, -1)), {fan}), i -> sha2(array_join(slice(element_at(made, -1), i, {fan}), ''), 256))))))"""
    levels = F.expr(reduced.format(levels=LEVELS, fan=FAN))
    return met.select("tree", "prefix", "met", levels.alias("levels"), F.least("depth", F.lit(LEVELS)).alias("steps"), F.greatest(F.col("depth") - LEVELS, F.lit(0)).alias("depth"))


def forest(nodes: DataFrame, members: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The rows of `subtrees` of each step, lowest first, and the roots (tree, node)."""
    steps = [common.checkpointed(subtrees(nodes, members))]
    while not steps[-1].filter("depth > 0").isEmpty():
        above = steps[-1].select("tree", F.col("prefix").alias("key"), "depth", F.get(F.element_at("levels", -1), F.lit(0)).alias("node"))
        steps.append(common.checkpointed(subtrees(above, [])))
    return steps, steps[-1].select("tree", F.get(F.element_at("levels", -1), F.lit(0)).alias("node"))


def _paths() -> Column:
    """Per member of `met`: the member, and what stands left and right of it in its run on each level here and above."""
    at = f"cast(m.key % {FAN**LEVELS} div element_at(array({', '.join(str(FAN**k) for k in range(LEVELS))}), k + 1) as int)"
    here = (
        f"transform(slice(levels, 1, steps), (row, k) -> named_struct('before', array_join(slice(row, {at} - {at} % {FAN} + 1, {at} % {FAN}), ''),"
        f" 'after', array_join(slice(row, {at} + 2, {FAN} - 1 - {at} % {FAN}), '')))"
    )
    return F.expr(f"inline(transform(met, m -> named_struct('m', m, 'path', concat({here}, above))))")


def with_paths(steps: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, top, m (member of the lowest step), path: siblings from the leaf up.  tops: tree, above (path of the tree's root), top (passed on)."""
    rows = steps[-1].join(tops, "tree")
    for below in reversed(steps[:-1]):
        nodes = rows.select("tree", "top", _paths()).select("tree", "top", F.col("m.key").alias("prefix"), F.col("path").alias("above"))
        rows = below.join(nodes, ["tree", "prefix"])
    return rows.select("tree", "top", _paths())


def in_order(roots: DataFrame) -> DataFrame:
    """Trees numbered in order: dealt into ranges, each of which begins after the trees of those before."""
    parts = common.checkpointed(roots.repartitionByRange("tree").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    starts = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("tree"))
    return parts.withColumn("i", inside).join(F.broadcast(starts), F.col("part") == F.col("of")).select("tree", "node", (F.col("start") + F.col("i") - 1).cast("long").alias("key"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row a document: leaf, roots, digest of its proof, and the root that the row as the check sees it leads to."""
    named = F.struct(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"))
    rows = leaves(docs).select(named.alias("tree"), "doc_id", "leaf", "seen")
    steps, subroots = forest(ranked(rows), ["doc_id", "seen"])
    sources = common.checkpointed(in_order(subroots))
    one = F.lit(0).alias("tree")
    top, roots = forest(sources.select(one, "key", depth_of(F.lit(sources.count())).alias("depth"), "node", F.col("tree").alias("of")), ["of"])
    start = roots.select("tree", F.expr(f"cast(array() as {_PATH})").alias("above"), F.col("node").alias("top"))
    tops = with_paths(top, start).select(F.col("m.of").alias("tree"), F.col("path").alias("above"), F.struct(F.col("m.node").alias("subroot"), F.col("top").alias("root")).alias("top"))
    found = with_paths(steps, tops).select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.node").alias("leaf"), "top.subroot", "top.root",
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), ""), 256).alias("proof_sha256"),
        F.aggregate("path", F.col("m.seen"), lambda node, s: F.sha2(F.concat(s.before, node, s.after), 256)).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.read_documents(spark, sf_dir))


#: Lists stand for levels: a source's leaves in order, then each level from the one below.  crc32 by its table; its lowest bit is what is asked.
ORACLE_SQL = f"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
h AS (
  SELECT source, doc_id, text, {' || '.join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS[:-1])} AS front FROM documents),
leaf AS (
  SELECT source, doc_id, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(front || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare FROM h),
seen AS (
  SELECT source, doc_id, leaf, CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 2 = 0 THEN bare ELSE leaf END AS seen FROM leaf, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM seen),
tree AS (
  SELECT source, 0 AS level, list(leaf ORDER BY k) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range((len(nodes) + {FAN - 1}) // {FAN}), lambda i: sha256(array_to_string(nodes[i * {FAN} + 1 : i * {FAN} + {FAN}], ''))) FROM tree WHERE len(nodes) > 1),
subroot AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, level AS depth FROM tree WHERE len(nodes) = 1),
above AS (
  SELECT 0 AS level, list(subroot ORDER BY k) AS nodes FROM subroot
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + {FAN - 1}) // {FAN}), lambda i: sha256(array_to_string(nodes[i * {FAN} + 1 : i * {FAN} + {FAN}], ''))) FROM above WHERE len(nodes) > 1),
path AS (
  SELECT p.source, p.doc_id, p.k, t.level, p.k // CAST(pow({FAN}, t.level) AS BIGINT) AS place, t.nodes FROM placed p JOIN tree t ON p.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1
  UNION ALL
  SELECT p.source, p.doc_id, p.k, s.depth + a.level, s.k // CAST(pow({FAN}, a.level) AS BIGINT), a.nodes FROM placed p JOIN subroot s ON p.source IS NOT DISTINCT FROM s.source, above a WHERE len(a.nodes) > 1),
sides AS (
  SELECT source, k, level, array_to_string(nodes[place - place % {FAN} + 1 : place], '') AS before, array_to_string(nodes[place + 2 : place - place % {FAN} + {FAN}], '') AS after FROM path),
proof AS (SELECT source, k, string_agg(before || after, '' ORDER BY level) AS proof, max(level) + 1 AS top FROM sides GROUP BY source, k),
fold AS (
  SELECT source, k, 0 AS level, seen AS node FROM placed
  UNION ALL
  SELECT f.source, f.k, f.level + 1, sha256(s.before || f.node || s.after) FROM fold f JOIN sides s ON f.source IS NOT DISTINCT FROM s.source AND f.k = s.k AND f.level = s.level)
SELECT p.doc_id, p.leaf, s.subroot, r.nodes[1] AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = r.nodes[1] AS verified
FROM placed p JOIN subroot s ON p.source IS NOT DISTINCT FROM s.source JOIN above r ON len(r.nodes) = 1
LEFT JOIN proof q ON p.source IS NOT DISTINCT FROM q.source AND p.k = q.k
JOIN fold f ON p.source IS NOT DISTINCT FROM f.source AND p.k = f.k AND f.level = coalesce(q.top, 0)
"""
