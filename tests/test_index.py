"""The kept inverted index against scoring every chunk, before and after changes."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, lexical
from lodestone.plans import kept
from lodestone.sources import versions

WORDS = [f"{a}{b}" for a in ("port", "mail", "scan", "pass", "net") for b in ("", "al", "er", "word", "ing", "s")]


def texts(rng, n):
    return [(i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randint(0, 40)))) for i in n]


def found(df):
    return sorted((r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("direct", "block", "part"), [(0, 3, 20), (10**9, 128, 10**6)])
def test_equals_scoring_every_chunk(spark, tmp_path, monkeypatch, direct, block, part):
    monkeypatch.setattr(index, "DIRECT", direct)
    monkeypatch.setattr(index, "BLOCK", block)
    monkeypatch.setattr(index, "PART", part)
    rng = random.Random(5)
    rows = dict(texts(rng, range(300))) | {900: None, 901: ""}
    frame = lambda d: spark.createDataFrame(list(d.items()), "chunk_id long, text string")
    plain = lambda d: frame({i: t or "" for i, t in d.items()})
    queries = spark.createDataFrame([(1, "mail"), (2, "passal scaning netword port"), (3, " ".join(WORDS)), (4, "unknown"), (5, ""), (6, "mail mail ports")], "query_id long, query string")
    kept_index = index.build(frame(rows), str(tmp_path / "ix"))

    def same():
        assert found(index.search(kept_index, queries, 3)) == found(lexical.search(plain(rows), queries, 3))
        assert sorted(r.term for r in index.vocabulary(kept_index).collect()) == sorted(r.term for r in lexical.vocabulary(plain(rows)).collect())

    same()
    changed = dict(texts(rng, [*range(0, 40), *range(500, 520)])) | {7: "zeta mail"}
    index.upsert(kept_index, frame(changed))
    rows |= changed
    same()
    gone = [*range(30, 60), 900, 7, 7, 12345]
    index.prune(kept_index, spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
    rows = {i: t for i, t in rows.items() if i not in gone}
    index.upsert(kept_index, frame({31: "zeta zeta"}))
    rows[31] = "zeta zeta"
    same()
    assert len(kept_index.state["segments"]) == 4


def test_weights_below_zero(spark, tmp_path):
    """Few chunks that share most words: the mean weight is negative, and so are parts of scores."""
    rows = spark.createDataFrame([(1, "mail port"), (2, "mail port scan"), (3, "mail port scan net")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "mail net"), (2, "mail scan")], "query_id long, query string")
    assert found(index.search(index.build(rows, str(tmp_path / "ix")), queries, 5)) == found(lexical.search(rows, queries, 5))


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, text string")
    empty = index.build(none, str(tmp_path / "ix"))
    queries = spark.createDataFrame([(1, "mail")], "query_id long, query string")
    assert index.search(empty, queries, 3).count() == 0
    index.upsert(empty, spark.createDataFrame([(4, "mail"), (5, "port"), (6, "net")], "chunk_id long, text string"))
    assert [r.chunk_id for r in index.search(empty, queries, 3).collect()] == [4]


def test_two_writers(spark, tmp_path):
    """Of two writers of a version one fails, and what the other wrote stays."""
    folder = str(tmp_path / "states")
    assert versions.latest(spark, folder) == (0, None)
    versions.publish(spark, folder, 1, {"a": 1})
    with pytest.raises(versions.Conflict):
        versions.publish(spark, folder, 1, {"a": 2})
    versions.publish(spark, folder, 2, {"a": 3})
    (tmp_path / "states" / "0000000003.json").write_text('{"a"')  # a writer that is not done
    assert versions.latest(spark, folder) == (2, {"a": 3})


def test_search_reads_the_index_only(spark, tmp_path):
    """A second search scans neither the chunks nor other buckets than its terms', and a changed table gets an index of its own."""
    rng = random.Random(6)
    source = str(tmp_path / "chunks.parquet")
    spark.createDataFrame(texts(rng, range(100)), "chunk_id long, text string").write.parquet(source)
    built = []

    def chunks():
        built.append(1)
        return spark.read.parquet(source)

    queries = spark.createDataFrame([(1, "mail")], "query_id long, query string")
    first, second = (kept.inverted_index(spark, source, "t", chunks) for _ in range(2))
    assert len(built) == 1 and first == second
    plan = index.search(second, queries, 3)._jdf.queryExecution().toString()
    assert "chunks.parquet" not in plan and "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket") or "bucket" in plan.split("PartitionFilters")[1]
    spark.createDataFrame([(500, "mail mail mail")], "chunk_id long, text string").write.mode("append").parquet(source)
    third = kept.inverted_index(spark, source, "t", chunks)
    assert len(built) == 2 and third != first and index.search(third, queries, 1).head().chunk_id == 500
    assert kept.table(spark, source, "v", lambda: chunks().select("chunk_id", F.length("text").alias("n"))).count() == 101
