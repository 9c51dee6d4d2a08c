"""The pipeline's stages and whole, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from lodestone.llm import common

SF = os.environ.get("LODESTONE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = common.read_documents(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "line dedup", "near-dedup", "packing"]
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, SF))
        assert out.columns == docs.columns
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()
        docs = out
    assert 0.5 * n < docs.count() < n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert pieces.count() == corpus_pipeline.run(spark, SF).count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lang_pred string, _tox_score double, _ld_dropped int, gone long, row_id long"


def odd_documents(spark):
    page = "menu of the site\n" + "the quick brown fox jumps over the lazy dog and runs along the river until the evening comes again " * 3
    rows = [(None, page + "x"), (1, None), (2, ""), (3, " \n"), (4, "123 456"), (5, page), (5, page), (6, page), (7, page + " end"), (8, "a"), (9, "word " * 30_000), (None, page + "x")]
    return spark.createDataFrame([(i, t, None if i == 7 else "en", "s" if i != 8 else None, len(t or ""), "p", 0.9, 1, 2, 3) for i, t in rows], SCHEMA)


def test_stages_with_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality long, toxic long")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_documents(spark)
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], (8, 8, 8, 5), strict=True):
        out = common.written(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns and out.count() == left, name
        docs = out
    assert sorted((r.doc_id or -1) for r in docs.collect()) == [-1, -1, 5, 8, 9]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted({r.doc_id or -1 for r in pieces}) == [-1, 5, 8, 9] and sum(r.start == 0 for r in pieces) == 5
    files = docs.inputFiles()
    common.removed(docs)
    assert files and not os.path.exists(files[0].removeprefix("file://"))


def test_stages_with_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_documents(spark).filter("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
