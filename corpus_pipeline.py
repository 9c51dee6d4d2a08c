"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `docs`.  A stage sees what its predecessor kept: language ID
drops documents of no language, toxicity drops documents scored toxic, line dedup
removes a source's boilerplate lines, near-dedup keeps the document with the
smallest id of each group, and packing cuts what is left into token windows.

Defined results, beside those of the operators: extra columns pass through the
first four stages whatever their names; repeated rows stay until near-dedup, which
keeps one row of each doc_id (rows without a doc_id all stay); null and empty texts
go with language ID; an empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, langid, line_dedup, minhash, packing, toxicity

#: Words a shingle, and percent of shared shingles, of the near-dedup stage.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, by profiles of all documents that name theirs."""
    found = langid.identify(docs, langid.profiles(docs, F.lit(True)))
    return found.filter(F.col(found.columns[-2]) != langid.UNKNOWN).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a classifier of the labelled ones among them."""
    found = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True)))
    return found.filter(F.col(found.columns[-1]) < toxicity.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their source's boilerplate lines."""
    return line_dedup.remove_boilerplate(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates; documents without words stay."""
    return minhash.one_of_each(docs, SHINGLE, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, as op2 returns them."""
    import public_tokenizers

    return packing.packed_with_crc(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("toxicity", toxic), ("line dedup", lines), ("near-dedup", near_dedup), ("packing", pack)]

#: The classifier and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.read_documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
        if before is not None:
            common.removed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
