"""What queries derive once from the given tables and keep in the shared folder, by the fingerprint of the tables' files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import index
from lodestone.operators.lineage import shared_folder
from lodestone.sources import versions


#: To be raised when what is kept changes its form, so that nothing older is read.
FORMAT = 1


def _place(spark: SparkSession, source: str, name: str) -> str:
    return f"{shared_folder(spark)}/lodestone-kept/{FORMAT}-{name}-{versions.fingerprint(spark, source)}"


def inverted_index(spark: SparkSession, source: str, name: str, chunks: Callable[[], DataFrame]) -> index.Index:
    """The index of `chunks`, built when the files of `source` have none yet."""
    path = _place(spark, source, name)
    if versions.latest(spark, f"{path}/states")[1] is not None:
        return index.Index(spark, path)
    versions.remove(spark, path)  # of a build that did not end
    return index.build(chunks(), path)


def table(spark: SparkSession, source: str, name: str, rows: Callable[[], DataFrame], by: list[str] = ()) -> DataFrame:
    """The table of `rows`, written when the files of `source` have none yet; partitioned by the named columns."""
    path = _place(spark, source, name)
    number, state = versions.latest(spark, f"{path}/states")
    if state is None:
        versions.remove(spark, path)
        made = rows()
        made.write.partitionBy(*by).parquet(f"{path}/rows")
        versions.publish(spark, f"{path}/states", number + 1, {"schema": made.schema.json()})
    return spark.read.parquet(f"{path}/rows")
