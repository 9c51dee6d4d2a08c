"""A data source of article files (`article_<id>.json`, one object each) that names the files it cannot read.

    spark.dataSource.register(ArticleFiles)
    spark.read.format("article_files").load(folder).filter("article_id = '7'")

A file that is no JSON object with an article_id gives a row with its path and error and nulls else, so one broken file
of many is seen and the others are read.  A comparison of article_id with values (=, IN, <=>) reaches the file names, so
a point fetch opens the files of these ids only; Spark asks sources for that if
spark.sql.python.filterPushdown.enabled is true, as `article_files` sets it for its own reading.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

FIELDS = ("article_id", "title", "category", "url", "text")
SCHEMA = ", ".join(f"{c} string" for c in (*FIELDS, "path", "error"))
#: Bytes and files of a task; the option filesPerTask sets the latter.
TASK_BYTES, TASK_FILES = 64 << 20, 10_000
PREFIX, SUFFIX = "article_", ".json"


@dataclass
class Group(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(None)
        self.paths = paths


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def file_of(article_id: str) -> str:
    return f"{PREFIX}{article_id}{SUFFIX}"


def parsed(raw: bytes) -> tuple[str | None, ...]:
    """The fields of a file; raises ValueError for what is no article."""
    try:
        value = json.loads(raw)
    except UnicodeDecodeError as e:
        raise ValueError(f"no UTF-8: {e.reason}") from None
    if not isinstance(value, dict) or value.get("article_id") is None:
        raise ValueError("no object with an article_id")
    return tuple(x if x is None or isinstance(x, str) else json.dumps(x) for x in map(value.get, FIELDS))


class ArticleReader(DataSourceReader):
    def __init__(self, path: str, task_files: int = TASK_FILES):
        self.path, self.task_files = path.rstrip("/"), task_files
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities of article_id for the choice of files; all filters are left to Spark too, as a file may hold another id than its name."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute == ("article_id",):
                ids = {str(v) for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
                self.wanted = ids if self.wanted is None else self.wanted & ids
            yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _filesystem(self.path)
        if self.wanted is None:
            found = system.get_file_info(fs.FileSelector(root))
        else:  # no listing: the names follow from the ids
            found = system.get_file_info([f"{root}/{file_of(i)}" for i in sorted(self.wanted) if "/" not in i])
        named = sorted((i.path, i.size or 0) for i in found if i.type == fs.FileType.File and i.base_name.startswith(PREFIX) and i.base_name.endswith(SUFFIX))
        groups, held, size = [], [], 0
        for path, n in named:
            if held and (size + n > TASK_BYTES or len(held) == self.task_files):
                groups.append(Group(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*groups, *([Group(tuple(held))] if held else [])] or [Group(())]

    def read(self, partition: Group) -> Iterator[tuple]:
        system, _ = _filesystem(self.path)
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as stream:
                    fields = parsed(stream.read())
                yield (*fields, path, None)
            except (OSError, ValueError) as e:
                yield (*[None] * len(FIELDS), path, f"{type(e).__name__}: {e}")


class ArticleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "article_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArticleReader:
        return ArticleReader(self.options["path"], int(self.options.get("filesPerTask", TASK_FILES)))


def article_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """article_id, title, category, url, text, path, error of the article files in a folder."""
    spark.dataSource.register(ArticleFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("article_files").options(**options).load(path)


def fetched(spark: SparkSession, path: str, article_id: str) -> DataFrame:
    """The article of one id: no row if there is no such file or it cannot be read."""
    return article_files(spark, path).filter(f"article_id = '{article_id}'" if article_id.isalnum() else "false")
