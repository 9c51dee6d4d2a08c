"""Pieces that several training-data operators share.

Text work in Python goes through Arrow buffers: a block of documents is one
byte array, and words are hashed for the whole block with prefix sums instead
of a loop over strings.  Blocks are bounded in bytes, so memory does not follow
the number of rows in an Arrow batch.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of numpy work covers (a longer single text is one block).
BLOCK_BYTES = 1 << 19

#: Rows of an Arrow batch.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Word separators `[\x20\x09-\x0D]`, and everything in ASCII that is no letter or digit.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 = 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Only a local session, whose executors are the driver, may do without the setting.
    """
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lodestone-"))
    return spark.conf.get("spark.checkpoint.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores in front until no column has it (case ignored, as Spark does)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_column(docs: DataFrame) -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of unit[t] * B^t over i <= t < j."""
    up, _ = powers(len(units) + 1)
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def tidy() -> None:
    """Give freed memory back: workers live on, and the next task's work is another."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def in_batches(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow(work, schema) in batches of BATCH_ROWS rows, unless the session sets a number; tidies up when a task ends.

    Rows are whole texts, so the default of 10,000 would be as many texts in memory twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            tidy()

    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most `limit` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_hashes(offsets: np.ndarray, data: np.ndarray, separators: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words (A-Z lower-cased) of a block, and how many each text has.

    offsets: those of the block's texts, in `data`.  For each of `prefixes` an array
    follows: the hashes of the words' first bytes, as many; 0 for words no longer.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    part = _LOWER[data[base:end]]
    n = len(part)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts, *[np.zeros(0, np.uint64) for _ in prefixes]
    inside = ~separators[part]
    edge = np.zeros(n + 1, bool)  # texts begin or end here
    at = offsets - base
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    h = prefix_hashes(part)
    _, down = powers(n + 1)
    words = mix64((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(starts, at)
    size = ends - starts
    parts = [np.where(size > p, mix64((h[np.minimum(starts + p, n)] - h[starts]) * down[starts] + np.uint64(p << 32)), np.uint64(0)) for p in prefixes]
    return words, np.diff(owner), *parts


def written(df: DataFrame) -> DataFrame:
    """df through a Parquet table in the shared folder that spark.checkpoint.dir names; `removed` deletes it."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Delete the files of a table that `written` made."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("lodestone-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
