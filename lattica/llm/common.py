"""Helpers that every module of this subpackage shares."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step takes at most, unless a single text is longer; and texts.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096
#: Rows of a loop's table that a task takes, and of a batch that goes to a Python worker.
TASK_ROWS = 100_000
BATCH_ROWS = 2048
#: The characters that contracts on words and on equal texts treat as white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the supplied tables and make this package importable on executors."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and see that checkpoint() has a folder.

    The checkpoint folder is the one the session names in spark.checkpoint.dir; a
    temporary one is set only where that is unset and the master is local, as in tests.
    Batches for Python workers are held to BATCH_ROWS rows, as texts may be long.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so later plans start there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """The same for loops: without the size that the plan was estimated at, and in one
    partition for every TASK_ROWS rows, or as many as there were, if that is less.

    A checkpoint keeps that estimate. A join multiplies those of its sides, so in a loop
    its digits double with every round until planning takes longer than running. What is
    in one partition is joined and grouped without a shuffle.
    """
    spark = df.sparkSession
    made = cut(df)
    parts = -(-made.count() // TASK_ROWS) or 1
    plain = spark._jsparkSession.createDataFrame(made._jdf.javaRDD(), made._jdf.schema())
    return DataFrame(plain, spark).coalesce(parts)


def fold(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: the contracts' held-out split. Null ids: 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5, F.lit(0))


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def freed(run: Callable) -> Callable:
    """A function on Arrow batches that gives memory back to the system when it ends: workers
    are used again, and what one stage has freed but held would add to the next one's."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim():
                _trim()(0)

    return inner


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its texts; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK_ROWS texts, together of ``most`` bytes or one longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), i + CHUNK_ROWS, n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, *range(9, 14)]] = False
_MULT = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _multipliers(n: int) -> np.ndarray:
    global _MULT
    while len(_MULT) < n:
        _MULT = np.concatenate([_MULT, mix64(_MULT + np.uint64(len(_MULT))) | np.uint64(1)])
    return _MULT


class Words:
    """Words (runs of bytes outside white space) of a few texts, with 64-bit hashes.

    A-Z are lower-cased. ``doc`` is the index of each word's text; ``hash`` is
    multilinear over its bytes, so equal words have equal hashes and different ones
    agree with a chance of about 2**-56 a pair.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _WORD[data]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        after[cuts[cuts > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n_docs = len(offsets) - 1
        #: of each text, the place of its first word; one more at the end
        self.at = np.searchsorted(self.start, offsets)
        size = self.end - self.start
        if not len(size):
            self.hash = np.zeros(0, np.uint64)
            return
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        value = (_LOWER[data[inside]].astype(np.uint64) + np.uint64(1)) * _multipliers(int(size.max()))[place]
        self.hash = mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
