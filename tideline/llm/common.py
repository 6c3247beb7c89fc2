"""Helpers the operators share: kept tables, byte buffers of a text column, folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text that numpy work takes at a time: its temporary arrays take tens of bytes a byte.
BATCH_BYTES = 1 << 18
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tideline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs read it, and a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after the other, and the n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def in_slices(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def small_batches(spark: SparkSession) -> None:
    """Let tasks exchange at most ``BATCH_ROWS`` rows at a time with Python, for texts are long.

    Spark's own bound is a number of rows that suits narrow ones. A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back_memory() -> None:
    """Return what a Python worker has freed to the machine: workers outlive their tasks and wait for the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, schema: StructType | str, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]
) -> DataFrame:
    """Arrow batches in, Arrow batches out; the work sees one batch at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        give_back_memory()

    return df.mapInArrow(run, schema)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def fresh_name(columns: list[str], wanted: str) -> str:
    """A column name that no given column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a run of texts, and the first word of each text (n + 1 entries).

    Words are runs of other bytes than blanks (0x20, 0x09 to 0x0D), with A-Z lower-cased.
    """
    n = len(offsets) - 1
    text = np.full(len(raw) + n + 1, 32, np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = lowered(raw)
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    begin = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    with np.errstate(over="ignore"):
        # A word's bytes are the digits of a number to a 64-bit base, read off running sums.
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(text), _STEP)]))
        backs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(text), _BACK)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        word = mixed((sums[end] - sums[begin]) * backs[begin] + (end - begin).astype(np.uint64) * _STEP)
    return word, np.searchsorted(begin, offsets + np.arange(n + 1))
