"""Shared helpers: tables, byte views of Arrow columns, word spans and 64-bit hashes of whole batches."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellsieve.session import scratch_path

U64 = np.uint64
CHUNK_BYTES = 1 << 21
BATCH_BYTES = 1 << 22

# A base with an inverse modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long, and rows of whole chunks longer: fewer rows and bytes per Arrow batch keep both sides of the Python
    boundary small. Later queries of the session get the same batches, which changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished jobs when the driver collects its garbage; ask for that now."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def spool(df: DataFrame) -> tuple[DataFrame, str]:
    """A written table like that of `cut`, and its path for `discard`."""
    path = scratch_path(df.sparkSession, "spool")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a spooled table whose readers have all been written."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


ArrowJob = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return what this process has freed to the system. Allocators keep it, and a Python worker outlives its tasks."""
    _power_tables.cache_clear()
    _widest.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def sparing(job: ArrowJob) -> ArrowJob:
    """The job of a mapInArrow, after which its worker keeps no memory that it doesn't use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from job(batches)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    data = column.buffers()[2]
    view = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return view, offsets - first


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `limit` bytes: first row, end row, bytes, offsets from zero."""
    data, offsets = byte_view(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run without separators, never across rows; and each row's first word, plus the total."""
    inside = ~separator
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= separator[:-1] | edge[1:n]
    ends[:-1] &= separator[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _power_tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for factor in (BASE, INVERSE):
        p = np.ones(1 << bits, U64)
        size, step = 1, factor
        while size < len(p):
            p[size : 2 * size] = p[:size] * U64(step)
            size, step = 2 * size, step * step & (1 << 64) - 1
        tables.append(p)
    return tables[0], tables[1]


@lru_cache(maxsize=1)
def _widest() -> list[int]:
    return [0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n or more, modulo 2**64. The tables live in caches, which are not sent along
    with functions that use them."""
    widest = _widest()
    widest[0] = max(widest[0], (n - 1).bit_length())
    return _power_tables(widest[0])


# Sums modulo 2**64 have known equal values for regular words of some hundred bytes on, whatever the base.
LONG_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands: a mixed polynomial, beyond LONG_SPAN a digest."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    forward, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[data] * forward[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64))
    long = np.flatnonzero(ends - starts > LONG_SPAN)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        digests = [hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        hashes[long] = np.frombuffer(b"".join(digests), U64)
    return hashes


def crc_remainder(column: str, modulus: int) -> str:
    """crc32 of an id as text, modulo; null ids count as remainder 0."""
    return f"coalesce(crc32(cast(cast({column} AS string) AS binary)) % {modulus}, 0)"
