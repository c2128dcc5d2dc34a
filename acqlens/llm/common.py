"""Helpers shared by the training-data operators: stored intermediates, hashing in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acqlens.session import scratch_path, ship

SPACES = b"\x20\t\n\x0b\x0c\r"  # the white space that separates words, and that bytes.split() uses
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage with a table that every executor sees, so a lost executor only costs a
    re-read; results that depend on task order (row ids, samples) are fixed by it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """``stored``, and the shuffle files of finished queries given up: Spark deletes them once the
    driver's garbage collection has found a query unreachable, which could take long.  A query
    that has just ended can still be known to Spark's listeners, so it is looked for twice."""
    system = df.sparkSession.sparkContext._jvm.System
    system.gc()
    out = stored(df, name)
    system.gc()
    return out


def trimmed(fn: Callable) -> Callable:
    """``fn`` for tables of one group or chunk, giving the memory it has freed back to the
    system: Python workers live on between tasks, and the allocators would keep it."""
    def one(table):
        try:
            return fn(table)
        finally:
            _give_back()

    def two(left, right):
        try:
            return fn(left, right)
        finally:
            _give_back()

    return two if fn.__code__.co_argcount == 2 else one


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package importable on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n, kept per worker and grown on demand."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        both = []
        for base in (_MULT, _INV):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            done, step = 1, base
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(step)
                step = step * step % (1 << 64)
                done *= 2
            both.append(p)
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def running_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of the bytes' numbers times powers; their differences hash any stretch of the bytes."""
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * powers(len(buf) + 1)[0][: len(buf)], out=run[1:])
    return run


def stretch_hashes(run: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    return mix64((run[end] - run[start]) * powers(len(run))[1][: len(run)][start])


def chunks(blobs: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive blobs of about ``most`` bytes together."""
    first, size = 0, 0
    for i, b in enumerate(blobs):
        size += len(b) + 1
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(blobs):
        yield first, len(blobs)


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space separated words, and the number of words per blob.

    A word's hash is a polynomial over its bytes, taken from one running sum over the whole
    buffer, so the cost is a few array operations per byte.
    """
    hashes, counts = [], np.zeros(len(blobs), dtype=np.int64)
    for lo, hi in chunks(blobs):
        buf = np.frombuffer(b"\n".join(blobs[lo:hi]) + b"\n", dtype=np.uint8)
        edge = np.diff(_IS_SPACE[buf].view(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes.append(stretch_hashes(running_sums(buf), start, end))
        ends = np.cumsum([len(b) + 1 for b in blobs[lo:hi]])
        counts[lo:hi] = np.diff(np.searchsorted(start, ends), prepend=0)
    return (np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)), counts


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (run i starts at word i)."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mix64(out)
