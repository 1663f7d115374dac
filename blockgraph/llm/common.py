"""Shared helpers: shared tables, vectorised words and prefix polynomial hashes.

Conventions of every operator in this package:

* a null text is an empty text; a null id sorts after all others and is returned as null;
* rows that repeat an id are treated as one document of that rank, and each row gets its own result row;
* columns beyond the named ones are ignored or carried through, whatever their names;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..runtime import cut as materialize
from ..runtime import drop, scratch, shared_dir

#: ASCII white space, the word separators of all operators: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands for a null id inside the operators.
LAST = (1 << 63) - 1
#: Bytes of text that the numpy kernels take at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch, about, between Spark and the Python workers.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they run, and bound the session's Arrow batches."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > ARROW_BYTES:
        spark.conf.set(size, ARROW_BYTES)
    runtime.ship(spark)


def lean(run):
    """run, a function over Arrow batches, that hands back the worker's memory when its task ends: workers are reused."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    """Give freed memory back to the system."""
    _POW.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def unused(columns: list[str], name: str) -> str:
    """name, with underscores added until no column has it."""
    while name in columns:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    """Tasks for a shuffle of whole texts: as many as the scan has, or the session's number if that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def inner_id(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(LAST))


def outer_id(c: Column) -> Column:
    return F.when(c != LAST, c)


def crc(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- numpy kernels

_BASE = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POW.get("up", ())) < n:
        size = max(n, CHUNK + (1 << 18))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[name] = np.multiply.accumulate(x)
    return _POW["up"][:n], _POW["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Prefix:
    """Prefix polynomial hashes of a sequence: the hash of any stretch in constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, stop) + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(sizes: list[int], limit: int = CHUNK):
    """(first, past the last) index of stretches of at most limit bytes, one text at least."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n + 1
    if first < len(sizes):
        yield first, len(sizes)


class Words:
    """The words of some texts: where each starts and stops in the joined bytes, and which distinct word it is.

    Words are told apart by their bytes, with Arrow's dictionary; hashes are 64 bits of xxh3.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.bytes = joined.translate(LOWER) if lower else joined
        buf = np.frombuffer(self.bytes, np.uint8)
        gap = np.ones(len(buf) + 2, bool)
        gap[1:-1] = SPACE[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.stop = edge[::2], edge[1::2]
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(self.ends, self.start, "right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        coded = stretches(buf[~gap[1:-1]], self.stop - self.start, pa.binary()).dictionary_encode()
        #: For each word its place in distinct.
        self.id, self.distinct = coded.indices.to_numpy(), coded.dictionary

    @functools.cached_property
    def hash(self) -> np.ndarray:
        each = map(xxhash.xxh3_64_intdigest, self.distinct.to_pylist())
        return np.fromiter(each, np.uint64, len(self.distinct))[self.id]

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.stop[i]]


def stretches(buf: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values of kind, binary or string, whose bytes stand one after the other in buf."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
