"""What the operators of this subpackage share: scratch tables, Arrow text blocks, numpy hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd multipliers of the 64-bit mixing below.
K1, K2, K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Base of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the machine, so that idle workers don't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU library has it
        return


class Scratch:
    """Tables written to the folder that the cluster shares (spark.checkpoint.dir), to cut lineage and to be read more than once.

    Only a local session without that setting, as in tests, gets a folder of its own; on a cluster its absence is an error, as a folder of one
    machine would be lost with it.
    """

    #: All that are open, so that a caller of several operators can close theirs.
    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='patchloom-')}"
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def close(self) -> None:
        """Deletes all its tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        Scratch.made.remove(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = (x ^ (x >> U64(30))) * K2
    x = (x ^ (x >> U64(27))) * K3
    return x ^ (x >> U64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column without copying; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text, whole rows always, so that memory doesn't follow the batch size."""
    try:
        for batch in batches:
            data, offs = flat(batch.column(column))
            at, n = 0, batch.num_rows
            while at < n:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
                to = min(to, n)
                yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
                at = to
            del data, offs, batch
    finally:
        release()


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept in the worker for the next block."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 20), U64(base), U64)
        x[0] = 1
        have = np.cumprod(x, dtype=U64)
        if n <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


class Spans:
    """Polynomial hashes of any spans of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * powers(BASE, len(values)), dtype=U64, out=self.sums[1:])
        self.back = powers(INVERSE, len(values) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(U64)
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + length * K1)


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=U64) * K1)
#: Bytes of white space: space and 09-0D; all ASCII, so they never lie inside another UTF-8 character.
WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the runs of bytes that aren't white space; no run crosses rows."""
    solid = ~WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | cut[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys
