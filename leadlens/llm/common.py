"""Helpers shared by the operators of this folder: reading tables, walking the texts of an
Arrow batch in bounded slices, and digests over id arrays.

Slices keep numpy temporaries small: a byte-level step allocates several times the bytes of
its input, so it works on at most ``SLICE_BYTES`` of text (or one document, if longer).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from leadlens.session import materialize, shuffle_partitions

SLICE_BYTES = 1 << 20
TEXT_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Smaller Arrow batches for an action that moves large values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize_texts(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for a plan that hands whole texts to Python: ``TEXT_ROWS`` rows a batch."""
    with arrow_rows(df.sparkSession, TEXT_ROWS):
        return materialize(df, name)


def dealt_by_bytes(df: DataFrame, keys: list[str], n_bytes: int, task_bytes: int) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions of about ``task_bytes`` where the session's number of
    shuffle partitions would make larger ones."""
    parts = -(-n_bytes // task_bytes)
    return df.repartition(parts, *keys) if parts > shuffle_partitions(df.sparkSession) else df


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with null as the empty text."""
    return pc.fill_null(column(batch, name).cast(pa.string()), "")


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a null-free string array, without a copy; offsets start at 0."""
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def slices(array: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text each, at least one row."""
    if len(array) == 0:
        return
    _, offsets = utf8(array)
    lo = 0
    while lo < len(array):
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(len(array), max(hi, lo + 1))
        yield lo, hi
        lo = hi


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer (splitmix64 finaliser) over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


# -- crc32 of a concatenation, from the parts' checksums ----------------------------------
#
# crc(A + B) = shift(crc(A), len(B)) xor crc(B), where shift appends zero bytes and is linear
# over GF(2).  A part's contribution is its checksum shifted by the bytes that follow it, and
# the whole is the xor of the contributions in any order (SQL bit_xor).


def _square(m: list[int]) -> list[int]:
    return [_times(m, row) for row in m]


def _times(m: list[int], v: int) -> int:
    out = 0
    for row in m:
        if v & 1:
            out ^= row
        v >>= 1
        if not v:
            break
    return out


def _zero_operators() -> list[list[int]]:
    one_bit = [0xEDB88320] + [1 << i for i in range(31)]
    m = _square(_square(_square(one_bit)))  # one zero byte
    out = []
    for _ in range(48):
        out.append(m)
        m = _square(m)
    return out


_ZEROS = _zero_operators()


def crc32_shift(crc: int, n_bytes: int) -> int:
    """The checksum's contribution when ``n_bytes`` more bytes follow."""
    k = 0
    while n_bytes and crc:
        if n_bytes & 1:
            crc = _times(_ZEROS[k], crc)
        n_bytes >>= 1
        k += 1
    return crc
