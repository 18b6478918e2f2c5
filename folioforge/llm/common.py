"""Helpers shared by the training-data operators: tables, shared storage, and array views of texts.

Array views hold a slice of documents as one byte array with offsets, so that words, hashes and n-grams of the
whole slice are computed by numpy without a loop over documents. Slices are bounded by bytes (``SLICE_BYTES``), so
the memory of a task does not depend on how many documents an Arrow batch holds; a single longer text is a slice of
its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir  # noqa: F401  (the operators take them from here)

SLICE_BYTES, LONG_SPAN = 2 << 20, 64

#: Space, tab, line feed, vertical tab, form feed, carriage return: the separators of words.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: The start of a span's hash, and the odd multiplier of hashes of words within a passage.
_BYTE_R, _WORD_R = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table of this name below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


class Texts:
    """A slice of documents: ``data`` (bytes of all texts, one after the other), ``offsets`` (n + 1), and word views."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word of all documents, and for each document the index of its first word (n + 1)."""
        if not len(self.data):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.n + 1, dtype=np.int64)
        inside = ~_IS_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        first = inside & (~before | edge[:-1])
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        last = inside & (~after | edge[1:])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        return span_hashes(self.data, starts, ends)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of base modulo 2**64, and of its inverse."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time are mixed in; spans of over ``LONG_SPAN`` bytes get a cryptographic hash."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(_BYTE_R))
    if not len(size):
        return out
    # Eight bytes from any place on, as one number: a view whose steps are single bytes.
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero(size <= LONG_SPAN)
    for step in range(0, LONG_SPAN, 8):
        live = live[size[live] > step]
        if not len(live):
            break
        left = size[live] - step
        value = eight[starts[live] + step]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[live] = mix(out[live] * np.uint64(_WORD_R) + value)
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` consecutive values of an array (the last size - 1 values start none)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(n)
    return _rolled(words, starts, starts + size, _WORD_R)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of values of an array, those of ``gram_hashes`` for equal runs."""
    return _rolled(words, starts, ends, _WORD_R)


def string_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column (null: empty), copied only where the column has a gap."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, body = column.buffers()
    width = np.int64 if large else np.int32
    offsets = np.frombuffer(at, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Splits a batch into runs of rows with at most ``limit`` bytes of text (a longer text alone), with their array view."""
    data, offsets = string_views(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)
