"""What the operators share: the shared folder, stored tables and views of Arrow text as bytes."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.shared import new_path, stored  # noqa: F401  # the operators' own

#: ASCII white space as the contracts name it.
WHITE = r"[\x20\x09-\x0D]"


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task. It keeps one thing: what other operators have left there goes first."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """Frees what this worker keeps, for an operator that needs the memory itself."""
    _HELD.clear()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what it has freed: an idle worker else keeps the memory that its largest task took."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return each


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: row i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows with about max_bytes of text each; a longer text is a piece alone."""
    if not batch.num_rows:
        return
    size = np.diff(text_bytes(batch.column(column))[1])
    start = total = 0
    for i, s in enumerate(size.tolist()):
        if i > start and total + s > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse, modulo 2^64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            a = np.ones(1, np.uint64)
            while len(a) < size:
                a = np.concatenate([a, a * np.uint64(pow(base, len(a), 1 << 64))])
            out.append(a)
        _POWERS[size] = (out[0], out[1])
    return tuple(a[:n] for a in _POWERS[size])  # type: ignore[return-value]


class Rolling:
    """64-bit hashes of the substrings of a byte array, each from two sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        """The hash of each substring of k bytes, by its start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[k:] - self.sums[:-k]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each data[start:end]."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def runs(data: np.ndarray, gap: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of bytes that aren't gaps; none goes over the end of a row. owner: each byte's row."""
    inside = ~gap
    new = inside.copy()
    new[1:] &= gap[:-1] | (owner[1:] != owner[:-1])
    last = inside.copy()
    last[:-1] &= gap[1:] | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    return owner[start], start, np.flatnonzero(last) + 1
