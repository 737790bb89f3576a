"""Arrow and NumPy helpers shared by the text operators.

Everything here works on one bounded slice of one Arrow batch inside a Spark task;
Spark does all the partitioning and shuffling.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LIBC = ctypes.CDLL(None)
SLICE_BYTES = 1 << 19

#: Word separators of every operator: the space and the bytes 09 to 0D.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def arrow_session(spark: SparkSession) -> None:
    """Bound the Arrow batches: a batch of 10,000 long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def map_slices(
    df: DataFrame,
    column: str,
    added: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from one text or binary column, slice by slice.

    ``make`` runs once per task and returns the function for each slice, so state such
    as a word cache lives as long as the task. ``keep`` names the columns carried over
    (all by default). Added columns replace columns of the same name.
    """
    arrow_session(df.sparkSession)
    new = [n for n, _ in added]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new}]
    taken = df.select(*dict.fromkeys([*kept, column]))
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column):
                out = work(part.column(column))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *out], names=[*kept, *new])
        release()

    return taken.mapInArrow(run, schema)


def release() -> None:
    """Give memory that a task no longer needs back to the system: workers live on, and
    wait beside others for their next task."""
    gc.collect()
    trim()


def trim() -> None:
    """The same after each group of a task, without looking for cycles."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of the column, a row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(raw(batch.column(column))[1]))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the word offsets of each row."""
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[filled] |= inside[filled]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[filled[filled > 0] - 1] |= inside[filled[filled > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, separator: int) -> pa.Array:
    """A text for each row: ``counts`` of the byte spans, with the separator between them."""
    cut = np.concatenate([[0], np.cumsum(counts)])
    last = np.zeros(len(starts), bool)
    last[cut[1:][counts > 0] - 1] = True
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + ~last)])
    text = np.full(int(to[-1]), separator, np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[place + np.repeat(to[:-1], size)] = data[place + np.repeat(starts, size)]
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(to[cut].astype(np.int32)), pa.py_buffer(text)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of non-overlapping, non-empty byte spans in order."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    rng = np.random.default_rng(90_001 + seed)
    of_byte = rng.integers(0, 2**64, 256, dtype=np.uint64)
    step = np.full(int(lens.max()), rng.integers(0, 2**62, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64)
    step[0] = 1
    power = np.cumprod(step, dtype=np.uint64)
    sums = np.empty(len(lens), np.uint64)
    for i in range(0, len(lens), 1 << 16):  # in parts, for the temporary arrays' sake
        size, start = lens[i : i + (1 << 16)], starts[i : i + (1 << 16)]
        base = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(base, size)
        value = of_byte[data[place + np.repeat(start, size)]]
        value *= power[place]
        sums[i : i + (1 << 16)] = np.add.reduceat(value, base)
    return mix(sums + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(word_hash: np.ndarray, word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the ``size`` words that start at each word, and the mask of those
    starts whose window ends inside its row."""
    n = len(word_hash)
    whole = np.zeros(n, bool)
    if n:
        row_end = np.repeat(word_offsets[1:], np.diff(word_offsets))
        whole = np.arange(n) + size <= row_end
    if n < size:
        return np.zeros(n, np.uint64), whole
    factor, done, total = np.uint64(0xA24BAED4963EE407), 0, None
    block, width, left = word_hash, 1, size
    # Double the covered width, adding the blocks that the binary form of size names.
    while left:
        if left & 1:
            moved = np.zeros(n, np.uint64)
            moved[: n - done] = block[done:]
            total = moved if total is None else mix(total * factor + moved)
            done += width
        left >>= 1
        if left:
            nxt = np.zeros(n, np.uint64)
            nxt[: n - width] = block[width:] if width < n else 0
            block = mix(block * factor + nxt)
            width *= 2
    return total, whole
