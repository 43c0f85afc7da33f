"""Strings of an Arrow batch as flat byte arrays: words and shingles hashed for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from postsieve.session import configure

# Rows of text that are passed to Python at once.
BATCH_ROWS = 1000
# Bytes handled at once; a longer text is one piece of its own.
CHUNK = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """The package's settings, and batches small enough for rows of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return configure(spark)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after another, and the n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text, with that text as in :func:`utf8`."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _tables() -> tuple[np.ndarray, np.uint64]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(
        0xD1342543DE82EF95
    )


_BYTE, _BASE = _tables()
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass(frozen=True)
class Classes:
    """For each byte: whether it belongs to a word, and itself with A-Z lower-cased."""

    inside: np.ndarray
    lower: np.ndarray


def byte_classes(separators: list[int]) -> Classes:
    inside, lower = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    inside[separators] = False
    lower[65:91] += 32
    return Classes(inside, lower)


# The two kinds of words the operators ask for.
BLANK_SEPARATED = byte_classes([0x20, *range(0x09, 0x0E)])
ALPHANUMERIC = byte_classes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Words:
    """Words of some documents: their hashes, their bytes' bounds, and for each document the bounds of its words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, classes: Classes) -> Words:
    # Upper case counts as a word character in both kinds.
    n = len(data)
    inside = classes.inside[classes.lower[data]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[classes.lower[data]] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each position; the last positions have none."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, sorted, and their bounds.

    A document of fewer words than ``size``, but not none, has one shingle: all of them.
    """
    all_windows = windows(found.hashes, size)
    counts = np.diff(found.bounds)
    out, bounds = [], np.zeros(len(counts) + 1, np.int64)
    for k, (start, n) in enumerate(zip(found.bounds[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= size:
            own = np.sort(all_windows[start : start + n - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = windows(found.hashes[start : start + n], n) ^ np.uint64(n)
        else:
            own = all_windows[:0]
        out.append(own)
        bounds[k + 1] = bounds[k] + len(own)
    return np.concatenate(out) if out else np.empty(0, np.uint64), bounds


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    if not len(values):
        return values, np.empty(0, np.int64)
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.diff(np.append(at, len(values)))
