"""Words and byte ranges of Arrow text columns as numpy arrays, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once. A longer document is a slice of its own.
SLICE_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def byte_table(outside: str) -> np.ndarray:
    """True for bytes that belong to a word; ``outside`` lists the ASCII characters that do not."""
    table = np.ones(256, bool)
    table[list(outside.encode("ascii"))] = False
    return table


#: The white space that the operators share: space and the controls 09 to 0D.
SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = byte_table(SPACES)
#: Digits, ASCII letters and everything beyond ASCII.
ALNUM = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes at most, or one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row, rows = 0, batch.num_rows
        while row < rows:
            end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), rows)
            yield batch.slice(row, end - row)
            row = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets); a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of word bytes; a word ends with its text."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base)
    if n:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_CACHE: dict[str, np.ndarray] = {}


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if n > 4 * SLICE_BYTES:
        return _powers(_ODD, n), _powers(np.uint64(pow(int(_ODD), -1, 1 << 64)), n)
    if not _CACHE or len(_CACHE["up"]) < n:
        size = max(n, SLICE_BYTES)
        _CACHE["up"], _CACHE["down"] = _powers(_ODD, size), _powers(np.uint64(pow(int(_ODD), -1, 1 << 64)), size)
    return _CACHE["up"][:n], _CACHE["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from differences of one running sum."""
    up, down = _weights(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else sums[:0]


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` neighbouring words, by the position of its first word."""
    count = len(hashes) - length + 1
    if count <= 0:
        return hashes[:0]
    total = np.zeros(count, np.uint64)
    for k in range(length):
        total = total * _STEP + hashes[k : k + count]
    return mix(total)


def same_row(rows: np.ndarray, length: int) -> np.ndarray:
    """Whether the window of ``length`` words that begins at a word stays within its text."""
    count = len(rows) - length + 1
    return rows[:count] == rows[length - 1 :] if count > 0 else np.zeros(0, bool)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema
    )


def ragged(values: np.ndarray, rows: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.Array:
    """A list column: ``values`` in the order of their ``rows``."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
