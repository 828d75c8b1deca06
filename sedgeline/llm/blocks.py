"""Words and shingles of Arrow string columns as numpy arrays.

Everything works on the UTF-8 bytes of a whole slice of rows at once, in slices of a few MB, so
that memory follows the slice (or the one longest text), not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IDENTITY = np.arange(256, dtype=np.uint8)
ASCII_LOWER = _IDENTITY + np.where((_IDENTITY >= 65) & (_IDENTITY <= 90), 32, 0).astype(np.uint8)
#: Bytes that end a word: space and \x09-\x0D.
SPACES = np.isin(_IDENTITY, [9, 10, 11, 12, 13, 32])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, HASH_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, start of each row in them and the end); a null text is empty.

    The column is cut before its slices are cast: a whole batch of long texts is never copied.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first, end in row_ranges(column):
        part = column.slice(first, end - first).fill_null("").cast(pa.large_string())
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
        yield first, end, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First and end row of runs of rows whose texts take about so many bytes together; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, end
        first = end


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are ascending and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _power(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, rows: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each row has. No word crosses rows."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(rows) - 1, np.int64)
    solid = ~spaces[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = rows[(rows > 0) & (rows < len(data))]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.diff(np.searchsorted(starts, rows, "left"))


def shingles(word: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every n-word shingle; a row of fewer words, but not none, has its whole sequence as one."""
    first = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(first + counts, counts) - np.arange(len(word))
    whole = np.flatnonzero(left >= n)
    total = np.zeros(len(whole), dtype=np.uint64)
    for k in range(n):
        total = mix(total + word[whole + k] + np.uint64(k + 1))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return row[whole], total
    rest = np.full(len(short), 0x5EED, dtype=np.uint64) + counts[short].astype(np.uint64)
    for k in range(n - 1):
        at = np.flatnonzero(counts[short] > k)
        rest[at] = mix(rest[at] + word[first[short[at]] + k] + np.uint64(k + 1))
    rows, values = np.concatenate([row[whole], short]), np.concatenate([total, rest])
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]


def windows(word: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each position on; none for the last n - 1."""
    if len(word) < n:
        return np.empty(0, np.uint64)
    out = np.empty(len(word) - n + 1, np.uint64)
    up, down = _power(HASH_BYTES + n)
    for i in range(0, len(out), HASH_BYTES):
        part = word[i : i + HASH_BYTES + n - 1]
        sums = np.append(np.uint64(0), np.cumsum(mix(part) * up[: len(part)], dtype=np.uint64))
        out[i : i + HASH_BYTES] = mix((sums[n:] - sums[:-n]) * down[: len(part) - n + 1])
    return out


def distinct(row: np.ndarray, value: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted by row and value, and their number per row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=n_rows)
