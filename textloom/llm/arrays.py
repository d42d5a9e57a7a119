"""Arrow text columns as UTF-8 byte arrays, and words and word hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task, so that arrays of eight bytes for each stay in
#: the caches; a longer text is handled alone.
WORK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 bounds of its texts; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    column = pc.fill_null(column, "") if column.null_count else column
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize)
    bounds = bounds.astype(np.int64)
    whole = np.frombuffer(data, np.uint8, bounds[-1])
    return whole[bounds[0] :], bounds - bounds[0]


def spans(bounds: np.ndarray, most: int = WORK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` bytes together, or of one longer text."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def work(column: pa.Array, most: int = WORK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of consecutive pieces of a column."""
    data, bounds = utf8(column)
    for i, j in spans(bounds, most):
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(
    data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, and how many each text has.

    ``is_word`` marks the 256 byte values; runs never cross texts.
    """
    mark = np.zeros(len(data) + 1, bool)
    mark[:-1] = is_word[data]
    inner = bounds[1:-1]
    first = mark[:-1].copy()
    first[1:] &= ~mark[:-2]
    last = mark[:-1] & ~mark[1:]
    cut = inner[(inner > 0) & (inner < len(data))]
    first[cut] = mark[cut]
    last[cut - 1] = mark[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE)
        down = np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hash`` gives the hash of any range."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = _tables(len(data) + 1)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they lie."""
    _, down = _tables(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ranges of ``size`` bytes, as ``range_hash`` gives them."""
    _, down = _tables(len(prefix))
    out = prefix[size:] - prefix[:-size]
    out *= down[: len(out)]
    return mix(out)


def run_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive hashes."""
    count = len(hashes) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : k + count] + np.uint64(k + 1))
    return out
