"""Content-defined anchors: equal long strings have equal anchors at equal places.

The anchor of a string of ``LENGTH`` bytes is the position of the least hash among its
substrings of ``GRAM`` bytes, the leftmost if several are least. It depends on the
string alone, so all occurrences of a string can be brought together by the hash at its
anchor, while a text has one anchor for some ninety consecutive starts.
"""

from __future__ import annotations

import numpy as np

from textloom.llm import arrays

LENGTH = 200
GRAM = 24
_SPAN = LENGTH - GRAM + 1
#: Low bits that hold a position, enough for the longest string that Spark has.
_PLACE = np.uint64((1 << 31) - 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_ranges(
    data: np.ndarray, bounds: np.ndarray, prefix: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, starts, hash) of all ranges of starts that share an anchor.

    Starts count from the beginning of their text; texts shorter than ``LENGTH`` have none.
    ``prefix`` is the prefix hash of the data.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    hashes = arrays.window_hash(prefix, GRAM)
    ranked = hashes & ~_PLACE
    ranked |= np.arange(len(hashes), dtype=np.uint64)
    anchor = _sliding_least(ranked, _SPAN) & _PLACE
    anchor = anchor.astype(np.int64)
    size = np.diff(bounds)
    change = np.zeros(len(data) + 1, np.int32)
    long = size >= LENGTH
    np.add.at(change, bounds[:-1][long], 1)
    np.add.at(change, bounds[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(change[: len(anchor)]) > 0
    fresh = valid.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    starts = bounds[:-1][long]
    fresh[starts] = True
    first = np.flatnonzero(fresh)
    stop = np.append(first[1:], len(anchor))
    text = np.searchsorted(bounds, first, "right") - 1
    stop = np.minimum(stop, bounds[1:][text] - LENGTH + 1)
    return text, first - bounds[text], stop - first, hashes[anchor[first]].view(np.int64)
