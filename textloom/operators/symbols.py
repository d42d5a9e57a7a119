"""Words as flat symbol arrays inside tasks, merges applied to them, and texts cut at spaces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bits of a symbol in a pair key.
SHIFT = 31

Batch = list[tuple[int, int, int]]


@dataclass
class Words:
    """Words of one batch as a flat symbol array with word numbers."""

    syms: np.ndarray
    word: np.ndarray
    n: int

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose right neighbour is in the same word, and the pair keys."""
        at = np.flatnonzero(self.word[1:] == self.word[:-1])
        return at, (self.syms[at] << SHIFT) | self.syms[at + 1]

    def merge(self, at: np.ndarray, new: np.ndarray) -> None:
        """Join the symbols at ``at`` with their right neighbours.

        Neighbouring positions occur only in runs of one symbol paired with
        itself; there every second one is taken, from the left.
        """
        if not len(at):
            return
        head = np.concatenate(([True], np.diff(at) != 1))
        start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - start) % 2 == 0
        at, new = at[take], new[take]
        self.syms[at] = new
        keep = np.ones(len(self.syms), dtype=bool)
        keep[at + 1] = False
        self.syms, self.word = self.syms[keep], self.word[keep]

    def to_arrow(self) -> pa.Array:
        offsets = np.zeros(self.n + 1, dtype=np.int32)
        np.cumsum(np.bincount(self.word, minlength=self.n), out=offsets[1:])
        return pa.ListArray.from_arrays(offsets, pa.array(self.syms.astype(np.int32)))


def from_lists(lists: pa.ListArray) -> Words:
    sizes = np.diff(lists.offsets.to_numpy())
    syms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(syms, np.repeat(np.arange(len(sizes)), sizes), len(sizes))


def from_strings(words: pa.Array, byte_ids: np.ndarray) -> Words:
    """Byte symbols of words; bytes outside the alphabet are dropped."""
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    syms = byte_ids[flat]
    word = np.repeat(np.arange(len(raw)), np.diff(offsets))
    known = syms >= 0
    return Words(syms[known], word[known], len(raw))


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: White space of two and of three bytes in UTF-8, as numbers.
_WHITE_TWO = np.array([0xC285, 0xC2A0])
_WHITE_THREE = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
#: Bytes of text whose cuts are looked for at once.
_CUT_BYTES = 1 << 20


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bounds of texts given end to end, and every space in them between characters that are no white space."""
    space = data == 32
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    space[filled] = False
    space[np.append(filled[1:], len(data)) - 1] = False
    at = np.flatnonzero(space)
    before, after = data[at - 1], data[at + 1]
    open_ = ~(_WHITE[before] | _WHITE[after])
    # The last byte of a longer character may be any from 128 on; its first tells its length.
    wide = np.flatnonzero(open_ & (before > 127))
    two = data[at[wide] - 2].astype(np.int64) << 8 | before[wide]
    three = data[np.maximum(at[wide] - 3, 0)].astype(np.int64) << 16 | two
    open_[wide] = ~(np.isin(two, _WHITE_TWO) | np.isin(three, _WHITE_THREE))
    wide = np.flatnonzero(open_ & (after > 127))
    two = after[wide].astype(np.int64) << 8 | data[at[wide] + 2]
    three = two << 8 | data[np.minimum(at[wide] + 3, len(data) - 1)]
    open_[wide] = ~(np.isin(two, _WHITE_TWO) | np.isin(three, _WHITE_THREE))
    mark = np.zeros(len(data) + 1, dtype=bool)
    mark[at[open_]] = True
    mark[bounds] = True
    return np.flatnonzero(mark)


def units(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts cut before every space that stands between two characters that are no white space.

    Null and empty texts give none. Texts are taken about a million bytes at a time.
    """
    raw = texts.drop_null().cast(pa.large_binary())
    if not len(raw):
        return
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(raw):
        j = int(np.searchsorted(ends, ends[i] + _CUT_BYTES, side="right")) - 1
        j = min(max(j, i + 1), len(raw))
        piece = data[ends[i] : ends[j]]
        if len(piece):
            bounds = _cuts(piece, ends[i : j + 1] - ends[i])
            buffers = [None, pa.py_buffer(bounds), pa.py_buffer(piece)]
            yield pa.LargeStringArray.from_buffers(len(bounds) - 1, *buffers[1:])
        i = j


class Lookup:
    """Sorted pair keys with a value each."""

    def __init__(self, pairs: list[tuple[int, int]], values: list[int]):
        keys = np.array([(l << SHIFT) | r for l, r in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(values, dtype=np.int64)[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of the known keys, and the values of those."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(0, dtype=np.int64)
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[slot] == keys
        return hit, self.values[slot[hit]]


def apply_batch(words: Words, lookup: Lookup) -> None:
    at, keys = words.pairs()
    hit, new = lookup.find(keys)
    words.merge(at[hit], new)


def lookups_of(batches: list[Batch]) -> list[Lookup]:
    return [Lookup([(l, r) for l, r, _ in b], [n for _, _, n in b]) for b in batches]
