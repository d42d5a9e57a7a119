"""Pair counts of a table of words, kept up to date by the differences that merges make.

The words are staged in blocks, each with an index of the pairs that occur in it and the words
that hold them. A round of merges looks its pairs up in the index, visits only the words
found, and sends on by how much they change the counts; Spark sums these differences.

Once two symbols exist, merging other pairs can only part them, so a count never rises.
It is therefore enough to follow the pairs above a floor: those that the words were
listed with, and pairs of new symbols whose sum exceeds it. When none is left above the
floor, the words are listed anew. The driver holds the list, never the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.symbols import SHIFT, Batch, Words, apply_batch, from_lists, lookups_of
from textloom.session import drop, stage

_MASK = (1 << SHIFT) - 1
_BLOCK_SCHEMA = "n binary, syms binary, ends binary, keys binary, first binary, held binary"
_BLOCK_NAMES = ["n", "syms", "ends", "keys", "first", "held"]
_BLOCK_TYPES = dict(n=np.int64, syms=np.int32, ends=np.int64, keys=np.int64, first=np.int64, held=np.int32)


def weighted_pairs(words: Words, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every adjacent pair, and the count of its word."""
    at, keys = words.pairs()
    return keys, n[words.word[at]]


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights; sums in doubles are exact below 2^53."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, weights, len(distinct)).astype(np.int64)


def pair_batch(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(keys >> SHIFT, pa.int32()), pa.array(keys & _MASK, pa.int32()), pa.array(sums, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["l", "r", "n"])


def count_pairs(words: DataFrame, batches: list[Batch], rank: np.ndarray | None = None) -> DataFrame:
    """Counts of adjacent pairs after the batches, by visiting all words.

    ``rank`` renames the symbols, so that sorting pairs sorts by token order.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = lookups_of(batches)
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for rb in stream:
            w = from_lists(rb.column("syms"))
            for lookup in lookups:
                apply_batch(w, lookup)
            if rank is not None:
                w.syms = rank[w.syms]
            more, weights = weighted_pairs(w, rb.column("n").to_numpy())
            keys, sums = summed(np.concatenate((keys, more)), np.concatenate((sums, weights)))
        yield pair_batch(keys, sums)

    return words.mapInArrow(run, "l int, r int, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))


def top_pairs(
    words: DataFrame, pending: list[Batch], min_frequency: int, n: int,
    rank: np.ndarray | None = None,
) -> list[tuple[int, int, int]]:
    """The first ``n`` pairs ``(l, r, count)`` in the order of greedy learning."""
    rows = (
        count_pairs(words, pending, rank)
        .filter(F.col("n") >= max(min_frequency, 1))
        .orderBy(F.col("n").desc(), "l", "r")
        .limit(n)
    )
    return _rows(rows)


def _rows(df: DataFrame) -> list[tuple[int, int, int]]:
    table = df.toArrow()
    return list(zip(*(table.column(c).to_pylist() for c in ("l", "r", "n"))))


def _index(words: DataFrame) -> DataFrame:
    """One row for each batch of words: the words, their pairs, and the words of each pair."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in stream:
            w = from_lists(rb.column("syms"))
            at, key = w.pairs()
            word = w.word[at]
            by = np.lexsort((word, key))
            key, word = key[by], word[by]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (word[1:] != word[:-1])
            keys, first = np.unique(key[fresh], return_index=True)
            parts = dict(
                n=rb.column("n").to_numpy(), syms=w.syms, keys=keys, held=word[fresh],
                ends=np.append(0, np.cumsum(np.bincount(w.word, minlength=w.n))),
                first=np.append(first, fresh.sum()),
            )
            row = [pa.array([parts[c].astype(_BLOCK_TYPES[c]).tobytes()], pa.binary()) for c in _BLOCK_NAMES]
            yield pa.RecordBatch.from_arrays(row, names=_BLOCK_NAMES)

    return words.mapInArrow(run, _BLOCK_SCHEMA)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of several ranges, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def touched_words(block: dict[str, np.ndarray], sought: np.ndarray) -> tuple[np.ndarray, Words]:
    """Numbers of the words of a block that hold a sought pair, and the words."""
    slot = np.searchsorted(block["keys"], sought)
    inside = slot < len(block["keys"])
    slot, sought = slot[inside], sought[inside]
    slot = slot[block["keys"][slot] == sought]
    places = _ranges(block["first"][slot], block["first"][slot + 1] - block["first"][slot])
    which = np.unique(block["held"][places]).astype(np.int64)
    size = block["ends"][which + 1] - block["ends"][which]
    syms = block["syms"][_ranges(block["ends"][which], size)].astype(np.int64)
    return which, Words(syms, np.repeat(np.arange(len(which)), size), len(which))


class PairList:
    """The counts of all pairs above a floor, and the indexed words to follow them with."""

    def __init__(self, words: DataFrame, symbols: int, min_frequency: int, most: int) -> None:
        listed = top_pairs(words, [], min_frequency, most + 1)
        self.floor = max(min_frequency, 1) - 1
        if len(listed) > most:
            # Pairs as frequent as the first one left out are left out too.
            self.floor = listed.pop()[2]
        self.counts = {(l, r): n for l, r, n in listed if n > self.floor}
        self.complete = self.floor < max(min_frequency, 1)
        self.visited = 0
        self.blocks: DataFrame | None = None
        if self.counts:
            self._hold(words, symbols)

    def _hold(self, words: DataFrame, symbols: int) -> None:
        self.close()
        self.blocks = stage(_index(words), "bpe-blocks")
        self.symbols, self.held_counts = symbols, dict(self.counts)

    def close(self) -> None:
        if self.blocks is not None:
            drop(self.blocks.sparkSession, self.blocks)
            self.blocks = None

    def follow(self, batches: list[Batch]) -> None:
        """Bring the counts up to date with all batches since the words were held."""
        rows = _rows(self._differences(batches))
        self.counts = dict(self.held_counts)
        for l, r, n in rows:
            n += self.held_counts.get((l, r), 0)
            if n > self.floor:
                self.counts[l, r] = n
            else:
                self.counts.pop((l, r), None)

    def rehold(self, words: DataFrame, symbols: int) -> None:
        """Go on from words to which all batches have been applied."""
        self._hold(words, symbols)

    def _differences(self, batches: list[Batch]) -> DataFrame:
        listed = np.sort(np.array([(l << SHIFT) | r for l, r in self.held_counts], dtype=np.int64))
        first_new, floor = self.symbols, self.floor
        # A word reached by way of a new symbol held a pair that made it.
        sought = np.array([(l << SHIFT) | r for b in batches for l, r, _ in b if max(l, r) < first_new], np.int64)

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookups = lookups_of(batches)
            keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for rb in stream:
                for row in range(rb.num_rows):
                    block = {c: np.frombuffer(rb.column(c)[row].as_buffer(), _BLOCK_TYPES[c]) for c in _BLOCK_NAMES}
                    which, words = touched_words(block, sought)
                    if not len(which):
                        continue
                    n = block["n"][which]
                    gone, less = weighted_pairs(words, n)
                    for lookup in lookups:
                        apply_batch(words, lookup)
                    made, more = weighted_pairs(words, n)
                    keys, sums = summed(
                        np.concatenate((keys, gone, made)), np.concatenate((sums, -less, more))
                    )
            slot = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
            kept = (listed[slot] == keys) | (keys >> SHIFT >= first_new) | (keys & _MASK >= first_new)
            kept &= sums != 0
            yield pair_batch(keys[kept], sums[kept])

        new = (F.col("l") >= first_new) | (F.col("r") >= first_new)
        found = self.blocks.mapInArrow(run, "l int, r int, n long")
        return found.groupBy("l", "r").agg(F.sum("n").alias("n")).filter(~new | (F.col("n") > floor))
