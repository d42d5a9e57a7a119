"""Suffix arrays by Larsson-Sadakane refinement, and an FM-index, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_sort(first: np.ndarray, step: int = 1) -> np.ndarray:
    """Suffix array of a sequence, given keys of the first ``step`` symbols at each position.

    Each round doubles the number of symbols that ranks stand for: positions whose
    rank is shared are sorted by the rank of the position ``step`` further on; settled
    ones are never moved again. A rank is the place of the first suffix of its group.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    places = np.flatnonzero(head)
    rank[order] = np.repeat(places, np.diff(np.append(places, n)))
    while step <= 2 * n:
        single = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        at = order[open_]
        key = rank[at] * (n + 2) + rank[np.minimum(at + step, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[open_] = fresh
        starts = np.flatnonzero(fresh)
        rank[at] = np.repeat(open_[starts], np.diff(np.append(starts, len(at))))
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols below 2 ** ``bits`` in a sequence, one bit vector per level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        rest = symbols
        for shift in range(bits - 1, -1, -1):
            bit = (rest >> shift) & 1
            ones = np.zeros(len(rest) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(rest) - int(ones[-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def below(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(place)
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[low], ones[place]
            low = np.where(one, zeros + a, low - a)
            place = np.where(one, zeros + b, place - b)
        return place - low


class FMIndex:
    """Backward search in a sequence of symbols; 0 separates its parts and matches nothing.

    Positions are sampled every ``every`` symbols and where a part begins, so a walk
    to a sampled position never leaves its part.
    """

    def __init__(self, symbols: np.ndarray, every: int = 8) -> None:
        n = len(symbols)
        gap = symbols == 0
        gaps = int(gap.sum())
        # Separators differ from each other, so no comparison runs past one.
        first = np.where(gap, np.cumsum(gap) - 1, symbols.astype(np.int64) + gaps)
        order = suffix_sort(first)
        self.before = symbols[order - 1].astype(np.int64)
        top = int(symbols.max(initial=0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.tree = WaveletMatrix(self.before, max(1, top.bit_length()))
        begins = np.zeros(n, bool)
        begins[0:1] = True
        begins[1:] = gap[:-1]
        self.sampled = (begins | (np.arange(n) % every == 0))[order]
        self.position = np.where(self.sampled, order, -1)
        self.top, self.n = top, n

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of the phrases that occur.

        ``phrases`` holds one phrase a row, from its last symbol backwards.
        """
        found, lows, highs = [], [], []
        who = np.arange(len(phrases))
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        for k in range(phrases.shape[1] if len(phrases) else 0):
            done = sizes[who] == k
            if done.any():
                found.append(who[done]), lows.append(low[done]), highs.append(high[done])
                who, low, high = who[~done], low[~done], high[~done]
            symbol = phrases[who, k]
            known = (symbol > 0) & (symbol <= self.top)
            who, low, high, symbol = who[known], low[known], high[known], symbol[known]
            low = self.first[symbol] + self.tree.below(symbol, low)
            high = self.first[symbol] + self.tree.below(symbol, high)
            some = low < high
            who, low, high = who[some], low[some], high[some]
            if not len(who):
                break
        found.append(who), lows.append(low), highs.append(high)
        return np.concatenate(found), np.concatenate(lows), np.concatenate(highs)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out = np.full(len(rows), -1, np.int64)
        at, row, walked = np.arange(len(rows)), rows.copy(), 0
        while len(at):
            here = self.sampled[row]
            out[at[here]] = self.position[row[here]] + walked
            at, row = at[~here], row[~here]
            symbol = self.before[row]
            row = self.first[symbol] + self.tree.below(symbol, row)
            walked += 1
        return out


def capped_prefixes(words: np.ndarray, order: np.ndarray, n: int, most: int, lane: int = 128) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, at most ``most``.

    Kasai's rule: the suffix one position on shares at least one symbol less with its own
    predecessor. The text is cut into lanes of ``lane`` positions that advance together.
    ``words`` holds the eight bytes from each position on, the first one lowest.
    """
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, np.int64)
    heads = np.arange(0, n, lane)
    held = np.zeros(len(heads), np.int64)
    for step in range(min(lane, n)):
        at = heads + step
        live = at < n
        held = np.maximum(held - 1, 0)
        held[~live] = 0
        other = np.where(live, before[np.minimum(at, n - 1)], -1)
        held[other < 0] = 0
        going = np.flatnonzero((other >= 0) & (held < most))
        while len(going):
            x, y = at[going] + held[going], other[going] + held[going]
            room = n - np.maximum(x, y)
            inside = room > 0
            going, x, y, room = going[inside], x[inside], y[inside], room[inside]
            differ = words[x] ^ words[y]
            equal = np.where(
                differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3
            )
            equal = np.minimum(equal, room)
            held[going] += equal
            going = going[(equal == 8) & (held[going] < most)]
        np.minimum(held, most, out=held)
        common[at[live]] = held[live]
    return common[order]
