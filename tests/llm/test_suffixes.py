import random

import numpy as np
import pytest
from cases import documents, texts

from textloom.llm import arrays, suffix_dedup
from textloom.llm.suffixes import FMIndex, capped_prefixes, suffix_sort


def packed(data):
    return suffix_dedup._eight(np.frombuffer(data, np.uint8))


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    data = bytes(rng.choices(b"ab" if seed % 2 else b"abcdefgh", k=400)) + b"abab" * 40 + b"!"
    order = suffix_sort(packed(data).byteswap(), step=8)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    got = capped_prefixes(packed(data), order, len(data), 50, lane=16)

    def common(x, y):
        n = 0
        while n < 50 and x + n < len(data) and y + n < len(data) and data[x + n] == data[y + n]:
            n += 1
        return n

    assert got[1:].tolist() == [common(x, y) for x, y in zip(order, order[1:])]


def test_backward_search_and_locate():
    rng = random.Random(1)
    symbols = np.array([0 if rng.random() < 0.1 else rng.randint(1, 4) for _ in range(600)] + [0])
    index = FMIndex(symbols, every=5)
    phrases = [[rng.randint(1, 5) for _ in range(rng.randint(1, 4))] for _ in range(80)]
    rows = np.zeros((80, 4), np.int64)
    for row, p in zip(rows, phrases):
        row[: len(p)] = p[::-1]
    who, low, high = index.search(rows, np.array([len(p) for p in phrases]))
    found = {w: sorted(index.locate(np.arange(a, b))) for w, a, b in zip(who, low, high)}
    seq = symbols.tolist()
    for k, p in enumerate(phrases):
        at = [i for i in range(len(seq) - len(p) + 1) if seq[i : i + len(p)] == p]
        assert found.get(k, []) == at


def brute(rows, length):
    import collections
    import hashlib

    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (key, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((key, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats_against_brute_force(spark, monkeypatch, most):
    """Also with anchor hashes spread over shards, so that lists are merged."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", most)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4_000)
    got = suffix_dedup.remove_repeats(documents(spark)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(texts(), 200)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).collect() == []


def test_small_work_pieces(spark, monkeypatch):
    monkeypatch.setattr(arrays.spans, "__defaults__", (300,))
    data, bounds = arrays.utf8(__import__("pyarrow").array(["a" * 500, "", "b"]))
    assert list(arrays.spans(bounds)) == [(0, 1), (1, 3)]
