import itertools
import random

import numpy as np
import pytest
from cases import documents, lower, prose, texts

from textloom.llm import near_dedup
from textloom.llm.components import components


def shingles(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            root[find(x)] = find(y)
    out = []
    for x, (key, _) in enumerate(rows):
        group = [k for y, (k, _) in enumerate(rows) if find(y) == find(x) and k is not None]
        least = min(group, default=None)
        out.append((key, len(sets[x]), least, key is not None and key == least))
    return sorted(out, key=repr)


def rows_of(df):
    got = df.select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted(map(tuple, got), key=repr)


def test_against_brute_force(spark):
    assert rows_of(near_dedup.near_duplicates(documents(spark))) == brute(texts())


def test_loose_groups(spark, monkeypatch):
    """Copies that differ from a base by more and more words: links form chains and gaps."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "SIGN_BLOCK", 3)
    rng, rows = random.Random(5), []
    base = prose(rng, 120).split()
    for i in range(60):
        words = list(base)
        for _ in range(i // 5):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert rows_of(near_dedup.near_duplicates(documents(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).collect() == []


@pytest.mark.parametrize("size,shift", [(200, 22), (200, 10), (9, 1), (18, 2)])
def test_misses_are_rare(size, shift):
    """Pairs of sets at similarity 0.8 and 0.9 share a table key; also short sets."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 62, size + (20 if size == 200 and shift == 22 else shift), dtype=np.uint64)
        signs = np.array([near_dedup.signature(pool[:size]), near_dedup.signature(pool[shift:])])
        keys = near_dedup.half_keys(signs)
        same = keys[0] == keys[1]
        missed += not (same[: near_dedup.HALVES].any() and same[near_dedup.HALVES :].any())
        missed += (signs[0] == signs[1]).sum() < near_dedup.AGREE
    assert missed <= 2


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
