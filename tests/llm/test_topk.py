import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import topk


def walk(node, vectors):
    gap = np.sqrt(((vectors[node.points] - node.center) ** 2).sum(axis=1))
    assert gap.max(initial=0) <= node.radius + 1e-9
    if node.children:
        assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        assert (node.children[0].center == node.center).all()
        limit = topk.SHRINK * node.radius
        for k, a in enumerate(node.children):
            assert a.radius <= limit + 1e-9
            for b in node.children[k + 1 :]:
                assert np.sqrt(((a.center - b.center) ** 2).sum()) > limit - 1e-9
            walk(a, vectors)


def test_cover_tree():
    vectors = np.random.default_rng(1).integers(-9, 9, (600, 3)).astype(float)
    tree = topk.cover_tree(vectors, least=4)
    assert tree.children
    walk(tree, vectors)


def test_spread_points_are_not_divided():
    """Points of a sphere in many dimensions have no clusters: few centres are tried, one leaf is made."""
    vectors = np.random.default_rng(1).normal(size=(4_000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None])
    assert not topk.cover_tree(vectors).children


def test_most_pairs_of_clustered_vectors_are_cut():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 32))
    data = np.repeat(middles, 300, axis=0) + 0.05 * rng.normal(size=(12_000, 32))
    data = np.floor(256 * data / np.linalg.norm(data, axis=1)[:, None])
    ids = rng.permutation(len(data)).astype(np.int64)
    queries, query_ids = data[::10], ids[::10]
    best = topk.dual_search(queries, query_ids, data, ids, 5, least=16, product=1 << 14)
    assert best.scored < 0.1 * len(queries) * len(data)
    for q in range(0, len(queries), 29):
        scores = data @ queries[q]
        want = sorted((-int(s), i) for s, i in zip(scores, ids) if i != query_ids[q])[:5]
        assert list(zip((-best.score[q]).tolist(), best.ids[q].tolist())) == want


@pytest.mark.parametrize("limits", [(256, 1 << 21), (4, 1), (8, 500)])
@pytest.mark.parametrize("seed,wide", [(0, 2), (1, 3), (2, 40)])
def test_dual_search(seed, wide, limits):
    rng = np.random.default_rng(seed)
    data = np.repeat(rng.integers(-20, 20, (400, wide)), 2, axis=0).astype(float)
    ids = rng.permutation(len(data)).astype(np.int64)
    queries, query_ids = data[:120], ids[:120]
    best = topk.dual_search(queries, query_ids, data, ids, 5, *limits)
    for q in range(120):
        scores = data @ queries[q]
        want = sorted((-int(s), i) for s, i in zip(scores, ids) if i != query_ids[q])[:5]
        assert list(zip((-best.score[q]).tolist(), best.ids[q].tolist())) == want


def test_top_k_with_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "DATA_BLOCK", (8, 8))
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(60)]
    rows += [(100, None, 0), (101, [None, 1.0], 0), (102, [math.nan, 1.0], 0), (103, [math.inf], 0), (None, [1.0], 0)]
    rows += [rows[7], (104, rows[7][1], 0), (105, [0.5], 0), (110, [], 0), (120, [0.1] * 6, 0)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, score long")
    got = topk.top_k(
        df.select("id", topk.scaled(F.col("embedding")).alias("vector"), "score").drop("score"), F.col("id") % 10 == 0
    ).collect()
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    expected = []
    for q in good:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1]), (1, [2])], "id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(df, F.col("id") == 0).collect()] == [(0, 1, 1, 2)]
    assert topk.top_k(df.limit(0), F.col("id") == 0).collect() == []


def test_repeated_ids_do_not_crowd_others_out(spark):
    rows = [(0, [1])] + [(1, [100 + i]) for i in range(8)] + [(i, [i]) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    got = topk.top_k(df, F.col("id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 107), (8, 8), (7, 7), (6, 6), (5, 5)]
