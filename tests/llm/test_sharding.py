import zlib

import pytest
from cases import documents, texts
from pyspark.sql import functions as F

from textloom.llm import sharding

TREE = sharding.uniform_tree(3, 2, 4)


def test_rows_slots_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 1)
    got = sharding.shard_rows(documents(spark), TREE).collect()
    expected = sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), k or -1) for k, t in texts()
    )
    assert sorted((r.size, r.text_crc32, r.doc_id or -1) for r in got) == expected
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in got} <= set(range(24))


def shards(spark, tree, n=20_000):
    ids = spark.range(n).withColumn("shard", sharding.tree_shard(F.col("id"), tree))
    return {r.id: r.shard for r in ids.collect()}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    old, new = shards(spark, TREE), shards(spark, sharding.grown(TREE))
    moved = {k for k in old if old[k] != new[k]}
    assert {new[k] for k in moved} == {24}
    assert abs(len(moved) - 20_000 / 25) < 150


def test_shares_follow_weights(spark):
    tree = [sharding.Shard(0, "a", "x", 1.0), sharding.Shard(1, "a", "y", 2.0), sharding.Shard(2, "b", "x", 5.0)]
    count = [0, 0, 0]
    for s in shards(spark, tree).values():
        count[s] += 1
    assert all(abs(c / 20_000 - w / 8) < 0.015 for c, w in zip(count, (1, 2, 5)))


def test_a_changed_weight_moves_rows_only_between_changed_subtrees(spark):
    heavier = [sharding.Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else 1.0) for s in TREE]
    old, new = shards(spark, TREE), shards(spark, heavier)
    region = {s.number: s.region for s in TREE}
    moved = [(old[k], new[k]) for k in old if old[k] != new[k]]
    assert moved and all(region[b] == region[5] for a, b in moved)


@pytest.mark.parametrize("weight", [0.0, -1.0, float("nan")])
def test_bad_weights(weight):
    with pytest.raises(ValueError):
        sharding.tree_shard(F.lit(1), [sharding.Shard(0, "a", "b", weight)])


def test_empty_table(spark):
    assert sharding.shard_rows(documents(spark, []), TREE).collect() == []
