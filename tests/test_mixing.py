"""Slots, draws, interleaving and plans: cases worked out by hand, and properties."""

import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from textloom.operators import mixing

# The training mix.
WEIGHTS = {
    "c4": 40, "fineweb": 40, "openwebtext2": 20, "arxiv": 10,
    "pubmed": 20, "book2": 20, "wikipedia": 10,
}


def mix_frame(spark, weights):
    rows = [(i, s, w) for i, (s, w) in enumerate(weights.items())]
    return spark.createDataFrame(rows, "pos int, source string, weight long")


# Slots worked out by hand: one each, the rest by weight, leftovers to the largest remainders.
SLOT_TABLE = [
    (WEIGHTS, 64, [15, 15, 8, 5, 8, 8, 5]),
    (WEIGHTS, 7, [1, 1, 1, 1, 1, 1, 1]),
    (WEIGHTS, 8, [2, 1, 1, 1, 1, 1, 1]),
    ({"a": 1, "b": 1, "c": 1}, 5, [2, 2, 1]),
    ({"a": 5}, 9, [9]),
]


@pytest.mark.parametrize("weights,slots,expected", SLOT_TABLE)
def test_slots(spark, weights, slots, expected):
    got = {r["source"]: r["slots"] for r in mixing.alloc_slots(mix_frame(spark, weights), slots).collect()}
    assert got == dict(zip(weights, expected))


def test_mix_is_checked(spark):
    assert mixing.validate_mix(WEIGHTS, 64, list(WEIGHTS)) == list(WEIGHTS.items())
    for bad in ({"a": 0}, {"a": -1}):
        with pytest.raises(ValueError):
            mixing.validate_mix(bad)
    with pytest.raises(ValueError):
        mixing.validate_mix(WEIGHTS, slots=6)
    with pytest.raises(ValueError):
        mixing.validate_mix(WEIGHTS, sources=["c4"])
    assert mixing.read_mix(mix_frame(spark, WEIGHTS)) == list(WEIGHTS.items())


def test_draws(spark):
    n = 40_000
    rows = mixing.draw_sources(spark.range(n), WEIGHTS, seed=9).collect()
    counts = Counter(r["source"] for r in rows)
    for s, w in WEIGHTS.items():
        assert counts[s] / n == pytest.approx(w / 160, abs=0.01)
    again = mixing.draw_sources(spark.range(n).repartition(5), WEIGHTS, seed=9).collect()
    assert sorted(rows) == sorted(again)
    other = mixing.draw_sources(spark.range(n), WEIGHTS, seed=10).collect()
    assert sorted(rows) != sorted(other)


def hashed(chunks, seed, epoch):
    return sorted(chunks, key=lambda c: (md5(f"{seed ^ epoch}:{c}".encode()).hexdigest(), c))


def window_frame(spark, lengths):
    rows = [
        (s, c, w, [c, w]) for s, ls in lengths.items() for c, n in ls.items() for w in range(n)
    ]
    return spark.createDataFrame(rows, "source string, chunk_id int, win long, seq array<int>")


def interleaved(spark, lengths, slots, wanted, seed=42):
    """{source: [(chunk, window), ...] in place order}."""
    out = mixing.interleave(
        window_frame(spark, lengths),
        spark.createDataFrame(list(slots.items()), "source string, slots long"),
        spark.createDataFrame(list(wanted.items()), "source string, wanted long"),
        seed=seed,
    )
    got = {s: [] for s in lengths}
    for r in out.orderBy("source", "place").collect():
        assert r["place"] == len(got[r["source"]]) and r["seq"] == [r["chunk_id"], r["win"]]
        got[r["source"]].append((r["chunk_id"], r["win"]))
    return got


def test_interleave_by_hand(spark):
    """Two open chunks take turns; the slot that runs out first loads the next chunk."""
    a, b, c = hashed([0, 1, 2], 42, 0)
    lengths = {"s": {a: 2, b: 3, c: 2}}
    got = interleaved(spark, lengths, {"s": 2}, {"s": 7})["s"]
    assert got[:6] == [(a, 0), (b, 0), (a, 1), (b, 1), (c, 0), (b, 2)]
    assert got[6] == (c, 1)
    one = interleaved(spark, lengths, {"s": 1}, {"s": 9})["s"]
    again = hashed([0, 1, 2], 42, 1)[0]
    assert one == [(a, 0), (a, 1), (b, 0), (b, 1), (b, 2), (c, 0), (c, 1), (again, 0), (again, 1)]


def test_interleave_properties(spark):
    rnd = random.Random(2)
    lengths = {
        f"s{k}": {c: rnd.randint(0, 9) for c in range(rnd.randint(1, 9))} | {99: rnd.randint(1, 30)}
        for k in range(12)
    }
    slots = {s: rnd.randint(1, 6) for s in lengths}
    epoch = {s: sum(n.values()) for s, n in lengths.items()}
    got = interleaved(spark, lengths, slots, {s: 3 * n for s, n in epoch.items()})
    for s, order in got.items():
        assert len(order) == 3 * epoch[s]
        open_ = min(slots[s], sum(n > 0 for n in lengths[s].values()))
        runs = [order[k::open_] for k in range(open_)]
        for run in runs:
            # A slot reads one chunk from its first window to its last, then another one.
            for (c, w), (d, v) in zip(run, run[1:]):
                assert (d, v) == (c, w + 1) if w + 1 < lengths[s][c] else v == 0
        # Chunks are loaded epoch by epoch: counts of loads differ by one epoch at most.
        loads = Counter(c for c, w in order if w == 0)
        assert max(loads.values()) - min(loads[c] for c, n in lengths[s].items() if n) <= 2


def test_mixed_sequences(spark):
    weights, lengths = {"a": 3, "b": 1}, {"a": {0: 5, 1: 7}, "b": {0: 4, 1: 1, 2: 6}}
    n = 150
    out = mixing.mixed_sequences(
        window_frame(spark, lengths), mix_frame(spark, weights), 3, spark.range(n), seed=1
    )
    rows = [tuple(r)[:4] for r in out.orderBy("id").collect()]
    drawn = {r["id"]: r["source"] for r in mixing.draw_sources(spark.range(n), weights, 1).collect()}
    assert [(i, s) for i, s, _, _ in rows] == sorted(drawn.items())
    # Each source's own rows follow its round-robin order.
    order = interleaved(spark, lengths, {"a": 2, "b": 1}, Counter(drawn.values()), seed=1)
    for s in weights:
        assert [(c, w) for _, t, c, w in rows if t == s] == order[s]
    with pytest.raises(ValueError, match="no chunks"):
        mixing.mixed_sequences(
            window_frame(spark, lengths), mix_frame(spark, weights | {"c": 1}), 4, spark.range(n), 1
        )


def test_permutations(spark):
    chunks = spark.range(300).select(F.lit("a").alias("source"), F.col("id").alias("chunk_id"))
    orders = []
    for epoch in (0, 1):
        rows = mixing.epoch_permutation(chunks, 42, epoch).orderBy("place").collect()
        assert [r["place"] for r in rows] == list(range(300))
        orders.append([r["chunk_id"] for r in rows])
        assert orders[-1] == hashed(range(300), 42, epoch)
    assert orders[0] != orders[1]


def test_worker_shards_cover(spark):
    parts = [
        [r["id"] for r in mixing.worker_shard(spark.range(11), w, 3, ["id"]).orderBy("id").collect()]
        for w in range(3)
    ]
    assert parts == [list(range(w, 11, 3)) for w in range(3)]


def test_budget_and_plan(spark):
    assert mixing.token_budget(353_000_000, 4, 512) == (3447265, 3447265 * 4 * 512)
    hand = spark.createDataFrame([("a", 100), ("b", 0)], "source string, tokens long")
    rows = mixing.mix_plan(mix_frame(spark, {"a": 3, "b": 1, "c": 1}), hand, 500).orderBy("source").collect()
    assert [(r["wanted"], r["tokens"], r["epochs"]) for r in rows] == [
        (300.0, 100, 3.0), (100.0, 0, None), (100.0, 0, None),
    ]


def test_draws_with_large_weights(spark):
    weights = {"a": 2**40, "b": 3 * 2**40, "c": 2**20}
    rows = mixing.draw_sources(spark.range(20_000), weights, seed=4).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in rows}
    assert counts["b"] / 20_000 == pytest.approx(0.75, abs=0.01) and counts.get("c", 0) < 3
    with pytest.raises(ValueError):
        mixing.draw_sources(spark.range(1), {"a": 2**62}, seed=4)


def test_hash_blocks_grow_with_the_rows(spark):
    from textloom.plans.prefix import hash_block

    df = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("h"))
    for rows, most in ((10, 16), (4096 * 17, 256), (4096 * 300, 2000)):
        blocks = df.select(hash_block("h", rows).alias("b")).distinct().count()
        assert blocks <= most and (blocks > most / 4 or most == 2000)
