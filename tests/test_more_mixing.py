"""Draws through a table of cells, verdicts as a plan, ordered batches, and cuts of long texts."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textloom.operators import mixing
from textloom.operators import vocabulary as bpe
from textloom.sources import writers


def mix_of(spark, weights):
    rows = [(i, f"s{i}", w) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "pos long, source string, weight long")


@pytest.mark.parametrize("weights", [[5], [1, 2, 3, 4], [1] * 50 + [10_000] + [1] * 50, [2**60, 1, 2**60]])
def test_cells_give_the_same_draws(spark, weights):
    mix = mix_of(spark, weights)
    rows = spark.range(3_000)
    got = {r["id"]: r["source"] for r in mixing.draw_from_table(rows, mix, 5).collect()}
    assert got == {r["id"]: r["source"] for r in mixing.draw_sources(rows, mix, 5).collect()}
    cells = mixing.draw_cells(mix).collect()
    assert len(cells) <= 2 * len(weights) + 1
    again = {r["id"]: r["source"] for r in mixing.draw_from_table(rows.repartition(7), mix, 5).collect()}
    assert again == got


def test_more_sources_than_a_literal_mix_may_hold(spark):
    n = mixing.MAX_SOURCES + 5_000
    mix = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("s"), "id").alias("source"), F.lit(3).alias("weight"))
    with pytest.raises(ValueError):
        mixing.draw_sources(spark.range(5), mix, 1)
    drawn = mixing.draw_from_table(spark.range(40_000), mix, 1)
    counts = [r["count"] for r in drawn.groupBy("source").count().collect()]
    assert sum(counts) == 40_000 and len(counts) > 0.9 * n * (1 - 2.72 ** (-40_000 / n)) and max(counts) < 20


def test_bad_weights_are_refused(spark):
    for weights in ([1, 0], [1, -2], [2**61, 2**61]):
        with pytest.raises(ValueError):
            mixing.draw_from_table(spark.range(2), mix_of(spark, weights), 1)
    assert mixing.draw_from_table(spark.range(2), mix_of(spark, []), 1).count() == 0


def test_verdicts(spark):
    slots = spark.createDataFrame([(1,), (2,), (3,)], "slots long")
    good, bad = mix_of(spark, [3, 4]), mix_of(spark, [3, 0])
    at_hand = spark.createDataFrame([("s0",), ("s9",)], "source string")

    def told(*args):
        return {r["slots"]: r["reason"] for r in mixing.mix_verdicts(*args).collect()}

    assert told(good, slots) == {1: "fewer slots than sources", 2: None, 3: None}
    assert set(told(bad, slots).values()) == {"a weight is not positive"}
    assert set(told(good, slots, at_hand).values()) == {"a source has no chunks"}
    assert mixing.checked_mix(good, 2).count() == 2
    with pytest.raises(PySparkException, match="fewer slots"):
        mixing.checked_mix(good, 1).collect()


def test_resuming_opens_later_files_only(spark, tmp_path):
    path = str(tmp_path / "b")
    batches = spark.range(100).select(F.col("id").alias("batch_id"), F.array("id").alias("items")).repartition(5, "items")
    writers.write_batches(batches, path, per_part=10)
    for start in (0, 37, 40, 99, 100, 500):
        got = writers.read_batches(spark, path, start)
        assert [r["batch_id"] for r in got.orderBy("batch_id").collect()] == list(range(start, 100))
        parts = {f.split("part=")[1].split("/")[0] for f in got.inputFiles()} if start < 100 else set()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert start >= 100 or f"part#" in plan and parts
    read = writers.read_batches(spark, path, 37).select(F.input_file_name().alias("f"), "batch_id").collect()
    assert {r["f"].split("part=")[1].split("/")[0] for r in read} == {"3", "4", "5", "6", "7", "8", "9"}
    for d in ("part=0", "part=1", "part=2"):
        for f in (tmp_path / "b/batches" / d).iterdir():
            f.write_bytes(b"not parquet any more")  # files that must not be opened
    assert writers.read_batches(spark, path, 37).count() == 63
    # Within a file, rows are in order.
    inside = spark.read.parquet(path + "/batches/part=5").select("batch_id").collect()
    assert [r[0] for r in inside] == list(range(50, 60))


def test_stretches_keep_pre_tokens(spark):
    rng = random.Random(6)
    odd = ["a", "b c", "  ", " ", "\n", "\t x", "it's", " 12", "1 2", "é", "日本", "!? ", "\u3000", "\x1c", " 's", "x\n\n y", "\U0001f600"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 60))) for _ in range(300)] + ["", " ", None, "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for length in (1, 5, 17):
        cut = df.select("i", F.posexplode(bpe.stretches("text", length)).alias("p", "part"))
        joined = cut.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "part"))), lambda s: s["part"]), "").alias("t"))
        assert {r["i"]: r["t"] for r in joined.collect()} == {i: t for i, t in enumerate(texts) if t is not None}
        words = cut.filter("part IS NOT NULL").select("i", "p", F.posexplode(bpe.pretokenize("part")).alias("q", "w")).collect()
        whole = df.filter("text IS NOT NULL").select("i", F.posexplode(bpe.pretokenize("text")).alias("q", "w")).collect()
        got, want = Counter(), Counter()
        for r in sorted(words, key=lambda r: (r["i"], r["p"], r["q"])):
            got[r["i"], got["n", r["i"]], r["w"]] += 1
            got["n", r["i"]] += 1
        for r in sorted(whole, key=lambda r: (r["i"], r["q"])):
            want[r["i"], want["n", r["i"]], r["w"]] += 1
            want["n", r["i"]] += 1
        assert got == want, length


def test_counts_of_a_very_long_text(spark):
    """50 MB in one row: the stretches are short, and the counts are those of its parts."""
    line = "The cat's 42 mice, and  more\nof it. "
    text = spark.range(1).select(F.repeat(F.lit(line), 50_000_000 // len(line)).alias("text"))
    parts = text.select(F.explode(bpe.stretches("text")).alias("p")).agg(F.max(F.length("p")), F.count("*")).first()
    assert parts[0] < 1.1 * bpe.STRETCH and parts[1] > 700
    n = 50_000_000 // len(line)
    got = {r["word"]: r["n"] for r in bpe.pretoken_counts(text).collect()}
    assert got[" The"] == n and "The" not in got and got[" cat"] == got["'s"] == got[" mice"] == n and got["\n"] == n


def test_articles_over_block_borders(spark):
    """Documents inside a block, at its borders and over several blocks; no group is larger than a block."""
    from textloom.functions.text import TITLE_MARK
    from textloom.operators.articles import assemble_articles
    from textloom.plans.prefix import BLOCK_WIDTH

    rnd, rows = random.Random(3), []
    for f in "xy":
        n = 3 * BLOCK_WIDTH + 500 if f == "x" else 90
        for i in range(n):
            title = rnd.random() < 0.01 and not BLOCK_WIDTH - 50 < i < 2 * BLOCK_WIDTH + 20 or i in (BLOCK_WIDTH, 3 * BLOCK_WIDTH)
            rows.append((f, i, (TITLE_MARK if title else "") + rnd.choice(["", "a", "line b"])))
    df = spark.createDataFrame(rows, "file string, row_idx long, text string").repartition(5)
    want, doc = {}, None
    for f, i, t in rows:
        if doc is None or doc[0] != f or t.startswith(TITLE_MARK):
            doc = (f, i)
        t = t.removeprefix(TITLE_MARK)
        if t:
            want.setdefault(doc, []).append((i, t))
    want = sorted((f, v[0][0], "".join(t + "\n" for _, t in v)) for (f, _), v in want.items())
    assert sorted(map(tuple, assemble_articles(df).collect())) == want
    longest = max(len(t.encode()) for _, _, t in want)
    assert assemble_articles(df, max_bytes=longest).count() == len(want)
    with pytest.raises(PySparkException, match=f"a document has {longest} bytes"):
        assemble_articles(df, max_bytes=longest - 1).collect()
