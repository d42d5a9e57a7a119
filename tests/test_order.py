"""Order-dependent operators against plain loops."""

import random

import pytest
from loops import next_fit
from pyspark.sql import functions as F

from textloom.operators.articles import assemble_articles
from textloom.operators.chunking import assign_chunks, chunk_sizes
from textloom.operators.packing import pack_windows, split_on_eos, to_batches
from textloom.operators.trainlog import debiased_ema, perplexity_rollup
from textloom.plans.prefix import ordinal, position_block, running_sum


def size_lists():
    rnd = random.Random(11)
    lists = {
        "empty texts": [0, 0, 5, 0, 10, 0, 0, 11, 0, 3, 10, 0, 0],
        "first too big": [50, 1, 2, 50, 50, 3, 10],
        "exact fit": [4, 6, 10, 5, 5, 1, 9, 10, 10],
        "equal": [3] * 60,
        "ones": [1] * 97,
        "zeros": [0] * 40,
        "one": [7],
    }
    for k in range(25):
        lists[f"random {k}"] = [
            rnd.choice([0, 0, 1, 2, 3, 4, 5, 9, 10, 11, 25]) for _ in range(rnd.randint(1, 120))
        ]
    return lists


@pytest.mark.parametrize("block,fan_in", [(1, 2), (1, 8), (2, 3), (3, 2), (7, 4), (64, 8), (1 << 20, 8)])
def test_next_fit(spark, block, fan_in):
    lists = size_lists()
    rows = [(s, i, b) for s, sizes in lists.items() for i, b in enumerate(sizes)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "source string, doc_ord long, n_bytes long")
    got = {(r["source"], r["doc_ord"]): r["chunk_id"] for r in chunk_sizes(df, 10, block_docs=block, fan_in=fan_in).collect()}
    want = {(s, i): c for s, sizes in lists.items() for i, c in enumerate(next_fit(sizes, 10))}
    assert got == want


def test_prefix_chunks(spark):
    lists = size_lists()
    rows = [(s, i, b) for s, sizes in lists.items() for i, b in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source string, doc_ord long, n_bytes long")
    got = {(r["source"], r["doc_ord"]): r["chunk_id"] for r in chunk_sizes(df, 10, "prefix").collect()}
    for s, sizes in lists.items():
        before = 0
        for i, b in enumerate(sizes):
            assert got[s, i] == before // 10
            before += b
    with pytest.raises(ValueError):
        chunk_sizes(df, 10, mode="other")


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_assign_chunks_both_ways(spark, limit):
    rnd = random.Random(3)
    texts = [("a" if i % 3 else "b", i, "é" * rnd.randint(0, 12)) for i in range(300)]
    df = spark.createDataFrame(texts, "source string, doc_ord long, text string")
    got = assign_chunks(df, 30, block_docs=50, broadcast_bytes=limit).collect()
    assert sorted((r["source"], r["doc_ord"], r["text"]) for r in got) == sorted(texts)
    found = {(r["source"], r["doc_ord"]): r["chunk_id"] for r in got}
    for s in "ab":
        mine = [t for t in texts if t[0] == s]
        chunks = next_fit([len(t[2].encode()) for t in mine], 30)
        assert [found[s, t[1]] for t in mine] == chunks


def test_running_sum_over_blocks(spark):
    rows = [(k, i, (i * 7) % 5) for k in "xy" for i in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = running_sum(df, ["k"], ["i"], F.col("v"), "s", position_block("i", 16))
    got = {(r["k"], r["i"]): r["s"] for r in out.collect()}
    for k in "xy":
        total = 0
        for kk, i, v in rows:
            if kk == k:
                assert got[k, i] == total
                total += v
    places = ordinal(df, [], ["i", "k"], "p", position_block("i", 16)).orderBy("i", "k").collect()
    assert [r["p"] for r in places] == list(range(len(rows)))


ARTICLES = {
    "a": (
        ["intro", "", "<SOT>One", "first", "", "x <SOT>", "<SOT>Two", "<SOT>", "tail"],
        [(0, "intro\n"), (2, "One\nfirst\nx <SOT>\n"), (6, "Two\n"), (8, "tail\n")],
    ),
    "b": (["<SOT>Only"], [(0, "Only\n")]),
    "c": (["", "", ""], []),
    "d": (["<SOT>", "", "<SOT>T", "line"], [(2, "T\nline\n")]),
}


@pytest.mark.parametrize("restage", [True, False])
def test_articles(spark, restage):
    rows = [(f, i, t) for f, (lines, _) in ARTICLES.items() for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, row_idx long, text string")
    out = assemble_articles(df, restage=restage).orderBy("file", "doc_ord").collect()
    for f, (_, docs) in ARTICLES.items():
        assert [(r["doc_ord"], r["text"]) for r in out if r["file"] == f] == docs


def test_many_articles(spark):
    """Every title starts a document; nothing but titles' marks and empty lines is lost."""
    rnd = random.Random(4)
    lines = [rnd.choice(["", "line", "two words", "<SOT>T"]) for _ in range(9000)]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, row_idx long, text string")
    out = [r["text"] for r in assemble_articles(df).orderBy("doc_ord").collect()]
    places = [i for i, t in enumerate(lines) if t == "<SOT>T"]
    assert len(out) == len(places) + any(lines[: places[0]])
    assert "".join(out) == "".join(t.removeprefix("<SOT>") + "\n" for t in lines if t)
    assert all(t.startswith("T\n") for t in out[-len(places) :])


def token_frame(spark, chunks):
    rows = [(s, c, i, ids) for (s, c), docs in chunks.items() for i, ids in enumerate(docs)]
    return spark.createDataFrame(rows, "source string, chunk_id int, doc_ord long, ids array<int>")


def test_pack_windows(spark):
    rnd, step = random.Random(6), 8
    chunks = {("n", n): [list(range(n))] for n in (0, 1, 8, 9, 16, 17, 18)}
    for c in range(12):
        chunks["r", c] = [
            [rnd.randint(2, 99) for _ in range(rnd.choice([0, 1, 2, 5, 8, 40]))] + [1]
            for _ in range(rnd.randint(1, 30))
        ]
    got = {
        (r["source"], r["chunk_id"], r["win"]): r["seq"]
        for r in pack_windows(token_frame(spark, chunks), step).collect()
    }
    want = {}
    for (s, c), docs in chunks.items():
        flat = [t for d in docs for t in d]
        for w in range((len(flat) - 1) // step if flat else 0):
            want[s, c, w] = flat[w * step : (w + 1) * step + 1]
    assert got == want


def test_split_on_eos(spark):
    rnd = random.Random(7)
    chunks = {
        ("s", c): [[rnd.choice([1, 1, 2, 3, 4, 5]) for _ in range(rnd.randint(0, 9))] for _ in range(20)]
        for c in range(10)
    }
    out = split_on_eos(token_frame(spark, chunks), order="doc_ord").collect()
    got = {(r["chunk_id"], r["doc_no"]): r["ids"] for r in out}
    want = {}
    for (_, c), pieces in chunks.items():
        doc, no = [], 0
        for t in (t for p in pieces for t in p):
            if t == 1:
                want[c, no] = doc
                doc, no = [], no + 1
            else:
                doc.append(t)
    assert got == want


def test_batches(spark):
    df = spark.range(10).select(F.col("id").alias("i"), (F.col("id") * 2).alias("x"))
    got = to_batches(df, 4, ["i"], "x").orderBy("batch_id").collect()
    assert [r["items"] for r in got] == [[0, 2, 4, 6], [8, 10, 12, 14], [16, 18]]
    same = to_batches(df, 4, [], "x", position="i").orderBy("batch_id").collect()
    assert [r["items"] for r in same] == [r["items"] for r in got]


def test_perplexity_last_interval(spark):
    log = spark.createDataFrame([(s, 2.0, 4) for s in range(451)], "step long, loss_sum double, n_tokens long")
    assert [r["step"] for r in perplexity_rollup(log).orderBy("step").collect()] == [200, 400]
    assert perplexity_rollup(log.filter("step < 200")).count() == 0


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.999, 0.01])
def test_ema(spark, alpha):
    rnd = random.Random(8)
    xs = [rnd.uniform(1, 12) for _ in range(2500)]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(xs)], "interval long, avg_loss double")
    got = [r["ema"] for r in debiased_ema(df, alpha).orderBy("interval").collect()]
    numer = denom = 0.0
    for x, y in zip(xs, got):
        numer, denom = x * alpha + numer * (1 - alpha), alpha + denom * (1 - alpha)
        assert y == pytest.approx(numer / denom, rel=1e-9)


def test_windows_are_cut_from_stretches():
    """Documents in order of their place leave fragments at the ends of a stretch only, in any batches."""
    import pyarrow as pa

    from textloom.operators.packing import _cut_task

    schema = pa.schema([("source", pa.string()), ("chunk_id", pa.int32()), ("win", pa.int64()), ("lo", pa.int64()), ("part", pa.list_(pa.int32()))])
    sizes, rows, at = [3, 1, 9, 2, 2, 14, 5, 1, 1, 6], [], 7
    for n in sizes:
        rows.append({"source": "a", "chunk_id": 2, "st": at, "ids": list(range(at, at + n))})
        at += n
    kinds = {"source": pa.string(), "chunk_id": pa.int32(), "st": pa.int64(), "ids": pa.list_(pa.int32())}
    for size in (1, 3, 10):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema=pa.schema(kinds)) for i in range(0, 10, size)]
        whole, rest = ([r for b in _cut_task(4, w, schema)(iter(batches)) for r in b.to_pylist()] for w in (True, False))
        assert [(r["win"], r["part"]) for r in whole] == [(w, list(range(4 * w, 4 * w + 5))) for w in range(2, 12)]
        assert [(r["win"], r["lo"], r["part"]) for r in rest] == [(1, 7, [7, 8])] + ([] if at == 49 else [(12, 48, list(range(48, at)))])
