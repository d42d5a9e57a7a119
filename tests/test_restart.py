"""Jobs and streams that are stopped and started again."""

import json
import os

import pytest
from loops import next_fit

from textloom.operators import vocabulary as bpe
from textloom.operators.chunking import assign_chunks, chunk_sizes, open_chunks
from textloom.plans import token_job
from textloom.sources import corpus, writers
from textloom.streaming.incremental import stream_chunks


def documents(spark, n=40):
    rows = [(s, i, f"text {i} of {s} " + "word " * (i % 5)) for s in "ab" for i in range(n)]
    return spark.createDataFrame(rows, "source string, doc_ord long, text string")


@pytest.fixture
def tables(spark, tmp_path):
    df = assign_chunks(documents(spark), 200)
    writers.write_chunks(df, str(tmp_path / "chunks"))
    return str(tmp_path / "chunks"), str(tmp_path / "tokens"), bpe.learn_bpe(bpe.pretoken_counts(df), 60)


def files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def scan_files(df, column="text"):
    """Files that the scan of a column has opened, by its own metric."""
    node = df._jdf.queryExecution().executedPlan()
    todo = [node]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName().startswith("Scan parquet") and column in node.output().mkString(","):
            return node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    raise AssertionError("no scan of texts")


def rows(df):
    return sorted(map(tuple, df.select("source", "chunk_id", "doc_ord", "ids").collect()))


def test_only_unfinished_chunks_are_written(spark, tables, tmp_path):
    chunks, tokens, vocab = tables
    texts = corpus.all_chunks(spark, chunks)
    want = rows(bpe.tokenize(texts, vocab))
    # Half of the chunks is finished, one has lost a document.
    writers.write_tokens(bpe.tokenize(texts.filter("chunk_id < 3 AND NOT (source = 'a' AND doc_ord = 1)"), vocab), tokens)
    before = files(tokens)
    broken = {f for f in before if "source=a/chunk_id=0/" in f}
    assert broken
    n = texts.select("source", "chunk_id").distinct().count()
    assert token_job.tokenize_pending(spark, chunks, tokens, vocab) == n - 5
    after = files(tokens)
    assert {f: t for f, t in after.items() if f in before} == {f: t for f, t in before.items() if f not in broken}
    assert rows(writers.read_tokens(spark, tokens)) == want
    assert token_job.tokenize_pending(spark, chunks, tokens, vocab) == 0
    assert files(tokens) == after


def test_small_chunks_share_folders(spark, tables, tmp_path):
    """Three chunks a folder: few files, the same rows, and a run goes on inside a folder."""
    vocab, root, tokens = tables[2], str(tmp_path / "few"), str(tmp_path / "few tokens")
    df = assign_chunks(documents(spark), 200)
    writers.write_chunks(df, root, per_folder=3)
    texts = corpus.all_chunks(spark, root)
    assert sorted(texts.select(*df.columns).collect()) == sorted(df.collect())
    n = texts.select("source", "chunk_id").distinct().count()
    folders = {os.path.dirname(f) for f in files(root)}
    assert len(folders) < n / 2 and all("/chunks_by_3=" in f for f in folders)
    want = rows(bpe.tokenize(texts, vocab))

    # Of the first folder of a one chunk is finished, one in part; the others of a are, and none of b.
    done = "source = 'a' AND chunk_id <> 1 AND NOT (chunk_id = 2 AND doc_ord % 2 = 0)"
    writers.write_tokens(bpe.tokenize(texts.filter(done), vocab), tokens, per_folder=3)
    before = files(tokens)
    of_a = texts.filter("source = 'a'").select("chunk_id").distinct().count()
    assert token_job.tokenize_pending(spark, root, tokens, vocab) == n - of_a + 2
    assert rows(writers.read_tokens(spark, tokens)) == want
    after = files(tokens)
    untouched = {f for f in before if "source=a/chunks_by_3=0/" not in f}
    assert untouched and {f: after.get(f) for f in untouched} == {f: before[f] for f in untouched}
    assert token_job.tokenize_pending(spark, root, tokens, vocab) == 0
    assert files(tokens) == after
    drawn = writers.read_token_chunks(spark, tokens, texts.select("source", "chunk_id").filter("chunk_id = 4").distinct())
    assert rows(drawn) == [r for r in want if r[1] == 4]

    # A token table that is not there yet gets the folders of the texts.
    token_job.tokenize_pending(spark, root, str(tmp_path / "new"), vocab)
    assert rows(writers.read_tokens(spark, str(tmp_path / "new"))) == want
    assert corpus.per_folder_of(spark, str(tmp_path / "new")) == 3
    assert writers.chunks_per_folder(1 << 28) == 1 and writers.chunks_per_folder(20_000) > 1000


def test_a_run_that_fails_can_be_repeated(spark, tables):
    chunks, tokens, vocab = tables
    replaced = token_job.replace_tokens

    def failing(df, path):
        replaced(df.filter("chunk_id = 1"), path)
        raise RuntimeError("stopped")

    token_job.replace_tokens = failing
    try:
        with pytest.raises(RuntimeError):
            token_job.tokenize_pending(spark, chunks, tokens, vocab)
    finally:
        token_job.replace_tokens = replaced
    token_job.tokenize_pending(spark, chunks, tokens, vocab)
    assert rows(writers.read_tokens(spark, tokens)) == rows(bpe.tokenize(corpus.all_chunks(spark, chunks), vocab))


def test_pending_chunks_prune_the_scan(spark, tables):
    from textloom.session import stage

    chunks, tokens, vocab = tables
    texts = corpus.all_chunks(spark, chunks)
    writers.write_tokens(bpe.tokenize(texts.filter("chunk_id > 0"), vocab), tokens)
    progress = stage(token_job.chunk_progress(spark, chunks, tokens), "progress")
    todo = token_job.pending_texts(spark, chunks, progress)
    assert {(r["source"], r["chunk_id"]) for r in todo.collect()} == {("a", 0), ("b", 0)}
    plan = todo._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "chunk_id" in line)
    assert "dynamicpruning" in scan
    # The scan has opened the files of the two pending chunks only.
    assert scan_files(todo) == len([f for f in files(chunks) if "chunk_id=0/" in f]) < len(files(chunks))
    joined = token_job.pending_texts(spark, chunks, progress, broadcast_bytes=0)
    assert rows(bpe.tokenize(joined, vocab)) == rows(bpe.tokenize(todo, vocab))


def test_drawn_chunks_prune_the_token_scan(spark, tables):
    from textloom.session import stage

    chunks, tokens, vocab = tables
    token_job.tokenize_pending(spark, chunks, tokens, vocab)
    every = writers.read_tokens(spark, tokens)
    order = stage(every.select("source", "chunk_id").distinct(), "order")
    drawn = writers.read_token_chunks(spark, tokens, order.filter("chunk_id < 2 AND source = 'a'"))
    assert rows(drawn) == rows(every.filter("chunk_id < 2 AND source = 'a'"))
    drawn.collect()
    assert "dynamicpruning" in drawn._jdf.queryExecution().executedPlan().toString()
    opened = [f for f in files(tokens) if "source=a/chunk_id=0/" in f or "source=a/chunk_id=1/" in f]
    assert scan_files(drawn, "ids") == len(opened) < len(files(tokens))
    joined = writers.read_token_chunks(spark, tokens, order.filter("chunk_id < 2"), broadcast_bytes=0)
    assert rows(joined) == rows(every.filter("chunk_id < 2"))


def test_no_partition_metadata_is_read_as_text(spark, tables):
    """Progress needs no text and no ids."""
    chunks, tokens, vocab = tables
    token_job.tokenize_pending(spark, chunks, tokens, vocab)
    plan = token_job.chunk_progress(spark, chunks, tokens)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "text:string" not in plan and "ids:array" not in plan


@pytest.mark.parametrize("block_docs,cuts", [(1000, (0, 4, 11, 18)), (3, (5,))])
def test_next_fit_goes_on_from_an_open_chunk(spark, block_docs, cuts):
    sizes = [5, 0, 30, 12, 40, 0, 0, 7, 7, 7, 100, 1, 39, 1, 0, 20, 20, 1]
    for cut in cuts:
        carry, got = None, []
        for lo, hi in ((0, cut), (cut, len(sizes))):
            rows = [("s", i, sizes[i]) for i in range(lo, hi)]
            df = spark.createDataFrame(rows, "source string, doc_ord long, n_bytes long")
            out = chunk_sizes(df, 40, block_docs=block_docs, fan_in=2, carry=carry)
            got += [r["chunk_id"] for r in out.orderBy("doc_ord").collect()]
            state = [tuple(r) for r in open_chunks(out, carry).collect()]
            carry = spark.createDataFrame(state, "source string, carry long, chunk long")
        assert got == next_fit(sizes, 40)
    with pytest.raises(ValueError):
        chunk_sizes(df, 40, "prefix", carry=carry)


def lines(path, texts):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({"content": t} if t is not None else {"other": 1}) + "\n" for t in texts))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Numbers over four micro-batches, one of them without a kept text, one that fails half way."""
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    parts = [["a" * 9, "bb", None, "drop"], ["drop", "drop"], ["c" * 30, "dd", ""], ["e" * 10, "f" * 10, "g" * 21, "h"]]
    fail = {"now": False}

    def clean(df):
        if fail["now"]:
            raise RuntimeError("stopped")
        return df.filter("text <> 'drop'")

    def run():
        stream_chunks(spark, str(src), "content", out, mark, "web", clean=clean, max_bytes=20).awaitTermination(120)

    for k, texts in enumerate(parts):
        lines(src / f"{k}/x.jsonl", texts)
        if k == 2:
            fail["now"] = True
            with pytest.raises(Exception, match="stopped"):
                run()
            fail["now"] = False
        run()
    rows = spark.read.parquet(out).orderBy("doc_ord").collect()
    kept = [t for part in parts for t in part if t not in (None, "drop")]
    assert [r["text"] for r in rows] == kept
    assert [r["chunk_id"] for r in rows] == next_fit([len(t) for t in kept], 20)
    assert len({r["doc_ord"] for r in rows}) == len(kept)


def test_stream_leaves_no_staged_tables(spark, tmp_path):
    from textloom import session

    before = len(session._staged)
    lines(tmp_path / "in/x.jsonl", ["one", "two"])
    stream_chunks(
        spark, str(tmp_path / "in"), "content", str(tmp_path / "out"), str(tmp_path / "mark"), "web", clean=lambda d: d
    ).awaitTermination(120)
    assert len(session._staged) == before
