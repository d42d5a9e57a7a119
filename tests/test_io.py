"""Sources, sinks and streams on small files."""

import gzip
import json

import pytest
from loops import next_fit
from pyspark.sql import functions as F

from textloom.operators import vocabulary as bpe
from textloom.operators.chunking import assign_chunks
from textloom.operators.packing import pack_windows, token_stats
from textloom.plans import recipes
from textloom.sources import corpus, manifest, writers
from textloom.streaming.incremental import stream_clean, stream_tokens


def write_lines(path, rows, opener=open):
    path.parent.mkdir(parents=True, exist_ok=True)
    with opener(path, "wt", encoding="utf-8") as f:
        f.writelines(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows)


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_jsonl(spark, tmp_path):
    write_lines(tmp_path / "a" / "x.jsonl", [{"content": "one"}, {"other": "no"}, {"content": None}])
    write_lines(tmp_path / "b" / "y.jsonl", [{"content": ""}, {"content": "two\u0000"}])
    write_lines(tmp_path / "b" / "skip.txt", [{"content": "not listed"}])
    assert texts(corpus.scan_jsonl(spark, str(tmp_path), "content", glob="*.jsonl")) == [
        "", "one", "two\u0000",
    ]
    df = corpus.read_jsonl(spark, str(tmp_path), "web", "content", glob="*.jsonl")
    assert [r["text"] for r in df.orderBy("doc_ord").collect()] == ["one", "", "two\u0000"]


def test_jsonl_order_over_splits(spark, tmp_path):
    for name in ("b", "a"):
        write_lines(tmp_path / f"{name}.jsonl", [{"k": f"{name} {i:05d}"} for i in range(4000)])
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = corpus.read_jsonl(spark, str(tmp_path), "web", "k")
        rows = df.orderBy("doc_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert [r["text"] for r in rows] == [f"{n} {i:05d}" for n in "ab" for i in range(4000)]
    assert [r["doc_ord"] for r in rows] == list(range(8000))


def test_gzip_jsonl(spark, tmp_path):
    write_lines(tmp_path / "x.json.gz", [{"text": "one", "n": 5}, {"text": "two", "n": 6}], gzip.open)
    df = corpus.scan_jsonl(spark, str(tmp_path), "text", order_key="n")
    assert sorted((r["text"], r["doc_ord"]) for r in df.collect()) == [("one", 5), ("two", 6)]


def test_broken_line_fails(spark, tmp_path):
    write_lines(tmp_path / "x.jsonl", [{"content": "one"}, '{"content": \n'])
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        corpus.scan_jsonl(spark, str(tmp_path), "content").collect()


def test_parquet_order_over_files(spark, tmp_path):
    root = tmp_path / "raw files"
    for k, name in enumerate(["b", "a", "c"]):
        rows = [(f"{name}{i}", "en" if i % 2 else "fr", k) for i in range(5)]
        spark.createDataFrame(rows, "text string, language string, extra int").coalesce(1).write.parquet(
            str(root / name)
        )
    df = corpus.read_corpus(spark, str(root), "web")
    assert [r["text"] for r in df.orderBy("doc_ord").collect()] == [
        f"{n}{i}" for n in "abc" for i in range(5)
    ]
    assert [r["doc_ord"] for r in df.orderBy("doc_ord").collect()] == list(range(15))
    english = corpus.read_corpus(
        spark, str(root), "web", columns=["language"], where=F.col("language") == "en"
    )
    assert [r["doc_ord"] for r in english.orderBy("doc_ord").collect()] == [1, 3, 6, 8, 11, 13]


def test_null_text_is_dropped(spark, tmp_path):
    spark.createDataFrame([("a",), (None,), ("",)], "text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    df = corpus.read_corpus(spark, str(tmp_path / "p"), "s").orderBy("doc_ord")
    assert [(r["doc_ord"], r["text"]) for r in df.collect()] == [(0, "a"), (2, "")]


def test_manifests(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Name,Chunks\narxiv,63\nwikitext,2")
    (tmp_path / "s.csv").write_text("Name,Total,Sampled,Epochs\nwiki,11.6 GB,11.6 GB,2\nweb,15.8 TB,54.1 GB,1\n")
    assert [tuple(r) for r in manifest.read_chunk_manifest(spark, str(tmp_path / "d.csv")).collect()] == [
        ("arxiv", 63), ("wikitext", 2),
    ]
    rows = manifest.read_download_manifest(spark, str(tmp_path / "s.csv")).collect()
    assert [tuple(r) for r in rows] == [("wiki", 11.6, 11.6, 2), ("web", 15800.0, 54.1, 1)]


def small_corpus(spark):
    rows = [(s, i, f"the {s} text number {i}") for s in ("a", "b") for i in range(12)]
    return spark.createDataFrame(rows, "source string, doc_ord long, text string")


def test_chunks_to_tokens_to_windows(spark, tmp_path):
    chunks = assign_chunks(small_corpus(spark), 60)
    writers.write_chunks(chunks, str(tmp_path / "chunks"))
    stored = corpus.all_chunks(spark, str(tmp_path / "chunks"))
    assert sorted(stored.select(*chunks.columns).collect()) == sorted(chunks.collect())
    assert "PartitionFilters: [isnotnull(chunk_id" in _plan(corpus.first_chunks(stored, 2))

    vocab = bpe.learn_bpe(bpe.pretoken_counts(corpus.first_chunks(stored, 10)), 60)
    done = stored.filter("source = 'a' and chunk_id = 0").select("source", "chunk_id").distinct()
    todo = writers.pending_chunks(stored, done)
    assert todo.filter("source = 'a' and chunk_id = 0").count() == 0
    writers.write_tokens(bpe.tokenize(stored, vocab), str(tmp_path / "tokens"))
    tokens = writers.read_tokens(spark, str(tmp_path / "tokens"))
    assert tokens.filter("n_tokens <> size(ids) or element_at(ids, -1) <> 1").count() == 0
    sizes = {(r["source"], r["chunk_id"]): r["tokens"] for r in token_stats(tokens).collect()}
    per_chunk = pack_windows(tokens, 8).groupBy("source", "chunk_id").count().collect()
    assert {(r["source"], r["chunk_id"]): r["count"] for r in per_chunk} == {
        k: (n - 1) // 8 for k, n in sizes.items() if n > 8
    }


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recipes(spark, tmp_path):
    english, other = "the cat is in the house and it is on", "der die das und in zu von mit"
    paper = "body\n## References\n\n[1]"
    write_lines(tmp_path / "arxiv/d/1.jsonl.gz", [{"text": paper}, {"text": "x"}], gzip.open)
    write_lines(tmp_path / "c4/en/1.json.gz", [{"text": " as is "}, {"url": "-"}], gzip.open)
    write_lines(tmp_path / "openwebtext2/1.jsonl", [{"content": other}, {"content": english}])
    write_lines(tmp_path / "pubmed/1.jsonl", [{"contents": "p"}, {"contents": ""}])
    for name in ("book2", "wikipedia", "fineweb"):
        spark.createDataFrame([("\u3000one \n", "en"), ("two", "fr")], "text string, language string").coalesce(
            1
        ).write.parquet(str(tmp_path / name))
    lines = ["before", "= Title =", "", "1 @,@ 000 , yes", "= = Part = ="]
    for part in ("p0", "p1"):
        spark.createDataFrame([(t,) for t in lines], "text string").coalesce(1).write.parquet(
            str(tmp_path / "wikitext" / part)
        )

    article = "Title\n1,000, yes\nPart\n"
    want = {
        "arxiv": ["body\n", "x"], "c4": [" as is "], "openwebtext2": [english], "pubmed": ["p", ""],
        "book2": ["one", "two"], "wikipedia": ["one", "two"], "fineweb": ["one"],
        "wikitext": ["before\n", article, "before\n", article],
    }
    assert set(want) == set(recipes.RECIPES)
    for name, docs in want.items():
        rows = recipes.chunk_corpus(spark, name, str(tmp_path / name), 8).orderBy("doc_ord").collect()
        assert [r["text"] for r in rows] == docs, name
        assert [r["chunk_id"] for r in rows] == next_fit([len(t.encode()) for t in docs], 8), name


def test_preview_and_json(spark, tmp_path):
    df = small_corpus(spark)
    assert corpus.preview(df, 3, ["source", "doc_ord"]).count() == 3
    assert corpus.describe_table(df)["rows"] == 24
    writers.write_preview(df, str(tmp_path / "p"), 5)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 24


def test_stream_tokens_once_per_file(spark, tmp_path):
    root, out, mark = (str(tmp_path / n) for n in ("chunks", "tokens", "mark"))
    df = assign_chunks(small_corpus(spark), 60)
    vocab = bpe.learn_bpe(bpe.pretoken_counts(df), 60)
    writers.write_chunks(df.filter("source = 'a'"), root)
    for _ in range(2):
        stream_tokens(spark, root, out, mark, vocab).awaitTermination(120)
        assert spark.read.parquet(out).count() == 12
    writers.write_chunks(df.filter("source = 'b'"), root, mode="append")
    stream_tokens(spark, root, out, mark, vocab).awaitTermination(120)
    got = spark.read.parquet(out).select("source", "chunk_id", "doc_ord", "ids").collect()
    want = bpe.tokenize(df, vocab).select("source", "chunk_id", "doc_ord", "ids").collect()
    assert sorted(got) == sorted(want)


def test_stream_clean(spark, tmp_path):
    english, other = "the cat is in the house and it is on", "der die das und in zu von mit"
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write_lines(src / "1.jsonl", [{"content": f"  {english} 1\n"}, {"content": other}, {"x": 1}])
    stream_clean(spark, str(src), "content", out, mark, "web", max_bytes=50).awaitTermination(120)
    write_lines(src / "2.jsonl", [{"content": f"{english} 2"}, {"content": f"{english} 3"}, {"content": english}])
    stream_clean(spark, str(src), "content", out, mark, "web", max_bytes=50).awaitTermination(120)
    rows = spark.read.parquet(out).orderBy("batch_id", "doc_ord").collect()
    assert [r["text"] for r in rows] == [f"{english} {n}" for n in (1, 2, 3)] + [english]
    # Positions count the lines that have the key; each batch's chunks start at 0.
    assert [(r["batch_id"], r["doc_ord"], r["chunk_id"]) for r in rows] == [(0, 0, 0), (1, 0, 0), (1, 1, 1), (1, 2, 2)]
    assert {r["source"] for r in rows} == {"web"}


def test_staged_tables(spark, monkeypatch):
    import os

    from textloom import session

    monkeypatch.setattr(session, "_staged", [])
    df = session.stage(spark.range(5), "five")
    assert sorted(r[0] for r in df.collect()) == list(range(5))
    (path,) = session._staged
    assert path.startswith(session.shared_dir(spark)) and os.path.isdir(path.removeprefix("file:"))
    other = session.stage(spark.range(2), "two")
    session.drop(spark, other)
    assert not os.path.exists(other.staged_path.removeprefix("file:"))
    assert session.drop_staged(spark) == 1
    assert not os.path.exists(path.removeprefix("file:"))


def test_ordered_files_grow_in_number(spark, tmp_path):
    """Files in id order hold a bounded number of bytes each, however many there are."""
    from textloom.catalog.files import in_id_order

    rows = spark.createDataFrame([(i * 7 % 400, "é" * 25) for i in range(400)], "doc_id long, text string")
    assert in_id_order(rows, "text", 3).rdd.getNumPartitions() == 3
    dealt = in_id_order(rows, "text", 3, file_bytes=1000)
    assert dealt.rdd.getNumPartitions() == 20
    dealt.write.parquet(str(tmp_path / "x"))
    ids = [spark.read.parquet(str(f)).toArrow()["doc_id"].to_pylist() for f in sorted((tmp_path / "x").glob("*.parquet"))]
    assert max(map(len, ids)) < 40
    assert [i for part in ids for i in part] == list(range(400))
    assert in_id_order(rows.limit(0), "text", 3).count() == 0


def test_stream_tokens_spreads_few_files(spark, tmp_path):
    """A micro-batch of one file is tokenized by all cores."""
    root, out, mark = (str(tmp_path / n) for n in ("chunks", "tokens", "mark"))
    df = spark.createDataFrame([("a", 0, i, f"text {i}") for i in range(200)], "source string, chunk_id int, doc_ord long, text string")
    writers.write_chunks(df.coalesce(1), root)
    vocab = bpe.Vocabulary([b"<s>", b"</s>", *[bytes([b]) for b in range(32, 127)]], specials=("<s>", "</s>"))
    stream_tokens(spark, root, out, mark, vocab).awaitTermination(120)
    assert spark.read.parquet(out).count() == 200
    assert len(list((tmp_path / "tokens" / "batch_id=0").glob("*.parquet"))) > 1
