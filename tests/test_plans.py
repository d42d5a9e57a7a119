"""Physical plans: what is read, pushed, shuffled and run in Python."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.catalog import full_catalog
from textloom.functions.lang import english_filter
from textloom.operators import vocabulary as bpe
from textloom.operators.packing import pack_windows
from textloom.plans import joins
from textloom.plans.prefix import running_sum
from textloom.sources.corpus import read_corpus

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(p):
    return re.findall(r"ReadSchema: struct<([^>]*)>", p)


def test_scan_reads_one_column(spark):
    p = plan(read_corpus(spark, f"{SF}/documents.parquet", "web").select("doc_ord", "text"))
    # The place in the file is made by the reader; the staged first row per file is joined in.
    assert "text:string,_tmp_metadata_row_index:bigint" in schemas(p)
    assert "BroadcastHashJoin" in p


def test_language_test_is_pushed(spark):
    p = plan(full_catalog().queries["lang_column_filter"](spark, SF))
    assert "EqualTo(lang,en)" in p


EXPRESSIONS = (
    "trim_unicode text_lengths ascii_ratio ascii_filter lang_sample stopword_counts lang_scores "
    "lang_probs lang_rank english_filter cut_tail cut_references wikitext_detok input_target pretokenize"
).split()


@pytest.mark.parametrize("name", EXPRESSIONS)
def test_text_functions_stay_in_the_jvm(spark, name):
    """The plan that runs: at most the shuffle that spreads a scan of one file over the cores."""
    p = plan(full_catalog().queries[name](spark, SF))
    assert "Python" not in p and "Arrow" not in p
    shuffles = [line for line in p.splitlines() if "Exchange" in line]
    assert len(shuffles) <= (name not in CHEAP)
    assert all("hashpartitioning(doc_id" in line and "REPARTITION" in line for line in shuffles)


# Cheap per row, so their scan is not spread.
CHEAP = {"text_lengths", "input_target", "cut_references"}


def test_english_filter_scores_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    p = plan(english_filter(docs, prob="p"))
    assert p.count("[^\\p{L}\\p{N}_]+") == 1
    lines = [line for line in p.splitlines() if re.search("Filter|Generate|Scan", line)]
    assert [re.search("Filter|Generate|Scan", line).group() for line in lines] == [
        "Filter", "Generate", "Filter", "Scan",
    ]
    assert "[^\\x00-\\x7F]+" in lines[2]


def test_tokenize_does_not_shuffle(spark):
    vocab = bpe.Vocabulary([s.encode() for s in bpe.SPECIAL_TOKENS] + [b"a"])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    p = plan(bpe.tokenize(docs, vocab))
    assert "ArrowEvalPython" in p and "Exchange" not in p


def test_running_sum_never_windows_a_whole_key(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    p = plan(running_sum(df, ["k"], ["id"], F.col("id"), "s"))
    keys = [re.search(r"_we\d[^\]]*\], \[([^\]]*)\]", line).group(1)
            for line in p.splitlines() if re.search(r"\bWindow \[", line)]
    # Over the rows of a (key, block) and the totals of a (key, gathering); only one total
    # per gathering of blocks meets in a window over the key.
    assert [len(k.split(",")) for k in keys].count(2) == 2
    assert "_sup" in p


def test_window_lengths_come_from_the_stored_count(spark, tmp_path):
    rows = [("a", 0, i, [1, 2, 3], 3) for i in range(4)]
    spark.createDataFrame(
        rows, "source string, chunk_id int, doc_ord long, ids array<int>, n_tokens int"
    ).write.parquet(str(tmp_path / "t"))
    read = schemas(plan(pack_windows(spark.read.parquet(str(tmp_path / "t")), 4)))
    assert sum("ids" in s for s in read) <= 2 and any("ids" not in s for s in read)


def test_ids_without_a_count_are_made_once(spark):
    """Tokens that still have to be encoded are staged before the passes over them."""
    vocab = bpe.Vocabulary([s.encode() for s in bpe.SPECIAL_TOKENS] + [b"a"])
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "lang AS source", "0 AS chunk_id", "doc_id AS doc_ord", "text"
    )
    assert "Python" not in plan(pack_windows(bpe.tokenize(docs, vocab), 64))


def test_finding_a_chunk_needs_no_python(spark):
    p = plan(full_catalog().queries["assign_chunks"](spark, SF))
    assert "Python" not in p and "Arrow" not in p and "BroadcastHashJoin" in p


def test_dropped_bytes_stay_in_the_jvm(spark):
    assert "Python" not in plan(full_catalog().queries["dropped_bytes"](spark, SF))


def test_no_cross_joins(spark):
    for name in ("draw_sources", "alloc_slots", "mix_plan", "chunk_nextfit", "pack_windows", "mixed_sequences"):
        p = plan(full_catalog().queries[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_spread_only_when_the_scan_is_too_narrow(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, cores)
    assert joins.spread(wide, "id") is wide
    assert joins.spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == cores


def test_broadcast_only_when_measured_small(spark):
    big, small = spark.range(100), spark.range(50)
    assert "broadcast" in joins.join_measured(big, small, ["id"], 1000)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in joins.join_measured(big, small, ["id"], 99)._jdf.queryExecution().logical().toString()
