"""Scans, samples, unions and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import Catalog, documents, table
from textloom.functions.lang import ASCII_BAR, ascii_ratio
from textloom.operators.stats import chunk_counts, corpus_stats, histogram01, keep_rate
from textloom.plans.prefix import idiv
from textloom.sources.corpus import (
    first_chunks, json_key, preview, read_corpus, sample_shards, union_sources,
)
from textloom.sources.writers import pending_chunks

catalog = Catalog()

ASCII_RATIO_SQL = """(length(regexp_replace(substr(text, 1, 1024), '[^\\x00-\\x7F]', '', 'g'))
    / nullif(length(substr(text, 1, 1024)), 0))"""


@catalog.add("scan_parquet", "SELECT 'web' AS source, doc_id AS doc_ord, text FROM documents")
def scan_parquet(spark, sf_dir):
    return read_corpus(spark, f"{sf_dir}/documents.parquet", "web").select(
        "source", "doc_ord", "text"
    )


@catalog.add(
    "lang_column_filter",
    "SELECT 'web' AS source, doc_id AS doc_ord, lang, text FROM documents WHERE lang = 'en'",
)
def lang_column_filter(spark, sf_dir):
    return read_corpus(
        spark, f"{sf_dir}/documents.parquet", "web", columns=["lang"], where=F.col("lang") == "en"
    ).select("source", "doc_ord", "lang", "text")


@catalog.add(
    "json_key_filter",
    """SELECT event_id, json_extract_string(props, '$.k') AS text FROM events
       WHERE json_extract_string(props, '$.k') IS NOT NULL""",
)
def json_key_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", json_key("props", "k").alias("text")).filter(
        F.col("text").isNotNull()
    )


@catalog.add(
    "union_sources",
    """SELECT 'documents' AS source, doc_id AS doc_ord, text FROM documents
       UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
       UNION ALL SELECT 'pages', page_id, html FROM pages
       UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations""",
)
def union_all_sources(spark, sf_dir):
    def part(name, order, text):
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("source"), F.expr(order).alias("doc_ord"), F.col(text).alias("text")
        )

    return union_sources(
        [
            part("documents", "doc_id", "text"),
            part("benchmark", "item_id", "text"),
            part("pages", "page_id", "html"),
            part("conversations", "conv_id * 1000 + turn", "text"),
        ]
    )


def numbered_chunks(spark, sf_dir):
    """Documents in chunks of 64 consecutive ids, per source."""
    return table(spark, sf_dir, "documents").select(
        "source", idiv(F.col("doc_id"), 64).cast("int").alias("chunk_id"), "doc_id", "text"
    )


@catalog.add(
    "first_chunks",
    """SELECT source, (doc_id // 64)::INT AS chunk_id, doc_id, text FROM documents
       WHERE doc_id // 64 < 10""",
)
def first_ten_chunks(spark, sf_dir):
    return first_chunks(numbered_chunks(spark, sf_dir), 10)


@catalog.add(
    "sample_shards",
    "SELECT url AS path FROM (SELECT url FROM pages ORDER BY md5('42:' || url), url LIMIT 128)",
)
def sampled_shards(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return sample_shards(files, 128, seed=42)


@catalog.add(
    "preview_limit",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
       ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 100""",
)
def preview_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    return preview(rows, 100, rows.columns)


@catalog.add(
    "corpus_stats",
    """SELECT source, count(*) AS items, round(avg(length(text)), 6) AS mean_length
       FROM documents GROUP BY source""",
)
def stats_chars(spark, sf_dir):
    return corpus_stats(table(spark, sf_dir, "documents")).withColumn(
        "mean_length", F.round("mean_length", 6)
    )


@catalog.add(
    "corpus_stats_bytes",
    """SELECT source, count(*) AS items, round(avg(strlen(text)), 6) AS mean_length
       FROM documents GROUP BY source""",
)
def stats_bytes(spark, sf_dir):
    return corpus_stats(table(spark, sf_dir, "documents"), unit="bytes").withColumn(
        "mean_length", F.round("mean_length", 6)
    )


@catalog.add(
    "chunk_counts",
    "SELECT source, count(DISTINCT doc_id // 64) AS chunks FROM documents GROUP BY source",
)
def chunks_per_source(spark, sf_dir):
    return chunk_counts(numbered_chunks(spark, sf_dir))


def histogram_sql(values: str) -> str:
    """100 bins of a column x, empty ones too, and a row without a bin for what lies outside."""
    return f"""WITH vals AS ({values}),
      counted AS (SELECT CASE WHEN x BETWEEN 0 AND 1 THEN least(floor(x * 100), 99)::INT END AS bin,
        count(*) AS n FROM vals GROUP BY 1),
      bins AS (SELECT unnest(range(0, 100))::INT AS bin UNION ALL SELECT NULL)
      SELECT b.bin, coalesce(n, 0) AS n FROM bins b LEFT JOIN counted c ON b.bin IS NOT DISTINCT FROM c.bin"""


@catalog.add(
    "ratio_histogram",
    histogram_sql(f"SELECT {ASCII_RATIO_SQL} AS x FROM documents"),
)
def ratio_histogram(spark, sf_dir):
    return histogram01(documents(spark, sf_dir, "text"), ascii_ratio("text"), 100)


@catalog.add(
    "keep_rate",
    f"""SELECT source, count(*) FILTER (WHERE {ASCII_RATIO_SQL} > {ASCII_BAR}) AS kept,
        count(*) AS total FROM documents GROUP BY source""",
)
def ascii_keep_rate(spark, sf_dir):
    return keep_rate(table(spark, sf_dir, "documents"), ascii_ratio("text") > ASCII_BAR)


@catalog.add(
    "pending_chunks",
    """SELECT DISTINCT o_orderpriority AS source, o_custkey::INT AS chunk_id FROM orders o
       WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F'
         AND d.o_orderpriority = o.o_orderpriority AND d.o_custkey = o.o_custkey)""",
)
def chunks_to_do(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"),
        F.col("o_custkey").cast("int").alias("chunk_id"), "o_orderstatus",
    )
    chunks = rows.select("source", "chunk_id").distinct()
    return pending_chunks(chunks, rows.filter("o_orderstatus = 'F'"))
