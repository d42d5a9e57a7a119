"""One registered query per operator, with SQL where DuckDB can say it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.catalog import table
from textloom.llm import (
    decontamination, fill_in_middle, language, lm_scoring, near_dedup, packing, pii, quality, sharding, source_audit, suffix_dedup, topk, url_lists,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards by the tree of 3 regions, 2 racks each, 4 shards each."""
    tree = sharding.uniform_tree(3, 2, 4)
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), tree)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def _digest(column: str) -> str:
    return f"CAST(conv(substring(md5({column}), 1, 4), 16, 10) AS INT)"


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against lists that all pages feed with dated entries.

    The tables hold no lists and no fetch times. Both follow from the pages: page
    p is fetched on day 37 p mod 365; its URL's digest names a day, a list, whether
    the entry adds or removes, and whether the pattern is the host or has one path
    segment.
    """
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(page_id * 37 % 365 AS INT))").alias("fetched")
    )
    first = F.get(url_lists.url_segments(F.col("url")), 0)
    host = url_lists.url_host(F.col("url"))
    entries = (
        pages.filter("url IS NOT NULL")
        .withColumn("d", F.expr(_digest("url")))
        .select(
            F.expr("CASE WHEN d % 2 = 0 THEN 'malware' ELSE 'adult' END").alias("list"),
            F.when((F.col("d") % 3 == 0) | first.isNull(), host)
            .otherwise(F.concat(host, F.lit("/"), F.lower(first)))
            .alias("pattern"),
            F.expr("date_add(DATE'2024-01-01', d % 365)").alias("at"),
            F.expr("CASE WHEN d % 5 < 3 THEN 'add' ELSE 'remove' END").alias("action"),
        )
    )
    return url_lists.url_verdicts(pages, entries)


SQL["op7_url_filter"] = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INT) AS fetched,
    CAST('0x' || substr(md5(url), 1, 4) AS INT) AS d,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'),
      lambda x: x <> '') AS segs
  FROM pages),
e AS (
  SELECT CASE WHEN d % 2 = 0 THEN 'malware' ELSE 'adult' END AS list,
    lower(CASE WHEN d % 3 = 0 OR len(segs) = 0 THEN host ELSE host || '/' || segs[1] END) AS pattern,
    DATE '2024-01-01' + d % 365 AS since, max(d % 5 < 3) AS adds
  FROM p WHERE url IS NOT NULL GROUP BY 1, 2, 3),
h AS (
  SELECT list, pattern, since, adds,
    lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS upto
  FROM e),
k AS (
  SELECT DISTINCT page_id, url, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1),
      lambda n: array_to_string(list_slice(string_split(host, '.'), -n, -1), '.')),
    list_transform(range(1, len(segs) + 1),
      lambda n: host || '/' || lower(array_to_string(segs[1:n], '/')))))) AS pattern
  FROM p WHERE host <> ''),
m AS (
  SELECT k.page_id, k.url, k.fetched, count(*) AS n, string_agg(DISTINCT h.list, ',' ORDER BY h.list) AS lists
  FROM k JOIN h ON k.pattern = h.pattern AND h.adds AND k.fetched >= h.since AND (h.upto IS NULL OR k.fetched < h.upto)
  GROUP BY ALL)
SELECT DISTINCT p.page_id, p.url, p.fetched, coalesce(m.n, 0) > 0 AS blocked, coalesce(m.n, 0) AS n_matches,
  coalesce(m.lists, '') AS lists
FROM p LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.url IS NOT DISTINCT FROM m.url
  AND p.fetched IS NOT DISTINCT FROM m.fetched
"""


def _count(rank: int) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == rank)).cast("long")


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs)
    base = F.filter("pii", lambda s: s["kind"] < len(pii.BASE))
    counts = [_count(rank).alias(f"n_{kind.name}") for rank, kind in enumerate(pii.BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
    )


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, 64 open windows per partition."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer)


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learned from two of three folds."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", language.held_out().alias("held_out"))
    out = language.predict(rows, language.learn(docs), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from four of five folds of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", quality.held_out().alias("held_out"))
    out = quality.score(rows, model, keep=["doc_id", "held_out"])
    kept = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return out.select("doc_id", "held_out", "score", kept)


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark, by windows of 10 words."""
    docs = table(spark, sf_dir, "documents")
    found = decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_c0").alias("doc_id"),
        F.col("_words").alias("n_words"),
        F.col("_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_hit") > 0).alias("contaminated"),
    )


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every vector whose id is divisible by 50, by integer inner product."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), topk.scaled(F.col("embedding")).alias("vector")
    )
    return topk.top_k(rows, F.col("id") % 50 == 0)


SQL["op9_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 80 per cent of their 4-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document under 200-byte strings that start elsewhere too."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text, learned from nine of ten folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = quality.held_out(folds=10)
    found = lm_scoring.score_texts(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut at two ranks of code points, and put together again."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


@query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the kept terms of every (lang, source) differ from other sources and from the language."""
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


SQL["op12_source_audit"] = """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\\x{80}-\\x{10FFFF}]+') AS ts
  FROM documents),
t AS (SELECT row, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
g AS (
  SELECT groups.lang, groups.source, coalesce(any_value(v.v), 0) AS v, coalesce(sum(c.n), 0) + coalesce(any_value(v.v), 0) AS total
  FROM groups LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = groups.lang AND c.source = groups.source GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // g.total::HUGEINT AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q
  FROM c GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0) AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM cell JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
