"""Operators whose result depends on row order: articles, chunks, windows, batches, log roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import Catalog, documents, table
from textloom.catalog.cleaning import DETOK_SQL, WIKI_LINES_SQL, wiki_lines
from textloom.functions.text import input_target, utrim, wikitext_detok
from textloom.operators.articles import assemble_articles
from textloom.operators.chunking import assign_chunks, chunk_bounds, chunk_sizes
from textloom.operators.packing import pack_windows, split_on_eos, to_batches, token_stats
from textloom.operators.trainlog import debiased_ema, perplexity_rollup

catalog = Catalog()

CHUNK_CAP = 20_000
SEQ_LEN = 64


@catalog.add(
    "assemble_articles",
    f"""WITH lines AS (SELECT lang AS file, line AS ord, {DETOK_SQL} AS line FROM {WIKI_LINES_SQL}),
    parts AS (SELECT file, ord, starts_with(line, '<SOT>') AS title,
        CASE WHEN starts_with(line, '<SOT>') THEN substr(line, 6) ELSE line END AS body FROM lines),
    numbered AS (SELECT *, sum(title::INT) OVER (PARTITION BY file ORDER BY ord) AS doc FROM parts)
    SELECT file, min(ord) AS doc_ord, string_agg(body || chr(10), '' ORDER BY ord) AS text
    FROM numbered WHERE length(body) > 0 GROUP BY file, doc""",
)
def articles(spark, sf_dir):
    lines = wiki_lines(spark, sf_dir).select(
        F.col("lang").alias("file"), F.col("line").alias("row_idx"),
        wikitext_detok(utrim("text")).alias("text"),
    )
    return assemble_articles(lines)


def sized_documents(spark, sf_dir):
    return documents(spark, sf_dir, "lang", "text").select(
        F.col("lang").alias("source"), F.col("doc_id").alias("doc_ord"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )


def fit_sql(cap: int) -> str:
    """Next-fit, one document at a time."""
    return f"""docs AS (SELECT lang AS source, doc_id AS doc_ord, strlen(text)::BIGINT AS b,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
    fit AS (SELECT source, doc_ord, rn, b, b AS used, 0 AS chunk_id FROM docs WHERE rn = 1
      UNION ALL
      SELECT d.source, d.doc_ord, d.rn, d.b,
        CASE WHEN f.used > 0 AND f.used + d.b > {cap} THEN d.b ELSE f.used + d.b END,
        CASE WHEN f.used > 0 AND f.used + d.b > {cap} THEN f.chunk_id + 1 ELSE f.chunk_id END
      FROM fit f JOIN docs d ON d.source = f.source AND d.rn = f.rn + 1)"""


FIT_SQL = fit_sql(CHUNK_CAP)
BOUNDS_SQL = f"""WITH RECURSIVE {FIT_SQL}
    SELECT source, chunk_id, min(doc_ord) AS lo, max(doc_ord) AS hi, count(*) AS docs,
      sum(b)::BIGINT AS bytes FROM fit GROUP BY source, chunk_id"""


@catalog.add("chunk_nextfit", BOUNDS_SQL)
def chunk_nextfit(spark, sf_dir):
    return chunk_bounds(chunk_sizes(sized_documents(spark, sf_dir), CHUNK_CAP))


@catalog.add("chunk_nextfit_blocks", BOUNDS_SQL)
def chunk_nextfit_blocks(spark, sf_dir):
    """The same through small blocks, so that their tables are composed over several levels."""
    sizes = sized_documents(spark, sf_dir)
    return chunk_bounds(chunk_sizes(sizes, CHUNK_CAP, block_docs=64, fan_in=2))


ASSIGNED_SQL = f"""WITH RECURSIVE {FIT_SQL}
    SELECT f.source, f.doc_ord, f.chunk_id, d.text FROM fit f JOIN documents d ON d.doc_id = f.doc_ord"""


def ordered_documents(spark, sf_dir):
    return documents(spark, sf_dir, "lang", "text").select(
        F.col("lang").alias("source"), F.col("doc_id").alias("doc_ord"), "text"
    )


@catalog.add("assign_chunks", ASSIGNED_SQL)
def documents_with_chunks(spark, sf_dir):
    out = assign_chunks(ordered_documents(spark, sf_dir), CHUNK_CAP)
    return out.select("source", "doc_ord", "chunk_id", "text")


@catalog.add("assign_chunks_joined", ASSIGNED_SQL)
def documents_with_joined_chunks(spark, sf_dir):
    """With a table of ranges that counts as too large to broadcast, and small blocks."""
    out = assign_chunks(
        ordered_documents(spark, sf_dir), CHUNK_CAP, block_docs=64, broadcast_bytes=0, fan_in=2
    )
    return out.select("source", "doc_ord", "chunk_id", "text")


@catalog.add(
    "chunk_prefix",
    f"""WITH docs AS (SELECT lang AS source, doc_id AS doc_ord, strlen(text)::BIGINT AS b,
        sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id) AS upto FROM documents)
    SELECT source, ((upto - b) // {CHUNK_CAP})::INT AS chunk_id, min(doc_ord) AS lo, max(doc_ord) AS hi,
      count(*) AS docs, sum(b)::BIGINT AS bytes FROM docs GROUP BY 1, 2""",
)
def chunk_prefix(spark, sf_dir):
    return chunk_bounds(chunk_sizes(sized_documents(spark, sf_dir), CHUNK_CAP, mode="prefix"))


# Stand-in token ids that SQL can make as well: word lengths + 2, then the end mark.
IDS_SQL = """list_append(list_transform(string_split(text, ' '), lambda w: length(w)::INT + 2), 1)"""


def tokens_sql(chunks: int) -> str:
    return f"""tokens AS (SELECT lang AS source, (doc_id % {chunks})::INT AS chunk_id,
    doc_id AS doc_ord, {IDS_SQL} AS ids FROM documents)"""


TOKENS_SQL = tokens_sql(3)


def stand_in_tokens(spark, sf_dir, chunks=3):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w) + 2)
    return documents(spark, sf_dir, "lang", "text").select(
        F.col("lang").alias("source"), (F.col("doc_id") % chunks).cast("int").alias("chunk_id"),
        F.col("doc_id").alias("doc_ord"), F.array_append(ids, F.lit(1)).alias("ids"),
    )


@catalog.add(
    "token_stats",
    f"""WITH {TOKENS_SQL} SELECT source, chunk_id, sum(len(ids))::BIGINT AS tokens, count(*) AS docs
        FROM tokens GROUP BY source, chunk_id""",
)
def tokens_per_chunk(spark, sf_dir):
    return token_stats(stand_in_tokens(spark, sf_dir))


PACK_SQL = f"""flat AS (SELECT source, chunk_id, id,
    row_number() OVER (PARTITION BY source, chunk_id ORDER BY doc_ord, i) - 1 AS p
  FROM (SELECT source, chunk_id, doc_ord, unnest(ids) AS id,
          generate_subscripts(ids, 1) AS i FROM tokens)),
placed AS (SELECT source, chunk_id, id, p, p // {SEQ_LEN} AS win FROM flat
  UNION ALL
  SELECT source, chunk_id, id, p, p // {SEQ_LEN} - 1 FROM flat WHERE p % {SEQ_LEN} = 0 AND p > 0),
windows AS (SELECT source, chunk_id, win::BIGINT AS win, string_agg(id::VARCHAR, ' ' ORDER BY p) AS seq
  FROM placed GROUP BY source, chunk_id, win HAVING count(*) = {SEQ_LEN} + 1)"""


@catalog.add("pack_windows", f"WITH {TOKENS_SQL}, {PACK_SQL} SELECT source, chunk_id, win, seq FROM windows")
def packed_windows(spark, sf_dir):
    windows = pack_windows(stand_in_tokens(spark, sf_dir), SEQ_LEN)
    return windows.withColumn("seq", F.array_join("seq", " "))


@catalog.add(
    "split_on_eos",
    """WITH pieces AS (SELECT role = 'assistant' AS ends, conv_id, turn,
        list_transform(string_split(text, ' '),
          lambda w: CASE WHEN length(w) <= 2 THEN 1 ELSE length(w)::INT + 2 END) AS ids FROM conversations),
    marked AS (SELECT conv_id, turn, CASE WHEN ends THEN list_append(ids, 1) ELSE ids END AS ids FROM pieces),
    flat AS (SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS p
      FROM (SELECT conv_id, turn, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM marked)),
    numbered AS (SELECT conv_id, id, p, coalesce(sum((id = 1)::INT) OVER (PARTITION BY conv_id
      ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doc_no FROM flat)
    SELECT 'chat' AS source, conv_id AS chunk_id, doc_no::BIGINT AS doc_no,
      coalesce(string_agg(id::VARCHAR, ' ' ORDER BY p) FILTER (WHERE id <> 1), '') AS ids
    FROM numbered GROUP BY conv_id, doc_no HAVING bool_or(id = 1)""",
)
def documents_of_stream(spark, sf_dir):
    ids = F.transform(
        F.split("text", " "),
        lambda w: F.when(F.length(w) <= 2, F.lit(1)).otherwise(F.length(w) + 2),
    )
    pieces = table(spark, sf_dir, "conversations").select(
        F.lit("chat").alias("source"), F.col("conv_id").alias("chunk_id"),
        F.col("turn").alias("ord"),
        F.when(F.col("role") == "assistant", F.array_append(ids, F.lit(1))).otherwise(ids).alias("ids"),
    )
    return split_on_eos(pieces).withColumn("ids", F.array_join("ids", " "))


def lineitem_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return to_batches(rows, 32, ["l_orderkey", "l_linenumber", "l_partkey"], "l_partkey")


BATCHES_SQL = """batches AS (SELECT (p // 32)::BIGINT AS batch_id,
    string_agg(l_partkey::VARCHAR, ' ' ORDER BY p) AS items
  FROM (SELECT l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS p FROM lineitem)
  GROUP BY 1)"""


@catalog.add("to_batches", f"WITH {BATCHES_SQL} SELECT batch_id, items FROM batches")
def batches(spark, sf_dir):
    return lineitem_batches(spark, sf_dir).withColumn("items", F.array_join("items", " "))


@catalog.add(
    "input_target",
    """SELECT vec_id, array_to_string(s[1:len(s) - 1], ' ') AS inputs, array_to_string(s[2:], ' ') AS targets
       FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT) AS s
             FROM embeddings)""",
)
def inputs_and_targets(spark, sf_dir):
    seq = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long"))
    inputs, targets = input_target("s")
    return table(spark, sf_dir, "embeddings").select("vec_id", seq.alias("s")).select(
        "vec_id", F.array_join(inputs, " ").alias("inputs"), F.array_join(targets, " ").alias("targets")
    )


def training_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.col("value").alias("loss_sum"),
        (F.col("user_id") + 1).alias("n_tokens"),
    )


INTERVALS_SQL = """intervals AS (SELECT * FROM (
    SELECT greatest(1, ceil(event_id / 200))::BIGINT AS interval, max(event_id) AS step,
      sum(value) / sum(1 + user_id) AS avg_loss FROM events GROUP BY 1) WHERE step = interval * 200)"""


@catalog.add(
    "perplexity_rollup",
    f"""WITH {INTERVALS_SQL} SELECT interval, step, round(avg_loss, 6) AS avg_loss,
        round(exp(avg_loss), 6) AS ppl FROM intervals""",
)
def perplexity(spark, sf_dir):
    rows = perplexity_rollup(training_log(spark, sf_dir))
    return rows.withColumn("avg_loss", F.round("avg_loss", 6)).withColumn("ppl", F.round("ppl", 6))


@catalog.add(
    "loss_ema",
    f"""WITH {INTERVALS_SQL}, pairs AS (SELECT a.interval, power(0.9::DOUBLE, a.interval - b.interval) AS w, b.avg_loss
        FROM intervals a JOIN intervals b ON b.interval <= a.interval)
    SELECT interval, round(sum(w * avg_loss) / sum(w), 6) AS ema,
      round(exp(sum(w * avg_loss) / sum(w)), 6) AS ema_ppl FROM pairs GROUP BY interval""",
)
def loss_ema(spark, sf_dir):
    rows = debiased_ema(perplexity_rollup(training_log(spark, sf_dir)))
    return rows.select("interval", F.round("ema", 6).alias("ema"), F.round("ema_ppl", 6).alias("ema_ppl"))
