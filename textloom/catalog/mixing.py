"""Seeded orders, slots, draws, interleaving and the mix plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.catalog import Catalog, table
from textloom.catalog.ordering import (
    BATCHES_SQL, PACK_SQL, SEQ_LEN, TOKENS_SQL, lineitem_batches, stand_in_tokens, tokens_sql,
)
from textloom.operators import mixing
from textloom.operators.packing import pack_windows, token_stats
from textloom.plans.prefix import idiv, ordinal
from textloom.session import scratch_path, stage
from textloom.sources import writers

catalog = Catalog()

SEED = 42
SLOTS = 64

# Listed order of the mix: by language; weights: documents of the language.
MIX_SQL = """mix AS (SELECT lang AS source, count(*) AS weight,
    row_number() OVER (ORDER BY lang) - 1 AS pos FROM documents GROUP BY lang)"""


def document_mix(spark, sf_dir):
    return mixing_order(
        table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source")).agg(
            F.count("*").alias("weight")
        )
    )


def mixing_order(weights):
    """Number the sources of a weight table by name; one row per source."""
    place = F.row_number().over(Window.partitionBy().orderBy("source")) - 1
    return weights.withColumn("pos", place)


@catalog.add(
    "epoch_permutation",
    f"""SELECT source, doc_id AS chunk_id, row_number() OVER (PARTITION BY source
          ORDER BY md5('{SEED ^ 3}:' || doc_id), doc_id) - 1 AS place FROM documents""",
)
def epoch_permutation(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("chunk_id"))
    return mixing.epoch_permutation(chunks, SEED, epoch=3)


@catalog.add(
    "seeded_shuffle",
    """SELECT page_id, url, row_number() OVER (ORDER BY md5('442:' || page_id), page_id) - 1 AS place
       FROM pages""",
)
def seeded_shuffle(spark, sf_dir):
    return mixing.seeded_shuffle(table(spark, sf_dir, "pages").select("page_id", "url"), 442, "page_id")


@catalog.add(
    "worker_shard",
    """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey,
         row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p % 4 = 1""",
)
def worker_shard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return mixing.worker_shard(orders, 1, 4, ["o_orderkey"])


@catalog.add(
    "alloc_slots",
    f"""WITH {MIX_SQL},
    sized AS (SELECT *, {SLOTS} - count(*) OVER () AS x, sum(weight) OVER ()::BIGINT AS total FROM mix),
    based AS (SELECT *, 1 + x * weight // total AS base, x * weight % total AS rem FROM sized),
    ranked AS (SELECT *, {SLOTS} - sum(base) OVER () AS rest,
        row_number() OVER (ORDER BY rem DESC, pos) AS rk FROM based)
    SELECT pos::INT AS pos, source, weight, (base + (rk <= rest)::INT)::BIGINT AS slots FROM ranked""",
)
def alloc_slots(spark, sf_dir):
    return mixing.alloc_slots(document_mix(spark, sf_dir), SLOTS)


DRAWS_SQL = f"""{MIX_SQL},
bounds AS (SELECT source, weight, sum(weight) OVER (ORDER BY pos)::BIGINT AS hi,
    sum(weight) OVER ()::BIGINT AS total FROM mix),
tickets AS (SELECT event_id AS id,
    (('0x' || substr(md5('{SEED}:' || event_id), 1, 15))::HUGEINT * (SELECT max(total) FROM bounds)
      // 1152921504606846976::HUGEINT)::BIGINT AS t
  FROM events),
draws AS (SELECT id, source FROM tickets JOIN bounds ON t >= hi - weight AND t < hi)"""


def event_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))


@catalog.add("draw_sources", f"WITH {DRAWS_SQL} SELECT id, source FROM draws")
def draw_sources(spark, sf_dir):
    return mixing.draw_sources(event_ids(spark, sf_dir), document_mix(spark, sf_dir), SEED)


@catalog.add("draw_sources_table", f"WITH {DRAWS_SQL} SELECT id, source FROM draws")
def draw_sources_table(spark, sf_dir):
    """The same draws through a table of cells, which may hold any number of sources."""
    return mixing.draw_from_table(event_ids(spark, sf_dir), document_mix(spark, sf_dir), SEED)


# Every document is a source of its own, with its length as the weight.
@catalog.add(
    "draw_documents",
    f"""WITH bounds AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS hi,
        sum(n_chars) OVER ()::BIGINT AS total FROM documents),
    tickets AS (SELECT event_id AS id, (('0x' || substr(md5('{SEED}:' || event_id), 1, 15))::HUGEINT
        * (SELECT max(total) FROM bounds) // 1152921504606846976::HUGEINT)::BIGINT AS t FROM events),
    met AS (SELECT id, t, doc_id, n_chars, hi FROM tickets ASOF JOIN bounds ON t < hi)
    SELECT id, doc_id::VARCHAR AS source FROM met WHERE t >= hi - n_chars""",
)
def draw_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("weight"))
    mix = ordinal(docs, [], ["doc_id"], "pos").select("pos", F.col("doc_id").cast("string").alias("source"), "weight")
    return mixing.draw_from_table(event_ids(spark, sf_dir), mix, SEED)


# The round-robin one chunk load at a time: `free` lists the round in which each
# slot falls free; the first of the smallest loads the next chunk of the order.
OPEN_CHUNKS = 8
CHUNKS = 12
INTERLEAVE_SQL = f"""{DRAWS_SQL}, {tokens_sql(CHUNKS)}, {PACK_SQL},
wanted AS (SELECT source, count(*) AS wanted FROM draws GROUP BY source),
lengths AS (SELECT source, chunk_id, count(*) AS n FROM windows GROUP BY source, chunk_id),
sized AS (SELECT *, {OPEN_CHUNKS} - count(*) OVER () AS x, sum(weight) OVER ()::BIGINT AS total FROM mix),
based AS (SELECT *, 1 + x * weight // total AS base, x * weight % total AS rem FROM sized),
given AS (SELECT source, base + (row_number() OVER (ORDER BY rem DESC, pos)
    <= {OPEN_CHUNKS} - sum(base) OVER ())::INT AS slots FROM based),
sources AS (SELECT source, wanted, count(*) AS files, least(any_value(slots), count(*)) AS p,
    wanted // sum(n) + 2 AS epochs FROM lengths JOIN wanted USING (source) JOIN given USING (source)
  GROUP BY source, wanted),
orders AS (SELECT source, chunk_id, n, e * files + row_number() OVER (PARTITION BY source, e
    ORDER BY md5(xor({SEED}, e) || ':' || chunk_id), chunk_id) - 1 AS k
  FROM (SELECT source, files, unnest(range(0, epochs::BIGINT))::BIGINT AS e FROM sources)
  JOIN lengths USING (source)),
loads AS (
  SELECT source, p, wanted, 0::BIGINT AS k, list_transform(range(0, p::BIGINT), lambda x: 0::BIGINT) AS free,
    NULL::INT AS chunk_id, NULL::BIGINT AS slot, NULL::BIGINT AS round FROM sources
  UNION ALL
  SELECT l.source, l.p, l.wanted, l.k + 1,
    list_transform(l.free, lambda x, i: CASE WHEN i = list_position(l.free, list_min(l.free)) THEN x + o.n ELSE x END),
    o.chunk_id, list_position(l.free, list_min(l.free))::BIGINT - 1, list_min(l.free)
  FROM loads l JOIN orders o ON o.source = l.source AND o.k = l.k
  WHERE list_min(l.free) * l.p + list_position(l.free, list_min(l.free)) - 1 < l.wanted),
ordered AS (SELECT w.source, ((round + win) * p + slot)::BIGINT AS place, w.chunk_id, win, seq
  FROM loads l JOIN windows w ON w.source = l.source AND w.chunk_id = l.chunk_id
  WHERE (round + win) * p + slot < wanted)"""


def open_chunk_windows(spark, sf_dir):
    tokens = stand_in_tokens(spark, sf_dir, CHUNKS)
    n = idiv(F.col("tokens") - 1, SEQ_LEN)
    lengths = token_stats(tokens).select("source", "chunk_id", n.alias("n"))
    return pack_windows(tokens, SEQ_LEN), lengths


@catalog.add(
    "interleave",
    f"WITH RECURSIVE {INTERLEAVE_SQL} SELECT source, place, chunk_id, win, seq FROM ordered",
)
def interleave(spark, sf_dir):
    """As many windows per source as events draw it, over one epoch or several."""
    windows, lengths = open_chunk_windows(spark, sf_dir)
    mix = document_mix(spark, sf_dir)
    wanted = (
        mixing.draw_sources(event_ids(spark, sf_dir), mix, SEED)
        .groupBy("source").agg(F.count("*").alias("wanted"))
    )
    out = mixing.interleave(windows, mixing.alloc_slots(mix, OPEN_CHUNKS), wanted, SEED, lengths)
    return out.withColumn("seq", F.array_join("seq", " "))


@catalog.add(
    "mixed_sequences",
    f"""WITH RECURSIVE {INTERLEAVE_SQL},
    turns AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS place FROM draws)
    SELECT id, source, chunk_id, win, seq FROM turns JOIN ordered USING (source, place)""",
)
def mixed_sequences(spark, sf_dir):
    windows, lengths = open_chunk_windows(spark, sf_dir)
    mixed = mixing.mixed_sequences(
        windows, document_mix(spark, sf_dir), OPEN_CHUNKS, event_ids(spark, sf_dir), SEED, lengths
    )
    return mixed.withColumn("seq", F.array_join("seq", " "))


@catalog.add(
    "resume_filter", f"WITH {BATCHES_SQL} SELECT batch_id, items FROM batches WHERE batch_id >= 100"
)
def resume_filter(spark, sf_dir):
    batches = mixing.resume_from(lineitem_batches(spark, sf_dir), 100)
    return batches.withColumn("items", F.array_join("items", " "))


@catalog.add(
    "drawn_chunk_tokens",
    f"""WITH {tokens_sql(CHUNKS)},
    drawn AS (SELECT source, chunk_id, row_number() OVER (PARTITION BY source
        ORDER BY md5(xor({SEED}, 1) || ':' || chunk_id), chunk_id) - 1 AS place
      FROM (SELECT DISTINCT source, chunk_id FROM tokens))
    SELECT source, chunk_id, doc_ord, md5(array_to_string(ids, ' ')) AS digest
    FROM tokens JOIN drawn USING (source, chunk_id) WHERE place < 2""",
)
def drawn_chunk_tokens(spark, sf_dir):
    """The first two chunks of each source in the order of an epoch; the scan opens no other chunks."""
    path = scratch_path(spark, "tokens")
    writers.write_tokens(stand_in_tokens(spark, sf_dir, CHUNKS), path)
    chunks = writers.read_tokens(spark, path).select("source", "chunk_id").distinct()
    order = stage(mixing.epoch_permutation(chunks, SEED, 1).select("source", "chunk_id", "place"), "order")
    drawn = writers.read_token_chunks(spark, path, order.filter("place < 2"))
    return drawn.select("source", "chunk_id", "doc_ord", F.md5(F.array_join("ids", " ")).alias("digest"))


def written_batches(spark, sf_dir):
    path = scratch_path(spark, "batches")
    writers.write_batches(lineitem_batches(spark, sf_dir), path, per_part=100)
    return path


@catalog.add(
    "resume_batches", f"WITH {BATCHES_SQL} SELECT batch_id, items FROM batches WHERE batch_id >= 100"
)
def resume_batches(spark, sf_dir):
    """Batches written in order and read again from one of them on; earlier files are not opened."""
    batches = writers.read_batches(spark, written_batches(spark, sf_dir), 100)
    return batches.withColumn("items", F.array_join("items", " "))


@catalog.add(
    "batch_manifest",
    f"""WITH {BATCHES_SQL} SELECT (batch_id // 100)::INT AS part, min(batch_id) AS lo, max(batch_id) AS hi,
        count(*) AS batches FROM batches GROUP BY 1""",
)
def batch_manifest(spark, sf_dir):
    out = writers.read_batch_manifest(spark, written_batches(spark, sf_dir))
    return out.select("part", "lo", "hi", "batches")


# 353M parameters, batches of 4 sequences of 512 tokens.
BUDGET = mixing.token_budget(353_000_000, 4, 512)[1]


@catalog.add(
    "mix_plan",
    f"""WITH {MIX_SQL}, {TOKENS_SQL},
    hand AS (SELECT source, sum(len(ids))::BIGINT AS tokens FROM tokens GROUP BY source),
    want AS (SELECT source, weight, weight / sum(weight) OVER () * {BUDGET} AS wanted FROM mix)
    SELECT source, weight, round(wanted, 4) AS wanted, tokens, round(wanted / tokens, 6) AS epochs
    FROM want JOIN hand USING (source)""",
)
def mix_plan(spark, sf_dir):
    stats = token_stats(stand_in_tokens(spark, sf_dir))
    at_hand = stats.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    plan = mixing.mix_plan(document_mix(spark, sf_dir), at_hand, BUDGET)
    return plan.withColumn("wanted", F.round("wanted", 4)).withColumn("epochs", F.round("epochs", 6))


@catalog.add(
    "mix_checks",
    f"""WITH {MIX_SQL}, n AS (SELECT count(*) AS sources, min(weight) AS least FROM mix)
    SELECT slots, slots >= sources AND least > 0 AS accepted
    FROM n, (SELECT unnest(range(1, 10)) AS slots)""",
)
def mix_checks(spark, sf_dir):
    """Whether the mix of the documents passes its checks with so many slots."""
    mix = document_mix(spark, sf_dir)
    slots = spark.range(1, 10).select(F.col("id").alias("slots"))
    return mixing.mix_verdicts(mix, slots, mix).select("slots", "accepted")
