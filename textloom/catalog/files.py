"""Round trips through files: readers, sinks, manifests and streams over the given tables.

Each query writes tables to the shared folder in the form that a reader expects, reads
them back, and leaves the folder to ``session.drop_staged``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import Catalog, table
from textloom.catalog.cleaning import PROBS_SQL
from textloom.catalog.ordering import (
    ASSIGNED_SQL, CHUNK_CAP, TOKENS_SQL, fit_sql, ordered_documents, stand_in_tokens,
)
from textloom.catalog.scans import ASCII_RATIO_SQL
from textloom.catalog.tokens import FINAL_SQL, LEARN_SQL, PIECES_SQL, learnt
from textloom.functions import lang
from textloom.operators import packing
from textloom.operators.chunking import assign_chunks
from textloom.operators.vocabulary import tokenize
from textloom.plans.token_job import tokenize_pending
from textloom.session import scratch_path
from textloom.sources import corpus, manifest, writers
from textloom.streaming.incremental import stream_chunks, stream_clean, stream_tokens

catalog = Catalog()

IN_ORDER_SQL = """SELECT 'web' AS source, row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord, text
    FROM documents WHERE text IS NOT NULL"""


# Bytes of text in a file, at most about.
FILE_BYTES = 256 << 20


def in_id_order(rows, text, least, file_bytes=FILE_BYTES):
    """Rows in id order, dealt to ``least`` files or as many as their texts need."""
    size = rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    files = max(least, -(-size // file_bytes))
    return rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")


def write_lines(spark, sf_dir, path, codec=None):
    """The documents as JSON lines in id order, in several files."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    in_id_order(rows, "content", 4).write.option("compression", codec or "none").json(path)


@catalog.add("jsonl_in_order", IN_ORDER_SQL)
def jsonl_in_order(spark, sf_dir):
    path = scratch_path(spark, "lines")
    write_lines(spark, sf_dir, f"{path}/a")
    return corpus.read_jsonl(spark, path, "web", "content", "*.json").select("source", "doc_ord", "text")


@catalog.add("jsonl_gzip_nested", IN_ORDER_SQL)
def jsonl_gzip_nested(spark, sf_dir):
    path = scratch_path(spark, "lines")
    write_lines(spark, sf_dir, f"{path}/a/b", "gzip")
    out = corpus.read_jsonl(spark, path, "web", "content", "*.json.gz")
    return out.select("source", "doc_ord", "text")


@catalog.add("parquet_files_in_order", IN_ORDER_SQL)
def parquet_files_in_order(spark, sf_dir):
    """Document order over several parquet files in nested folders."""
    path = scratch_path(spark, "files")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    in_id_order(rows, "text", 5).write.parquet(f"{path}/x/y")
    return corpus.read_corpus(spark, path, "web", glob="*.parquet").select("source", "doc_ord", "text")


@catalog.add(
    "jsonl_key_present",
    """SELECT event_id AS doc_ord, json_extract_string(props, '$.k') AS text FROM events
       WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_id % 3 > 0""",
)
def jsonl_key_present(spark, sf_dir):
    """Lines of which every third lacks the key."""
    path = scratch_path(spark, "lines")
    key = F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k"))
    events = table(spark, sf_dir, "events").select("event_id", key.alias("k"))
    events.write.option("ignoreNullFields", "true").json(path)
    return corpus.scan_jsonl(spark, path, "k", order_key="event_id")


@catalog.add("chunk_table", ASSIGNED_SQL)
def chunk_table(spark, sf_dir):
    """Raw documents, cut into chunks, written as a chunk table and scanned again."""
    path = scratch_path(spark, "chunks")
    chunks = assign_chunks(ordered_documents(spark, sf_dir), CHUNK_CAP)
    writers.write_chunks(chunks, path, per_folder=writers.chunks_per_folder(CHUNK_CAP))
    return corpus.all_chunks(spark, path).select("source", "doc_ord", "chunk_id", "text")


@catalog.add(
    "token_table",
    f"""WITH {TOKENS_SQL} SELECT source, chunk_id, doc_ord, len(ids)::INT AS n_tokens,
        array_to_string(ids, ' ') AS ids FROM tokens""",
)
def token_table(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    writers.write_tokens(stand_in_tokens(spark, sf_dir), path)
    return writers.read_tokens(spark, path).select(
        "source", "chunk_id", "doc_ord", "n_tokens", F.array_join("ids", " ").alias("ids")
    )


@catalog.add(
    "preview_sink",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY ALL LIMIT 100",
)
def preview_sink(spark, sf_dir):
    path = scratch_path(spark, "preview")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    writers.write_preview(corpus.preview(rows, 100, rows.columns), path)
    return spark.read.parquet(path)


@catalog.add("json_sink", "SELECT event_id, event_type, value, props FROM events")
def json_sink(spark, sf_dir):
    path = scratch_path(spark, "rows")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    writers.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@catalog.add(
    "chunk_manifest", "SELECT lang AS source, count(DISTINCT source)::INT AS chunks FROM documents GROUP BY 1"
)
def chunk_manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    rows = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("Name"))
    rows.agg(F.count_distinct("source").alias("Chunks")).write.option("header", "true").csv(path)
    return manifest.read_chunk_manifest(spark, path)


@catalog.add(
    "download_manifest",
    """SELECT source, count(*) * 1e3 AS total_gb, round(sum(n_chars) * 1e-3, 6) AS sampled_gb,
         count(DISTINCT lang)::INT AS epochs FROM documents GROUP BY source""",
)
def download_manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("Name")).agg(
        F.concat(F.count("*").cast("string"), F.lit(" TB")).alias("Total"),
        F.concat(F.sum("n_chars").cast("string"), F.lit(" MB")).alias("Sampled"),
        F.count_distinct("lang").alias("Epochs"),
    )
    rows.write.option("header", "true").csv(path)
    out = manifest.read_download_manifest(spark, path)
    return out.withColumn("sampled_gb", F.round("sampled_gb", 6))


@catalog.add(
    "english_keep_rate",
    f"""WITH {PROBS_SQL} SELECT source, count(*) FILTER (WHERE {ASCII_RATIO_SQL} > {lang.ASCII_BAR}
          AND p[1] > {lang.LANG_BAR}) AS kept, count(*) AS total FROM probs GROUP BY source""",
)
def english_keep_rate(spark, sf_dir):
    """Documents that the whole language filter keeps, of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = lang.english_filter(docs).groupBy("source").agg(F.count("*").alias("kept"))
    every = docs.groupBy("source").agg(F.count("*").alias("total"))
    return every.join(kept, "source", "left").select("source", F.coalesce("kept", F.lit(0)).alias("kept"), "total")


@catalog.add(
    "windows_of_tokens",
    f"""WITH {LEARN_SQL}, {FINAL_SQL},
    pieces AS (SELECT lang AS source, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
      FROM (SELECT lang, doc_id, {PIECES_SQL} AS w FROM documents)),
    flat AS (SELECT source, doc_id, i, unnest(list_transform(string_split(ids, ' '), lambda x: x::INT)) AS id,
        generate_subscripts(string_split(ids, ' '), 1) AS j
      FROM pieces JOIN final USING (word)
      UNION ALL SELECT lang, doc_id, 2147483647, 1, 0 FROM documents),
    placed AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, i, j) - 1 AS p FROM flat),
    cut AS (SELECT source, id, p, p // 512 AS win FROM placed
      UNION ALL SELECT source, id, p, p // 512 - 1 FROM placed WHERE p % 512 = 0 AND p > 0)
    SELECT source, win::BIGINT AS win, md5(string_agg(id::VARCHAR, ' ' ORDER BY p)) AS digest
    FROM cut GROUP BY source, win HAVING count(*) = 513""",
)
def windows_of_tokens(spark, sf_dir):
    """Learn, encode, write, scan and pack: the way from documents to training windows."""
    path = scratch_path(spark, "tokens")
    docs = ordered_documents(spark, sf_dir).withColumn("chunk_id", F.lit(0))
    writers.write_tokens(tokenize(docs, learnt(spark, sf_dir)), path)
    windows = packing.pack_windows(writers.read_tokens(spark, path), 512)
    return windows.select("source", "win", F.md5(F.array_join("seq", " ")).alias("digest"))


@catalog.add(
    "stream_tokens",
    f"""WITH {LEARN_SQL}, {FINAL_SQL},
    pieces AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i
      FROM (SELECT doc_id, lang, {PIECES_SQL} AS w FROM documents))
    SELECT lang AS source, 0 AS chunk_id, doc_id AS doc_ord, md5(string_agg(ids, ' ' ORDER BY i) || ' 1') AS digest
    FROM pieces JOIN final USING (word) GROUP BY lang, doc_id""",
)
def tokens_of_a_stream(spark, sf_dir):
    """A chunk table tokenized by a stream, a few files at a time."""
    path = scratch_path(spark, "stream")
    docs = ordered_documents(spark, sf_dir).withColumn("chunk_id", F.lit(0))
    writers.write_chunks(docs, f"{path}/chunks")
    stream_tokens(
        spark, f"{path}/chunks", f"{path}/out", f"{path}/state", learnt(spark, sf_dir), max_files=3
    ).awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select("source", "chunk_id", "doc_ord", F.md5(F.array_join("ids", " ")).alias("digest"))


@catalog.add(
    "stream_clean",
    f"""WITH {PROBS_SQL}, kept AS (SELECT doc_id, text, strlen(text)::BIGINT AS b FROM probs
      WHERE {ASCII_RATIO_SQL} > {lang.ASCII_BAR} AND p[1] > {lang.LANG_BAR})
    SELECT 'web' AS source, text, b FROM kept""",
)
def texts_of_a_stream(spark, sf_dir):
    """English documents of a stream of JSON lines; chunk numbers are checked on the way."""
    path = scratch_path(spark, "stream")
    write_lines(spark, sf_dir, f"{path}/lines")
    stream_clean(
        spark, f"{path}/lines", "content", f"{path}/out", f"{path}/state", "web",
        clean=lang.english_filter, max_bytes=CHUNK_CAP, max_files=2,
    ).awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    size = F.octet_length("text").cast("long")
    return rows.filter("chunk_id >= 0 AND doc_ord >= 0").select("source", "text", size.alias("b"))


# Larger chunks, since the job writes every one of them up to three times.
JOB_CAP = 5 * CHUNK_CAP


@catalog.add(
    "token_job",
    f"""WITH RECURSIVE {fit_sql(JOB_CAP)}, {LEARN_SQL.removeprefix("RECURSIVE ")}, {FINAL_SQL},
    pieces AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
      FROM (SELECT doc_id, {PIECES_SQL} AS w FROM documents)),
    coded AS (SELECT doc_id, md5(string_agg(ids, ' ' ORDER BY i) || ' 1') AS digest
      FROM pieces JOIN final USING (word) GROUP BY doc_id)
    SELECT f.source, f.chunk_id, f.doc_ord, coalesce(digest, md5('1')) AS digest
    FROM fit f LEFT JOIN coded ON doc_id = doc_ord""",
)
def token_job(spark, sf_dir):
    """A job that was stopped: a third of the chunks is there, a third in part; then it runs again, twice."""
    path, per_folder = scratch_path(spark, "job"), writers.chunks_per_folder(JOB_CAP)
    writers.write_chunks(assign_chunks(ordered_documents(spark, sf_dir), JOB_CAP), f"{path}/chunks", per_folder=per_folder)
    chunks, vocab = corpus.all_chunks(spark, f"{path}/chunks"), learnt(spark, sf_dir)
    third = F.col("chunk_id") % 3
    stopped = chunks.filter((third == 0) | ((third == 1) & (F.col("doc_ord") % 2 == 0)))
    writers.write_tokens(tokenize(stopped, vocab), f"{path}/tokens", per_folder=per_folder)
    left = [tokenize_pending(spark, f"{path}/chunks", f"{path}/tokens", vocab) for _ in range(2)]
    out = writers.read_tokens(spark, f"{path}/tokens").select(
        "source", "chunk_id", "doc_ord", F.md5(F.array_join("ids", " ")).alias("digest")
    )
    # The second run finds nothing to do.
    return out.filter(F.lit(left[1] == 0))


@catalog.add(
    "stream_chunks",
    f"""WITH RECURSIVE {PROBS_SQL}, kept AS (SELECT doc_id, text, strlen(text)::BIGINT AS b,
        row_number() OVER (ORDER BY doc_id) AS rn FROM probs
      WHERE {ASCII_RATIO_SQL} > {lang.ASCII_BAR} AND p[1] > {lang.LANG_BAR}),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord FROM documents),
    fit AS (SELECT doc_id, rn, b AS used, 0 AS chunk_id FROM kept WHERE rn = 1
      UNION ALL
      SELECT k.doc_id, k.rn, CASE WHEN f.used > 0 AND f.used + k.b > {CHUNK_CAP} THEN k.b ELSE f.used + k.b END,
        CASE WHEN f.used > 0 AND f.used + k.b > {CHUNK_CAP} THEN f.chunk_id + 1 ELSE f.chunk_id END
      FROM fit f JOIN kept k ON k.rn = f.rn + 1)
    SELECT 'web' AS source, doc_ord, chunk_id, text FROM fit JOIN placed USING (doc_id) JOIN kept USING (doc_id)""",
)
def chunks_of_a_stream(spark, sf_dir):
    """English documents that arrive in three parts; the stream is started anew for each."""
    path = scratch_path(spark, "stream")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    for part in range(3):
        cut = F.floor((F.col("doc_id") - low) * 3 / (high - low + 1))
        in_id_order(rows.filter(cut == part), "content", 3).write.json(f"{path}/lines/part={part}")
        stream_chunks(
            spark, f"{path}/lines", "content", f"{path}/out", f"{path}/state", "web",
            clean=lang.english_filter, max_bytes=CHUNK_CAP,
        ).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("source", "doc_ord", "chunk_id", "text")
