"""Cleaning and tokenizing as streams: each new file is handled once, restarts are safe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.lang import english_filter
from textloom.functions.text import utrim
from textloom.operators.chunking import MAX_CHUNK_BYTES, assign_chunks, chunk_sizes, open_chunks, with_chunks
from textloom.operators.vocabulary import Vocabulary, tokenize
from textloom.plans.joins import spread
from textloom.session import stage, staged_scope
from textloom.sources.corpus import in_file_order
from textloom.sources.writers import CODEC

CHUNK_SCHEMA = "doc_ord long, text string, source string, chunk_id int"
STATE_SCHEMA = "source string, carry long, chunk long, docs long"


def stream_tokens(
    spark: SparkSession, chunks: str, out: str, checkpoint: str, vocab: Vocabulary,
    max_files: int = 1000,
) -> StreamingQuery:
    """Tokenize the chunk files that have appeared under ``chunks`` since the last run.

    Each micro-batch writes its own ``batch_id`` partition and replaces it when
    a batch is run again after a failure, so a document is never written twice.
    """
    files = (
        spark.readStream.schema(CHUNK_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(chunks)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # A few files are a few tasks, however many cores there are.
        ids = tokenize(spread(batch.filter(F.col("text").isNotNull()), "doc_ord"), vocab)
        (
            ids.select("source", "chunk_id", "doc_ord", "ids", F.size("ids").alias("n_tokens"))
            .write.mode("overwrite")
            .option("compression", CODEC)
            .parquet(f"{out}/batch_id={batch_id}")
        )

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def clean_english(rows: DataFrame) -> DataFrame:
    """Trim and keep English texts; stateless, for batch and streaming frames."""
    return english_filter(rows.filter(F.col("text").isNotNull()).withColumn("text", utrim("text")))


def stream_clean(
    spark: SparkSession, path: str, key: str, out: str, checkpoint: str, source: str,
    clean: Callable[[DataFrame], DataFrame] = clean_english,
    max_bytes: int = MAX_CHUNK_BYTES, max_files: int = 1000,
) -> StreamingQuery:
    """Clean new JSON-lines files and cut what is kept into chunks.

    Each micro-batch numbers its documents in file order and its chunks from 0, and
    writes ``(source, doc_ord, chunk_id, text)`` to its own ``batch_id`` partition, which
    a batch that is run again replaces.
    """
    lines = _new_lines(spark, path, key, max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        with staged_scope(spark):
            kept = stage(clean(in_file_order(batch, source)).select("source", "doc_ord", "text"), "kept")
            _write_batch(assign_chunks(kept, max_bytes), out, batch_id)

    return _started(lines, write, checkpoint)


def _new_lines(
    spark: SparkSession, path: str, key: str, max_files: int, recursive: bool = False
) -> DataFrame:
    """``(file, split, text)`` of JSON-lines files as they appear."""
    return (
        spark.readStream.schema(f"`{key}` string")
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", str(recursive).lower())
        .json(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col(f"`{key}`").alias("text"),
        )
    )


def _write_batch(rows: DataFrame, out: str, batch_id: int) -> None:
    (
        rows.select("source", "doc_ord", "chunk_id", "text")
        .write.mode("overwrite")
        .option("compression", CODEC)
        .parquet(f"{out}/batch_id={batch_id}")
    )


def _started(
    lines: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_chunks(
    spark: SparkSession, path: str, key: str, out: str, checkpoint: str, source: str,
    clean: Callable[[DataFrame], DataFrame] = clean_english,
    max_bytes: int = MAX_CHUNK_BYTES, max_files: int = 1000,
) -> StreamingQuery:
    """Clean new JSON-lines files and go on with the chunks where the last micro-batch stopped.

    The state between micro-batches is one row a source: the number of its open chunk, the
    bytes in it, and the documents numbered so far. Batch n reads what batch n - 1 left
    beside the checkpoint and leaves its own; a batch that is run again after a failure
    finds the same state and replaces what it had written. The documents of a micro-batch are
    chunked in parallel like those of a table, so chunks and numbers are those of one
    next-fit pass over all batches in turn, files of a batch in path order.
    """
    state = f"{checkpoint}/open-chunks"

    def write(batch: DataFrame, batch_id: int) -> None:
        with staged_scope(spark):
            reader = spark.read.schema(STATE_SCHEMA)
            before = reader.parquet(f"{state}/batch_id={batch_id - 1}") if batch_id else spark.createDataFrame([], STATE_SCHEMA)
            past = before.filter(F.col("source") == source).agg(F.max("docs")).first()[0] or 0
            rows = stage(in_file_order(batch, source), "lines").withColumn("doc_ord", F.col("doc_ord") + past)
            kept = stage(clean(rows).select("source", "doc_ord", "text"), "kept")
            sizes = kept.select("source", "doc_ord", F.octet_length("text").cast("long").alias("n_bytes"))
            assigned = stage(chunk_sizes(sizes, max_bytes, carry=before), "chunk-of")
            _write_batch(with_chunks(kept, assigned), out, batch_id)
            docs = rows.groupBy("source").agg(F.max("doc_ord").alias("last"))
            after = (
                open_chunks(assigned, before)
                .join(docs, "source", "full")
                .join(before.select("source", "docs"), "source", "left")
                .select(
                    "source", F.coalesce("carry", F.lit(0)).alias("carry"), F.coalesce("chunk", F.lit(0)).alias("chunk"),
                    F.coalesce(F.col("last") + 1, "docs").alias("docs"),
                )
            )
            after.coalesce(1).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    return _started(_new_lines(spark, path, key, max_files, recursive=True), write, checkpoint)
