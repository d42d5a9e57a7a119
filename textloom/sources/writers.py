"""Sinks: text chunks, token chunks, previews, JSON, and the done-list test.

Spark's commit protocol makes each write all-or-nothing, which is what the
temporary-name-then-rename step does for a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.joins import BROADCAST_BYTES
from textloom.sources.corpus import named_chunks, with_folder, without_folder

# Codec and level of the chunk files.
CODEC = "zstd"
CODEC_LEVEL = "3"

#: Bytes of text in a folder of small chunks, at most about.
FOLDER_BYTES = 32 << 20

TOKENS_SCHEMA = "doc_ord long, ids array<int>, n_tokens int, source string, chunk_id int"


def chunks_per_folder(max_bytes: int) -> int:
    """How many chunks of ``max_bytes`` share a folder, so that a table of small ones has few files."""
    return max(1, FOLDER_BYTES // max_bytes)


def _write_by_chunk(df: DataFrame, path: str, mode: str, per_folder: int, whole: bool = True) -> None:
    # Rebalancing gathers a folder where it can and lets AQE split it where it is
    # larger than the advisory size, so no writer gets a whole hot chunk.
    df, by = with_folder(df, per_folder)
    order = by if "chunk_id" in by else [*by, "chunk_id"]
    (
        df.hint("rebalance", *by)
        .sortWithinPartitions(*order, "doc_ord")
        .write.mode(mode)
        .option("compression", CODEC)
        .option("parquet.compression.codec.zstd.level", CODEC_LEVEL)
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_chunks(df: DataFrame, path: str, mode: str = "errorifexists", per_folder: int = 1) -> None:
    """Write ``(source, chunk_id, doc_ord, text)`` as a chunk table.

    A chunk has a folder of its own, or ``per_folder`` consecutive chunks have one together, which
    small chunks need: every folder costs at least one file. All writes to a table take the same number.
    """
    _write_by_chunk(df.select("source", "chunk_id", "doc_ord", "text"), path, mode, per_folder)


def write_tokens(df: DataFrame, path: str, mode: str = "errorifexists", per_folder: int = 1) -> None:
    """Write ``(source, chunk_id, doc_ord, ids)`` as a token table, in folders as ``write_chunks``.

    The token count is stored too: passes that only need lengths then leave the
    ids unread.
    """
    _write_by_chunk(_with_size(df), path, mode, per_folder)


def _with_size(df: DataFrame) -> DataFrame:
    return df.select("source", "chunk_id", "doc_ord", "ids", F.size("ids").alias("n_tokens"))


def replace_tokens(df: DataFrame, path: str, per_folder: int = 1) -> None:
    """Write the token chunks of ``df`` in place of those of a token table; other folders are not touched.

    Every replaced folder appears as a whole: partitions are moved into place when all are written.
    """
    _write_by_chunk(_with_size(df), path, "overwrite", per_folder, whole=False)


def scan_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Scan a token table, with the column of its folders if they hold several chunks."""
    return spark.read.schema(TOKENS_SCHEMA).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Scan a token table."""
    return without_folder(scan_tokens(spark, path))


def read_token_chunks(
    spark: SparkSession, path: str, wanted: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The tokens of the chunks named in ``wanted`` (source, chunk_id), and the files of no other folders.

    ``wanted`` should be a staged table with a condition on it. Its rows prune the partitions when the scan
    starts, if they are measured to be small enough to be sent to all tasks; otherwise they are joined.
    """
    return named_chunks(scan_tokens(spark, path), wanted, broadcast_bytes)


def write_batches(batches: DataFrame, path: str, per_part: int = 4096, mode: str = "errorifexists") -> None:
    """Write ``(batch_id, ...)`` rows in order: ``per_part`` consecutive batches a partition, sorted.

    A manifest beside them lists the range of batch numbers of every partition.
    """
    part = F.expr(f"CAST(batch_id DIV {per_part} AS INT)")
    (
        batches.withColumn("part", part)
        .repartition("part")
        .sortWithinPartitions("part", "batch_id")
        .write.mode(mode)
        .option("compression", CODEC)
        .partitionBy("part")
        .parquet(f"{path}/batches")
    )
    spark = batches.sparkSession
    ranges = spark.read.parquet(f"{path}/batches").groupBy("part").agg(
        F.min("batch_id").alias("lo"), F.max("batch_id").alias("hi"), F.count("*").alias("batches")
    )
    kept = ranges.withColumn("per_part", F.lit(per_part))
    kept.coalesce(1).write.mode("overwrite" if mode == "overwrite" else "errorifexists").parquet(f"{path}/manifest")


def read_batch_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(part, lo, hi, batches, per_part)`` of written batches."""
    return spark.read.parquet(f"{path}/manifest")


def read_batches(spark: SparkSession, path: str, iteration: int = 0) -> DataFrame:
    """Written batches from a saved iteration on; partitions that end before it are not opened."""
    first = read_batch_manifest(spark, path).filter(F.col("hi") >= iteration).agg(F.min("part")).first()[0]
    root = f"{path}/batches"
    if first is None:
        return spark.read.parquet(root).filter(F.lit(False)).drop("part")
    # The schema comes from the first partition that is read, too.
    schema = spark.read.option("basePath", root).parquet(f"{root}/part={first}").schema
    rows = spark.read.schema(schema).parquet(root)
    return rows.filter((F.col("part") >= first) & (F.col("batch_id") >= iteration)).drop("part")


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``chunks`` whose (source, chunk_id) is not in ``done`` yet."""
    return chunks.join(done.select("source", "chunk_id"), ["source", "chunk_id"], "left_anti")


def write_preview(df: DataFrame, path: str, n: int = 100) -> None:
    """Write the first ``n`` rows as parquet."""
    df.limit(n).write.mode("overwrite").option("compression", CODEC).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines."""
    df.write.mode("overwrite").json(path)
