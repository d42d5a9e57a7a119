"""Tokenizing a chunk table as a job that can be stopped and started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.vocabulary import Vocabulary, tokenize
from textloom.plans.joins import BROADCAST_BYTES
from textloom.session import exists, stage, staged_scope
from textloom.sources.corpus import CHUNK_SCHEMA, all_chunks, named_chunks, per_folder_of, with_folder
from textloom.sources.writers import read_tokens, replace_tokens, scan_tokens

CHUNK = ["source", "chunk_id"]


def chunk_progress(spark: SparkSession, chunks: str, tokens: str) -> DataFrame:
    """``(source, chunk_id, docs, done)``: documents of each text chunk, and how many are tokenized.

    Only partition values and row counts are read, no texts and no ids. Chunks that are not
    in the text table any more are left out.
    """
    have = all_chunks(spark, chunks).groupBy(*CHUNK).agg(F.count("*").alias("docs"))
    if not exists(spark, tokens):
        return have.withColumn("done", F.lit(0).cast("long"))
    done = read_tokens(spark, tokens).groupBy(*CHUNK).agg(F.count("*").alias("done"))
    return have.join(done, CHUNK, "left").fillna(0, ["done"])


def pending_texts(
    spark: SparkSession, chunks: str, progress: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The texts of the chunks that are not complete.

    ``progress`` should be a staged table of ``chunk_progress``. Its unfinished rows prune
    the partitions of the text table when the scan starts, if they are measured to be
    small enough to be sent to all tasks; otherwise the scan is joined with them.
    """
    return named_chunks(spark.read.schema(CHUNK_SCHEMA).parquet(chunks), progress.filter("done < docs"), broadcast_bytes)


def _beside(spark: SparkSession, tokens: str, progress: DataFrame, per_folder: int) -> DataFrame:
    """The tokens of other chunks in the folders of those that are not complete."""
    unfinished, by = with_folder(progress.filter("done < docs").select(*CHUNK), per_folder)
    near = scan_tokens(spark, tokens).join(unfinished.select(*by).distinct(), by, "left_semi")
    return near.join(unfinished.select(*CHUNK), CHUNK, "left_anti").select(*CHUNK, "doc_ord", "ids")


def tokenize_pending(
    spark: SparkSession, chunks: str, tokens: str, vocab: Vocabulary, special_in_text: str = "split"
) -> int:
    """Tokenize the chunks under ``chunks`` that ``tokens`` lacks or holds in part; returns how many.

    A run that was stopped leaves whole chunks, or none or some files of a chunk; such a
    chunk is written anew as a whole, finished ones are neither read nor written; only where several
    chunks share a folder, the ids of its finished ones are copied. Running the job again when all is done
    writes nothing. The tokens get folders as they have, or, if there are none yet, as the texts have. A chunk that holds a null text, which has no
    tokens, never counts as finished.
    """
    with staged_scope(spark):
        progress = stage(chunk_progress(spark, chunks, tokens), "progress")
        left = progress.filter("done < docs").count()
        if left:
            coded = tokenize(pending_texts(spark, chunks, progress), vocab, special_in_text=special_in_text)
            there = per_folder_of(spark, tokens)
            if (there or per_folder_of(spark, chunks) or 1) == 1:
                replace_tokens(coded, tokens)
            elif there:
                beside = _beside(spark, tokens, progress, there)
                replace_tokens(coded.select(beside.columns).unionByName(beside), tokens, there)
            else:
                replace_tokens(coded, tokens, per_folder_of(spark, chunks))
        return left
