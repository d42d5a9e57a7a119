"""Corpus statistics. All are plain grouped aggregates, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_stats(df: DataFrame, unit: str = "chars", text: str = "text") -> DataFrame:
    """Documents and mean length per source, in characters or UTF-8 bytes."""
    length = {"chars": F.length, "bytes": F.octet_length}[unit](text)
    return df.groupBy("source").agg(
        F.count("*").alias("items"), F.avg(length).alias("mean_length")
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Number of chunks per source."""
    # Two levels, so a hot source is combined per chunk before it is counted.
    return chunks.groupBy("source", "chunk_id").count().groupBy("source").agg(
        F.count("*").alias("chunks")
    )


def histogram01(df: DataFrame, value: Column | str, bins: int = 100) -> DataFrame:
    """Counts of a value on [0, 1] in equal bins; 1.0 falls in the last bin.

    Every bin has a row, also an empty one. Values outside the range and nulls are
    counted in a last row without a bin number.
    """
    value = F.col(value) if isinstance(value, str) else value
    bin_no = F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)).cast("int")
    inside = F.when(F.col("x").between(0.0, 1.0), bin_no)
    counted = df.select(value.alias("x")).groupBy(inside.alias("bin")).agg(F.count("*").alias("n"))
    # One row per bin, so the frame of bins is as small as the result.
    numbers = df.sparkSession.range(bins + 1).select(
        F.when(F.col("id") < bins, F.col("id")).cast("int").alias("bin")
    )
    return (
        numbers.alias("b")
        .join(counted.alias("c"), F.col("b.bin").eqNullSafe(F.col("c.bin")), "left")
        .select("b.bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def keep_rate(df: DataFrame, kept: Column) -> DataFrame:
    """Rows kept by a condition, of all rows, per source."""
    return df.groupBy("source").agg(
        F.count_if(F.coalesce(kept, F.lit(False))).alias("kept"), F.count("*").alias("total")
    )
