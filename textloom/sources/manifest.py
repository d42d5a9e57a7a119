"""Manifest tables: chunks per source, and download sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS_SCHEMA = "Name string, Chunks int"
DOWNLOAD_SCHEMA = "Name string, Total string, Sampled string, Epochs int"

_UNITS = {"KB": 1e-6, "MB": 1e-3, "GB": 1.0, "TB": 1e3}


def size_in_gb(c: str) -> Column:
    """Parse a size such as ``15.8 TB`` into gigabytes."""
    number = F.regexp_extract(c, r"^\s*([0-9.]+)", 1).cast("double")
    unit = F.upper(F.regexp_extract(c, r"([A-Za-z]+)\s*$", 1))
    factor = F.lit(None).cast("double")
    for name, value in _UNITS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return number * factor


def read_chunk_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(source, chunks)`` rows."""
    rows = spark.read.schema(CHUNKS_SCHEMA).option("header", "true").csv(path)
    return rows.select(F.col("Name").alias("source"), F.col("Chunks").alias("chunks"))


def read_download_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(source, total_gb, sampled_gb, epochs)`` rows."""
    rows = spark.read.schema(DOWNLOAD_SCHEMA).option("header", "true").csv(path)
    return rows.select(
        F.col("Name").alias("source"),
        size_in_gb("Total").alias("total_gb"),
        size_in_gb("Sampled").alias("sampled_gb"),
        F.col("Epochs").alias("epochs"),
    )
