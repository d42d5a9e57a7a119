"""Measured choices: which side to broadcast, whether a scan needs spreading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table's rows, written out as text, take at most ``limit`` bytes."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= limit


def join_measured(
    big: DataFrame, small: DataFrame, on: Sequence[str] | Column, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Join a narrow table in; broadcast it only if it is measured to be small.

    ``small`` should be a staged table, so that measuring it is cheap. Beyond the
    limit this is an ordinary shuffled join and AQE splits skewed keys.
    """
    if is_small(small, limit):
        small = F.broadcast(small)
    return big.join(small, on if isinstance(on, Column) else list(on))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shuffle rows by a unique key if the scan has fewer partitions than there are cores.

    A file with one row group, like a gzip file, is one task however much work
    each row needs. Scans that already keep all cores busy are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
