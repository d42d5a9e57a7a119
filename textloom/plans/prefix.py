"""Running sums over ordered rows without putting a whole key into one task.

A plain ``sum() over (partition by key order by pos)`` sends each key to one
task, which fails when one source holds a third of the corpus. Positions here
are integers, so rows are first cut into blocks of ``width`` consecutive
positions. Each (key, block) is summed by itself. Blocks are gathered once more, and
only one total per gathering goes through the window over a whole key.
A block holds at most ``width`` rows whatever the distribution of the keys; blocks by
hash hold about as many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WIDTH = 1 << 12
SUPER_WIDTH = 1 << 12


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division, exact for any long (``/`` goes through doubles)."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def position_block(order: str, width: int = BLOCK_WIDTH) -> Column:
    """Block number of a dense integer position."""
    return idiv(F.col(order), width)


def hash_block(hash_col: str, rows: int, width: int = BLOCK_WIDTH) -> Column:
    """Block number of a row ordered by a hex digest: as many leading digits as ``rows`` asks for.

    With ``rows`` measured, a block holds ``width`` rows or fewer on average.
    """
    digits = 1
    while 16**digits * width < rows and digits < 15:
        digits += 1
    return F.conv(F.substring(F.col(hash_col), 1, digits), 16, 10).cast("long")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: Column | None = None,
    total: str | None = None,
    keep_block: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the key that come before this one.

    ``block`` must not decrease along ``order``; by default it is derived from
    the first order column, a dense integer position. ``total`` names a column for the
    sum over the whole key, ``keep_block`` one for the block, by which the result is
    partitioned together with the keys.
    """
    keys = list(keys)
    if block is None:
        block = position_block(order[0])
    tagged = df.withColumn("_blk", block).withColumn("_val", value.cast("long"))

    def before(by: str, *within: str) -> Column:
        rows = Window.partitionBy(*keys, *within).orderBy(by)
        sums = F.sum("_tot").over(rows.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(sums, F.lit(0))

    totals = (
        tagged.groupBy(*keys, "_blk")
        .agg(F.sum("_val").alias("_tot"))
        .withColumn("_sup", idiv(F.col("_blk"), SUPER_WIDTH))
    )
    # Only one total per SUPER_WIDTH blocks goes through the window of a whole key.
    supers = (
        totals.groupBy(*keys, "_sup")
        .agg(F.sum("_tot").alias("_tot"))
        .select(
            *keys, "_sup", before("_sup").alias("_base"),
            F.sum("_tot").over(Window.partitionBy(*keys)).alias("_all"),
        )
    )
    offsets = (
        totals.withColumn("_in", before("_blk", "_sup"))
        .join(supers, [*keys, "_sup"])
        .select(*keys, "_blk", (F.col("_base") + F.col("_in")).alias("_off"), "_all")
    )
    inside = (
        Window.partitionBy(*keys, "_blk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = tagged.withColumn("_loc", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
    done = local.join(offsets, [*keys, "_blk"]).withColumn(out, F.col("_loc") + F.col("_off"))
    if total:
        done = done.withColumn(total, F.col("_all"))
    if keep_block:
        done = done.withColumnRenamed("_blk", keep_block)
    return done.drop("_blk", "_val", "_loc", "_off", "_all")


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    block: Column | None = None,
) -> DataFrame:
    """Add ``out``: the zero-based position of each row within its key."""
    return running_sum(df, keys, order, F.lit(1), out, block)
