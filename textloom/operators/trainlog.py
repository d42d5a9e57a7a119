"""Roll-ups of a training log ``(step, loss_sum, n_tokens)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.prefix import idiv, ordinal

# Steps per interval, weight of the newest interval.
STAT_INTERVAL = 200
EMA_ALPHA = 0.1


def perplexity_rollup(log: DataFrame, every: int = STAT_INTERVAL) -> DataFrame:
    """Mean loss and perplexity per interval: ``(interval, step, avg_loss, ppl)``.

    An interval closes at each positive multiple of ``every``; step 0 counts to
    the first one and an interval whose closing step is missing is not emitted.
    """
    interval = F.greatest(F.lit(1), idiv(F.col("step") + (every - 1), every))
    return (
        log.groupBy(interval.alias("interval"))
        .agg(
            F.max("step").alias("step"),
            (F.sum("loss_sum") / F.sum("n_tokens")).alias("avg_loss"),
        )
        .filter(F.col("step") == F.col("interval") * every)
        .withColumn("ppl", F.exp("avg_loss"))
    )


def debiased_ema(
    df: DataFrame, alpha: float = EMA_ALPHA, n: str = "interval", x: str = "avg_loss"
) -> DataFrame:
    """Exponential mean with bias correction in the order of ``n``: adds ``ema``, ``ema_ppl``.

    A row's place k = 1, 2, ... is counted, so numbers may be missing in ``n``. In closed
    form ema_k = alpha * sum_i r^(k-i) x_i / (1 - r^k), r = 1 - alpha.
    Rows are summed in blocks short enough for r^-i to stay in range. A block
    reaches later rows through one number, its decayed sum. Those of the last
    ``back`` blocks are added; beyond them r^distance is exactly 0.0 as a double.
    """
    decay = -math.log1p(-alpha)
    width = max(1, math.floor(46 / decay))
    back = math.ceil(746 / (decay * width)) + 1
    r = F.lit(1.0 - alpha)
    place = F.col("_k")
    blk, inside = idiv(place, width), (place % width).cast("double")

    counted = ordinal(df, [], [n], "_k")
    rows = counted.withColumn("_b", blk).withColumn("_i", inside).withColumn(
        "_t", F.col(x) * alpha * F.pow(r, -F.col("_i"))
    )
    # Decayed to the last place of the block.
    sums = rows.groupBy("_b").agg((F.sum("_t") * F.pow(r, F.lit(width - 1.0))).alias("_s"))
    near = Window.orderBy("_b").rangeBetween(-back, -1)

    def weigh(acc: Column, e: Column) -> Column:
        return acc + e["_s"] * F.pow(r, ((F.col("_b") - e["_b"] - 1) * width).cast("double"))

    carried = sums.withColumn("_l", F.collect_list(F.struct("_b", "_s")).over(near)).select(
        "_b", F.aggregate("_l", F.lit(0.0), weigh).alias("_c")
    )
    upto = Window.partitionBy("_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    numer = (F.sum("_t").over(upto) + F.col("_c") * r) * F.pow(r, F.col("_i"))
    denom = 1.0 - F.pow(r, (place + 1).cast("double"))
    return (
        rows.join(carried, "_b")
        .withColumn("ema", numer / denom)
        .withColumn("ema_ppl", F.exp("ema"))
        .drop("_b", "_i", "_t", "_c", "_k")
    )
