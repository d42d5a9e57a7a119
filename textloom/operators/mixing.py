"""Weighted mixing of sources into one reproducible order of sequences.

Randomness is a hash of a seed and a key, never a generator with state, so a
draw does not depend on partitioning and a lost task recomputes the same rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping, Sequence
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.joins import join_measured
from textloom.plans.prefix import hash_block, idiv, ordinal, position_block, running_sum
from textloom.session import stage

# Fixed value: training tokens per model parameter.
TOKENS_PER_PARAMETER = 20.0

MAX_SOURCES = 10_000

_SCHEDULE_ROWS = 8192
_SCHEDULE_SCHEMA = "source string, chunk_id int, slot int, round long, slots int, wanted long"


def seeded_hash(seed: int, *cols: Column | str) -> Column:
    """Hex digest of a seed and key columns."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


# Hex digits, and so bits, of the hash that a weighted draw uses.
DRAW_DIGITS = 15
MAX_WEIGHT = 2**62


def seeded_draw(seed: int, *cols: Column | str) -> Column:
    """Uniform integer in [0, 16^DRAW_DIGITS) from a seed and key columns."""
    return F.conv(F.substring(seeded_hash(seed, *cols), 1, DRAW_DIGITS), 16, 10).cast("long")


def read_mix(mix: Mapping[str, int] | DataFrame) -> list[tuple[str, int]]:
    """A mix as (source, weight) pairs in listed order; a table is read by ``pos``.

    A mix is configuration: one row per source. More than MAX_SOURCES is refused.
    """
    if isinstance(mix, DataFrame):
        rows = mix.orderBy("pos").select("source", "weight").limit(MAX_SOURCES + 1).collect()
        pairs = [(r["source"], int(r["weight"])) for r in rows]
    else:
        pairs = [(s, int(w)) for s, w in mix.items()]
    if len(pairs) > MAX_SOURCES:
        raise ValueError(f"a mix holds at most {MAX_SOURCES} sources")
    return pairs


def validate_mix(
    mix: Mapping[str, int] | DataFrame,
    slots: int | None = None,
    sources: Sequence[str] | None = None,
) -> list[tuple[str, int]]:
    """Check weights, slots and sources at hand; returns the pairs."""
    pairs = read_mix(mix)
    for source, weight in pairs:
        if weight <= 0:
            raise ValueError(f"weight of {source} must be positive: {weight}")
        if sources is not None and source not in sources:
            raise ValueError(f"no chunks of source {source}")
    if slots is not None and slots < len(pairs):
        raise ValueError("fewer slots than sources")
    return pairs


def alloc_slots(mix: DataFrame, slots: int) -> DataFrame:
    """Open-chunk slots per source by largest remainder: ``(source, weight, slots)``.

    ``mix`` holds ``(pos, source, weight)``. Every source gets one slot; the rest
    go by weight, and what is left over to the largest remainders, ties in
    listed order. A source with no more slots than sources left is an error of
    the caller (see :func:`validate_mix`).
    """
    whole = Window.partitionBy()
    extra = F.lit(slots) - F.count("*").over(whole)
    sized = mix.select(
        "pos", "source", "weight",
        extra.alias("x"), F.sum("weight").over(whole).alias("total"),
    ).select(
        "pos", "source", "weight",
        (1 + idiv(F.col("x") * F.col("weight"), F.col("total"))).alias("base"),
        (F.col("x") * F.col("weight") % F.col("total")).alias("rem"),
    )
    by_rem = Window.partitionBy().orderBy(F.col("rem").desc(), "pos")
    return sized.select(
        "pos", "source", "weight", "base",
        (F.lit(slots) - F.sum("base").over(whole)).alias("left"),
        F.row_number().over(by_rem).alias("rank"),
    ).select(
        "pos", "source", "weight",
        (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("slots"),
    )


def pick_source(pairs: Sequence[tuple[str, int]], draw: Column) -> Column:
    """Source of a weighted draw from a uniform integer (see ``seeded_draw``).

    The product of draw and total has up to 122 bits, so it is taken in decimals.
    """
    total, bounds = 0, []
    for _, weight in pairs:
        total += weight
        bounds.append(total)
    if total >= MAX_WEIGHT:
        raise ValueError(f"weights sum to {MAX_WEIGHT} or more")
    product = draw.cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    ticket = F.call_function("div", product, F.lit(16**DRAW_DIGITS).cast("decimal(19,0)"))
    passed = F.size(
        F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= ticket)
    )
    return F.element_at(F.array(*[F.lit(s) for s, _ in pairs]), passed + 1)


def draw_sources(
    rows: DataFrame, mix: Mapping[str, int] | DataFrame, seed: int, key: str = "id"
) -> DataFrame:
    """Add a ``source`` drawn by weight, with replacement, to each row."""
    return rows.withColumn("source", pick_source(validate_mix(mix), seeded_draw(seed, key)))


def draw_cells(mix: DataFrame) -> DataFrame:
    """``(cell, lo, hi, source, total, width)``: where the tickets of each source lie.

    ``mix`` holds ``(pos, source, weight)`` with dense positions from 0. The tickets from 0 to the sum of
    the weights are cut into as many cells of equal width as there are sources, so there are at most two
    rows a cell on average, whatever the weights are. Weights that are not positive,
    and sums of MAX_WEIGHT or more, are errors.
    """
    weight = F.col("weight").cast("long")
    whole = F.sum(F.col("weight").cast("decimal(38,0)"))
    facts = mix.agg(whole.alias("total"), F.count("*").alias("n"), F.count_if(weight.isNull() | (weight <= 0)).alias("bad"))
    total, n, bad = facts.first()
    if bad:
        raise ValueError(f"{bad} weights are not positive")
    if total is not None and total >= MAX_WEIGHT:
        raise ValueError(f"weights sum to {MAX_WEIGHT} or more")
    total = int(total or 0)
    width = -(-total // max(n, 1)) or 1
    placed = running_sum(mix.select("pos", "source", weight.alias("weight")), [], ["pos"], F.col("weight"), "lo")
    hi = F.col("lo") + F.col("weight")
    return placed.select(
        F.explode(F.sequence(idiv(F.col("lo"), width), idiv(hi - 1, width))).alias("cell"),
        "lo", hi.alias("hi"), "source", F.lit(total).cast("long").alias("total"), F.lit(width).cast("long").alias("width"),
    )


def draw_from_table(rows: DataFrame, mix: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """``draw_sources`` for a mix of any number of sources: the same draws.

    A row's ticket names its cell, and only the sources that reach into the cell are compared. The
    cells are sent to all tasks if they are measured to be small, and joined otherwise.
    """
    cells = stage(draw_cells(mix), "cells")
    facts = cells.select("total", "width").first()
    if facts is None:
        return rows.withColumn("source", F.lit(None).cast("string")).limit(0)
    product = seeded_draw(seed, key).cast("decimal(19,0)") * F.lit(facts["total"]).cast("decimal(19,0)")
    ticket = F.call_function("div", product, F.lit(16**DRAW_DIGITS).cast("decimal(19,0)"))
    drawn = rows.withColumn("_ticket", ticket).withColumn("_cell", idiv(F.col("_ticket"), facts["width"]))
    sought = cells.select(
        F.col("cell").alias("_cell"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "source"
    )
    met = join_measured(drawn, sought, ["_cell"])
    inside = (F.col("_ticket") >= F.col("_lo")) & (F.col("_ticket") < F.col("_hi"))
    return met.filter(inside).drop("_ticket", "_cell", "_lo", "_hi")


def mix_verdicts(mix: DataFrame, slots: DataFrame, at_hand: DataFrame | None = None) -> DataFrame:
    """``(slots, accepted, reason)`` for each number of slots in a table, as one plan.

    A mix is refused if a weight is not positive, if a source has no chunks in ``at_hand``
    (source), or if there are fewer slots than sources; ``reason`` says which comes first,
    and is null for an accepted one.
    """
    weight = F.col("weight")
    bad = F.count_if(weight.isNull() | (weight <= 0))
    facts = mix.agg(F.count("*").alias("sources"), bad.alias("bad"))
    absent = F.lit(0)
    if at_hand is not None:
        absent = mix.join(at_hand.select("source"), "source", "left_anti").agg(F.count("*")).scalar()
    reason = (
        F.when(facts.select("bad").scalar() > 0, "a weight is not positive")
        .when(absent > 0, "a source has no chunks")
        .when(F.col("slots") < facts.select("sources").scalar(), "fewer slots than sources")
    )
    return slots.select("slots", reason.isNull().alias("accepted"), reason.alias("reason"))


def checked_mix(mix: DataFrame, slots: int, at_hand: DataFrame | None = None) -> DataFrame:
    """The mix itself; reading it fails with the reason if the mix is refused for so many slots."""
    asked = mix.sparkSession.range(slots, slots + 1).select(F.col("id").alias("slots"))
    reason = mix_verdicts(mix, asked, at_hand).select("reason").scalar()
    return mix.filter(F.when(reason.isNotNull(), F.raise_error(reason).cast("boolean")).otherwise(True))


def epoch_permutation(
    chunks: DataFrame, seed: int, epoch: int, keys: Sequence[str] = ("source",),
    item: str = "chunk_id",
) -> DataFrame:
    """Add ``place``: the chunk's position in its source's order for an epoch."""
    hashed = chunks.withColumn("_h", seeded_hash(seed ^ epoch, item))
    block = hash_block("_h", chunks.count())
    return ordinal(hashed, keys, ["_h", item], "place", block).drop("_h")


def seeded_shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Add ``place``: the row's position in a seeded order of the whole table."""
    hashed = df.withColumn("_h", seeded_hash(seed, key))
    return ordinal(hashed, [], ["_h", key], "place", hash_block("_h", df.count())).drop("_h")


def worker_shard(
    df: DataFrame, worker: int, workers: int, order: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Every ``workers``-th row in order, starting at row ``worker``."""
    return (
        ordinal(df, keys, order, "_n").filter(F.col("_n") % workers == worker).drop("_n")
    )


def _make_schedule(seed: int):
    def schedule(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which chunk each slot of one source reads, from which round on.

        Sees one row per chunk, never a window, and gives its rows out as it goes. Slots
        that fall free in the same round reload in slot order.
        """
        table = pa.Table.from_batches(list(batches))
        lengths = dict(zip(table["chunk_id"].to_pylist(), table["n"].to_pylist()))
        wanted = table["wanted"][0].as_py()
        slots = min(table["slots"][0].as_py(), len(lengths))

        def given(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            chunk, slot, start = zip(*rows)
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.repeat(key[0], n), pa.array(chunk, pa.int32()), pa.array(slot, pa.int32()),
                    pa.array(start, pa.int64()), pa.repeat(pa.scalar(slots, pa.int32()), n),
                    pa.repeat(pa.scalar(wanted, pa.int64()), n),
                ],
                names=["source", "chunk_id", "slot", "round", "slots", "wanted"],
            )

        queue, epoch, rows = iter(_epoch_order(lengths, seed, 0)), 0, []
        free = [(0, s) for s in range(slots)]
        while free[0][0] * slots + free[0][1] < wanted:
            start, slot = free[0]
            chunk = next(queue, None)
            if chunk is None:
                epoch += 1
                queue = iter(_epoch_order(lengths, seed, epoch))
                chunk = next(queue)
            rows.append((chunk, slot, start))
            if len(rows) == _SCHEDULE_ROWS:
                yield given(rows)
                rows = []
            heapq.heapreplace(free, (start + lengths[chunk], slot))
        if rows:
            yield given(rows)

    return schedule


def _epoch_order(chunks: Iterable[int], seed: int, epoch: int) -> list:
    """The order that ``epoch_permutation`` gives, for one source's chunk list."""
    return sorted(chunks, key=lambda c: (md5(f"{seed ^ epoch}:{c}".encode()).hexdigest(), c))


def interleave_schedule(
    lengths: DataFrame, slots: DataFrame, wanted: DataFrame, seed: int
) -> DataFrame:
    """Chunk loads of the endless round-robin, one row per load.

    Every open slot yields one window per round, so window ``k`` of a chunk that
    slot ``s`` loads in round ``r`` comes out at place ``(r + k) * slots + s``.
    Only chunk lengths are needed: ``lengths (source, chunk_id, n)``,
    ``slots (source, slots)``, ``wanted (source, wanted)``. Chunks without a
    window are skipped.
    """
    rows = (
        lengths.filter("n > 0")
        .join(slots.select("source", "slots"), "source")
        .join(wanted.select("source", "wanted"), "source")
    )
    return rows.groupBy("source").applyInArrow(_make_schedule(seed), _SCHEDULE_SCHEMA)


def _window_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("source", "chunk_id").agg(F.count("*").alias("n"))


def interleave(
    windows: DataFrame, slots: DataFrame, wanted: DataFrame, seed: int,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Place windows in each source's round-robin order: ``(source, place, chunk_id, win, seq)``.

    A window appears once per epoch in which its chunk is loaded in time; places
    run from 0 to ``wanted - 1`` per source. Pass ``lengths`` if known (from
    token totals), otherwise windows are counted.
    """
    if lengths is None:
        lengths = _window_counts(windows)
    loads = stage(interleave_schedule(lengths, slots, wanted, seed), "loads")
    return (
        join_measured(windows, loads, ["source", "chunk_id"])
        .withColumn("place", (F.col("round") + F.col("win")) * F.col("slots") + F.col("slot"))
        .filter(F.col("place") < F.col("wanted"))
        .select("source", "place", "chunk_id", "win", "seq")
    )


def mixed_sequences(
    windows: DataFrame, mix: Mapping[str, int] | DataFrame, slots: int, draws: DataFrame,
    seed: int, lengths: DataFrame | None = None,
) -> DataFrame:
    """The mixed stream ``(id, source, chunk_id, win, seq)``.

    ``draws`` holds the dense positions ``id`` of the output. Each draws a source
    by weight; the k-th draw of a source takes the k-th window of that source's
    round-robin order. ``(source, k)`` is unique on both sides of the join.
    """
    if lengths is None:
        lengths = _window_counts(windows)
    lengths = stage(lengths.filter("n > 0"), "lengths")
    pairs = validate_mix(mix, slots)
    listed = [source for source, _ in pairs]
    at_hand = lengths.select("source").filter(F.col("source").isin(listed)).distinct().collect()
    validate_mix(dict(pairs), slots, [r["source"] for r in at_hand])
    drawn = stage(draw_sources(draws.select("id"), dict(pairs), seed), "draws")
    numbered = ordinal(drawn, ["source"], ["id"], "place", position_block("id"))
    wanted = stage(drawn.groupBy("source").agg(F.count("*").alias("wanted")), "wanted")
    numbered_mix = [(i, source, weight) for i, (source, weight) in enumerate(pairs)]
    table = windows.sparkSession.createDataFrame(numbered_mix, "pos int, source string, weight long")
    ordered = interleave(windows, alloc_slots(table, slots), wanted, seed, lengths)
    return numbered.join(ordered, ["source", "place"]).select(
        "id", "source", "chunk_id", "win", "seq"
    )


def resume_from(batches: DataFrame, iteration: int) -> DataFrame:
    """Batches from a saved iteration on."""
    return batches.filter(F.col("batch_id") >= iteration)


def token_budget(
    parameters: int, batch_size: int, seq_len: int, coeff: float = TOKENS_PER_PARAMETER
) -> tuple[int, int]:
    """Training batches and tokens for a model size."""
    batches = int(parameters * coeff / batch_size / seq_len)
    return batches, batches * batch_size * seq_len


def mix_plan(mix: DataFrame, at_hand: DataFrame, budget_tokens: int) -> DataFrame:
    """Tokens wanted per source against tokens at hand, and the epochs that takes."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())
    wanted = mix.select("pos", "source", "weight", (share * budget_tokens).alias("wanted"))
    return wanted.join(at_hand.select("source", "tokens"), "source", "left").select(
        "source", "weight", "wanted",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.col("wanted") / F.nullif(F.col("tokens"), F.lit(0))).alias("epochs"),
    )
