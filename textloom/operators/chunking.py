"""Size-bounded chunking of ordered documents.

Next-fit is sequential: a chunk ends where the next document would overflow it,
and where it ends decides where every later chunk ends. It is made parallel by
treating each block of consecutive documents as a function of the bytes already
in the open chunk when the block begins:

1. Per (source, block), that function is tabulated: intervals of the carry-in,
   with the chunks started and the carry-out for each. Chains of chunks that
   start at different documents tend to meet, so tables are smaller than blocks.
2. Tables of neighbouring blocks are composed, ``fan_in`` at a time and level by
   level, until a source has fewer than ``fan_in`` left.
3. From the top down, each group is entered with its true carry-in, which fixes
   the carry-in and the first chunk number of its members.
4. Each block replays its documents from its carry-in.

No task sees more than one block or ``fan_in`` tables, however large the source.
Only document sizes take part; the texts are joined back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.joins import BROADCAST_BYTES, is_small
from textloom.plans.prefix import idiv, ordinal, running_sum
from textloom.session import stage

# Fixed value: largest chunk, in UTF-8 bytes.
MAX_CHUNK_BYTES = 268_435_456

BLOCK_DOCS = 1 << 21
FAN_IN = 8

_STEP_SCHEMA = "source string, blk long, c_lo long, c_hi long, started long, tail long, adds boolean"
_STEP_ARROW = pa.schema(
    [("source", pa.string())]
    + [(name, pa.int64()) for name in ("blk", "c_lo", "c_hi", "started", "tail")]
    + [("adds", pa.bool_())]
)
_CARRY_SCHEMA = "source string, blk long, carry long, chunk long"
_ASSIGN_SCHEMA = "source string, doc_ord long, n_bytes long, chunk_id int"
_NO_LIMIT = np.iinfo(np.int64).max


def _in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's documents in order, and their running byte sums from 0 on."""
    rows = rows.sort_by("doc_ord")
    sums = np.zeros(rows.num_rows + 1, dtype=np.int64)
    np.cumsum(rows.column("n_bytes").to_numpy(), out=sums[1:])
    return rows, sums


def _first_start(sums: np.ndarray, base, max_bytes: int, floor):
    """First document that must open a chunk, for open chunks that began at ``base``.

    ``base`` is the running sum at which the open chunk began (negative if it
    began in an earlier block). A document opens a chunk if the open one holds
    some bytes and would overflow; ``floor`` is the first place where it holds some.
    """
    overflow = np.searchsorted(sums, base + max_bytes, side="right") - 1
    return np.maximum(overflow, floor)


def _chains(sums: np.ndarray, max_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For a chunk opened at each document: chunks opened in the block, and the last one's place."""
    n = len(sums) - 1
    filled = np.searchsorted(sums, sums, side="right")
    jump = np.minimum(_first_start(sums, sums, max_bytes, filled), n)
    jump[n] = n
    count = np.ones(n + 1, dtype=np.int64)
    count[n] = 0
    last = np.arange(n + 1)
    # Pointer doubling: after k rounds each entry covers 2**k hops.
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[jump], last)
        count = count + count[jump]
        jump = jump[jump]
    return count, last


@dataclass
class _Steps:
    """A block's table: for a carry-in in ``lo..hi``, chunks started and carry-out.

    The carry-out is ``tail``, plus the carry-in itself where ``adds`` is set,
    which means that the block fits into the open chunk. Rows are in order of
    the carry-in and cover every value from 0 on.
    """

    lo: np.ndarray
    hi: np.ndarray
    started: np.ndarray
    tail: np.ndarray
    adds: np.ndarray

    def enter(self, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows for some carry-ins, with chunks started and carry-outs."""
        at = np.searchsorted(self.lo, carry, side="right") - 1
        return at, self.started[at], self.tail[at] + np.where(self.adds[at], carry, 0)

    def merged(self) -> _Steps:
        """Neighbouring rows with the same outcome as one; carry-in 0 stays apart."""
        same = (
            (self.started[1:] == self.started[:-1])
            & (self.tail[1:] == self.tail[:-1])
            & (self.adds[1:] == self.adds[:-1])
            & (self.lo[:-1] > 0)
        )
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        last = np.concatenate((first[1:], [len(self.lo)])) - 1
        return _Steps(
            self.lo[first], self.hi[last], self.started[first], self.tail[first], self.adds[first]
        )

    def then(self, after: _Steps) -> _Steps:
        """The table of this block followed by ``after``."""
        fixed, open_ = np.flatnonzero(~self.adds), np.flatnonzero(self.adds)
        _, started, tail = after.enter(self.tail[fixed])
        parts = [
            _Steps(
                self.lo[fixed], self.hi[fixed], self.started[fixed] + started, tail,
                np.zeros(len(fixed), dtype=bool),
            )
        ]
        for i in open_:  # at most two rows: carry-in 0, and the largest that still fit
            lo, hi, plus = self.lo[i], self.hi[i], self.tail[i]
            a = np.searchsorted(after.lo, lo + plus, side="right") - 1
            z = np.searchsorted(after.lo, hi + plus, side="right")
            parts.append(
                _Steps(
                    np.maximum(after.lo[a:z] - plus, lo), np.minimum(after.hi[a:z] - plus, hi),
                    after.started[a:z], after.tail[a:z] + np.where(after.adds[a:z], plus, 0),
                    after.adds[a:z],
                )
            )
        joined = [np.concatenate([getattr(p, f) for p in parts]) for f in _FIELDS]
        order = np.argsort(joined[0], kind="stable")
        return _Steps(*(c[order] for c in joined)).merged()

    def to_arrow(self, source: str, blk: int) -> pa.Table:
        n = len(self.lo)
        columns = [pa.repeat(source, n), pa.repeat(pa.scalar(blk, pa.int64()), n)]
        columns += [pa.array(getattr(self, f)) for f in _FIELDS]
        return pa.table(columns, schema=_STEP_ARROW)


_FIELDS = ("lo", "hi", "started", "tail", "adds")


def _tables(rows: pa.Table) -> Iterator[tuple[int, _Steps]]:
    """The step tables in ``rows``, in block order."""
    rows = rows.sort_by([("blk", "ascending"), ("c_lo", "ascending")])
    blk = rows.column("blk").to_numpy()
    fields = [rows.column(c).to_numpy() for c in ("c_lo", "c_hi", "started", "tail", "adds")]
    cuts = np.flatnonzero(np.diff(blk)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(blk)]):
        yield int(blk[a]), _Steps(*(f[a:z] for f in fields))


def _make_steps(max_bytes: int):
    def steps(key: tuple, rows: pa.Table) -> pa.Table:
        _, sums = _in_order(rows)
        n, total = len(sums) - 1, int(sums[-1])
        count, last = _chains(sums, max_bytes)

        def outcome(entry: np.ndarray) -> list[np.ndarray]:
            fits = entry >= n
            at = np.minimum(entry, n - 1)
            tail = np.where(fits, total, total - sums[last[at]])
            return [np.where(fits, 0, count[at]), tail, fits]

        filled = np.searchsorted(sums, 0, side="right")
        empty = np.array([_first_start(sums, 0, max_bytes, filled)])
        # A carry-in c > 0 opens its first chunk at document j exactly when
        # max - sums[j + 1] < c <= max - sums[j]; below that nothing opens.
        hi = np.append(max_bytes - sums[:-1], max_bytes - total)
        lo = np.append(max_bytes - sums[1:] + 1, 1)
        hi[0] = _NO_LIMIT
        entry = np.flatnonzero((hi >= 1) & (np.maximum(lo, 1) <= hi))[::-1]
        zero = np.zeros(1, dtype=np.int64)
        table = [np.concatenate((zero, np.maximum(lo[entry], 1))), np.concatenate((zero, hi[entry]))]
        table += [np.concatenate(pair) for pair in zip(outcome(empty), outcome(entry))]
        return _Steps(*table).merged().to_arrow(key[0].as_py(), key[1].as_py())

    return steps


def _compose(key: tuple, rows: pa.Table) -> pa.Table:
    """The step table of a group of neighbouring blocks."""
    tables = (t for _, t in _tables(rows))
    whole = next(tables)
    for t in tables:
        whole = whole.then(t)
    return whole.to_arrow(key[0].as_py(), key[1].as_py())


def _descend(rows: pa.Table) -> pa.Table:
    """Carry-in and first chunk of each block of a group, from those of the group."""
    source = rows.column("source")[0].as_py()
    carry, chunk = (np.array([rows.column(c)[0].as_py()]) for c in ("carry", "chunk"))
    out = []
    for blk, table in _tables(rows):
        out.append((source, blk, int(carry[0]), int(chunk[0])))
        _, started, carry = table.enter(carry)
        chunk = chunk + started
    names = ["source", "blk", "carry", "chunk"]
    return pa.table([list(c) for c in zip(*out)], names=names)


def _make_replay(max_bytes: int):
    def replay(rows: pa.Table) -> pa.Table:
        carry, chunk = rows.column("carry")[0].as_py(), rows.column("chunk")[0].as_py()
        rows, sums = _in_order(rows)
        n = len(sums) - 1
        filled = 0 if carry > 0 else int(np.searchsorted(sums, 0, side="right"))
        at = int(_first_start(sums, -carry, max_bytes, filled))
        opens = np.zeros(n, dtype=np.int64)
        while at < n:
            opens[at] = 1
            filled = int(np.searchsorted(sums, sums[at], side="right"))
            at = int(_first_start(sums, int(sums[at]), max_bytes, filled))
        chunk_id = pa.array(chunk + np.cumsum(opens), pa.int32())
        return rows.select(["source", "doc_ord", "n_bytes"]).append_column("chunk_id", chunk_id)

    return replay


def _entered(df: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Rows with the bytes of their source's open chunk and its number; 0 and 0 if nothing is carried."""
    if carry is None:
        zero = F.lit(0).cast("long")
        return df.select("*", zero.alias("carry"), zero.alias("chunk"))
    return df.join(carry.select("source", "carry", "chunk"), "source", "left").fillna(0, ["carry", "chunk"])


def _next_fit(
    sizes: DataFrame, max_bytes: int, block_docs: int, fan_in: int, carry: DataFrame | None = None
) -> DataFrame:
    placed = ordinal(sizes.select("source", "doc_ord", "n_bytes"), ["source"], ["doc_ord"], "n")
    blocked = stage(
        placed.select("source", "doc_ord", "n_bytes", idiv(F.col("n"), block_docs).alias("blk")),
        "blocked-sizes",
    )
    blocks = (blocked.agg(F.max("blk")).first()[0] or 0) + 1
    replay = _make_replay(max_bytes)
    if blocks == 1:
        whole = _entered(blocked, carry).groupBy("source", "blk")
        return whole.applyInArrow(replay, _ASSIGN_SCHEMA)

    steps = blocked.groupBy("source", "blk").applyInArrow(_make_steps(max_bytes), _STEP_SCHEMA)
    levels = [stage(steps, "steps")]
    while blocks > fan_in:
        group = idiv(F.col("blk"), fan_in).alias("grp")
        up = levels[-1].groupBy("source", group).applyInArrow(_compose, _STEP_SCHEMA)
        levels.append(stage(up, "steps"))
        blocks = -(-blocks // fan_in)

    carries = _entered(levels[-1], carry).groupBy("source").applyInArrow(_descend, _CARRY_SCHEMA)
    for lower in reversed(levels[:-1]):
        entered = carries.withColumnRenamed("blk", "grp")
        carries = (
            lower.withColumn("grp", idiv(F.col("blk"), fan_in))
            .join(entered, ["source", "grp"])
            .groupBy("source", "grp")
            .applyInArrow(_descend, _CARRY_SCHEMA)
        )
    return (
        blocked.join(carries, ["source", "blk"])
        .groupBy("source", "blk")
        .applyInArrow(replay, _ASSIGN_SCHEMA)
    )


def _prefix_chunks(sizes: DataFrame, max_bytes: int) -> DataFrame:
    summed = running_sum(sizes, ["source"], ["doc_ord"], F.col("n_bytes"), "_before")
    chunk = idiv(F.col("_before"), max_bytes).cast("int")
    return summed.select("source", "doc_ord", "n_bytes", chunk.alias("chunk_id"))


def chunk_sizes(
    sizes: DataFrame,
    max_bytes: int = MAX_CHUNK_BYTES,
    mode: str = "next_fit",
    block_docs: int = BLOCK_DOCS,
    fan_in: int = FAN_IN,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Chunk numbers for ``(source, doc_ord, n_bytes)`` rows.

    ``mode="next_fit"``: a document opens a chunk if the open one holds some
    bytes and would exceed ``max_bytes``. ``mode="prefix"`` cuts at multiples of
    ``max_bytes`` of the running byte count, a coarser rule with no carry.
    ``doc_ord`` must be unique in its source and is best dense. Rows with a null size
    are dropped.
    ``block_docs`` bounds the documents one task holds. Next-fit goes on from ``carry``
    (source, carry, chunk): the bytes and the number of each source's open chunk.
    """
    sizes = sizes.filter(F.col("n_bytes").isNotNull())
    if mode == "next_fit":
        return _next_fit(sizes, max_bytes, block_docs, fan_in, carry)
    if carry is not None:
        raise ValueError("only next_fit goes on from an open chunk")
    if mode == "prefix":
        return _prefix_chunks(sizes, max_bytes)
    raise ValueError(f"unknown mode: {mode}")


def chunk_bounds(assigned: DataFrame) -> DataFrame:
    """One row per chunk: its document range, documents and bytes."""
    return assigned.groupBy("source", "chunk_id").agg(
        F.min("doc_ord").alias("lo"),
        F.max("doc_ord").alias("hi"),
        F.count("*").alias("docs"),
        F.sum("n_bytes").alias("bytes"),
    )


def open_chunks(assigned: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """``(source, carry, chunk)``: each source's open chunk after the documents of ``chunk_sizes``."""
    sums = assigned.groupBy("source", "chunk_id").agg(F.sum("n_bytes").alias("bytes"))
    last = sums.groupBy("source").agg(F.max(F.struct("chunk_id", "bytes")).alias("l"))
    after = last.select("source", F.col("l.bytes").alias("carry"), F.col("l.chunk_id").cast("long").alias("chunk"))
    if carry is None:
        return after
    before = carry.select("source", F.col("carry").alias("_c"), F.col("chunk").alias("_k"))
    # What was carried in still counts if the chunk is the same; a source without documents keeps its own.
    same = F.when(F.col("_k") == F.col("chunk"), F.col("_c")).otherwise(0)
    return after.join(before, "source", "full").select(
        "source",
        F.coalesce(F.col("carry") + F.coalesce(same, F.lit(0)), F.col("_c")).alias("carry"),
        F.coalesce("chunk", "_k").alias("chunk"),
    )


def assign_chunks(
    df: DataFrame,
    max_bytes: int = MAX_CHUNK_BYTES,
    mode: str = "next_fit",
    block_docs: int = BLOCK_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES,
    fan_in: int = FAN_IN,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Add ``chunk_id`` to ``(source, doc_ord, text, ...)`` rows; rows with a null text are dropped.

    Chunks are ranges of ``doc_ord``. Ranges are cut at blocks of positions, about as
    many as there are chunks, so a row finds its chunk by an equality of source and
    block and a test of the few ranges there. The table of ranges is broadcast if it is
    measured to be small, and the texts are then not shuffled; a larger one is joined by
    document. ``carry`` is that of ``chunk_sizes``.
    """
    df = df.filter(F.col("text").isNotNull())
    sizes = stage(
        df.select("source", "doc_ord", F.octet_length("text").cast("long").alias("n_bytes")),
        "sizes",
    )
    assigned = stage(chunk_sizes(sizes, max_bytes, mode, block_docs, fan_in, carry), "chunk-of")
    return with_chunks(df, assigned, broadcast_bytes)


def with_chunks(df: DataFrame, assigned: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join the chunk numbers of a staged ``chunk_sizes`` to the documents."""
    bounds = stage(chunk_bounds(assigned).select("source", "chunk_id", "lo", "hi"), "chunk-lo")
    if not is_small(bounds, broadcast_bytes):
        return df.join(assigned.drop("n_bytes"), ["source", "doc_ord"])
    whole = bounds.agg(F.max("hi"), F.min("lo"), F.count("*")).first()
    width = max(1, ((whole[0] or 0) - (whole[1] or 0) + 1) // max(whole[2], 1))
    ranges = bounds.select(
        F.col("source").alias("_s"), "chunk_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        F.explode(F.sequence(idiv(F.col("lo"), width), idiv(F.col("hi"), width))).alias("_b"),
    )
    place = F.col("doc_ord")
    here = (F.col("source") == F.col("_s")) & (idiv(place, width) == F.col("_b"))
    found = df.join(F.broadcast(ranges), here & place.between(F.col("_lo"), F.col("_hi")))
    return found.drop("_s", "_b", "_lo", "_hi")
