"""Token streams: fixed-length windows, splitting at end-of-document marks, batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.plans.prefix import idiv, ordinal, running_sum
from textloom.session import stage

# Fixed value: id of the end-of-document mark.
EOS = 1


def n_tokens(tokens: DataFrame) -> Column:
    """Tokens per row: the stored count where the table has one."""
    return F.col("n_tokens") if "n_tokens" in tokens.columns else F.size("ids")


def with_counts(tokens: DataFrame) -> DataFrame:
    """A token table with ``n_tokens``, staged if it had no such column."""
    if "n_tokens" in tokens.columns:
        return tokens
    return stage(tokens.withColumn("n_tokens", F.size("ids")), "tokens")


class _Stretch:
    """Consecutive tokens of a chunk from a position on, with what has been cut from them."""

    def __init__(self, key: tuple, start: int, step: int) -> None:
        self.key, self.start, self.step = key, start, step
        self.held = np.zeros(0, dtype=np.int32)
        self.win = max(-(-start // step) - 1, 0)

    def end(self) -> int:
        return self.start + len(self.held)

    def add(self, ids: np.ndarray, last: bool) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(win, lo, tokens)`` of windows that get no more tokens from here, of all if ``last``.

        Whole windows that follow each other come as one item: the rows of a matrix.
        """
        self.held = np.concatenate([self.held, ids]) if len(self.held) else ids
        step, final = self.step, (self.end() - 1) // self.step
        if self.win < final and self.start > self.win * step:
            stop = self.win * step + step + 1
            yield self.win, self.start, self.held[None, : stop - self.start]
            self.win += 1
        if self.win < final:
            begin = self.win * step - self.start
            view = np.lib.stride_tricks.sliding_window_view(self.held[begin:], step + 1)
            yield self.win, self.win * step, view[: (final - self.win) * step : step]
            self.win = final
        keep = max(self.start, self.win * step)
        self.held, self.start = self.held[keep - self.start :].copy(), keep
        if last and len(self.held):
            yield self.win, self.start, self.held[None, :]


def _cut_task(step: int, whole: bool, schema: pa.Schema):
    """Whole windows of the documents of a task, or the fragments of all others.

    Documents in order of their place make long stretches; in any other order there are only more fragments.
    """

    def rows(key: tuple, found: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for win, lo, tokens in found:
            n, width = tokens.shape
            if (width == step + 1) == whole:
                part = pa.array(np.ascontiguousarray(tokens, dtype=np.int32).ravel())
                place = np.arange(n, dtype=np.int64)
                columns = [
                    pa.array([key[0]] * n), pa.array([key[1]] * n), pa.array(win + place), pa.array(lo + place * step),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), part),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, open_ = np.zeros(0, dtype=np.int32), None
        for batch in batches:
            if not batch.num_rows:
                continue
            source, chunk = (batch.column(c).dictionary_encode(null_encoding="encode") for c in (0, 1))
            starts, ids = batch.column(2).to_numpy(), batch.column(3)
            ends = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.to_numpy(zero_copy_only=False)
            new = starts[1:] != starts[:-1] + np.diff(ends)[:-1]
            for c in (source, chunk):
                code = c.indices.to_numpy(zero_copy_only=False)
                new |= code[1:] != code[:-1]
            cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [batch.num_rows]))
            for i, j in zip(cuts, cuts[1:]):
                key = source[i].as_py(), chunk[i].as_py()
                if open_ and (open_.key != key or open_.end() != starts[i]):
                    yield from rows(open_.key, open_.add(none, True))
                    open_ = None
                open_ = open_ or _Stretch(key, int(starts[i]), step)
                yield from rows(key, open_.add(flat[ends[i] : ends[j]], False))
        if open_:
            yield from rows(open_.key, open_.add(none, True))

    return run


def pack_windows(tokens: DataFrame, seq_len: int) -> DataFrame:
    """Cut each chunk's concatenated tokens into windows of ``seq_len + 1``, step ``seq_len``.

    ``tokens`` holds ``(source, chunk_id, doc_ord, ids)``. Consecutive windows
    share one token; the tail that fills no window is dropped and windows never
    cross chunks. Documents that follow each other in a task are cut as one stretch of
    tokens, an Arrow batch at a time; only the fragments of windows at the ends of stretches are
    shuffled, at most ``seq_len + 1`` a window, so no task sees a whole chunk.

    A table without a stored token count is staged first, so that the ids are made once.
    """
    tokens = with_counts(tokens)
    placed = running_sum(
        tokens.select("source", "chunk_id", "doc_ord", "ids", F.col("n_tokens").alias("n")).filter("n > 0"),
        ["source", "chunk_id"], ["doc_ord"], F.col("n"), "st",
    )
    rows = placed.select("source", "chunk_id", "st", "ids").sortWithinPartitions("source", "chunk_id", "st")
    names = placed.select("source", "chunk_id").schema.fields
    schema = StructType([*names, *StructType.fromDDL("win long, lo long, part array<int>").fields])

    def cut(whole: bool) -> DataFrame:
        return rows.mapInArrow(_cut_task(seq_len, whole, to_arrow_schema(schema)), schema)

    def joined(parts: DataFrame) -> DataFrame:
        rows = parts.groupBy("source", "chunk_id", "win").agg(
            F.sort_array(F.collect_list(F.struct("lo", "part"))).alias("parts")
        )
        return rows.select("source", "chunk_id", "win", F.flatten("parts.part").alias("seq"))

    across = joined(cut(False)).filter(F.size("seq") == seq_len + 1)
    return cut(True).select("source", "chunk_id", "win", F.col("part").alias("seq")).unionByName(across)


def split_on_eos(stream: DataFrame, eos: int = EOS, order: str = "ord") -> DataFrame:
    """Split ``(source, chunk_id, ord, ids)`` pieces of a token stream into documents.

    A document may span pieces. Tokens after the last mark of a chunk belong to
    no document. Returns ``(source, chunk_id, doc_no, ids)`` without the marks.
    """
    pieces = stream.select("source", "chunk_id", F.col(order).alias("ord"), "ids").filter(
        F.size("ids") > 0
    )
    marks = F.size(F.filter("ids", lambda t: t == eos))
    summed = running_sum(pieces, ["source", "chunk_id"], ["ord"], marks, "before", total="docs")
    # Tokens after a chunk's last mark are dropped here, before any grouping, so
    # a stream without marks never gathers in one group.
    placed = summed.filter(F.col("before") < F.col("docs")).withColumn(
        "at", F.filter(F.sequence(F.lit(1), F.size("ids")), lambda i: F.get("ids", i - 1) == eos)
    )
    n = F.size("at")

    def cut(k: Column) -> Column:
        start = F.when(k == 0, F.lit(1)).otherwise(F.get("at", k - 1) + 1)
        stop = F.when(k < n, F.get("at", k)).otherwise(F.size("ids") + 1)
        return F.struct(
            (F.col("before") + k).alias("doc_no"),
            F.slice("ids", start, stop - start).alias("part"),
        )

    return (
        placed.select(
            "source", "chunk_id", "ord", "docs",
            F.explode(F.transform(F.sequence(F.lit(0), n), cut)).alias("c"),
        )
        .filter(F.col("c.doc_no") < F.col("docs"))
        .groupBy("source", "chunk_id", F.col("c.doc_no").alias("doc_no"))
        .agg(F.sort_array(F.collect_list(F.struct("ord", "c.part"))).alias("parts"))
        .select("source", "chunk_id", "doc_no", F.flatten("parts.part").alias("ids"))
    )


def to_batches(
    df: DataFrame, batch_size: int, order: Sequence[str], item: str, position: str | None = None
) -> DataFrame:
    """Group each ``batch_size`` consecutive rows: ``(batch_id, items)``, the last may be short.

    ``position`` names a dense zero-based position if the rows already have one.
    """
    if position is None:
        df = ordinal(df, [], order, "_pos")
        position = "_pos"
    place = F.col(position)
    return (
        df.groupBy(idiv(place, batch_size).alias("batch_id"))
        .agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.col(item).alias("x")))).alias("r"))
        .select("batch_id", F.col("r.x").alias("items"))
    )


def token_stats(tokens: DataFrame) -> DataFrame:
    """Tokens and documents per chunk."""
    return tokens.groupBy("source", "chunk_id").agg(
        F.sum(n_tokens(tokens)).cast("long").alias("tokens"), F.count("*").alias("docs")
    )
