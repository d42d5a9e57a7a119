"""Shards from a hierarchical weighted hash tree (region, rack, shard).

A row descends the tree. At each node every child draws ``-ln(u) / weight``,
where ``u`` hashes the row's key and the child's path, and the smallest draw
wins, so a child gets rows in proportion to its weight. Changing a weight moves
rows only between the subtrees whose weights change. A shard that arrives as a
region of its own therefore takes rows only into itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import stage

#: Rows that are numbered together, about; more blocks follow from more rows.
BLOCK_ROWS = 1 << 14


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def uniform_tree(regions: int, racks: int, shards: int) -> list[Shard]:
    """Equal weights; shard numbers run through racks and regions."""
    return [
        Shard((g * racks + k) * shards + s, f"g{g}", f"k{k}")
        for g in range(regions)
        for k in range(racks)
        for s in range(shards)
    ]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, as a region of its own."""
    number = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(number, f"new{number}", "k0", weight)]


def _children(tree: Sequence[Shard]) -> dict[str, dict[str, float]]:
    """Path of an inner node -> its children's names and weights (sums of their shards)."""
    out: dict[str, dict[str, float]] = {}
    for s in tree:
        if not (s.weight > 0 and math.isfinite(s.weight)):
            raise ValueError(f"shard {s.number}: a weight must be positive")
        for path, child in (
            ("", s.region),
            (s.region, s.rack),
            (f"{s.region}/{s.rack}", str(s.number)),
        ):
            kids = out.setdefault(path, {})
            kids[child] = kids.get(child, 0.0) + s.weight
    if len(out) == 0:
        raise ValueError("a tree needs a shard")
    return out


def _draw(key: Column, path: Column, child: Column, weight: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, path, child), 11)
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def tree_shard(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard number of a key; null keys count as one key."""
    kids = _children(tree)
    table = F.create_map(
        *(
            x
            for path, names in kids.items()
            for x in (
                F.lit(path),
                F.array(
                    *(
                        F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))
                        for n, w in names.items()
                    )
                ),
            )
        )
    )

    def descend(path: Column) -> Column:
        draws = F.transform(
            F.element_at(table, path),
            lambda c: F.struct(
                _draw(key, path, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")
            ),
        )
        return F.array_min(draws)["name"]

    region = descend(F.lit(""))
    rack = F.concat(region, F.lit("/"), descend(region))
    return descend(rack).cast("int")


def slots(df: DataFrame, group: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    Rows are cut into blocks by a hash of ``order``, as many as the measured
    number of rows asks for, and numbered in each block; one total per block goes
    through the window over the group. No task sees a whole group. ``df`` is read three
    times, so it should be a stored table.
    """
    each = df.groupBy(group).count()
    groups, rows = each.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / (max(1, groups) * BLOCK_ROWS)))
    tagged = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(group, "_block")
        .count()
        .select(group, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    return (
        tagged.withColumn("_place", F.row_number().over(inside) - 1)
        .join(offsets, [group, "_block"])
        .withColumn(out, (F.col("_first") + F.col("_place")).cast("long"))
        .drop("_block", "_place", "_first")
    )


def shard_rows(
    df: DataFrame, tree: Sequence[Shard], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Shard, slot and, for the tree with one more shard, the new shard of each row.

    Keeps the key; adds ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``,
    ``shard``, ``grown_shard`` and ``slot``. Null texts have no bytes; rows with a
    null key share one shard; repeated rows get a slot each; an empty table gives
    no rows. Other columns are not carried, so none can clash.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key),
        (F.length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumns(
        {
            "shard": tree_shard(F.col(key), tree),
            "grown_shard": tree_shard(F.col(key), grown(tree)),
        }
    )
    return slots(stage(rows, "sharded"), "shard", [key, "text_crc32", "size"])
