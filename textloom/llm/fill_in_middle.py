"""Fill-in-the-middle texts, cut at exact ranks found in an indexable skip list.

A text is a row of units. The bottom lane of its skip list links every unit to the next;
each lane above keeps about a quarter of the nodes. Every link carries what it jumps over:
units, code points and bytes. A search starts at the head of the highest lane, takes a
link as long as the units passed do not exceed the rank, goes down a lane where it would,
and arrives with exactly so many units passed, and with the code points and bytes before
them. All texts of a piece are built and searched at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm import arrays

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Of 100 texts, so many are cut; of 100 cut ones, so many put the suffix first.
CUT_SHARE = 90
SUFFIX_FIRST_SHARE = 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def unit_starts(data: np.ndarray, bounds: np.ndarray, unit: str = "code_point") -> np.ndarray:
    """First bytes of the units of texts given end to end, in order; none crosses a text.

    A unit is a code point, or with ``word`` a word with the white space after it (white
    space at the start of a text is a unit of its own).
    """
    if unit == "code_point":
        return np.flatnonzero((data & 0xC0) != 0x80)
    if unit != "word":
        raise ValueError(f"unknown unit: {unit}")
    space = _SPACE[data]
    first = np.zeros(len(data), bool)
    first[1:] = ~space[1:] & space[:-1]
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(first)


@dataclass
class Lane:
    """Widths of the links from each node to the next; the node below; heads and ends of texts."""

    units: np.ndarray
    points: np.ndarray
    bytes: np.ndarray
    below: np.ndarray
    head: np.ndarray
    last: np.ndarray


class SkipList:
    """Lanes over the units of several texts, the highest one first.

    Every text has a head in front of its first unit and an end behind its last one, both
    in all lanes. Other nodes rise by a hash of their place, so a repeated task builds
    the same lanes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str = "code_point") -> None:
        n = len(bounds) - 1
        starts = unit_starts(data, bounds, unit)
        self.sizes = np.diff(np.searchsorted(starts, bounds))
        # Nodes: the units of a text, then its end.
        total = len(starts) + n
        end = np.cumsum(self.sizes) + np.arange(n)
        is_end = np.zeros(total, bool)
        is_end[end] = True
        head = end - self.sizes
        place = np.empty(total, np.int64)
        place[~is_end], place[is_end] = starts, bounds[1:]
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        point = points[place]
        unit_no = np.arange(total) - np.cumsum(is_end) + is_end
        random = arrays.mix((np.arange(total) + 1).astype(np.uint64))
        fixed = is_end.copy()
        fixed[head] = True
        self.lanes: list[Lane] = []
        node = np.arange(total)
        below = np.arange(total)
        number = np.arange(total)
        quarter = np.uint64(3)
        while True:
            width = [np.append(np.diff(x[node]), 0) for x in (unit_no, point, place)]
            number[node] = np.arange(len(node))
            self.lanes.insert(0, Lane(*width, below, number[head], number[end]))
            up = fixed[node] | ((random[node] & quarter) == 0)
            if up.all() or not n:
                break
            random >>= np.uint64(2)
            below = np.flatnonzero(up)
            node = node[up]

    def find(self, text: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and bytes in front of each rank (in units) of its text."""
        passed = np.zeros((3, len(text)), np.int64)
        if not len(text):
            return passed[1], passed[2]
        at = self.lanes[0].head[text]
        for lane in self.lanes:
            going = np.arange(len(text))
            while len(going):
                here = at[going]
                fits = (here < lane.last[text[going]]) & (passed[0, going] + lane.units[here] <= rank[going])
                going, here = going[fits], here[fits]
                passed[0, going] += lane.units[here]
                passed[1, going] += lane.points[here]
                passed[2, going] += lane.bytes[here]
                at[going] = here + 1
            at = lane.below[at]
        return passed[1], passed[2]


def _cut_task(unit: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in arrays.work(batch.column(0)):
                part = batch.slice(i, j - i)
                form = part.column(3).to_pylist()
                cuts = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)])
                lanes = SkipList(data, bounds, unit)
                rank = np.sort(cuts.astype(np.int64) % (lanes.sizes + 1)[:, None], axis=1)
                row = np.repeat(np.arange(j - i), 2)
                points, places = (x.reshape(-1, 2) for x in lanes.find(row, rank.ravel()))
                whole, out = data.tobytes(), []
                for r, kind in enumerate(form):
                    a, b, c, d = bounds[r], bounds[r] + places[r, 0], bounds[r] + places[r, 1], bounds[r + 1]
                    out.append(_arranged(kind, whole[a:b], whole[b:c], whole[c:d]))
                plain = np.array([kind == "plain" for kind in form], bool)
                columns = [
                    *part.columns[3:],
                    pa.array(lanes.sizes, pa.int64()),
                    pa.array(points[:, 0], pa.int64(), mask=plain),
                    pa.array(points[:, 1] - points[:, 0], pa.int64(), mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "psm":
        return b"".join([p, prefix, s, suffix, m, middle])
    if form == "spm":
        return b"".join([s, suffix, p, prefix, m, middle])
    return prefix + middle + suffix


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 from the SHA-256 of seed and key; a null key counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "code_point", seed: int = 1
) -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, output)`` of every row.

    ``n`` counts the units. The prefix ends after the smaller, the middle after the larger of
    two draws from 0 to n; ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix,
    prefix, middle) or ``plain``. Plain, with null widths, are texts that the draw leaves
    out, null and empty ones (output empty), and those that hold a mark already. A text is cut between
    code points only. Repeated keys draw alike, a null key draws as an empty one; other
    columns are not read; an empty table gives an empty one.
    """
    named = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    one, two, three, four = _draws(F.col(f"`{key}`"), seed)
    marked = named.contains(PREFIX) | named.contains(SUFFIX) | named.contains(MIDDLE)
    form = (
        F.when((named == "") | marked | (three % 100 >= CUT_SHARE), "plain")
        .when(four % 100 < SUFFIX_FIRST_SHARE, "spm")
        .otherwise("psm")
    )
    rows = docs.select(
        named.alias("text"), one.alias("one"), two.alias("two"), form.alias("form"), F.col(f"`{key}`").alias("key")
    )
    schema = StructType(
        rows.schema.fields[3:]
        + StructType.fromDDL("n long, prefix_chars long, middle_chars long, output string").fields
    )
    out = rows.mapInArrow(_cut_task(unit, to_arrow_schema(schema)), schema)
    return out.select(F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; no mark but those put in can occur in a cut one."""
    part = F.split(output, "|".join([PREFIX, SUFFIX, MIDDLE]), -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
