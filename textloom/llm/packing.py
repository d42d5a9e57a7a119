"""Bounded-space online packing of tokenized documents into sequences.

Each partition keeps a fixed number of open windows. A document is cut into full
windows and a rest; the rest goes into the open window that it fills best; when
none has room and no further window may be opened, the fullest is emitted. The
windows that stay open at the end of the partitions are merged the same way, many
partitions at a time, until one group is left. Token ids never leave the task that
made them: only one short row per piece does.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from textloom.session import stage

#: Partitions whose open windows are merged in one task.
MERGE_FAN_IN = 64

_PIECE = (
    "start long, length long, ids_crc32 long, doc_tokens long, task long, window long, "
    "offset long, used long"
)


class OpenWindows:
    """At most ``most`` open windows of ``size``, looked up by the room they have left."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.room: list[tuple[int, int]] = []
        self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """The window for ``length`` and the place in it: best fit, else a new window."""
        k = bisect_left(self.room, (length, -1))
        if k < len(self.room):
            left, window = self.room.pop(k)
        else:
            if len(self.room) == self.most:
                self.room.pop(0)  # the fullest is emitted
            left, window = self.size, self.next
            self.next += 1
        if left > length:
            insort(self.room, (left - length, window))
        return window, self.size - left


class Encoder:
    """Ids of texts as ``tokenizers`` gives them for a byte-level BPE file.

    Texts in plain scripts go through the same merges in ``tiktoken``, which is
    several times faster. Texts with other characters (where two Unicode tables might
    differ), with long unbroken runs (where its merging is quadratic), or with the
    string of a special token go to ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_letters()
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding(
            "file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.special = [t["content"] for t in spec["added_tokens"]]

    def plain(self, text: str) -> bool:
        if not text.isascii() and _OTHER.search(text):
            return False
        if any(s in text for s in self.special):
            return False
        if len(text) < _RUN:
            return True
        sizes = list(map(len, text.split()))
        blank = len(text) - sum(sizes) - len(sizes)
        return max(sizes, default=0) < _RUN and (blank < _RUN - 2 or not _BLANKS.search(text))

    def __call__(self, text: str) -> np.ndarray:
        if self.plain(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


#: Characters outside the plain scripts, and how long a run may be.
_OTHER = re.compile(r"[^\x00-\u017f\u2010-\u2027\u20ac]")
_RUN = 500
_BLANKS = re.compile(r"\s{500}")

#: Fixed value: the public pattern that splits text before byte-level merges.
_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pack_task(path: str, size: int, most: int, end_id: int, schema: pa.Schema):
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = Encoder(path), TaskContext.get().partitionId()
        windows = OpenWindows(size, most)
        used: dict[int, int] = {}
        for batch in batches:
            rows: list[list] = [[] for _ in columns]
            keys = []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    if len(piece) == size:
                        window, offset = windows.next, 0
                        windows.next += 1
                    else:
                        window, offset = windows.place(len(piece))
                    used[window] = offset + len(piece)
                    keys.append(row)
                    crc = zlib.crc32(piece.tobytes())
                    cells = (start, len(piece), crc, len(ids), task, window, offset, None)
                    for column, cell in zip(rows[1:], cells):
                        column.append(cell)
            still = {w for _, w in windows.room}
            used = {w: n for w, n in used.items() if w in still}
            taken = batch.column(0).take(pa.array(keys, pa.int64()))
            cells = [pa.array(c, f.type) for c, f in zip(rows[1:], list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([taken.cast(schema.field(0).type), *cells], schema=schema)
        left = [(task, w, used[w]) for _, w in windows.room]
        if left:
            names = dict(zip(("task", "window", "used"), zip(*left)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(names[f.name]), f.type)
                    if f.name in names
                    else pa.nulls(len(left), f.type)
                    for f in schema
                ],
                schema=schema,
            )

    return run


def _merge_task(size: int, most: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["used", "task", "window"], ascending=[False, True, True])
        windows = OpenWindows(size, most)
        placed = [windows.place(int(n)) for n in frame["used"]]
        frame["to_window"] = [w for w, _ in placed]
        frame["to_offset"] = [o for _, o in placed]
        still = {w: size - left for left, w in windows.room}
        frame["to_used"] = [still.get(w) for w in frame["to_window"]]
        frame["to_task"] = frame["group"]
        return frame

    return run


def merge_open(opened: DataFrame, size: int, most: int) -> DataFrame:
    """Where each open window goes: ``(task, window) -> (level, to_task, to_window, to_offset)``."""
    level, moves = 0, None
    items = opened
    while True:
        level += 1
        moved = stage(
            items.withColumn("group", F.expr(f"task div {MERGE_FAN_IN}"))
            .groupBy("group")
            .applyInPandas(
                _merge_task(size, most),
                "task long, window long, used long, group long, to_window long, to_offset long, "
                "to_used long, to_task long",
            )
            .drop("group", "used"),
            "merge",
        )
        own = moved.select(
            "task",
            "window",
            F.lit(level).alias("level"),
            "to_task",
            "to_window",
            "to_offset",
            "to_used",
        )
        if moves is None:
            moves = own
        else:
            # What had been left open one level below is carried on by its new place.
            kept = moves.filter("to_used IS NULL")
            carried = (
                moves.filter("to_used IS NOT NULL")
                .alias("a")
                .join(
                    own.alias("b"),
                    (F.col("a.to_task") == F.col("b.task"))
                    & (F.col("a.to_window") == F.col("b.window")),
                )
                .select(
                    "a.task",
                    "a.window",
                    "b.level",
                    "b.to_task",
                    "b.to_window",
                    (F.col("a.to_offset") + F.col("b.to_offset")).alias("to_offset"),
                    "b.to_used",
                )
            )
            moves = stage(kept.unionByName(carried), "moves")
        if moved.select("to_task").distinct().limit(2).count() < 2:
            return moves
        items = (
            moved.filter("to_used IS NOT NULL")
            .select(
                F.col("to_task").alias("task"),
                F.col("to_window").alias("window"),
                F.col("to_used").cast("long").alias("used"),
            )
            .distinct()
        )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = 1024,
    open_windows: int = 64,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: its document, its place there, its sequence and its offset there.

    A null text counts as empty, so it gives the end id alone. Repeated rows are
    packed once each, under the same key. An empty table gives no rows. Only the key
    and the text are read. ``tokenizer`` is a file that all executors can read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    out = f"_key {kind}, {_PIECE}"
    arrow = to_arrow_schema(StructType.fromDDL(out))
    made = stage(
        rows.mapInArrow(_pack_task(tokenizer, size, open_windows, end_id, arrow), out), "pieces"
    )
    opened = made.filter("used IS NOT NULL").select("task", "window", "used")
    moves = merge_open(opened, size, open_windows)
    pieces = made.filter("used IS NULL").drop("used")
    placed = pieces.join(moves.drop("to_used"), ["task", "window"], "left")
    # One number per sequence: level, task and window have bits of their own.
    number = (
        F.coalesce("level", F.lit(0)).cast("long") * (1 << 58)
        + F.coalesce("to_task", "task") * (1 << 32)
        + F.coalesce("to_window", "window")
    )
    return placed.select(
        F.col("_key").alias(key),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        number.alias("sequence_id"),
        (F.coalesce("to_offset", F.lit(0)) + F.col("offset")).alias("offset"),
    )
