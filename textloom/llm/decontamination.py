"""Benchmark decontamination with an FM-index per shard of the training texts.

Windows of consecutive benchmark words are the phrases. A shard (a few megabytes of
texts in a task) keeps the runs of words that all occur in the benchmark and are long
enough to hold a phrase, indexes them as symbols, and searches all phrases backwards at
once through the ranks of a wavelet tree. Occurrences are located by sampled suffix
positions and merged into removal spans. Nothing is shuffled but the phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm import arrays
from textloom.llm.suffixes import FMIndex
from textloom.session import stage

#: Words of a window.
WINDOW = 10
#: Distinct windows that are sent to the tasks together; more windows take more passes.
BLOCK_WINDOWS = 1 << 17

#: Bytes of texts in a shard, about; its index is built and searched at once.
SHARD_BYTES = 1 << 20

#: Digits, a-z and all bytes of characters beyond ASCII; A-Z is lowered first.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


@dataclass
class Phrases:
    """Distinct windows: symbols from the last word backwards, sizes, and the items that hold each."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    sizes: np.ndarray
    items: list[list[str]]


def _hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, words of each text, and hashes; hashing goes piece by piece."""
    found = []
    for i, j in arrays.spans(bounds):
        piece = arrays.lower(data[bounds[i] : bounds[j]])
        starts, ends, count = arrays.words(piece, bounds[i : j + 1] - bounds[i], _WORD)
        hashes = arrays.range_hash(arrays.prefix_hash(piece), starts, ends)
        found.append((starts + bounds[i], ends + bounds[i], count, hashes))
    none = np.zeros(0, np.int64)
    found = found or [(none, none, none, none.view(np.uint64))]
    return tuple(np.concatenate(x) for x in zip(*found))


def _window_task(size: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in arrays.work(batch.column(1)):
                _, _, count, word = _hashed_words(data, bounds)
                first = np.cumsum(count) - count
                many = np.where(count >= size, count - size + 1, (count > 0).astype(int))
                item = np.repeat(np.arange(j - i), many)
                at = first[item] + np.arange(len(item)) - (np.cumsum(many) - many)[item]
                long = np.minimum(count, size)[item]
                rows = [word[a : a + n].astype("<u8").tobytes() for a, n in zip(at, long)]
                ids = batch.column(0).take(pa.array(i + item))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.binary())], schema=schema)

    return run


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(words, items)``: every distinct window of the benchmark and the items that hold it.

    An item of fewer words than a window is one window. Items with a null text, or without
    words, have none. The windows of an item without an id count like others, but no list names it.
    """
    schema = StructType.fromDDL("item string, words binary")
    rows = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")
    ).filter("text IS NOT NULL")
    found = rows.mapInArrow(_window_task(size, to_arrow_schema(schema)), schema)
    return found.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _phrases(rows: list) -> Phrases:
    words = [np.frombuffer(r["words"], "<u8") for r in rows]
    sizes = np.array([len(w) for w in words], np.int64)
    vocabulary = np.unique(np.concatenate([*words, np.zeros(0, "<u8")]))
    symbols = np.zeros((len(words), int(sizes.max(initial=0))), np.int64)
    for row, w in zip(symbols, words):
        row[: len(w)] = np.searchsorted(vocabulary, w[::-1]) + 1
    return Phrases(vocabulary, symbols, sizes, [list(r["items"]) for r in rows])


def occurrences(word: np.ndarray, count: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence in a shard's words; none crosses a text."""
    none = np.zeros(0, np.int64)
    if not len(word) or not len(phrases.sizes):
        return none, none
    place = np.minimum(np.searchsorted(phrases.vocabulary, word), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[place] == word, place + 1, 0)
    # Maximal runs of known words in one text, of the length of the shortest phrase at least.
    known = symbol > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    edges = (np.cumsum(count) - count)[count > 0]
    begins[edges] = known[edges]
    run = np.cumsum(begins) - 1
    long = np.bincount(run[known], minlength=1) >= phrases.sizes.min()
    kept = np.flatnonzero(known)
    kept = kept[long[run[kept]]]
    if not len(kept):
        return none, none
    owner = run[kept]
    fresh = np.ones(len(kept), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    at = np.arange(len(kept)) + np.cumsum(fresh)  # a separator before each run
    symbols = np.zeros(len(kept) + int(fresh.sum()) + 1, np.int64)
    symbols[at] = symbol[kept]
    back = np.full(len(symbols), -1, np.int64)
    back[at] = kept
    index = FMIndex(symbols)
    phrase, low, high = index.search(phrases.symbols, phrases.sizes)
    many = high - low
    phrase = np.repeat(phrase, many)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return phrase, back[index.locate(rows)]


def _hit_task(phrases, schema: pa.Schema, cut: bool):
    """Adds to each text's hit words (as byte ranges), their number, and the items found.

    With ``cut``, the text comes out without those ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = phrases.value
        for batch in batches:
            names = batch.schema.names
            for i, j, data, bounds in arrays.work(batch.column(names.index("_text")), SHARD_BYTES):
                shard = batch.slice(i, j - i)
                done = _shard_hits(shard, data, bounds, sought)
                if cut:
                    texts = zip(shard.column(names.index("_text")), done["_ranges"])
                    done["_text"] = pa.array(
                        [_cut(t.as_py(), r.as_py()) if r.is_valid else t.as_py() for t, r in texts],
                        pa.string(),
                    )
                # One shard at a time, so that a task holds little besides its input batch.
                yield pa.RecordBatch.from_arrays(
                    [
                        done[f.name] if f.name in done else shard.column(names.index(f.name)).cast(f.type)
                        for f in schema
                    ],
                    schema=schema,
                )

    return run


def _shard_hits(
    shard: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, sought: Phrases
) -> dict[str, pa.Array]:
    """The result columns of one shard, what earlier blocks of phrases found included."""
    names = shard.schema.names
    old_ranges, old_items = (shard.column(names.index(c)) for c in ("_ranges", "_items"))
    starts, ends, count, word = _hashed_words(data, bounds)
    phrase, at = occurrences(word, count, sought)
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + sought.sizes[phrase], -1)
    hit = np.cumsum(change[:-1]) > 0
    last = np.cumsum(count)
    text = np.searchsorted(last, at, "right")
    pairs = np.unique(text * len(sought.sizes) + phrase) if len(at) else at
    in_text: dict[int, set[str]] = {}
    for pair in pairs.tolist():
        row, p = divmod(pair, len(sought.sizes))
        in_text.setdefault(row, set()).update(sought.items[p])
    hits, ranges, items = [], [], []
    for row in range(shard.num_rows):
        old, a, b = old_ranges[row].as_py(), last[row] - count[row], last[row]
        marked = hit[a:b]
        if old:
            before = np.frombuffer(old, "<i8").reshape(-1, 2)
            inside = starts[a:b] - bounds[row]
            k = np.searchsorted(before[:, 0], inside, "right") - 1
            marked = marked | ((k >= 0) & (inside < before[np.maximum(k, 0), 1]))
        hits.append(int(marked.sum()))
        ranges.append(_merged(starts[a:b], ends[a:b], marked, int(bounds[row])))
        items.append(sorted(set(old_items[row].as_py() or ()) | in_text.get(row, set())))
    return {
        "_words": pa.array(count, pa.int64()),
        "_hit": pa.array(hits, pa.int64()),
        "_ranges": pa.array(ranges, pa.binary()),
        "_items": pa.array(items, pa.list_(pa.string())),
    }


def _merged(starts: np.ndarray, ends: np.ndarray, marked: np.ndarray, origin: int) -> bytes | None:
    """Byte ranges of maximal runs of marked words, the gaps between their words included."""
    if not marked.any():
        return None
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return (np.column_stack([starts[first], ends[last]]) - origin).astype("<i8").tobytes()


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    key: str | list[str] = "doc_id",
    text: str = "text",
    block: int = BLOCK_WINDOWS,
    cut: bool = False,
) -> DataFrame:
    """The ``key`` columns (as ``_c0``, ``_c1``, ...) and what the text shares with the benchmark.

    ``_words`` and ``_hit`` count words, ``_items`` lists the items with a window in the
    text (sorted as strings), ``_ranges`` holds the removal spans as pairs of byte
    offsets; with ``cut``, ``_text`` is the text without them. A null text has no words
    and stays null; an empty benchmark hits nothing; repeated rows stay. Other columns are
    not read. Windows are sent in blocks of a bounded size, one pass over the texts for each;
    between passes the texts are staged, so a task holds one block at a time.
    """
    windows = stage(benchmark_windows(benchmark, size), "windows")
    blocks = max(1, -(-windows.count() // block))
    out = docs.select(
        *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate([key] if isinstance(key, str) else key)),
        F.col(f"`{text}`").cast("string").alias("_text"),
        F.lit(None).cast("long").alias("_words"),
        F.lit(None).cast("long").alias("_hit"),
        F.lit(None).cast("binary").alias("_ranges"),
        F.lit(None).cast("array<string>").alias("_items"),
    )
    for b in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        sent = docs.sparkSession.sparkContext.broadcast(_phrases(part))
        last = b == blocks - 1
        fields = [f for f in out.schema if f.name != "_text" or cut or not last]
        schema = StructType(fields)
        out = out.mapInArrow(_hit_task(sent, to_arrow_schema(schema), cut and last), schema)
        if not last:
            out = stage(out, "hits")
    return out


def _cut(text: str, ranges: bytes) -> str:
    data, out, at = text.encode(), [], 0
    for a, b in np.frombuffer(ranges, "<i8").reshape(-1, 2):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def remove_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents with every removal span cut out of the text; other texts stay as they are."""
    others = [c for c in docs.columns if c != text]
    found = find_hits(docs, benchmark, size, others, text, cut=True)
    named = {c: F.col(f"_c{i}") for i, c in enumerate(others)} | {text: F.col("_text")}
    return found.select(*(named[c].alias(c) for c in docs.columns))
