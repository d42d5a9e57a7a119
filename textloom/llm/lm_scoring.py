"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count c is kept as its level: the number of thresholds, growing by a constant factor,
that do not exceed c. An n-gram of level q is entered q times, as (n-gram, 1) to
(n-gram, q), and its level is read back by asking for (n-gram, 1), (n-gram, 2), ... until
one is missing; a wrong answer can only be too high, and each step more is rarer by the
same factor. The filter is made of blocks that tasks build in parallel, each with as many
bits as its entries need, and is sent to the workers in segments of a bounded size.

A word after another gets the Dirichlet-smoothed estimate (c(v w) + S p(w)) / (c(v) + S), where
p(w) is the additive estimate of single words, all counts read from the filter. One end
follows the words of each text; it also stands in front of the first one.

Besides, every text gets the exact score of single words. The most frequent words, as
many as fit a fixed number of bytes, are sent to the tasks with their counts; what is left
of a text, a few words in a hundred, is joined with the table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm import arrays, terms
from textloom.session import drop, stage

#: Added to each count of a single word.
ADDED = 0.1
#: Weight of single words against what followed the word before.
STRENGTH = 16.0
#: Growth of the thresholds between levels, and questions asked for one entry.
GROWTH = 1.5
PROBES = 4
#: Bytes of text handled at once; segments are swept once for each such piece.
PIECE_BYTES = 2 << 20
#: n-grams that a task gathers before it sends their counts on.
GATHERED = 1 << 20
#: n-grams of one block, about: what the tasks of the count send for it.
BLOCK_GRAMS = 1 << 20
#: Bytes of a segment, and segments that a worker keeps open.
SEGMENT_BYTES = 12 << 20
OPEN_SEGMENTS = 3
#: Bytes of the frequent words sent to all tasks, with their counts.
FREQUENT_BYTES = 16 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_BYTES = terms.byte_map(_IS_WORD)
_END = np.uint64(0x6A09E667F3BCC909)
_PAIR = np.uint64(0xBB67AE8584CAA73B)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keys have 48 bits.
_SPARE = np.uint64(16)


def thresholds(growth: float = GROWTH) -> np.ndarray:
    """Least counts of the levels, from 1 up to 2 ** 60."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, np.int64)


def estimates(least: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for level 0."""
    middle = (least[:-1] + least[1:] - 1) / 2
    return np.concatenate([[0.0], middle, [float(least[-1])]])


@dataclass
class Texts:
    """Tokens of a piece: codes of words, ends included (code ``len(names)``), and their pairs."""

    words: terms.Words
    token: np.ndarray
    row: np.ndarray
    hashes: np.ndarray  # of the distinct words, the end last

    def keys(self) -> np.ndarray:
        return self.hashes >> _SPARE

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word before and word of every distinct pair, and the pair of each token."""
        n = len(self.hashes)
        before = np.empty_like(self.token)
        before[:1], before[1:] = n - 1, self.token[:-1]
        distinct, which = np.unique(before * n + self.token, return_inverse=True)
        return distinct // n, distinct % n, which

    def pair_keys(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        return arrays.mix(self.hashes[before] * _PAIR + self.hashes[word]) >> _SPARE


def _texts(data: np.ndarray, bounds: np.ndarray) -> Texts:
    words = terms.split(data, bounds, _BYTES)
    n = len(bounds) - 1
    many = np.bincount(words.row, minlength=n)
    end = np.cumsum(many) + np.arange(n)
    is_end = np.zeros(len(words.code) + n, bool)
    is_end[end] = True
    token = np.full(len(is_end), len(words.names), np.int64)
    token[~is_end] = words.code
    hashes = np.append(arrays.mix(terms.string_hash(words.names)), _END)
    return Texts(words, token, np.repeat(np.arange(n), many + 1), hashes)


# ------------------------------------------------------------------ counting


def _count_task(schema: pa.Schema):
    """Distinct words of each piece with their counts; the end is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in arrays.work(batch.column(0), PIECE_BYTES):
                words = terms.split(data, bounds, _BYTES)
                count = np.bincount(words.code, minlength=len(words.names))
                names = pa.concat_arrays([words.names.cast(pa.string()), pa.nulls(1, pa.string())])
                counts = pa.array(np.append(count, j - i), pa.int64())
                yield pa.RecordBatch.from_arrays([names, counts], schema=schema)

    return run


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over the one column of texts; the row whose word is null counts the ends."""
    schema = StructType.fromDDL("word string, n long")
    parts = texts.mapInArrow(_count_task(to_arrow_schema(schema)), schema)
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a key; it never falls as keys rise."""
    return ((key >> np.uint64(16)) * np.uint64(blocks)) >> np.uint64(32)


def _gram_task(blocks: int, schema: pa.Schema):
    """Sorted keys of words and pairs with their counts, one row for each block they meet.

    A key takes six bytes and a count one; a higher count is dealt out over several entries.
    """

    def packed(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, count = _summed(np.concatenate(keys), np.concatenate(counts))
        times = -(-count // 255)
        key, count = np.repeat(key, times), np.repeat(count, times)
        share = np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times)
        count = np.minimum(count - 255 * share, 255).astype(np.uint8)
        cut = np.searchsorted(_block_of(key, blocks), np.arange(blocks + 1))
        met = np.flatnonzero(np.diff(cut))
        short = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows = [
            pa.array(met, pa.int32()),
            pa.array([short[cut[b] : cut[b + 1]].tobytes() for b in met], pa.binary()),
            pa.array([count[cut[b] : cut[b + 1]].tobytes() for b in met], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, _, data, bounds in arrays.work(batch.column(0), PIECE_BYTES):
                texts = _texts(data, bounds)
                before, word, which = texts.pairs()
                keys += [texts.keys(), texts.pair_keys(before, word)]
                counts += [np.bincount(texts.token, minlength=len(texts.hashes)), np.bincount(which)]
                held += len(keys[-1]) + len(keys[-2])
                if held >= GATHERED:
                    yield packed(keys, counts)
                    keys, counts, held = [], [], 0
        if keys:
            yield packed(keys, counts)

    return run


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, count = key[order], count[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    return key[first], np.add.reduceat(count, first) if len(first) else count


# -------------------------------------------------------------------- filter


def _places(key: np.ndarray, level: int, bits: np.ndarray | np.uint64, probes: int) -> Iterator[np.ndarray]:
    """Bits that belong to (key, level), one array for each question."""
    at = arrays.mix(key + np.full(1, level, np.uint64) * _STEP)
    step = arrays.mix(at + _PAIR) | np.uint64(1)
    for _ in range(probes):
        yield at % bits
        at = at + step


def build_block(key: np.ndarray, count: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """The bits of a block, as bytes; half of them are set."""
    level = np.searchsorted(thresholds(), count, "right")
    entries = int(level.sum())
    size = max(64, -(-int(entries * probes / np.log(2)) // 64) * 64)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in _places(key[level >= q], q, np.uint64(size), probes):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def _block_task(probes: int, schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        short = np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(short), 8), np.uint8)
        wide[:, :6] = short
        key = wide.view("<u8").ravel().astype(np.uint64)
        count = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint8).astype(np.int64)
        bits = build_block(*_summed(key, count), probes)
        rows = [[group["block"][0].as_py()], [len(bits)], [bits.tobytes()]]
        return pa.table([pa.array(x, t) for x, t in zip(rows, schema.types)], schema=schema)

    return run


@dataclass
class Segment:
    """Consecutive blocks: the first one's number, where each begins, and their bytes."""

    first: int
    begins: np.ndarray
    data: np.ndarray
    probes: int

    def has(self, key: np.ndarray, block: np.ndarray, level: int) -> np.ndarray:
        """Whether all bits of (key, level) are set."""
        begin = self.begins[block - self.first]
        bits = ((self.begins[block - self.first + 1] - begin) * 8).astype(np.uint64)
        out = bits > 0  # a block without entries has no bits
        if not out.all():
            out[out] = self.has(key[out], block[out], level)
            return out
        for at in _places(key, level, bits, self.probes):
            byte = self.data[begin + (at >> np.uint64(3)).astype(np.int64)]
            out &= ((byte >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return out


@dataclass
class CountFilter:
    """Segments (each sent by itself) with their first blocks, and the number of blocks."""

    segments: list[Broadcast]
    firsts: list[int]
    blocks: int

    def levels(self, key: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Level of every key, no higher than ``most``.

        A worker goes through the segments one by one; beyond OPEN_SEGMENTS it lets each
        go again, so its memory does not grow with the filter.
        """
        order = np.argsort(key)
        block = _block_of(key[order], self.blocks).astype(np.int64)
        cuts = np.searchsorted(block, [*self.firsts, self.blocks])
        level = np.zeros(len(key), np.int64)
        for shared, a, b in zip(self.segments, cuts, cuts[1:]):
            if a == b:
                continue
            segment = shared.value
            going, where, q = order[a:b], block[a:b], 1
            while len(going):
                hit = np.ones(len(going), bool) if most is None else most[going] >= q
                hit[hit] = segment.has(key[going[hit]], where[hit], q)
                going, where = going[hit], where[hit]
                level[going] = q
                q += 1
            if len(self.segments) > OPEN_SEGMENTS:
                # The value is loaded again from the worker's local copy when it is next asked for.
                vars(shared).pop("_value", None)
        return level


def build_filter(
    texts: DataFrame, tokens: int, probes: int = PROBES, segment_bytes: int = SEGMENT_BYTES
) -> CountFilter:
    """Count words and pairs of the one column of texts, and enter them.

    Keys are spread over blocks by their own bits, so blocks are alike whatever the words
    are; each task sends at most one sum for a key and a block at a time.
    """
    spark = texts.sparkSession
    blocks = max(1, -(-2 * tokens // BLOCK_GRAMS))
    sums = StructType.fromDDL("block int, keys binary, counts binary")
    built = StructType.fromDDL("block int, size int, bits binary")
    parts = texts.mapInArrow(_gram_task(blocks, to_arrow_schema(sums)), sums)
    table = stage(parts.groupBy("block").applyInArrow(_block_task(probes, to_arrow_schema(built)), built), "filter")
    sizes = np.zeros(blocks, np.int64)
    for r in table.select("block", "size").toLocalIterator():
        sizes[r["block"]] = r["size"]
    segments, firsts, first = [], [], 0
    while first < blocks:
        upto = np.cumsum(sizes[first:])
        last = first + max(1, int(np.searchsorted(upto, segment_bytes, "right")))
        rows = table.filter(F.col("block").between(first, last - 1)).select("block", "bits").collect()
        begins = np.concatenate([[0], np.cumsum(sizes[first:last])])
        data = np.zeros(int(begins[-1]), np.uint8)
        for r in rows:
            at = begins[r["block"] - first]
            data[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        segments.append(spark.sparkContext.broadcast(Segment(first, begins, data, probes)))
        firsts.append(first)
        first = last
    drop(spark, table)
    return CountFilter(segments, firsts, blocks)


# ------------------------------------------------------------------- scoring


@dataclass
class Frequent:
    """Frequent words with their counts, and the count of ends; tasks sort them by hash."""

    names: pa.Array
    counts: np.ndarray
    ends: int
    hashes: np.ndarray | None = None

    def _sort(self) -> None:
        hashes = terms.string_hash(self.names)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], self.counts[order]
        self.names = self.names.take(pa.array(order))

    def find(self, names: pa.Array) -> np.ndarray:
        """Count of every name, -1 for those that are not here; strings decide, not hashes."""
        out = np.full(len(names), -1, np.int64)
        if self.hashes is None:
            self._sort()
        if not len(self.hashes) or not len(names):
            return out
        own = terms.string_hash(names)
        at = np.searchsorted(self.hashes, own)
        # Different words of one hash stand side by side.
        while True:
            open_ = np.flatnonzero((at < len(self.hashes)) & (out < 0))
            open_ = open_[self.hashes[at[open_]] == own[open_]]
            if not len(open_):
                return out
            same = pc.equal(names.take(pa.array(open_)).cast(pa.large_string()), self.names.take(pa.array(at[open_])))
            same = same.to_numpy(zero_copy_only=False)
            out[open_[same]] = self.counts[at[open_[same]]]
            at[open_[~same]] += 1


def frequent_words(counts: DataFrame, most: int = FREQUENT_BYTES) -> Frequent:
    """The most frequent words that take at most ``most`` bytes with their counts.

    Words are taken by classes of nearly equal counts, so that no sort is needed; a
    few hundred sums tell how many classes fit.
    """
    size = F.octet_length("word") + 24
    rank = F.floor(F.log2("n") * 16).cast("int").alias("rank")
    words = counts.filter("word IS NOT NULL")
    sums = words.groupBy(rank).agg(F.sum(size).alias("size")).orderBy(F.desc("rank")).collect()
    least, total = None, 0
    for r in sums:
        total += r["size"]
        if total > most:
            break
        least = r["rank"]
    ends = counts.filter("word IS NULL").first()
    ends = ends["n"] if ends else 0
    if least is None:
        return Frequent(pa.array([], pa.large_string()), np.zeros(0, np.int64), ends)
    rows = words.filter(rank >= least).toArrow()
    return Frequent(rows["word"].combine_chunks().cast(pa.large_string()), rows["n"].to_numpy(), ends)


def _score_task(model: CountFilter, frequent: Broadcast, total: int, distinct: int, schema: pa.Schema):
    """The columns handed through, then token counts, both scores, and words left to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = estimates(thresholds())
        room = total + ADDED * (distinct + 1)
        for batch in batches:
            for i, j, data, bounds in arrays.work(batch.column(0), PIECE_BYTES):
                n = j - i
                texts = _texts(data, bounds)
                exact = np.append(frequent.value.find(texts.words.names), frequent.value.ends)
                here = exact[texts.token] >= 0
                gain = np.log10((np.maximum(exact, 0) + ADDED) / room)[texts.token]
                known = here & (exact[texts.token] > 0)
                level = model.levels(texts.keys())
                before, word, which = texts.pairs()
                both = np.minimum(level[before], level[word])
                pair = value[model.levels(texts.pair_keys(before, word), both)]
                alone = (value[level] + ADDED) / room
                chance = np.log10((pair + STRENGTH * alone[word]) / (value[level[before]] + STRENGTH))
                sums = [
                    np.bincount(texts.row, minlength=n),
                    np.bincount(texts.row, known, n).astype(np.int64),
                    np.bincount(texts.row, np.where(here, gain, 0.0), n),
                    np.bincount(texts.row, chance[which], n),
                ]
                left = ~here
                names = len(texts.hashes)
                rest, many = np.unique(texts.row[left] * names + texts.token[left], return_counts=True)
                cut = np.searchsorted(rest // names, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(cut),
                    pa.StructArray.from_arrays(
                        [texts.words.names.take(pa.array(rest % names)).cast(pa.string()), pa.array(many, pa.int64())],
                        ["word", "times"],
                    ),
                )
                kept = batch.slice(i, n).columns[1:]
                columns = [*kept, *(pa.array(x) for x in sums), lists]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, schema)], schema=schema
                )

    return run


def score_texts(
    docs: DataFrame,
    learned: Column,
    key: str = "doc_id",
    text: str = "text",
    probes: int = PROBES,
    segment_bytes: int = SEGMENT_BYTES,
    frequent_bytes: int = FREQUENT_BYTES,
) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    The counts come from the rows where ``learned`` holds. ``n_known`` counts tokens that
    occur there; ``train_tokens`` is the number of all tokens there. A null text counts as
    empty, and an empty one is its end alone; null and repeated keys and repeated rows are
    rows like others; other columns are not read. With no row to learn from, nothing is
    known and every probability is one. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    named = F.col(f"`{text}`").cast("string").alias("text")
    train = docs.filter(learned).select(named)
    counts = stage(word_counts(train), "word-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"] if sums["n"] else 0
    frequent = spark.sparkContext.broadcast(frequent_words(counts, frequent_bytes))
    model = build_filter(train, total, probes, segment_bytes)
    rows = docs.select(named, F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("place"))
    schema = StructType(
        rows.schema.fields[1:]
        + StructType.fromDDL(
            "n_tokens long, n_known long, base double, score double, left array<struct<word string, times long>>"
        ).fields
    )
    task = _score_task(model, frequent, total, distinct, to_arrow_schema(schema))
    scored = stage(rows.mapInArrow(task, schema), "scores")
    room = F.lit(total + ADDED * (distinct + 1))
    there = F.coalesce("n", F.lit(0))
    rest = (
        scored.select("place", F.inline("left"))
        .join(counts, "word", "left")
        .groupBy("place")
        .agg(
            F.sum(F.when(there > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((there + ADDED) / room)).alias("more"),
        )
    )
    return scored.drop("left").join(rest, "place", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
