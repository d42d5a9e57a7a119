"""How the terms of each source differ from those of its language and of the other sources.

Which terms of a language occur in enough documents is found by iceberg prefix refinement:
the first bytes of all terms are counted by distinct documents, prefixes below the
threshold are discarded, the others are extended to the next width, and so on until only
complete terms are left. A document lies in one piece of one task, so distinct documents
of a prefix add up over pieces; only sums are shuffled, and the strings of rare terms
hardly ever. What is kept of a level reaches the next one as a bitmap of a bounded size; a
prefix that it lets through by mistake is counted exactly and discarded a level later.

Occurrences are then counted for the kept terms by source. Sums over all kept terms for
pairs of sources come from dense blocks of sources and buckets of terms; no pair of
sources is ever written for a single term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm import arrays, terms
from textloom.plans.joins import join_measured
from textloom.session import stage

#: Documents of a language that a kept term occurs in, at least.
LEAST_DOCS = 3
#: Widths of the prefixes in bytes; the last one goes on growing by the factor.
WIDTHS = (8, 24)
WIDER = 16
#: Bytes of text handled at once.
PIECE_BYTES = 5 << 20
#: Rows of sums that a task gathers from its pieces, about, before it gives them out.
HELD_ROWS = 5 << 17
#: Bits of the bitmap that tells which prefixes go on: so many for each, up to a bound, in
#: blocks of bits set together.
PREFIX_BITS = 16
BITMAP_BITS = 1 << 27
BITMAP_BLOCK = 1 << 20
#: Sources in a block, and terms in a bucket, about.
SOURCE_BLOCK = 64
BUCKET_TERMS = 1 << 15
#: Ranks of the terms of a group.
TOP_TERMS = 200
#: Probabilities are counted in parts of this.
SCALE = 1_000_000_000

_IS_TERM = np.zeros(256, bool)
_IS_TERM[65:91] = _IS_TERM[97:123] = _IS_TERM[128:] = True
_BYTES = terms.byte_map(_IS_TERM)
_WHOLE = pa.array([False, True])
#: Counts below this give a product with SCALE that a long holds.
_FITTING = (2**63 - 1) // SCALE


# ------------------------------------------------------------- kept terms


def _bits_of(lang: np.ndarray, name: np.ndarray, size: int) -> np.ndarray:
    """Bit of each (hash of language, hash of prefix) among ``size`` bits."""
    key = arrays.mix(lang + arrays.mix(name))
    return (key % np.uint64(size)).astype(np.int64)


def _distinct(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, all below ``most``, and the place of each key among them."""
    if most > 4 * len(key) + PIECE_BYTES:
        return np.unique(key, return_inverse=True)
    mark = np.zeros(most, bool)
    mark[key] = True
    return np.flatnonzero(mark), (np.cumsum(mark, dtype=np.int32)[key] - 1).astype(np.int64)


class _Piece:
    """Row and (language, term) of every word of some texts, and the distinct (language, term).

    Only terms of more than ``longer`` bytes take part.
    """

    def __init__(
        self, batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, bounds: np.ndarray, longer: int = 0
    ) -> None:
        words = terms.split(data, bounds, _BYTES, longer)
        lang = batch.column(1).slice(i, j - i).dictionary_encode()
        self.langs, row_lang = lang.dictionary, lang.indices.to_numpy(zero_copy_only=False)
        self.names, self.row = words.names.cast(pa.large_binary()), words.row
        n = max(len(self.names), 1)
        both, self.which = _distinct(row_lang.astype(np.int64)[words.row] * n + words.code, len(self.langs) * n)
        self.lang, self.term = both // n, both % n
        self.size = pc.binary_length(self.names).to_numpy(zero_copy_only=False).astype(np.int64)[self.term]

    def passing(self, width: int | None, bitmap: np.ndarray) -> np.ndarray:
        """Which (language, term) have their first bytes (all of them: None) marked."""
        cut = self.names if width is None else pc.binary_slice(self.names, 0, width)
        lang = terms.string_hash(self.langs.cast(pa.large_binary()))
        bit = _bits_of(lang[self.lang], terms.string_hash(cut)[self.term], 8 * len(bitmap))
        return ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


class _Sums:
    """Sums of rows (language, name, kind) over consecutive pieces of a task."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.names: list[pa.Array] = []
        self.langs: dict[str, int] = {}
        self.kinds: dict[str | bool, int] = {}
        self.held = self.known = 0

    def add(
        self, langs: pa.Array, lang: np.ndarray, names: pa.Array, name: np.ndarray,
        kinds: pa.Array, kind: np.ndarray, value: np.ndarray,
    ) -> None:
        """Rows as places in three arrays of distinct values, and what they add."""
        places = []
        for known, own, at in ((self.langs, langs, lang), (self.kinds, kinds, kind)):
            places.append(np.array([known.setdefault(x, len(known)) for x in own.to_pylist()], np.int32)[at])
        used, name = _distinct(name, len(names))
        self.parts.append((places[0], (name + self.known).astype(np.int32), places[1], value))
        self.names.append(names.take(pa.array(used)))
        self.held, self.known = self.held + len(value), self.known + len(used)

    def total(self) -> tuple[pa.Array, pa.Array, np.ndarray, pa.Array, np.ndarray]:
        """Language and name of each pair in order; the pair, kind and sum of each row, by pair. The rows are let go."""
        lang, name, kind, value = (np.concatenate(x) for x in zip(*self.parts))
        names = pa.concat_arrays(self.names).dictionary_encode()
        self.parts, self.names = [], []
        n, kinds = max(len(names.dictionary), 1), max(len(self.kinds), 1)
        name = names.indices.to_numpy(zero_copy_only=False)[name]
        pair, place = _distinct(lang.astype(np.int64) * n + name, len(self.langs) * n)
        row, place = _distinct(place * kinds + kind, len(pair) * kinds)
        sums = np.bincount(place, value, len(row)).astype(np.int64)
        return (
            pa.array(list(self.langs), pa.string()).take(pa.array(pair // n)), names.dictionary.take(pa.array(pair % n)),
            row // kinds, pa.array(list(self.kinds)).take(pa.array(row % kinds)), sums,
        )


def _summed(add: Callable[..., None], put: Callable[[_Sums], pa.RecordBatch]):
    """A task that gives out what ``put`` makes of the sums to which ``add`` adds each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for piece in arrays.work(batch.column(0), PIECE_BYTES):
                add(sums, batch, *piece)
                if sums.held >= HELD_ROWS:
                    yield put(sums)
                    sums = _Sums()
        if sums.held:
            yield put(sums)

    return run


def _level_task(width: int, before: int, bitmap: Broadcast | None, schema: pa.Schema):
    """Documents of every prefix of ``width`` bytes whose shorter prefix is still in."""

    def put(sums: _Sums) -> pa.RecordBatch:
        langs, names, pair, complete, docs = sums.total()
        pair = pa.array(pair)
        columns = [langs.take(pair), names.take(pair), complete, pa.array(docs)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def add(sums: _Sums, batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, bounds: np.ndarray) -> None:
        piece = _Piece(batch, i, j, data, bounds, before)
        cut = pc.binary_slice(piece.names, 0, width).dictionary_encode()
        prefix = cut.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(len(cut.dictionary), 1)
        # A complete term is told from the prefix of a longer one.
        key = ((piece.lang * n + prefix[piece.term]) << 1) | (piece.size <= width)
        key, which = _distinct(key, 2 * n * len(piece.langs))
        row, which = piece.row, which[piece.which]
        if bitmap is not None:
            going = piece.passing(before, bitmap.value)[piece.which]
            row, which = row[going], which[going]
        shift = len(key).bit_length()
        met = np.sort((row << shift) | which)
        met = met[np.append(True, met[1:] != met[:-1])] if len(met) else met
        docs = np.bincount(met & ((1 << shift) - 1), minlength=len(key))
        key, docs = key[docs > 0], docs[docs > 0]
        if len(key):
            sums.add(piece.langs, (key >> 1) // n, cut.dictionary, (key >> 1) % n, _WHOLE, key & 1, docs)

    return _summed(add, put)


def _bit_task(size: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, key = (batch.column(c).cast(pa.large_binary()) for c in (0, 1))
            bit = _bits_of(terms.string_hash(lang), terms.string_hash(key), size)
            columns = [pa.array(bit // BITMAP_BLOCK, pa.int32()), pa.array(bit % BITMAP_BLOCK, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _bitmap_task(schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        bits = np.zeros(BITMAP_BLOCK, bool)
        bits[group["bit"].to_numpy()] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table([pa.array([group["block"][0].as_py()], pa.int32()), pa.array([packed], pa.binary())], schema=schema)

    return run


def _bitmap(keys: DataFrame) -> Broadcast:
    """The bits of ``(lang, key)`` rows, sent to all tasks: BITMAP_BITS at most at any number of rows."""
    bits, blocks = StructType.fromDDL("block int, bit int"), StructType.fromDDL("block int, bits binary")
    many = min(BITMAP_BITS, PREFIX_BITS * keys.count())
    many = max(1, -(-many // BITMAP_BLOCK)) * BITMAP_BLOCK
    found = keys.select("lang", "key").mapInArrow(_bit_task(many, to_arrow_schema(bits)), bits).distinct()
    out = np.zeros(many // 8, np.uint8)
    size = BITMAP_BLOCK // 8
    for r in found.groupBy("block").applyInArrow(_bitmap_task(to_arrow_schema(blocks)), blocks).collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``(lang, term)``: the terms that occur in at least ``least`` documents of the language.

    ``docs`` has the columns ``text`` and ``lang``, without nulls.
    """
    schema = StructType.fromDDL("lang string, key binary, complete boolean, docs long")
    rows = docs.select("text", "lang")
    kept, before, bitmap, level = None, 0, None, 0
    while True:
        width = widths[level] if level < len(widths) else before * WIDER
        counted = rows.mapInArrow(_level_task(width, before, bitmap, to_arrow_schema(schema)), schema)
        sums = counted.groupBy("lang", "key", "complete").agg(F.sum("docs").alias("docs"))
        found = stage(sums.filter(F.col("docs") >= least).drop("docs"), "prefixes")
        whole = found.filter("complete").select("lang", F.col("key").cast("string").alias("term"))
        kept = whole if kept is None else kept.unionByName(whole)
        longer = found.filter("NOT complete")
        if not longer.limit(1).count():
            return kept
        bitmap, before, level = _bitmap(longer), width, level + 1


# ------------------------------------------------------------------ counts


def _count_task(bitmap: Broadcast, schema: pa.Schema):
    """Sources and occurrences of every (language, term) of some pieces whose bit is set."""

    def put(sums: _Sums) -> pa.RecordBatch:
        langs, names, pair, source, times = sums.total()
        cut = pa.array(np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair)).astype(np.int32))
        columns = [
            langs, names.cast(pa.large_string()),
            pa.ListArray.from_arrays(cut, source.cast(pa.string())), pa.ListArray.from_arrays(cut, pa.array(times)),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def add(sums: _Sums, batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, bounds: np.ndarray) -> None:
        piece = _Piece(batch, i, j, data, bounds)
        source = batch.column(2).slice(i, j - i).dictionary_encode()
        own = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(len(source.dictionary), 1)
        going = piece.passing(None, bitmap.value)[piece.which]
        entry, at = _distinct(piece.which[going] * n + own[piece.row[going]], len(piece.term) * n)
        if len(entry):
            both, times = entry // n, np.bincount(at, minlength=len(entry))
            sums.add(piece.langs, piece.lang[both], piece.names, piece.term[both], source.dictionary, entry % n, times)

    return _summed(add, put)


def term_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, term, source, n, all)``: occurrences of kept terms in each source, and in the language."""
    schema = StructType.fromDDL("lang string, term string, source array<string>, n array<long>")
    task = _count_task(_bitmap(kept.withColumnRenamed("term", "key")), to_arrow_schema(schema))
    parts = docs.select("text", "lang", "source").mapInArrow(task, schema)
    # Both sides are dealt by (term, lang), and so are the sums and totals that follow. The
    # kept terms of a partition are far fewer than the counts, which need no order to meet them.
    found = parts.join(kept.hint("shuffle_hash"), ["term", "lang"], "left_semi")
    entries = found.select("lang", "term", "n", F.posexplode("source").alias("k", "source"))
    sums = entries.withColumn("n", F.expr("n[k]")).groupBy("term", "lang", "source").agg(F.sum("n").alias("n"))
    # Terms first: rows are sorted by the first bytes of what stands first.
    total = F.sum("n").over(Window.partitionBy("term", "lang"))
    return sums.select("lang", "term", "source", "n", total.alias("all"))


def _parts(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact: in decimals where a long does not hold the product."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    wide = F.call_function("div", top, total.cast("decimal(20,0)"))
    short = F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total)
    return F.when(count < _FITTING, short).otherwise(wide) + 1


def _pair_task(schema: pa.Schema):
    """Sums over the terms of a bucket for all pairs of sources of two blocks.

    The second table holds the sources of both blocks, with the part that each gives a term
    that it does not have. Parts are at most 10 ** 9 + 1, so squares fit a long.
    """

    def run(rows: pa.Table, sources: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        first, second = rows["first"][0].as_py(), rows["second"][0].as_py()
        by = np.argsort(sources["at"].to_numpy())
        index, zero = (sources[c].to_numpy()[by] for c in ("at", "zero"))
        a, b = (np.flatnonzero(index // SOURCE_BLOCK == x) for x in (first, second))
        code = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order, size = np.argsort(code, kind="stable"), np.bincount(code)
        at, part = (rows[c].to_numpy()[order] for c in ("place", "part"))
        place, end = np.searchsorted(index, at), np.concatenate([[0], np.cumsum(size)])
        ways = [(a, b)] if first == second else [(a, b), (b, a)]
        totals = [np.zeros((len(x), len(y)), np.int64) for x, y in ways]
        for low in range(0, len(size), 1024):
            high = min(low + 1024, len(size))
            inside = slice(end[low], end[high])
            dense = np.tile(zero, (high - low, 1))
            dense[np.repeat(np.arange(high - low), size[low:high]), place[inside]] = part[inside]
            for (x, y), total in zip(ways, totals):
                q = dense[:, y]
                for k, own in enumerate(x):
                    gap = dense[:, own, None] - q
                    total[k] += (gap * gap // q).sum(axis=0)
        own = np.concatenate([np.repeat(index[x], len(y)) for x, y in ways])
        other = np.concatenate([np.tile(index[y], len(x)) for x, y in ways])
        columns = [
            pa.repeat(rows["lang"][0], len(own)), pa.array(own), pa.array(other),
            pa.array(np.concatenate([t.ravel() for t in totals])), pa.repeat(len(size), len(own)),
        ]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, own, other, total, terms)``: sums over those terms that meet the blocks of both.

    An entry of a term goes to each pair of blocks with its own, so a term that meets a pair
    is there with its entries in both.
    """
    block = f"CAST(floor(at / {SOURCE_BLOCK}) AS INT)"
    placed = join_measured(counts, groups.select("lang", "source", "at", "total", "blocks"), ["lang", "source"])
    buckets = max(1, -(-counts.count() // BUCKET_TERMS))
    dealt = placed.select(
        "lang", "term", F.col("at").alias("place"), _parts(F.col("n"), F.col("total")).alias("part"), F.expr(block).alias("m"),
        F.expr(f"pmod(xxhash64(term), {buckets})").alias("bucket"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("o"),
    ).select("lang", "term", "place", "part", "bucket", F.least("m", "o").alias("first"), F.greatest("m", "o").alias("second"))
    partners = groups.filter("kept > 0").select(
        "lang", "at", "zero", F.expr(block).alias("block"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("o")
    )
    sources = partners.select(
        "lang", "at", "zero", F.least("block", "o").alias("first"), F.greatest("block", "o").alias("second"),
        F.explode(F.expr(f"sequence(0L, {buckets - 1}L)")).alias("bucket"),
    )
    schema = StructType.fromDDL("lang string, own long, other long, total long, terms long")
    keys = ["bucket", "first", "second", "lang"]
    sums = dealt.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInArrow(_pair_task(to_arrow_schema(schema)), schema)
    return sums.groupBy("lang", "own", "other").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms"))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(
    docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, widths: tuple[int, ...] = WIDTHS
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (lang, source) that occurs.

    Null texts, languages and sources count as empty ones. With c occurrences of a kept term
    in a group, N of all kept terms there, and V kept terms in the language, p = 1 +
    floor(10 ** 9 (c + 1) / (N + V)), and two groups differ in a term by floor((p - q) ** 2 / q).
    Part ``pair``: every other source of the language, and the sum over its kept terms (0
    if it has none). Part ``term``: the kept terms that the group has more of than its
    language, up to rank ``top``. Ranks go by value from the highest, then by the bytes of the
    item. Repeated rows are documents of their own; other columns are not read; an empty
    table gives an empty one.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = stage(kept_terms(rows, least, widths), "kept-terms")
    counts = stage(term_counts(rows, kept), "term-counts")
    in_lang = Window.partitionBy("lang")
    groups = (
        rows.select("lang", "source").distinct()
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        .join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
        .fillna(0, ["n", "kept"])
        .select(
            "lang", "source", "kept", (F.col("n") + F.col("kept")).alias("total"),
            (F.sum("n").over(in_lang) + F.col("kept")).alias("lang_total"),
            (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("at"),
            F.ceil(F.count("*").over(in_lang) / SOURCE_BLOCK).cast("int").alias("blocks"),
        )
        .withColumn("zero", F.when(F.col("kept") > 0, _parts(F.lit(0), F.col("total"))))
    )
    groups = stage(groups, "groups")

    both = ["lang", "source"]
    compared = join_measured(counts, groups.select(*both, "total", "lang_total"), both).select(
        *both, F.lit("term").alias("part"), F.col("term").alias("item"),
        _parts(F.col("n"), F.col("total")).alias("p"), _parts(F.col("all"), F.col("lang_total")).alias("q"),
    )
    found = compared.filter("p > q").withColumn("value", _divergence(F.col("p"), F.col("q"))).drop("p", "q")
    order = [F.desc("value"), F.col("item")]
    # A number in front decides most comparisons of the sort.
    in_group = Window.partitionBy(F.xxhash64(*both), *both).orderBy(*order)
    by_term = found.withColumn("rank", F.row_number().over(in_group)).filter(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("other"), F.col("zero").alias("q"))
    pairs = groups.withColumnRenamed("at", "own").join(other, "lang").filter("own <> other")
    rest = (F.col("kept") - F.coalesce("terms", F.lit(0))) * _divergence(F.col("zero"), F.col("q"))
    value = F.when(F.col("kept") > 0, F.coalesce("sum", F.lit(0)) + rest).otherwise(0).cast("long")
    sums = _pair_sums(counts, groups).withColumnRenamed("total", "sum")
    by_pair = pairs.join(sums, ["lang", "own", "other"], "left").select(
        *both, F.lit("pair").alias("part"), "item", value.alias("value")
    )
    return by_pair.withColumn("rank", F.row_number().over(Window.partitionBy(*both).orderBy(*order))).unionByName(by_term)
