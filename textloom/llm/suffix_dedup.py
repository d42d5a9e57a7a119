"""Removal of long repeated byte strings with suffix arrays.

Two equal strings of 200 bytes have equal anchors (``anchors``), so an occurrence can
only be repeated within its anchor hash. Ranges of starts that share an anchor are the
units of work, and the work narrows step by step:

1. per distinct text, the anchor hash and the hash of the whole range (its context);
2. ranges whose context occurs twice are repeated as a whole; ranges alone with their
   anchor hash are unique; only ranges that share an anchor hash under different contexts
   need a closer look, and one range of each context stands for all;
3. the contexts of an anchor hash meet in one shard, which sorts their suffixes by
   Larsson-Sadakane refinement, takes common prefixes by Kasai's rule, and marks starts
   whose neighbours agree for 200 bytes;
4. an anchor hash with very many contexts is spread over several shards, and their sorted
   lists of strings are merged by binary search.

Copies of a text are one text with a count. No step gathers a whole hash or text group
into one task, and texts without a repeated anchor are read but never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm import arrays
from textloom.llm.anchors import LENGTH, anchor_ranges
from textloom.llm.suffixes import capped_prefixes, suffix_sort
from textloom.session import drop, stage

#: Bytes of contexts that a shard sorts, about.
SHARD_BYTES = 1 << 20
#: Contexts of one anchor hash that stay in one shard.
SHARD_CONTEXTS = 4096

_FULL, _SHIP = 1, 2


def _ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor hash, context hash)."""
    prefix = arrays.prefix_hash(data)
    text, first, starts, anchor = anchor_ranges(data, bounds, prefix)
    at = bounds[text] + first
    context = arrays.range_hash(prefix, at, at + starts + LENGTH - 1).view(np.int64)
    return text, first, starts, anchor, context


def _anchor_task(schema: pa.Schema):
    """(key, class, anchors, contexts, repeats) of each text, every context once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in arrays.work(batch.column(2)):
                text, _, _, anchor, context = _ranges(data, bounds)
                by = np.lexsort((context, anchor, text))
                text, anchor, context = text[by], anchor[by], context[by]
                new = np.ones(len(by), bool)
                new[1:] = (
                    (text[1:] != text[:-1])
                    | (anchor[1:] != anchor[:-1])
                    | (context[1:] != context[:-1])
                )
                again = np.diff(np.append(np.flatnonzero(new), len(by))) > 1
                text, anchor, context = text[new], anchor[new], context[new]
                cuts = pa.array(np.searchsorted(text, np.arange(j - i + 1)), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (anchor, context, again)
                ]
                own = [batch.column(k).slice(i, j - i).cast(schema.field(k).type) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *lists], schema=schema)

    return run


def _key(text: np.ndarray, anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One number for a context in a text of the piece at hand."""
    mixed = arrays.mix(anchor.view(np.uint64) + arrays.mix(context.view(np.uint64)))
    return arrays.mix(mixed + text.astype(np.uint64))


def _context_task(schema: pa.Schema):
    """Covered byte ranges, and contexts to be compared, of the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for i, j, data, bounds in arrays.work(batch.column(1)):
                text, first, starts, anchor, context = _ranges(data, bounds)
                lists = [batch.column(k).slice(i, j - i) for k in (2, 3, 4)]
                size = lists[0].value_lengths().to_numpy()
                wanted = [x.flatten().to_numpy() for x in lists]
                keys = _key(np.repeat(np.arange(j - i), size), *wanted[:2])
                by = np.argsort(keys)
                keys, codes = keys[by], wanted[2][by]
                own = _key(text, anchor, context)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                code = np.where(keys[at] == own, codes[at], 0)
                full = np.flatnonzero(code & _FULL)
                node, start, stop = _joined(
                    nodes[i + text[full]], first[full], first[full] + starts[full] + LENGTH - 1
                )
                yield _parts(schema, node, start, stop)
                ship = np.flatnonzero(code & _SHIP)
                ship = ship[np.unique(own[ship], return_index=True)[1]]
                heads = bounds[text[ship]] + first[ship]
                tails = heads + starts[ship] + LENGTH - 1
                bodies = [data[a:z].tobytes() for a, z in zip(heads.tolist(), tails.tolist())]
                yield _parts(
                    schema, nodes[i + text[ship]], first[ship], starts[ship], anchor[ship], bodies
                )

    return run


def _parts(schema, node, start, stop, anchor=None, bodies=None) -> pa.RecordBatch:
    cells = [node, start, stop, anchor, bodies]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(node), f.type) if c is None else pa.array(c, f.type) for c, f in zip(cells, schema)],
        schema=schema,
    )


def _joined(node: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of each node that touch or overlap as one; they come in order of their starts."""
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] > stop[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(node)) - 1
    return node[heads], start[heads], stop[tails[: len(heads)]]


def _covered(node: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges covered by repeated strings at these starts, merged."""
    by = np.lexsort((start, node))
    node, start = node[by], start[by]
    new = np.ones(len(by), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] > start[:-1] + LENGTH)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(by)) - 1
    return node[heads], start[heads], start[tails[: len(heads)]] + LENGTH


_SHARD_OUT = "node long, start long, stop long, bucket long, strings binary, nodes binary, starts binary"


def _shard_task(table: pa.Table) -> pa.Table:
    """Repeated starts within a shard; of spread anchor hashes also the sorted strings."""
    table = table.sort_by([("h", "ascending"), ("node", "ascending"), ("start", "ascending")])
    bodies = table["body"].to_pylist()
    node, start = table["node"].to_numpy(), table["start"].to_numpy()
    starts, parts = table["stop"].to_numpy(), table["parts"].to_numpy()
    data = np.frombuffer(b"".join(bodies), np.uint8)
    origin = np.cumsum([0, *map(len, bodies)])
    # Starts whose 200 bytes lie in their context, and the context of each.
    owner = np.repeat(np.arange(len(bodies)), starts)
    offset = np.arange(len(owner)) - (np.cumsum(starts) - starts)[owner]
    at = origin[:-1][owner] + offset
    which = np.full(len(data), -1, np.int64)
    which[at] = np.arange(len(at))
    words = _eight(data)
    order = suffix_sort(words.byteswap(), step=8)
    common = capped_prefixes(words, order, len(data), LENGTH)
    group = np.cumsum(common < LENGTH)
    ours = which[order]
    group, ours = group[ours >= 0], ours[ours >= 0]
    many = np.bincount(group)[group] > 1
    marked = ours[many]
    nodes, first, last = _covered(node[owner[marked]], (start[owner] + offset)[marked])
    out = [_table(nodes, first, last)]
    spread = parts[owner[ours]] > 1
    if spread.any():
        group, ours, many = group[spread], ours[spread], many[spread]
        head = np.ones(len(group), bool)
        head[1:] = group[1:] != group[:-1]
        group, ours, many = group[head], ours[head], many[head]
        out.append(_strings(data, at[ours], owner[ours], many, node, start, offset[ours], table["h"].to_numpy(), parts))
    return pa.concat_tables(out)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, the first in the lowest place; zeros follow the end."""
    long = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= long[k : k + len(data)] << np.uint64(8 * k)
    return out


def _table(node, start, stop, bucket=None, strings=None, nodes=None, starts=None) -> pa.Table:
    n = len(bucket) if bucket is not None else len(node)
    columns = [node, start, stop, bucket, strings, nodes, starts]
    types = [pa.int64()] * 4 + [pa.binary()] * 3
    names = ["node", "start", "stop", "bucket", "strings", "nodes", "starts"]
    cells = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types)]
    return pa.table(dict(zip(names, cells)))


def _strings(data, at, owner, many, node, start, offset, anchor, parts) -> pa.Table:
    """Per bucket, the shard's distinct strings in order; alone ones with their place."""
    one = arrays.prefix_hash(data)
    two = arrays.prefix_hash(_TURNED[data])
    prints = arrays.range_hash(one, at, at + LENGTH), arrays.range_hash(two, at, at + LENGTH)
    pieces = parts[owner].astype(np.uint64)
    bucket = arrays.mix(anchor[owner].view(np.uint64) + prints[0] % pieces).view(np.int64)
    nodes = np.where(many, -1, node[owner])
    places = start[owner] + offset
    by = np.lexsort((prints[1], prints[0], bucket))
    bucket = bucket[by]
    cuts = np.flatnonzero(np.append([True], bucket[1:] != bucket[:-1]))
    rows = [np.arange(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]
    pairs = np.column_stack([prints[0], prints[1]])[by].astype("<u8")
    return _table(
        None,
        None,
        None,
        bucket[cuts],
        [pairs[r].tobytes() for r in rows],
        [nodes[by[r]].astype("<i8").tobytes() for r in rows],
        [places[by[r]].astype("<i8").tobytes() for r in rows],
    )


_TURNED = ((np.arange(256) * 167 + 13) % 256).astype(np.uint8)


def _merge_task(table: pa.Table) -> pa.Table:
    """Starts whose string another shard lists too: binary search in the merged lists."""
    pairs, nodes, starts, buckets = [], [], [], []
    for b, s, n, p in zip(*(table[c].to_pylist() for c in ("bucket", "strings", "nodes", "starts"))):
        pairs.append(np.frombuffer(s, "<u8").reshape(-1, 2))
        nodes.append(np.frombuffer(n, "<i8"))
        starts.append(np.frombuffer(p, "<i8"))
        buckets.append(np.full(len(nodes[-1]), b))
    strings = np.concatenate(pairs)
    whole = arrays.mix(strings[:, 0] * np.uint64(3) ^ strings[:, 1]) + np.concatenate(buckets).view(np.uint64)
    merged = np.sort(whole)
    found = np.searchsorted(merged, whole, "right") - np.searchsorted(merged, whole, "left") > 1
    node, start = np.concatenate(nodes), np.concatenate(starts)
    found &= node >= 0
    return _table(*_covered(node[found], start[found])).select(["node", "start", "stop"])


def _cut_task(schema: pa.Schema):
    """(node, n_removed, n_spans, kept_sha256) of texts, given their covered ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = arrays.utf8(batch.column(1))
            out = []
            for row in range(batch.num_rows):
                text = data[bounds[row] : bounds[row + 1]]
                first, last = (np.array(batch.column(k)[row].values) for k in (2, 3))
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, first, 1)
                np.add.at(change, last, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = hashlib.sha256(text[~gone].tobytes()).hexdigest()
                out.append((int(gone.sum()), spans, kept))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))],
                schema=schema,
            )

    return run


def _repeated(units: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(node, hashes, contexts, codes)``: what each text must cover or have compared.

    Also the staged tables that this is read from.
    """
    occurrences = units.select(
        "node",
        (F.col("copies") > 1).alias("copied"),
        F.explode(F.arrays_zip("anchors", "contexts", "again")).alias("x"),
    ).select("node", "copied", F.col("x.anchors").alias("h"), F.col("x.contexts").alias("c"), "x.again")
    hashes = (
        occurrences.groupBy("h")
        .agg(
            (F.min("c") != F.max("c")).alias("ship"),
            ((F.min("node") != F.max("node")) | F.max("again")).alias("twice"),
        )
        .filter("ship OR twice")
        .select("h", "ship")
    )
    hashes = stage(hashes, "hashes")
    met = stage(occurrences.join(hashes, "h"), "met")
    contexts = met.groupBy("h", "c").agg(
        F.min("node").alias("lo"),
        ((F.min("node") != F.max("node")) | F.max("again") | F.max("copied")).alias("full"),
    )
    contexts = stage(contexts, "contexts")
    judged = met.join(contexts, ["h", "c"])
    ship = F.when(F.col("ship") & (F.col("node") == F.col("lo")), _SHIP).otherwise(0)
    full = F.when(F.col("full") & ~F.col("copied"), _FULL).otherwise(0)
    codes = (
        judged.withColumn("code", (ship + full).cast("int"))
        .filter("code > 0")
        .groupBy("node")
        .agg(F.collect_list(F.struct("h", "c", "code")).alias("x"))
        .select("node", F.col("x.h").alias("hashes"), F.col("x.c").alias("contexts"), F.col("x.code").alias("codes"))
    )
    return codes, [hashes, met, contexts]


def _compared(contexts: DataFrame) -> DataFrame:
    """Covered ranges from comparing contexts shard by shard."""
    total = contexts.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, total // SHARD_BYTES)
    crowded = stage(
        contexts.groupBy("h")
        .count()
        .filter(F.col("count") > SHARD_CONTEXTS)
        .select("h", F.ceil(F.col("count") / SHARD_CONTEXTS).alias("parts")),
        "crowded",
    )
    placed = contexts.join(crowded, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(
        F.col("parts") > 1, F.pmod(F.xxhash64("node", "start"), F.col("parts"))
    ).otherwise(F.lit(0))
    sorted_ = stage(
        placed.withColumn("shard", F.pmod(F.xxhash64("h", part), F.lit(shards)))
        .groupBy("shard", F.when(F.col("parts") > 1, F.xxhash64("h", part)).alias("own"))
        .applyInArrow(_shard_task, _SHARD_OUT),
        "sorted",
    )
    merged = (
        sorted_.filter("bucket IS NOT NULL")
        .select("bucket", "strings", "nodes", "starts")
        .groupBy("bucket")
        .applyInArrow(_merge_task, "node long, start long, stop long")
    )
    inside = sorted_.filter("bucket IS NULL").select("node", "start", "stop")
    return inside.unionByName(merged)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` for every row.

    A byte goes if a string of 200 bytes that covers it also starts anywhere else, in
    another row or in its own. Null texts count as empty; empty and short texts lose
    nothing. Each of several equal rows counts as a document of its own, so equal texts
    of 200 bytes or more lose all. An empty table gives no rows. Only the key and the
    text are read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(
        F.col(key).alias("_key"), F.sha2(body.cast("binary"), 256).alias("class"), body.alias("_text")
    )
    kind = source.schema["_key"].dataType.simpleString()
    listed = StructType.fromDDL(
        f"_key {kind}, class string, anchors array<long>, contexts array<long>, again array<boolean>"
    )
    units = stage(
        source.mapInArrow(_anchor_task(to_arrow_schema(listed)), listed)
        .groupBy("class")
        .agg(
            F.min("_key").alias("_key"),
            F.count(F.lit(1)).alias("copies"),
            F.first("anchors").alias("anchors"),
            F.first("contexts").alias("contexts"),
            F.first("again").alias("again"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "units",
    )
    codes, used = _repeated(units)
    wanted = codes.join(units.select("node", "class", "_key"), "node")
    texts = source.alias("s").join(
        wanted.alias("w"),
        (F.col("s.class") == F.col("w.class")) & F.col("s._key").eqNullSafe(F.col("w._key")),
    )
    found = stage(
        texts.select("node", "_text", "hashes", "contexts", "codes").dropDuplicates(["node"]), "texts"
    )
    drop(docs.sparkSession, *used)
    made = StructType.fromDDL("node long, start long, stop long, h long, body binary")
    parts = stage(found.mapInArrow(_context_task(to_arrow_schema(made)), made), "parts")
    whole = parts.filter("h IS NULL").select("node", "start", "stop")
    ranges = whole.unionByName(_compared(parts.filter("h IS NOT NULL")))
    per_text = ranges.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("x"))
    per_text = per_text.select("node", F.col("x.start").alias("first"), F.col("x.stop").alias("last"))
    results = StructType.fromDDL("node long, n_removed long, n_spans long, kept string")
    cut = (
        found.select("node", "_text")
        .join(per_text, "node")
        .select("node", "_text", "first", "last")
        .mapInArrow(_cut_task(to_arrow_schema(results)), results)
    )
    by_class = stage(
        units.select("class", "copies", "node").join(cut, "node", "left").drop("node"), "results"
    )
    size = F.octet_length("_text").cast("long")
    rows = source.select("_key", "class", size.alias("n_bytes")).join(by_class, "class")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        F.col("_key").alias(key),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, hashlib.sha256(b"").hexdigest())
        .otherwise(F.coalesce("kept", "class"))
        .alias("kept_sha256"),
    )
