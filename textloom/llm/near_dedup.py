"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Each document has two collections of ``HALVES`` half keys, every one a hash of ``ROWS``
minhashes. A table key is a pair of half keys, one of either collection, so the minhashes
of 2 * HALVES bands give HALVES ** 2 tables. Pairs are formed only from half keys that
another document shares. Documents with equal sets are one class throughout.

Signatures join bucket mates that may be similar (see ``AGREE``) into clusters: each
bucket's members with one that the bucket picks, then, where a bucket still holds
several clusters, all members across them. This writes only as many pairs as it takes to join
the clusters. Within a cluster all pairs of full sets are compared, in pairs of blocks of
bounded size, and links are written as stars. So no pair that shares a table key and passes
the signatures is left out, and no step writes all pairs of a group.
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
from textloom.llm.components import components
from textloom.session import drop, stage

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE = 4
LEAST = 80
#: A pair at similarity 0.8 shares no table with probability below 0.0004.
HALVES = 12
ROWS = 3
#: Equal minhashes of 72 from which a pair may be similar: at similarity 0.8 fewer are seen
#: with probability below 0.0002.
AGREE = 44
#: Members of a bucket whose signatures are compared as one block.
SIGN_BLOCK = 1024
#: Members of a cluster that are compared as one block, and bytes of their sets.
BLOCK = 256
BLOCK_BYTES = 4 << 20

_HASHES = 2 * HALVES * ROWS
_rng = np.random.default_rng(20_240_501)
_FACTORS = _rng.integers(1, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64)

#: Words are what ASCII white space leaves.
_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the whole sequence if it is shorter."""
    data = arrays.lower(data)
    starts, ends, count = arrays.words(data, bounds, _WORD)
    word = arrays.range_hash(arrays.prefix_hash(data), starts, ends)
    run = arrays.run_hash(word, size)
    last = np.cumsum(count)
    for n, end in zip(count.tolist(), last.tolist()):
        if n >= size:
            yield np.unique(run[end - n : end - size + 1])
        else:
            yield arrays.run_hash(word[end - n : end], n) if n else word[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minhashes of a set that is not empty."""
    best = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096] * _FACTORS[:, None] + _OFFSETS[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def half_keys(signatures: np.ndarray) -> np.ndarray:
    """Hashes of ``ROWS`` minhashes each, all different by place: first one collection, then the other."""
    bands = signatures.astype(np.uint64).reshape(len(signatures), 2 * HALVES, ROWS)
    out = np.broadcast_to(np.arange(2 * HALVES, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        out = arrays.mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k] + np.uint64(1))
    return out.view(np.int64)


def set_hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def _sketch_task(size: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in arrays.work(batch.column(1)):
                sets = list(shingle_sets(data, bounds, size))
                some = [len(s) > 0 for s in sets]
                signs = np.array([signature(s) for s in sets if len(s)], "<u4").reshape(-1, _HASHES)
                keys = iter(half_keys(signs).tolist())
                rows = iter(signs)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(schema.field(0).type),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_hash(s) if n else None for s, n in zip(sets, some)], pa.binary()),
                        pa.array([next(rows).tobytes() if n else None for n in some], pa.binary()),
                        pa.array([next(keys) if n else None for n in some], pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return run


def _set_task(size: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in arrays.work(batch.column(0)):
                sets = [s for s in shingle_sets(data, bounds, size) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_hash(s) for s in sets], pa.binary()),
                        pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least member of each one's component."""
    root = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        least = np.where(linked, root[None, :], len(root)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def _similar(sets: list[np.ndarray], least: int) -> np.ndarray:
    """Which pairs of sets are similar enough, by counts of what they share."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    shingle = np.concatenate(sets)
    by = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[by], owner[by]
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    both = np.zeros((n, n))
    wide = 4096
    for first in range(0, (int(column[-1]) if len(column) else -1) + 1, wide):
        a, z = np.searchsorted(column, [first, first + wide])
        block = np.zeros((n, min(wide, int(column[-1]) + 1 - first)), np.float32)
        block[owner[a:z], column[a:z] - first] = 1
        both += block @ block.T  # sums below 2 ** 24 are exact
    return 100 * both >= least * (size[:, None] + size[None, :] - both)


def _groups(table: pa.Table, names: list[str]) -> np.ndarray:
    """Bounds of the runs of equal values in these columns of a sorted table."""
    edge = np.zeros(table.num_rows + 1, bool)
    edge[0] = edge[-1] = True
    for name in names:
        values = table[name].to_numpy()
        edge[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(edge)


def _confirm_task(least: int):
    """Links found in each block pair of a cluster, as stars: full sets decide."""

    def run(table: pa.Table) -> pa.Table:
        names = ["cluster", "p", "q"]
        table = table.sort_by([(n, "ascending") for n in [*names, "node"]])
        nodes, raw = table["node"].to_numpy(), table["shingles"].to_pylist()
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = _groups(table, names)
        for a, z in zip(cuts, cuts[1:]):
            sets = [np.frombuffer(x, "<u8") for x in raw[a:z]]
            root = _local_roots(_similar(sets, least))
            moved = root != np.arange(z - a)
            one.append(nodes[a:z][moved])
            two.append(nodes[a:z][root[moved]])
        return pa.table({"a": np.concatenate(one), "b": np.concatenate(two)})

    return run


def _sift(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs whose signatures and sizes allow them to be similar."""
    one = classes.select(F.col("node").alias("a"), F.col("sign").alias("sx"), F.col("n").alias("nx"))
    two = classes.select(F.col("node").alias("b"), F.col("sign").alias("sy"), F.col("n").alias("ny"))
    schema = StructType.fromDDL("a long, b long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, _HASHES)
                for k in (2, 3)
            )
            good = (x == y).sum(axis=1) >= AGREE
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, schema=arrow)

    both = pairs.join(one, "a").join(two, "b").filter(
        f"100 * least(nx, ny) >= {least} * greatest(nx, ny)"
    )
    return both.select("a", "b", "sx", "sy").mapInArrow(run, schema)


def _forest_task(least: int):
    """Per block pair of a bucket, just enough pairs to join the components that may be linked."""

    def run(table: pa.Table) -> pa.Table:
        names = ["key", "p", "q"]
        table = table.sort_by([(n, "ascending") for n in [*names, "node"]])
        nodes, roots = table["node"].to_numpy(), table["root"].to_numpy()
        sizes = table["n"].to_numpy()
        signs = np.frombuffer(b"".join(table["sign"].to_pylist()), "<u4").reshape(-1, _HASHES)
        found: set[tuple[int, int]] = set()
        cuts = _groups(table, names)
        for a, z in zip(cuts, cuts[1:]):
            label = roots[a:z].copy()
            for k in range(1, z - a):
                rows = np.flatnonzero(label[:k] != label[k])
                same = (signs[a + rows] == signs[a + k]).sum(axis=1) >= AGREE
                low, high = np.minimum(sizes[a + rows], sizes[a + k]), np.maximum(sizes[a + rows], sizes[a + k])
                rows = rows[same & (100 * low >= least * high)]
                for other in np.unique(label[rows]):
                    x = rows[np.argmax(label[rows] == other)]
                    found.add((int(nodes[a + x]), int(nodes[a + k])))
                for other in np.unique(label[rows]):
                    label[label == other] = label[k]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _buckets(classes: DataFrame) -> DataFrame:
    """``(key, node, size, lead)`` of every member of a table bucket with two classes or more."""
    halves = stage(
        classes.select("node", F.posexplode("halves").alias("i", "half")).select("node", "i", "half"),
        "halves",
    )
    shared = stage(halves.groupBy("half").count().filter("count > 1").select("half"), "shared")
    met = stage(halves.join(shared, "half"), "met")
    first = met.filter(F.col("i") < HALVES).select("node", F.col("half").alias("x"))
    second = met.filter(F.col("i") >= HALVES).select("node", F.col("half").alias("y"))
    keys = stage(first.join(second, "node").select("node", F.xxhash64("x", "y").alias("key")), "keys")
    # The picked member is the least in one of four orders of the ids, so that the buckets of
    # a large group pick few different members.
    turn = F.col("key").bitwiseAND(F.lit(3)) * F.lit(0x1249_2492_4924_9249)
    many = stage(
        keys.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"), F.min(F.col("node").bitwiseXOR(turn)).alias("code"))
        .filter("size > 1")
        .select("key", "size", F.col("code").bitwiseXOR(turn).alias("lead")),
        "many",
    )
    members = stage(keys.join(many, "key"), "members")
    drop(classes.sparkSession, halves, shared, met, keys, many)
    return members


def _blocks(rows: DataFrame, group: str, blocks: str, *columns: str) -> DataFrame:
    """Deal the members of a group to blocks, and each to all pairs of its block with another."""
    return (
        rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))
        .withColumn("o", F.explode(F.expr(f"sequence(0, CAST({blocks} AS INT) - 1)")))
        .withColumns({"p": F.least("part", "o"), "q": F.greatest("part", "o")})
        .select(group, "p", "q", "node", *columns)
    )


def _clusters(members: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """``(node, root)``: groups closed under "share a table key and may be similar by signature"."""
    picked = (
        members.filter("node <> lead")
        .select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
        .distinct()
    )
    star = stage(_sift(picked, classes, least), "star")
    roots = stage(components(star), "roots")
    large = stage(
        members.filter("size > 2")
        .join(roots, "node", "left")
        .select("key", "node", "size", F.coalesce("root", "node").alias("root")),
        "large",
    )
    split = (
        large.groupBy("key")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("size").alias("size"))
        .filter("lo <> hi")
        .select("key", F.ceil(F.col("size") / SIGN_BLOCK).alias("blocks"))
    )
    rows = stage(_blocks(large.join(stage(split, "split"), "key"), "key", "blocks", "root"), "rows")
    bins = -(-rows.count() // 20_000)
    if not bins:
        return roots
    full = rows.join(classes.select("node", "sign", "n"), "node").withColumn(
        "bin", F.pmod(F.xxhash64("key", "p", "q"), F.lit(bins))
    )
    more = full.groupBy("bin").applyInArrow(_forest_task(least), "a long, b long").distinct()
    more = stage(more, "more")
    if not more.limit(1).count():
        return roots
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stage(components(stars.unionByName(more)), "roots")


def _sets_of(source: DataFrame, sought: DataFrame, size: int) -> DataFrame:
    """``(node, shingles)`` of the classes sought, from the text of a row of each.

    The list grows with the input, so it is never broadcast, at no size.
    """
    schema = StructType.fromDDL("class binary, shingles binary")
    texts = source.alias("s").join(
        sought.hint("merge").alias("t"), F.col("s._key").eqNullSafe(F.col("t._key")), "left_semi"
    )
    found = texts.select("_text").mapInArrow(_set_task(size, to_arrow_schema(schema)), schema)
    by_class = found.join(sought.select("class", "node"), "class").select("node", "shingles")
    return by_class.dropDuplicates(["node"])


def _links(clusters: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Confirmed links within the clusters, as stars."""
    held = clusters.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node")
    count = held.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)
        ).alias("blocks")
    )
    sized = held.join(stage(count, "count"), "root").withColumnRenamed("root", "cluster")
    rows = stage(_blocks(sized, "cluster", "blocks", "bytes"), "rows")
    bins = max(1, (rows.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES)
    full = rows.drop("bytes").join(sets, "node").withColumn(
        "bin", F.pmod(F.xxhash64("cluster", "p", "q"), F.lit(bins))
    )
    return full.groupBy("bin").applyInArrow(_confirm_task(least), "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, least: int = LEAST
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row.

    ``component_id`` is the least key that links reach, ``kept`` whether it is the row's
    own. Null and empty texts, and texts of white space, have no shingles and no links.
    Rows with a null key take part but name no component unless they stand alone
    (``component_id`` is then null); they are never kept. Repeated rows share a component.
    An empty table gives no rows. Only the key and the text are read.
    """
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()
    schema = StructType.fromDDL(
        f"_key {kind}, n long, class binary, sign binary, halves array<long>"
    )
    sketched = stage(source.mapInArrow(_sketch_task(size, to_arrow_schema(schema)), schema), "sketch")
    classes = stage(
        sketched.filter("n > 0")
        .groupBy("class")
        .agg(
            F.min("_key").alias("_key"),
            F.first("n").alias("n"),
            F.first("sign").alias("sign"),
            F.first("halves").alias("halves"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    clusters = _clusters(_buckets(classes), classes, least)
    sought = stage(clusters.join(classes.select("node", "class", "_key"), "node"), "sought")
    sets = stage(_sets_of(source, sought, size), "sets")
    roots = stage(components(stage(_links(clusters, sets, least), "links")), "roots")
    named = classes.select("class", "node", "_key").join(roots, "node", "left")
    least_key = (
        named.withColumn("root", F.coalesce("root", "node"))
        .select("class", "root", "_key")
    )
    names = least_key.groupBy("root").agg(F.min("_key").alias("component_id"))
    by_class = stage(least_key.select("class", "root").join(names, "root").select("class", "component_id"), "names")
    out = sketched.select("_key", "n", "class").join(by_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"),
    )
