"""Readers that turn raw corpora into ``(source, doc_ord, text)`` rows.

``doc_ord`` is the document's place in its source: files in path order, rows in
file order, counted densely. Everything downstream that depends on order uses it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.plans.joins import BROADCAST_BYTES, is_small, join_measured
from textloom.plans.prefix import idiv
from textloom.session import exists, stage

#: Name of the partition column of a folder of several chunks, before their number.
FOLDER = "chunks_by_"
CHUNK_SCHEMA = "doc_ord long, text string, source string, chunk_id int"


def _reader(spark: SparkSession, glob: str | None, recursive: bool):
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader


def _with_first(parts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Staged table of files or splits with the position of their first row."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    return stage(parts.select(*order, first), "first-rows")


def read_corpus(
    spark: SparkSession,
    path: str | Sequence[str],
    source: str,
    text: str = "text",
    columns: Sequence[str] = (),
    where: Column | None = None,
    glob: str | None = None,
    recursive: bool = True,
) -> DataFrame:
    """Scan a parquet corpus, reading only the text column and ``columns``.

    ``where`` is a condition on the read columns (a metadata test such as
    ``language = 'en'``) and is pushed into the parquet scan. Rows with a null
    text are dropped.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = _reader(spark, glob, recursive).parquet(*paths)
    place = raw.select(F.col("_metadata.file_path").alias("file"))
    # Row counts come from the footers, one row per file.
    files = _with_first(place.groupBy("file").agg(F.count("*").alias("rows")), ["file"])
    rows = raw if where is None else raw.filter(where)
    rows = rows.select(
        F.lit(source).alias("source"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row_idx"),
        F.col(text).alias("text"),
        *[F.col(c) for c in columns],
    ).filter(F.col("text").isNotNull())
    return (
        join_measured(rows, files, ["file"])
        .withColumn("doc_ord", F.col("first") + F.col("row_idx"))
        .select("source", "file", "row_idx", "doc_ord", "text", *columns)
    )


def scan_jsonl(
    spark: SparkSession,
    path: str | Sequence[str],
    key: str,
    order_key: str | None = None,
    glob: str | None = None,
    recursive: bool = True,
) -> DataFrame:
    """JSON lines (plain or gzip) that have ``key``, renamed to ``text``, in no order.

    A malformed line fails the read. ``order_key`` names a numeric field to keep
    as ``doc_ord``.
    """
    rows = _jsonl(spark, path, key, order_key, glob, recursive)
    order = [F.col(f"`{order_key}`").alias("doc_ord")] if order_key else []
    return rows.select(F.col(f"`{key}`").alias("text"), *order).filter(F.col("text").isNotNull())


def _jsonl(spark, path, key, order_key, glob, recursive) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    fields = [f"`{key}` string"] + ([f"`{order_key}` long"] if order_key else [])
    reader = _reader(spark, glob, recursive).schema(", ".join(fields))
    return reader.option("mode", "FAILFAST").json(paths)


def read_jsonl(
    spark: SparkSession,
    path: str | Sequence[str],
    source: str,
    key: str,
    glob: str | None = None,
    recursive: bool = True,
) -> DataFrame:
    """Scan a JSON-lines corpus into ``(source, file, doc_ord, text)``.

    JSON scans carry no row index, so the rows are staged as parquet once, with
    the split they came from and their place in the task that read it. Staging
    also makes the rows of a gzip file, which is one task, splittable.
    """
    rows = _jsonl(spark, path, key, None, glob, recursive).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col(f"`{key}`").alias("text"),
    )
    return in_file_order(rows, source)


def in_file_order(rows: DataFrame, source: str) -> DataFrame:
    """``(source, file, doc_ord, text)`` of scanned ``(file, split, text)`` rows, without null texts."""
    numbered = rows.withColumn("at", F.monotonically_increasing_id())
    staged = stage(numbered.filter(F.col("text").isNotNull()), "jsonl")
    # Rows of a split are numbered in reading order; the numbers start anywhere.
    base = F.min("at").alias("base")
    splits = staged.groupBy("file", "split").agg(base, (F.max("at") - F.min("at") + 1).alias("rows"))
    splits = stage(splits, "splits")
    firsts = _with_first(splits.select("file", "split", "rows"), ["file", "split"])
    starts = splits.join(firsts, ["file", "split"]).select(
        "file", "split", (F.col("first") - F.col("base")).alias("shift")
    )
    return join_measured(staged, stage(starts, "split-starts"), ["file", "split"]).select(
        F.lit(source).alias("source"), "file", (F.col("at") + F.col("shift")).alias("doc_ord"), "text"
    )


def json_key(c: Column | str, key: str) -> Column:
    """One key of a JSON text column, null where the record lacks it."""
    return F.get_json_object(c, f"$.{key}")


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All corpora as one table."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def all_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Every text chunk under ``root``, a table partitioned by source and chunk, or folder of chunks."""
    return without_folder(spark.read.schema(CHUNK_SCHEMA).parquet(root))


def folder_of(rows: DataFrame) -> str | None:
    """The partition column of the folders of a scanned table, if they hold several chunks each."""
    return next((c for c in rows.columns if c.startswith(FOLDER)), None)


def without_folder(rows: DataFrame) -> DataFrame:
    name = folder_of(rows)
    return rows.drop(name) if name else rows


def with_folder(rows: DataFrame, per_folder: int) -> tuple[DataFrame, list[str]]:
    """Rows with the column of their folder, and the columns that partition the table."""
    if per_folder == 1:
        return rows, ["source", "chunk_id"]
    name = f"{FOLDER}{per_folder}"
    return rows.withColumn(name, idiv(F.col("chunk_id"), per_folder).cast("int")), ["source", name]


def per_folder_of(spark: SparkSession, path: str) -> int | None:
    """Chunks in a folder of a written table, by the name of its first one; None if nothing is there."""
    if not exists(spark, path):
        return None
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for source in files.listStatus(root):
        if source.getPath().getName().startswith("source="):
            for folder in files.listStatus(source.getPath()):
                name = folder.getPath().getName().split("=")[0]
                if name == "chunk_id" or name.startswith(FOLDER):
                    return 1 if name == "chunk_id" else int(name.removeprefix(FOLDER))
    return None


def named_chunks(rows: DataFrame, wanted: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of the chunks named in ``wanted`` (source, chunk_id); ``rows`` come with their folder.

    The names prune the partitions when the scan starts, if they are measured to be small enough to be sent
    to all tasks; otherwise they are joined.
    """
    names, folder = wanted.select("source", "chunk_id"), folder_of(rows)
    small = is_small(names, broadcast_bytes)
    if folder:
        names, _ = with_folder(names, int(folder.removeprefix(FOLDER)))
    found = rows.join(F.broadcast(names) if small else names, names.columns, "left_semi")
    return without_folder(found)


def first_chunks(chunks: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` chunks of each source; prunes partitions of a chunk table."""
    return chunks.filter(F.col("chunk_id") < n)


def sample_shards(files: DataFrame, n: int, seed: int = 42, path: str = "path") -> DataFrame:
    """``n`` shards drawn by seed, in path order.

    The draw hashes seed and path, so it does not depend on partitioning.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(path)))
    return files.orderBy(key, path).limit(n).orderBy(path)


def preview(df: DataFrame, n: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows."""
    return (df.orderBy(*order) if order else df).limit(n)


def describe_table(df: DataFrame) -> dict:
    """Column names, schema text and row count, for people."""
    return {"names": df.columns, "schema": df.schema.simpleString(), "rows": df.count()}
