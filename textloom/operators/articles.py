"""Reassembly of articles that are stored one line per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import TITLE_MARK
from textloom.plans.prefix import running_sum
from textloom.session import stage


def assemble_articles(
    lines: DataFrame, file: str = "file", order: str = "row_idx", line: str = "text",
    restage: bool = True, max_bytes: int | None = None,
) -> DataFrame:
    """Join cleaned lines into documents ``(file, doc_ord, text)``.

    A line that starts with the title mark opens a document and loses the mark;
    empty lines are dropped; every kept line ends with a newline. Lines before
    the first title of a file form a document of their own. ``doc_ord`` is the
    place of the document's first kept line.

    The running title count is taken per block of lines, and lines are joined inside
    their block first, so no group holds more lines than a block has. Only the first
    and last document of a block, which may go on in its neighbours, are shuffled again and
    joined from one part a block. A document of more than ``max_bytes`` is an error.
    ``restage`` writes the cleaned lines once, which is cheaper than running the
    rewrite rules for both passes of the count.
    """
    is_title = F.col(line).startswith(TITLE_MARK)
    body = F.when(is_title, F.substring(line, len(TITLE_MARK) + 1, 2**31 - 1)).otherwise(F.col(line))
    cleaned = lines.select(
        F.col(file).alias("file"), F.col(order).alias("ord"),
        is_title.cast("int").alias("title"), body.alias("body"),
    )
    if restage:
        cleaned = stage(cleaned, "lines")
    numbered = running_sum(cleaned, ["file"], ["ord"], F.col("title"), "before", keep_block="blk")
    kept = numbered.withColumn("doc", F.col("before") + F.col("title")).filter(F.length("body") > 0)
    parts = _joined(kept.select("file", "blk", "doc", "ord", "body"), ["file", "blk", "doc"], "\n", max_bytes)
    block = Window.partitionBy("file", "blk")
    border = (F.col("doc") == F.min("doc").over(block)) | (F.col("doc") == F.max("doc").over(block))
    marked = parts.withColumn("border", border)
    across = marked.filter("border").select("file", "doc", "ord", "body")
    return (
        marked.filter(~F.col("border"))
        .select("file", "doc", "ord", "body")
        .unionByName(_joined(across, ["file", "doc"], "", max_bytes))
        .select("file", F.col("ord").alias("doc_ord"), F.col("body").alias("text"))
    )


def _joined(rows: DataFrame, keys: list[str], end: str, max_bytes: int | None) -> DataFrame:
    """The bodies of each group in order, each followed by ``end``, with the first place."""
    size = F.sum(F.octet_length("body") + len(end))
    groups = rows.groupBy(*keys).agg(
        F.min("ord").alias("first"), size.alias("size"),
        F.sort_array(F.collect_list(F.struct("ord", "body"))).alias("parts"),
    )
    whole = F.concat(F.array_join(F.col("parts.body"), end), F.lit(end))
    if max_bytes is not None:
        message = F.concat(F.lit("a document has "), F.col("size"), F.lit(f" bytes, more than {max_bytes}: "), "file")
        whole = F.when(F.col("size") > max_bytes, F.raise_error(message).cast("string")).otherwise(whole)
    return groups.select(*keys, F.col("first").alias("ord"), whole.alias("body"))
