"""How each corpus is read and cleaned on its way to size-bounded chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lang import english_filter
from textloom.functions.text import cut_references, utrim, wikitext_detok
from textloom.operators.articles import assemble_articles
from textloom.operators.chunking import MAX_CHUNK_BYTES, assign_chunks
from textloom.sources.corpus import read_corpus, read_jsonl


@dataclass(frozen=True)
class Recipe:
    """File pattern, field and cleaning of a corpus; ``key`` marks JSON lines."""

    glob: str
    key: str | None = None
    language: str | None = None
    clean: Callable[[Column], Column] | None = None
    english: bool = False
    lines: bool = False


# File patterns, field names and the steps applied per corpus.
RECIPES: dict[str, Recipe] = {
    "arxiv": Recipe("*.jsonl.gz", key="text", clean=cut_references),
    "book2": Recipe("*.parquet", clean=utrim),
    "c4": Recipe("*.json.gz", key="text"),
    "fineweb": Recipe("*.parquet", language="en", clean=utrim),
    "openwebtext2": Recipe("*.jsonl", key="content", english=True),
    "pubmed": Recipe("*.jsonl", key="contents"),
    "wikipedia": Recipe("*.parquet", clean=utrim),
    "wikitext": Recipe("*.parquet", clean=lambda c: wikitext_detok(utrim(c)), lines=True),
}


def read_documents(
    spark: SparkSession, name: str, path: str, recipe: Recipe | None = None
) -> DataFrame:
    """Cleaned documents ``(source, doc_ord, text)`` of a raw corpus under ``path``."""
    recipe = recipe or RECIPES[name]
    if recipe.key:
        rows = read_jsonl(spark, path, name, recipe.key, recipe.glob)
    elif recipe.language:
        rows = read_corpus(
            spark, path, name, glob=recipe.glob,
            columns=["language"], where=F.col("language") == recipe.language,
        )
    else:
        rows = read_corpus(spark, path, name, glob=recipe.glob)
    if recipe.english:
        rows = english_filter(rows)
    if recipe.clean:
        rows = rows.withColumn("text", recipe.clean(F.col("text")))
    if recipe.lines:
        docs = assemble_articles(rows, "file", "doc_ord", "text")
        rows = docs.withColumn("source", F.lit(name))
    return rows.select("source", "doc_ord", "text")


def chunk_corpus(
    spark: SparkSession, name: str, path: str,
    max_bytes: int = MAX_CHUNK_BYTES, mode: str = "next_fit", recipe: Recipe | None = None,
) -> DataFrame:
    """Documents of a raw corpus with their chunk number, ready for ``write_chunks``."""
    return assign_chunks(read_documents(spark, name, path, recipe), max_bytes, mode)
