"""Documents ready for training: language, near-duplicates, benchmark, personal data, packing.

Each stage reads what the one before it wrote, and works on all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, language, near_dedup, packing, pii
from textloom.session import stage

#: No single SQL text says what the network or the tokenizer does; tests hold each stage
#: against a plain version instead.
ORACLE_SQL = None

#: Below this probability of its best language, a text is not taken for any learned one.
LEAST_LANGUAGE = 0.3


#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or with no likely language go.

    The network learns from the stage's own input. Null and empty texts have no letter, so they
    go; whole texts count, however long; repeated rows stay. All columns stay as they are, whatever
    their names. Where no language can be learned, as in an empty table, nothing stays.
    """
    names = docs.columns
    held = [f"_d{i}" for i in range(len(names))]
    rows = docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(names, held)))
    judged = language.predict(rows, language.learn(docs), text=held[names.index("text")])
    kept = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)
    return judged.filter(kept).select(*(F.col(h).alias(c) for c, h in zip(names, held)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    A row is known by its id and its text, so an id that occurs with two texts is two
    documents, and rows without an id take part like others, after those with one. Of rows that
    repeat an id and a text one stays. Null and empty texts resemble nothing and stay. An
    empty table gives an empty one; columns are kept whatever their names.
    """
    row = "_row" + "_" * max(map(len, docs.columns), default=0)
    place = F.struct(
        F.col("doc_id").isNull().alias("nameless"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("text"),
    )
    keyed = docs.withColumn(row, place)
    groups = near_dedup.near_duplicates(keyed, key=row, size=SHINGLE_WORDS)
    rows = stage(groups.filter("kept").select(row), "kept").groupBy(row).count()
    # The list of rows grows with the input, so it is never broadcast, at no size.
    out = keyed.join(rows.filter("count = 1").hint("merge"), row, "left_semi")
    again = rows.filter("count > 1")
    if again.limit(1).count():
        repeated = keyed.join(again, row, "left_semi")
        out = out.unionByName(repeated.dropDuplicates([row]))
    return out.drop(row)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark.

    ``n_chars`` follows the text. Documents that share nothing are not touched; null texts stay
    null; rows are neither dropped nor merged. An empty benchmark or table changes nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cut = decontamination.remove_hits(docs, benchmark)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of every span of personal data; ``n_chars`` follows.

    Null texts stay null, other rows and columns as they are, whatever their names.
    """
    names = docs.columns
    spans = "_spans" + "_" * max(map(len, names), default=0)
    masked = pii.mask(pii.find_spans(docs, out=spans), spans=spans).select(*(F.col(f"`{c}`") for c in names))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 1024 tokens.

    A null text counts as empty; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
