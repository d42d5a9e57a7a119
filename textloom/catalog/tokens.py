"""Pre-tokens, learnt merges, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import Catalog, documents, table
from textloom.operators import vocabulary as bpe
from textloom.session import scratch_path

catalog = Catalog()

# Small enough for the recursive SQL to follow; every document takes part.
LEARN_SIZE = 160

# RE2 has no look-ahead. A mark (U+E000) put before the last character of each
# white-space run that is followed by text does the same.
PIECES_SQL = """regexp_extract_all(
    regexp_replace(CASE WHEN starts_with(text, ' ') OR text = '' THEN text ELSE ' ' || text END,
      '(\\s+)(\\s\\S)', '\\1\\x{e000}\\2', 'g'),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}\\x{e000}]+|\\s+')"""
PIECES_SQL = PIECES_SQL.replace("\\1\\x{e000}\\2", "\\1\ue000\\2")


@catalog.add(
    "pretokenize",
    f"""SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, chr(31))) AS digest
        FROM (SELECT doc_id, {PIECES_SQL} AS w FROM documents)""",
)
def pretokenize(spark, sf_dir):
    words = documents(spark, sf_dir, "text").select("doc_id", bpe.pretokenize("text").alias("w"))
    return words.select(
        "doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", "\x1f")).alias("digest")
    )


COUNTS_SQL = f"""counts AS (SELECT word, count(*) AS n
  FROM (SELECT unnest({PIECES_SQL}) AS word FROM documents) GROUP BY word)"""


@catalog.add("pretoken_counts", f"WITH {COUNTS_SQL} SELECT word, n FROM counts")
def pretoken_counts(spark, sf_dir):
    return bpe.pretoken_counts(documents(spark, sf_dir, "text"))


# Every document many times over, in stretches of some 500 characters.
@catalog.add(
    "pretoken_counts_long",
    f"""WITH {COUNTS_SQL.replace("FROM documents", "FROM (SELECT array_to_string([text for i in range(20)], ' ') AS text FROM documents)")}
    SELECT word, n FROM counts""",
)
def pretoken_counts_long(spark, sf_dir):
    long = F.concat(F.repeat(F.concat("text", F.lit(" ")), 19), "text")
    return bpe.pretoken_counts(documents(spark, sf_dir, "text").select(long.alias("text")), length=500)


# Greedy learning one merge at a time. A word is spelled '<12><45>...' in token
# ids; each step finds the most frequent pair of all words and replaces it.
LEARN_SQL = f"""{COUNTS_SQL},
hexes AS (SELECT word, n, regexp_extract_all(hex(encode(word)), '..') AS hs FROM counts),
bytes AS (SELECT DISTINCT unnest(hs) AS h FROM hexes),
ranked AS (SELECT h, ('0x' || h)::INT AS b FROM bytes),
alphabet AS (SELECT h, 3 + row_number() OVER (ORDER BY
    NOT (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255), b) AS id FROM ranked),
ids AS (SELECT map_from_entries(list((h, id))) AS m, max(id) + 1 AS next FROM alphabet),
spelled AS (SELECT word, n, next,
    array_to_string(list_transform(hs, lambda h: '<' || m[h] || '>'), '') AS s FROM hexes, ids),
rec AS (
  SELECT 0 AS step, next AS made, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::BIGINT AS cnt, word, n, s
  FROM spelled
  UNION ALL
  SELECT rec.step + 1, rec.made + 1, top.l, top.r, top.cnt, rec.word, rec.n,
    replace(rec.s, '<' || top.l || '><' || top.r || '>', '<' || rec.made || '>')
  FROM rec, (SELECT l, r, sum(n)::BIGINT AS cnt
        FROM (SELECT n, unnest(xs[1:len(xs) - 1]) AS l, unnest(xs[2:]) AS r
              FROM (SELECT n, list_transform(string_split(s[2:length(s) - 1], '><'), lambda x: x::BIGINT) AS xs
                    FROM rec) WHERE len(xs) > 1)
        GROUP BY l, r HAVING sum(n) >= 2 ORDER BY cnt DESC, l, r LIMIT 1) AS top
  WHERE rec.made < {LEARN_SIZE})"""
LEARN_SQL = "RECURSIVE " + LEARN_SQL
FINAL_SQL = """final AS (SELECT word, n, replace(s[2:length(s) - 1], '><', ' ') AS ids
  FROM rec WHERE step = (SELECT max(step) FROM rec))"""


def learnt(spark, sf_dir) -> bpe.Vocabulary:
    return bpe.learn_bpe(bpe.pretoken_counts(documents(spark, sf_dir, "text")), vocab_size=LEARN_SIZE)


@catalog.add(
    "bpe_merges",
    f"""WITH {LEARN_SQL} SELECT DISTINCT step::INT - 1 AS rank, l::INT AS "left", r::INT AS "right",
        made::INT - 1 AS new_id, cnt AS pair_count FROM rec WHERE step > 0""",
)
def bpe_merges(spark, sf_dir):
    vocab = learnt(spark, sf_dir)
    counts = spark.createDataFrame(list(enumerate(vocab.counts)), "rank int, pair_count long")
    return vocab.merge_table(spark).join(counts, "rank")


# No SQL: a recursion over some thousand merges is out of its reach. Tests hold learning
# until no pair occurs twice against learning one merge at a time.
@catalog.add("bpe_full")
def bpe_full(spark, sf_dir):
    """The vocabulary of the benchmark texts at its production size, or until no pair occurs twice."""
    vocab = bpe.learn_bpe(bpe.pretoken_counts(table(spark, sf_dir, "benchmark")))
    counts = spark.createDataFrame(list(enumerate(vocab.counts)), "rank int, pair_count long")
    return vocab.merge_table(spark).join(counts, "rank")


@catalog.add("encode_words", f"WITH {LEARN_SQL}, {FINAL_SQL} SELECT word, n, ids FROM final")
def encode_words(spark, sf_dir):
    counts = bpe.pretoken_counts(documents(spark, sf_dir, "text"))
    coded = bpe.encode_words(counts, bpe.learn_bpe(counts, vocab_size=LEARN_SIZE))
    return coded.withColumn("ids", F.array_join("ids", " "))


@catalog.add(
    "tokenize_docs",
    f"""WITH {LEARN_SQL}, {FINAL_SQL},
    pieces AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
      FROM (SELECT doc_id, {PIECES_SQL} AS w FROM documents))
    SELECT doc_id, string_agg(ids, ' ' ORDER BY i) || ' 1' AS ids
    FROM pieces JOIN final USING (word) GROUP BY doc_id""",
)
def tokenize_docs(spark, sf_dir):
    coded = bpe.tokenize(documents(spark, sf_dir, "text"), learnt(spark, sf_dir))
    return coded.withColumn("ids", F.array_join("ids", " "))


@catalog.add(
    "roundtrip",
    """SELECT doc_id, CASE WHEN starts_with(text, ' ') OR text = '' THEN text ELSE ' ' || text END AS text
       FROM documents""",
)
def roundtrip(spark, sf_dir):
    vocab = learnt(spark, sf_dir)
    coded = bpe.tokenize(documents(spark, sf_dir, "text"), vocab)
    return bpe.detokenize(coded, vocab).select("doc_id", "text")


@catalog.add("vocabulary_size", f"WITH {LEARN_SQL} SELECT max(made)::INT AS tokens FROM rec")
def vocabulary_size(spark, sf_dir):
    """Counted from the stored vocabulary."""
    path = scratch_path(spark, "vocabulary")
    learnt(spark, sf_dir).vocab_table(spark).write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").cast("int").alias("tokens"))


# Texts with special tokens inside: between two copies, in front, or none.
@catalog.add(
    "tokenize_specials",
    f"""WITH {LEARN_SQL}, {FINAL_SQL},
    parts AS (SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN [text, '</s>', text]
        WHEN 1 THEN ['<pad>', text] ELSE [text] END) AS text,
      generate_subscripts(CASE doc_id % 3 WHEN 0 THEN [text, '</s>', text]
        WHEN 1 THEN ['<pad>', text] ELSE [text] END, 1) AS part FROM documents),
    pieces AS (SELECT doc_id, part, unnest(w) AS word, generate_subscripts(w, 1) AS i
      FROM (SELECT doc_id, part, {PIECES_SQL} AS w FROM parts WHERE text NOT IN ('</s>', '<pad>'))),
    coded AS (SELECT doc_id, part, string_agg(ids, ' ' ORDER BY i) AS ids
      FROM pieces JOIN final USING (word) GROUP BY doc_id, part
      UNION ALL SELECT doc_id, part, CASE text WHEN '</s>' THEN '1' ELSE '2' END FROM parts
      WHERE text IN ('</s>', '<pad>'))
    SELECT doc_id, string_agg(ids, ' ' ORDER BY part) || ' 1' AS ids FROM coded GROUP BY doc_id""",
)
def tokenize_specials(spark, sf_dir):
    third = F.col("doc_id") % 3
    marked = (
        F.when(third == 0, F.concat("text", F.lit("</s>"), "text"))
        .when(third == 1, F.concat(F.lit("<pad>"), "text"))
        .otherwise(F.col("text"))
    )
    docs = documents(spark, sf_dir, "text").select("doc_id", marked.alias("text"))
    coded = bpe.tokenize(docs, learnt(spark, sf_dir))
    return coded.withColumn("ids", F.array_join("ids", " "))


@catalog.add(
    "dropped_bytes",
    """WITH known AS (SELECT list(DISTINCT h) || ['20'] AS hs
      FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM benchmark))
    SELECT doc_id, len(list_filter(regexp_extract_all(hex(encode(text)), '..'),
      lambda h: NOT list_contains(hs, h))) AS dropped FROM documents, known""",
)
def dropped_bytes(spark, sf_dir):
    """Bytes of the documents that a vocabulary learnt on the benchmark texts does not know."""
    counts = bpe.pretoken_counts(table(spark, sf_dir, "benchmark"))
    vocab = bpe.learn_bpe(counts, vocab_size=LEARN_SIZE)
    docs = documents(spark, sf_dir, "text")
    return docs.select("doc_id", bpe.dropped_bytes(vocab).alias("dropped"))
