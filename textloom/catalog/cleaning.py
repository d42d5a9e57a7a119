"""Text functions and the language filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import Catalog, documents, table
from textloom.catalog.scans import ASCII_RATIO_SQL, histogram_sql
from textloom.functions import lang, text
from textloom.operators.stats import histogram01

catalog = Catalog()

# White space as an RE2 class: the Unicode property and U+001C to U+001F.
WS_SQL = (
    "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)


@catalog.add(
    "trim_unicode",
    f"""SELECT doc_id, regexp_replace(x, '^{WS_SQL}+|{WS_SQL}+$', '', 'g') AS text
        FROM (SELECT doc_id, '  ' || chr(8195) || text || chr(10) || chr(9) || chr(133) AS x
              FROM documents)""",
)
def trim_unicode(spark, sf_dir):
    padded = F.concat(F.lit("  \u2003"), F.col("text"), F.lit("\n\t\x85"))
    return documents(spark, sf_dir, "text").select("doc_id", text.utrim(padded).alias("text"))


@catalog.add(
    "text_lengths",
    "SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes FROM documents",
)
def text_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.char_length("text").alias("chars"), text.byte_length("text").alias("bytes")
    )


@catalog.add(
    "ascii_ratio", f"SELECT doc_id, round({ASCII_RATIO_SQL}, 6) AS ratio FROM documents"
)
def ascii_ratio(spark, sf_dir):
    return documents(spark, sf_dir, "text").select(
        "doc_id", F.round(lang.ascii_ratio("text"), 6).alias("ratio")
    )


@catalog.add(
    "ascii_filter",
    f"SELECT doc_id, text FROM documents WHERE {ASCII_RATIO_SQL} > {lang.ASCII_BAR}",
)
def ascii_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").filter(
        lang.ascii_ratio("text") > lang.ASCII_BAR
    )


SAMPLE_SQL = """(CASE WHEN length(text) < 4096 THEN substr(text, 1, 2048)
    ELSE substr(text, 1, 1024) || substr(text, length(text) // 2 + 1, 1024) END)"""


def _words_sql(name: str) -> str:
    return ", ".join(f"'{w.lower()}'" for w in lang.STOP_WORDS[name])


_HITS_SQL = ",\n".join(
    f"len(list_filter(ws, lambda w: w IN ({_words_sql(k)})))::INT AS {k.lower()}"
    for k in lang.LANGUAGES
)
_LOW = [k.lower() for k in lang.LANGUAGES]
COUNTS_SQL = f"""
counts AS (SELECT doc_id, source, text, scale, {_HITS_SQL}
  FROM (SELECT doc_id, source, text, greatest(length(s) / 100.0, 1e-6)::DOUBLE AS scale,
          regexp_split_to_array(lower(translate(s, 'ſİı', 'sii')), '[^\\p{{L}}\\p{{N}}_]+') AS ws
        FROM (SELECT doc_id, source, text, {SAMPLE_SQL} AS s FROM documents)))"""
SCORES_SQL = f"""{COUNTS_SQL},
scores AS (SELECT doc_id, source, text, [{", ".join(f"{k} / scale" for k in _LOW)}, 1.0::DOUBLE] AS sc
  FROM counts)"""
PROBS_SQL = f"""{SCORES_SQL},
shifted AS (SELECT doc_id, source, text,
  list_transform(sc, lambda s: exp(s - list_max(sc))) AS es FROM scores),
probs AS (SELECT doc_id, source, text, list_transform(es, lambda e: e / list_sum(es)) AS p FROM shifted)"""


@catalog.add("lang_sample", f"SELECT doc_id, {SAMPLE_SQL} AS sample FROM documents")
def lang_sample(spark, sf_dir):
    return documents(spark, sf_dir, "text").select("doc_id", lang.lang_sample("text").alias("sample"))


@catalog.add("stopword_counts", f"WITH {COUNTS_SQL} SELECT doc_id, {', '.join(_LOW)} FROM counts")
def stopword_counts(spark, sf_dir):
    rows = documents(spark, sf_dir, "text").select("doc_id", lang.stopword_counts("text").alias("m"))
    return rows.select("doc_id", *[F.col("m")[k].alias(k.lower()) for k in lang.LANGUAGES])


def _labelled(spark, sf_dir, scored):
    rows = documents(spark, sf_dir, "text").select("doc_id", scored.alias("m"))
    return rows.select("doc_id", *[F.round(F.col("m")[k], 6).alias(k.lower()) for k in lang.LABELS])


def _by_label_sql(values: str) -> str:
    return ", ".join(f"round({values}[{i + 1}], 6) AS {k.lower()}" for i, k in enumerate(lang.LABELS))


@catalog.add("lang_scores", f"WITH {SCORES_SQL} SELECT doc_id, {_by_label_sql('sc')} FROM scores")
def lang_scores(spark, sf_dir):
    return _labelled(spark, sf_dir, lang.lang_scores("text"))


@catalog.add("lang_probs", f"WITH {PROBS_SQL} SELECT doc_id, {_by_label_sql('p')} FROM probs")
def lang_probs(spark, sf_dir):
    return _labelled(spark, sf_dir, lang.lang_probs("text"))


@catalog.add("english_histogram", histogram_sql(f"WITH {PROBS_SQL} SELECT p[1] AS x FROM probs"))
def english_histogram(spark, sf_dir):
    return histogram01(documents(spark, sf_dir, "text"), lang.lang_probs("text")["English"], 100)


_RANK_ROWS_SQL = ", ".join(
    f"{{'neg': -p[{i + 1}], 'pos': {i}, 'lang': '{k}'}}" for i, k in enumerate(lang.LABELS)
)


@catalog.add(
    "lang_rank",
    f"""WITH {PROBS_SQL}, ranked AS (SELECT doc_id, list_sort([{_RANK_ROWS_SQL}]) AS r FROM probs)
    SELECT doc_id, array_to_string(list_transform(r, lambda x: x.lang), ',') AS ranking,
      round(-r[1].neg, 6) AS best FROM ranked""",
)
def lang_rank(spark, sf_dir):
    rows = documents(spark, sf_dir, "text").select("doc_id", lang.lang_ranked("text").alias("r"))
    return rows.select(
        "doc_id",
        F.array_join("r.lang", ",").alias("ranking"),
        F.round(F.col("r")[0]["p"], 6).alias("best"),
    )


@catalog.add(
    "english_filter",
    f"""WITH {PROBS_SQL} SELECT doc_id, source, text FROM probs
        WHERE {ASCII_RATIO_SQL} > {lang.ASCII_BAR} AND p[1] > {lang.LANG_BAR}""",
)
def english_filter(spark, sf_dir):
    return lang.english_filter(documents(spark, sf_dir, "source", "text"))


@catalog.add(
    "cut_tail",
    """SELECT doc_id, regexp_replace(x, '(?ms)^\\s*(?:See also|References|External links|Further reading|Notes)\\s*$.*', '') AS text
       FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || E'\\n\\n  \\nSee also \\n' || text
               WHEN 1 THEN text || E'\\nSee also this\\n' || text ELSE text || E'\\nNotes' END AS x
             FROM documents)""",
)
def cut_tail(spark, sf_dir):
    third = F.col("doc_id") % 3
    tailed = (
        F.when(third == 0, F.concat("text", F.lit("\n\n  \nSee also \n"), "text"))
        .when(third == 1, F.concat("text", F.lit("\nSee also this\n"), "text"))
        .otherwise(F.concat("text", F.lit("\nNotes")))
    )
    return documents(spark, sf_dir, "text").select("doc_id", text.cut_tail(tailed).alias("text"))


@catalog.add(
    "cut_references",
    """SELECT doc_id, split_part(x, E'## References\\n\\n', 1) AS text
       FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || E'\\n## References\\n\\n' || text
               ELSE text || E'\\n## References\\n' || text END AS x FROM documents)""",
)
def cut_references(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 2 == 0, F.lit("\n## References\n\n")).otherwise(
        F.lit("\n## References\n")
    )
    papers = F.concat("text", mark, "text")
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_references(papers).alias("text"))


def _detok_sql(x: str) -> str:
    """The rewrite rules of the library, spelled for RE2."""
    for pattern, replacement in text.DETOK_RULES:
        pattern = pattern.replace(text.WS, WS_SQL).replace("'", "''")
        replacement = replacement.replace("$", "\\").replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


# Wiki-like lines made from the documents: section heads, spaced prose, and a title line
# before every tenth document.
WIKI_LINES_SQL = """(SELECT doc_id * 2 + 1 AS line, lang, CASE doc_id % 10
      WHEN 5 THEN '= = ' || source || ' = = ' || replace(text, ' ', ' @-@ ')
      WHEN 7 THEN '" ' || source || ' " ( ' || substr(text, 1, 40) || ' ) we '' re ' || text
      ELSE replace(replace(text, ',', ' ,'), '.', ' .') END AS text FROM documents
    UNION ALL SELECT doc_id * 2, lang, '= ' || source || ' =' FROM documents WHERE doc_id % 10 = 0)"""
DETOK_SQL = _detok_sql("text")


def wiki_lines(spark, sf_dir):
    kind = F.col("doc_id") % 10
    prose = (
        F.when(kind == 5, F.concat(F.lit("= = "), "source", F.lit(" = = "), F.replace("text", F.lit(" "), F.lit(" @-@ "))))
        .when(kind == 7, F.concat(F.lit('" '), "source", F.lit(' " ( '), F.substring("text", 1, 40), F.lit(" ) we ' re "), "text"))
        .otherwise(F.replace(F.replace("text", F.lit(","), F.lit(" ,")), F.lit("."), F.lit(" .")))
    )
    body = F.struct((F.col("doc_id") * 2 + 1).alias("line"), prose.alias("text"))
    head = F.struct(
        (F.col("doc_id") * 2).alias("line"), F.concat(F.lit("= "), "source", F.lit(" =")).alias("text")
    )
    lines = F.explode(F.when(kind == 0, F.array(head, body)).otherwise(F.array(body)))
    docs = documents(spark, sf_dir, "source", "lang", "text").select("lang", lines.alias("l"))
    return docs.select("l.line", "lang", "l.text")


@catalog.add("wikitext_detok", f"SELECT line, {DETOK_SQL} AS text FROM {WIKI_LINES_SQL}")
def wikitext_detok(spark, sf_dir):
    return wiki_lines(spark, sf_dir).select("line", text.wikitext_detok("text").alias("text"))
