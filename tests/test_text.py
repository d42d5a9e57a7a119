"""Text and language functions against plain Python statements of the rules."""

import math
import random
import re

import pytest

from textloom.functions import lang, text
from textloom.sources.manifest import size_in_gb


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["y"] for r in rows.select("i", expr.alias("y")).orderBy("i").collect()]


SPACES = ["", " ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "\n \n"]


def soup(words, n, seed):
    rnd = random.Random(seed)
    return [
        "".join(rnd.choice(words) + rnd.choice(SPACES) for _ in range(rnd.randint(0, 14)))
        for _ in range(n)
    ]


def test_trim(spark):
    texts = soup(["a", "​b", "x y", ""], 300, 1)
    assert column(spark, texts, text.utrim("t")) == [t.strip() for t in texts]


def test_trim_long_inner_run(spark):
    t = " a" + " " * 200_000 + "b "
    assert column(spark, [t], text.utrim("t")) == [t.strip()]


def test_cut_tail(spark):
    names = "|".join(text.TAIL_HEADINGS)
    pattern = re.compile(rf"^\s*(?:{names})\s*$", re.MULTILINE)

    def cut(t):
        m = pattern.search(t)
        return t[: m.start()] if m else t

    texts = soup(["body", "See also", "Notes", "References", "Notes on", "x"], 800, 2)
    texts += ["Notes", "See also\r\n", "in a sentence See also here", "a\n\n\n  Notes  \n\nb", "a\nNotes\n"]
    assert column(spark, texts, text.cut_tail("t")) == [cut(t) for t in texts]


def test_cut_references(spark):
    texts = ["a## References\n\nb## References\n\nc", "a## References\nb", "", "## References\n\n"]
    want = [t.split("## References\n\n")[0] for t in texts]
    assert column(spark, texts, text.cut_references("t")) == want


def python_rules():
    """The same rules in Python's syntax: its white space is one class there."""
    for pattern, replacement in text.DETOK_RULES:
        yield re.compile(pattern.replace(text.WS, r"\s")), replacement.replace("$1", r"\1")


def test_detok(spark):
    words = ["=", "= Title =", "= = Sec = =", "we", "'re", "'", '"', "(", ")", "[", "]", ",", ".", "@,@", "@-@", "1", "000", "s", "s ' "]
    texts = [t.strip() for t in soup(words, 800, 3)]
    texts += ["= Robert =", "= = Early life = =", "1 @,@ 000 people", '" Hello " , he said', "players ' union", "= A = b ="]

    def rewrite(t):
        for pattern, replacement in python_rules():
            t = pattern.sub(replacement, t)
        return t

    assert column(spark, texts, text.wikitext_detok("t")) == [rewrite(t) for t in texts]


def test_input_target(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([7],)], "s array<int>")
    a, b = text.input_target("s")
    got = [(r["a"], r["b"]) for r in rows.select(a.alias("a"), b.alias("b")).collect()]
    assert got == [([1, 2], [2, 3]), ([], [])]


def counts(**found):
    return {k: found.get(k, 0) for k in LANGUAGES}


LANGUAGES = [k for k in lang.LABELS if k != "Uncertain"]

# Words counted by hand: whole words in any case, in the sample of the text.
COUNTED = [
    ("", counts()),
    ("THE cat, the dog and The bird", counts(English=4)),
    ("of-the the_of ofthe", counts(English=2)),
    ("the " * 500, counts(English=500)),
    ("x" * 5000 + " the and of", counts()),  # beyond the sample of a long text
    ("the and " + "x" * 5000, counts(English=2)),
]


def test_stopword_counts(spark):
    got = column(spark, [t for t, _ in COUNTED], lang.stopword_counts("t"))
    for (text, expected), found in zip(COUNTED, got):
        assert found["English"] == expected["English"], text[:40]


def test_scores_are_counts_per_hundred_characters(spark):
    texts = ["the cat", "the " * 60, "x" * 300]
    for text, score in zip(texts, column(spark, texts, lang.lang_scores("t"))):
        assert score["Uncertain"] == 1.0
        assert score["English"] == pytest.approx(100 * text.split().count("the") / len(text))


def test_probabilities_are_a_softmax(spark):
    texts = ["the cat and the dog of the house", "zzz", "et les chats de la maison", "", "the " * 2000]
    scores = column(spark, texts, lang.lang_scores("t"))
    probs = column(spark, texts, lang.lang_probs("t"))
    ranked = column(spark, texts, lang.lang_ranked("t"))
    for score, p, order in zip(scores, probs, ranked):
        assert sum(p.values()) == pytest.approx(1)
        for a in p:  # ratios of a softmax are powers of e
            assert p[a] / p["Uncertain"] == pytest.approx(math.exp(score[a] - 1.0))
        listed = [r["p"] for r in order]
        assert listed == sorted(listed, reverse=True) and {r["lang"] for r in order} == set(p)


def test_ascii_ratio_and_filter(spark):
    texts = ["a" * 98 + "éé", "a" * 99 + "é", "é" * 3, "a" * 1024 + "é" * 9, None, ""]
    ratios = column(spark, texts, lang.ascii_ratio("t"))
    assert ratios == [0.98, 0.99, 0.0, 1.0, None, None]
    rows = spark.createDataFrame([(t,) for t in [*texts, "the cat is in the house and it is on"]], "text string")
    kept = [r["text"] for r in lang.english_filter(rows).collect()]
    assert kept == ["the cat is in the house and it is on"]


def test_english_filter_is_subset_of_ascii(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ascii_ids = {r[0] for r in docs.filter(lang.ascii_ratio("text") > 0.98).select("doc_id").collect()}
    english = {r[0] for r in lang.english_filter(docs).select("doc_id").collect()}
    assert english and english < ascii_ids


def test_sizes(spark):
    rows = spark.createDataFrame([("0.3 GB",), ("15.8 TB",), ("327 GB",)], "t string")
    got = [r[0] for r in rows.select(size_in_gb("t")).collect()]
    assert got == pytest.approx([0.3, 15800.0, 327.0])
