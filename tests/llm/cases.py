"""Documents with awkward values, and plain versions of word rules, shared by the tests."""

import random
import re

#: Columns that clash with names used inside the operators.
CLASHES = ("_key _text _c0 _words class node score lang_pred pii held_out text_crc32 h c task "
           "window label kept count _pii _pii0 _PII3 _pii5 place").split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(rng, n):
    syllables = "an be co du el fi go hu in ja ko lu".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def texts(seed=3):
    """(doc_id, text): copies, near copies, a shared passage, empty, null, odd and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(12)]
    passage = prose(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, base[0]) for i in range(4)]
    for i in range(6):
        words = base[1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((30 + i, " ".join(words)))
    rows += [(40 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 15)) for i in range(5)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "x"), (54, "ÄÖ é 日本 😀"), (55, "\x00\x00")]
    rows += [(60, prose(rng, 6_000)), (61, "ab " * 3_000), (62, "z" * 20_000)]
    rows += [(None, base[2]), (None, None), (7, base[7]), (7, base[7]), (8, "other text for one id")]
    return rows


def documents(spark, rows=None, clashes=True):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clashes:
        for k, name in enumerate(CLASHES):
            df = df.selectExpr("*", f"{k} AS `{name}`")
    return df.repartition(3)


def words(pattern, text):
    return re.findall(pattern, lower(text or ""))
