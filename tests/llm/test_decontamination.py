import random

import pytest
from cases import documents, prose, texts, words

from textloom.llm import decontamination

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


NAMELESS = "ten words that stand in an item without any id"


def bench_rows():
    rng = random.Random(9)
    rows = [(i, prose(rng, 30)) for i in range(8)]
    rows += [(20, texts()[0][1][5:400]), (21, "Short ITEM, here"), (22, "x"), (23, ""), (24, None), (25, rows[0][1])]
    return rows + [(None, "no id"), (20, rows[1][1]), (None, NAMELESS), (None, rows[2][1])]


def doc_rows():
    bench = dict(r for r in bench_rows() if r[1])
    rows = texts()
    rows += [(70, "before " + bench[2].upper() + " after"), (71, bench[3] + " " + bench[3]), (72, "a short-item HERE!")]
    rows += [(76, f"before {NAMELESS.upper()} after"), (77, "a text with no id")]
    rows += [(73, " ".join(bench[4].split()[:9])), (74, bench[0]), (75, "日本 " + bench[5] + " é")]
    return rows


def brute():
    windows = {}
    for item, text in bench_rows():
        w = words(WORD, text)
        if w:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).update([str(item)] if item is not None else [])
    out = []
    for key, text in doc_rows():
        w, hit, items = words(WORD, text), set(), set()
        for window, found in windows.items():
            n = len(window)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == window:
                    hit.update(range(k, k + n))
                    items |= found
        out.append((key, len(w), len(hit), sorted(items)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_against_brute_force(spark, block):
    """Also with the windows sent in several blocks."""
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    found = decontamination.find_hits(documents(spark, doc_rows()), bench, block=block)
    got = found.select("_c0", "_words", "_hit", "_items").collect()
    assert sorted(((r[0], r[1], r[2], list(r[3])) for r in got), key=repr) == brute()


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = documents(
        spark,
        [(1, "é: ONE two, three four five six seven eight nine ten eleven! end"), (2, "one two three"), (3, None)],
    )
    out = decontamination.remove_hits(docs, bench)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é: ! end", 2: "one two three", 3: None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "a b")])
    assert [(r._words, r._hit) for r in decontamination.find_hits(docs, none).collect()] == [(2, 0)]
    assert decontamination.find_hits(documents(spark, []), none).collect() == []
