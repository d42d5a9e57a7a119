"""Skip list ranks, outputs and round trips against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from cases import documents, texts
from pyspark.sql import functions as F

from textloom.llm import fill_in_middle as fim


def piece(rows):
    data = [t.encode() for t in rows]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), bounds


def test_every_rank_of_a_skip_list():
    rows = ["", "a", "äö😀x", "", "one  two\tthrée ", " lead", "z" * 700, "日本 " * 90, ""]
    data, bounds = piece(rows)
    for unit in ("code_point", "word"):
        lanes = fim.SkipList(data, bounds, unit)
        assert len(lanes.lanes) > 3 and sum(x.units.sum() > 0 for x in lanes.lanes) == len(lanes.lanes)
        for k, t in enumerate(rows):
            if unit == "code_point":
                units = list(t)
            else:
                units = [t[a:b] for a, b in zip(*word_cuts(t))]
            assert lanes.sizes[k] == len(units)
            ranks = np.arange(len(units) + 1)
            points, places = lanes.find(np.full(len(ranks), k), ranks)
            upto = ["".join(units[:r]) for r in ranks]
            assert points.tolist() == [len(u) for u in upto]
            assert places.tolist() == [len(u.encode()) for u in upto]


def word_cuts(t):
    ws = "\t\n\x0b\x0c\r "
    starts = [i for i in range(len(t)) if i == 0 or (t[i] not in ws and t[i - 1] in ws)]
    return starts, starts[1:] + [len(t)]


def test_lanes_thin_out():
    data, bounds = piece(["x" * 50_000])
    sizes = [len(lane.units) for lane in fim.SkipList(data, bounds).lanes]
    assert sizes[-1] == 50_001 and 5 < len(sizes) < 14
    assert all(a <= b for a, b in zip(sizes, sizes[1:])) and sizes[-2] < 14_000


def plain(key, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def rows_with_marks():
    rng = random.Random(2)
    rows = texts() + [(300 + i, "".join(rng.choices("<>PSM é😀", k=rng.randint(1, 12)))) for i in range(150)]
    return rows + [(500, "a <P> b"), (501, "<M>"), (502, "x<S>"), (503, "<p>"), (504, "é😀" * 1_500_000)]


def test_against_plain_version(spark):
    rows = rows_with_marks()
    out = fim.fill_in_middle(documents(spark, rows))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_words_as_units(spark):
    text = "one two  three four\nfive " * 20
    out = fim.fill_in_middle(spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string"), unit="word")
    starts = {*word_cuts(text)[0], len(text)}
    for r in out.filter("form != 'plain'").collect():
        assert r["n"] == 100
        assert r["prefix_chars"] in starts and r["prefix_chars"] + r["middle_chars"] in starts
    with pytest.raises(ValueError):
        fim.unit_starts(*piece(["x"]), "line")


def test_no_rows(spark):
    assert fim.fill_in_middle(documents(spark).limit(0)).collect() == []
