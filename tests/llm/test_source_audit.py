"""Kept terms, divergences and ranks against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import CLASHES, lower, prose
from pyspark.sql import functions as F

from textloom.llm import arrays, source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def table(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string, doc_id long")
    for k, name in enumerate([*CLASHES, "term", "key", "part", "n", "all", "at", "entries"]):
        df = df.selectExpr("*", f"{k} AS `{name}`") if name not in df.columns else df
    return df.repartition(4)


def plain(rows, least=3, top=200):
    docs = [(TERM.findall(lower(t or "")), g or "", s or "") for t, g, s, _ in rows]
    within, counts = {}, {}
    for words, lang, source in docs:
        counts.setdefault((lang, source), Counter()).update(words)
        within.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang in within:
        kept = {t for t, n in within[lang].items() if n >= least}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (g, s), c in counts.items() if g == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def part(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c.get(t, 0) + 1) // total for t in kept}

        p = {s: part(c) for s, c in groups.items()}
        q = part(whole)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            found = [((p[s][t] - q[t]) ** 2 // q[t], t) for t, n in groups[s].items() if n and p[s][t] > q[t]]
            for name, items, most in (("pair", pairs, None), ("term", found, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, name, t, v, k + 1) for k, (v, t) in enumerate(items[:most])]
    return sorted(out)


def rows_of(seed, sources, n):
    rng = random.Random(seed)
    odd = ["é", "Éa", "日本語", "x" * 47, "x" * 48, "x" * 49, "y" * 768, "y" * 769, "z" * 20_000, "abcdef", "abcdefg", "abcdefgh", "AbC"]
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(0, 40)).split() + rng.choices(odd, k=rng.choice([0, 0, 2]))
        rng.shuffle(words)
        rows.append((rng.choice([" ", "-", "\x00"]).join(words), rng.choice(["en", "en", "de", None]), f"s{rng.randrange(sources)}", i))
    rows += [("only once here", "fr", "a", 1), ("nothing shared", "fr", "b", 2), (None, "it", "a", 3), ("", "it", None, 4)]
    rows += [("same words again", "es", None, 5)] * 3 + [("same", "es", "", 6), ("!!", "es", "c", None), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed,sources,n,kw", [(1, 4, 120, {}), (2, 150, 400, {"top": 3}), (3, 3, 60, {"least": 1, "widths": (1, 2)})])
def test_against_plain_version(spark, seed, sources, n, kw):
    """Also with sources in several blocks, and with short steps."""
    rows = rows_of(seed, sources, n)
    got = source_audit.source_divergence(table(spark, rows), **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, kw.get("least", 3), kw.get("top", 200))


def test_prefixes_do_not_decide_for_whole_terms(spark):
    """A prefix that many documents share keeps none of the rare terms behind it."""
    rows = [(f"prefixes{'abcdefgh'[i]} rarest{'xyz'[i % 3]}longer", "en", "s", i) for i in range(8)]
    rows += [("twice twice twice", "en", "s", 9), ("twice", "en", "t", 10)]
    kept = source_audit.kept_terms(table(spark, rows)).collect()
    # rarestxlonger and rarestylonger occur in three documents, rarestzlonger in two.
    assert sorted(r["term"] for r in kept) == ["rarestxlonger", "rarestylonger"]


def test_discarded_prefixes_are_not_extended(spark):
    """With a bitmap that lets everything through the result is the same."""
    rows = [(f"{'ab'[i % 2]}{'cdefghijk'[i]}lmnopqrstuvwx common", "en", "s", i) for i in range(9)]
    docs = table(spark, rows)
    want = [r["term"] for r in source_audit.kept_terms(docs).collect()]
    full, source_audit._bitmap = source_audit._bitmap, lambda keys: spark.sparkContext.broadcast(
        __import__("numpy").full(source_audit.BITMAP_BITS // 8, 255, "uint8"))
    try:
        got = [r["term"] for r in source_audit.kept_terms(docs).collect()]
    finally:
        source_audit._bitmap = full
    assert got == want == ["common"]


def test_large_counts_stay_exact(spark):
    parts = spark.range(1).select(
        source_audit._parts(F.lit(9 * 10**15), F.lit(9 * 10**15 + 7)).alias("a"),
        source_audit._parts(F.lit(0), F.lit(1)).alias("b"),
    ).first()
    assert tuple(parts) == (1 + 10**9 * (9 * 10**15 + 1) // (9 * 10**15 + 7), 1 + 10**9)


def test_long_text_and_no_rows(spark):
    rows = [("ab cd " * 400_000 + "q" * 1_500_000, "en", "s", i) for i in range(3)] + [("ab ab ef", "en", "t", 3)] * 3
    got = source_audit.source_divergence(table(spark, rows))
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert source_audit.source_divergence(table(spark, rows).limit(0)).collect() == []


def test_later_levels_take_long_terms_only():
    """A level looks at no term that an earlier one has settled; distinct keys need no sort."""
    batch = pa.record_batch([pa.array(["a bb ccc", "ccc dddd a", ""]), pa.array(["x", "y", "x"])], names=["text", "lang"])
    for longer, want in ((0, [("x", "a"), ("x", "bb"), ("x", "ccc"), ("y", "a"), ("y", "ccc"), ("y", "dddd")]),
                         (2, [("x", "ccc"), ("y", "ccc"), ("y", "dddd")]), (9, [])):
        (work,) = arrays.work(batch.column(0), 1 << 20)
        piece = source_audit._Piece(batch, *work, longer)
        names = piece.names.cast(pa.large_string()).to_pylist()
        assert sorted((piece.langs[int(l)].as_py(), names[t]) for l, t in zip(piece.lang, piece.term)) == want
    key = np.array([5, 1, 5, 0, 9])
    for most in (10, 1 << 40):
        found, place = source_audit._distinct(key, most)
        assert found.tolist() == [0, 1, 5, 9] and place.tolist() == [2, 1, 2, 0, 3]


class _All:
    value = np.full(1 << 10, 255, np.uint8)


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_pieces_of_a_task_are_summed(monkeypatch, held):
    """What a task gives out holds each key once, however many pieces its texts make, until it holds too much."""
    monkeypatch.setattr(source_audit, "PIECE_BYTES", 40)
    monkeypatch.setattr(source_audit, "HELD_ROWS", held)
    texts, langs, sources = ["a bb a ccc ccccc", "ccc a dddd", "", "bb a ?", "a a ccc"] * 3, list("xyxyx") * 3, list("stsst") * 3
    batch = pa.record_batch([pa.array(texts), pa.array(langs), pa.array(sources)], names=["text", "lang", "source"])
    counts, docs = Counter(), Counter()
    for text, lang, source in zip(texts, langs, sources):
        words = TERM.findall(text)
        counts.update((lang, w, source) for w in words)
        docs.update({(lang, w[:3].encode(), len(w) <= 3) for w in words})
    level = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("complete", pa.bool_()), ("docs", pa.int64())])
    count = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
    found = [r for b in source_audit._level_task(3, 0, None, level)(iter([batch, batch])) for r in b.to_pylist()]
    parts = [r for b in source_audit._count_task(_All, count)(iter([batch, batch])) for r in b.to_pylist()]
    got, summed = Counter(), Counter()
    for r in found:
        got[r["lang"], r["key"], r["complete"]] += r["docs"]
    for r in parts:
        for source, n in zip(r["source"], r["n"]):
            summed[r["lang"], r["term"], source] += n
    assert got == docs + docs and summed == counts + counts
    assert (len(found) == len(docs)) == (len(parts) == len({k[:2] for k in counts})) == (held > 1)


def test_counts_meet_kept_terms_without_a_sort(spark):
    rows = [("ab cd ab", "en", "s", i) for i in range(4)]
    docs = table(spark, rows).select("text", "lang", "source")
    counts = source_audit.term_counts(docs, source_audit.kept_terms(docs))
    assert "SortMergeJoin" not in counts._jdf.queryExecution().simpleString()
    assert sorted(map(tuple, counts.collect())) == [("en", "ab", "s", 8, 8), ("en", "cd", "s", 4, 4)]


def test_parts_at_the_end_of_longs(spark):
    """Parts are the same in longs and in decimals, and change over without an overflow."""
    ends = [0, 5, *(source_audit._FITTING + k for k in (-2, -1, 0, 1)), 10**12]
    rows = spark.createDataFrame([(c, t) for c in ends for t in (c + 1, c + 7, 3 * c + 2)], "count long, total long")
    parts = rows.select("count", "total", source_audit._parts(F.col("count"), F.col("total")).alias("part"))
    assert all(r.part == 1 + 10**9 * (r["count"] + 1) // r.total for r in parts.collect())
