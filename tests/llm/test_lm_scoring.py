"""Token counts, exact base scores and filter scores against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents, prose, texts, words

from textloom.llm import lm_scoring, quality

WORD = r"[^\x20\x09-\x0D]+"
END = object()


def learned_rows(rows):
    return [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]


def tokens(text):
    return [*words(WORD, text), END]


def plain(rows):
    """What every row should give, counts read at their levels but without a wrong answer."""
    single, pair = Counter(), Counter()
    for t in learned_rows(rows):
        w = tokens(t)
        single.update(w)
        pair.update(zip([END, *w], w))
    total, distinct = sum(single.values()), len(single)
    room = total + 0.1 * (distinct + 1)
    least = lm_scoring.thresholds()
    value = lm_scoring.estimates(least)

    def at_level(c):
        return value[np.searchsorted(least, c, "right")]

    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((single[x] + 0.1) / room) for x in w)
        score = 0.0
        for a, b in zip([END, *w], w):
            alone = (at_level(single[b]) + 0.1) / room
            s = lm_scoring.STRENGTH
            score += math.log10((at_level(pair[a, b]) + s * alone) / (at_level(single[a]) + s))
        out.append((i, len(w), sum(single[x] > 0 for x in w), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    docs = documents(spark, rows)
    found = lm_scoring.score_texts(docs, ~quality.held_out(folds=10), **kw)
    assert found.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted(((*r[:4], round(r[4], 6), round(r[5], 6)) for r in found.collect()), key=repr)


def rows_with_odd_words():
    rows = texts() + [(i, prose(random.Random(i), 30)) for i in range(100, 160)]
    return rows + [(200, "\x1c a\x0bb\x0cc\x85d \xa0 e　f"), (201, "ÀÉ Àé \x00 x"), (202, "퟿\U0001f600")]


@pytest.mark.parametrize("kw", [{}, {"segment_bytes": 64, "frequent_bytes": 200}, {"frequent_bytes": 0}])
def test_against_plain_version(spark, kw, monkeypatch):
    """With so many questions that no answer is wrong; also in many segments, and with most words joined."""
    monkeypatch.setattr(lm_scoring, "BLOCK_GRAMS", 500)
    rows = rows_with_odd_words()
    assert got(spark, rows, probes=50, **kw) == plain(rows)


def test_few_wrong_answers_with_the_usual_filter(spark):
    rows = rows_with_odd_words()
    want = plain(rows)
    found = got(spark, rows)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    apart = [abs(a[5] - b[5]) / a[1] for a, b in zip(found, want)]
    assert np.mean(apart) < 0.08 and all(r[5] < 0 for r in found)


def test_levels_are_never_too_low():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 1 << 48, 40_000).astype(np.uint64)
    count = rng.zipf(1.5, len(key)).clip(max=10**9).astype(np.int64)
    bits = lm_scoring.build_block(key, count)
    segment = lm_scoring.Segment(0, np.array([0, len(bits)]), bits, lm_scoring.PROBES)

    class Sent:
        value = segment

    model = lm_scoring.CountFilter([Sent()], [0], 1)
    level = np.searchsorted(lm_scoring.thresholds(), count, "right")
    read = model.levels(key)
    assert (read >= level).all() and (read > level).mean() < 0.08
    other = rng.integers(0, 1 << 48, 40_000).astype(np.uint64)
    assert 0.03 < (model.levels(other) > 0).mean() < 0.09
    assert model.levels(key, np.minimum(level, 2)).max() == 2


def test_level_estimates():
    least = lm_scoring.thresholds()
    value = lm_scoring.estimates(least)
    count = np.array([0, 1, 2, 3, 10, 1000, 10**6])
    read = value[np.searchsorted(least, count, "right")]
    assert (read[:4] == count[:4]).all() and (np.abs(read - count) <= 0.25 * count).all()


def test_bits_grow_with_what_was_counted(spark):
    small = documents(spark, texts(), clashes=False).select("text")
    large = documents(spark, texts() + [(i, prose(random.Random(i), 300)) for i in range(900, 1000)], clashes=False).select("text")
    sizes = [
        sum(len(s.value.data) for s in lm_scoring.build_filter(d, 10_000).segments) for d in (small, large)
    ]
    assert sizes[1] > 2 * sizes[0]


def test_nothing_learned_and_no_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "a b"), (2, None)])
    found = lm_scoring.score_texts(docs, F.lit(False)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm_scoring.score_texts(docs.limit(0), F.lit(True)).collect() == []


def test_texts_like_the_corpus_score_higher(spark):
    """Held out texts: pairs seen before beat the same words in another order."""
    rng = random.Random(5)
    lines = [prose(rng, 8) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(lines, k=6))) for i in range(400)]
    shuffled = []
    for i, t in rows[:60]:
        w = t.split()
        rng.shuffle(w)
        shuffled.append((i + 1000, " ".join(w)))
    out = {r[0]: r for r in got(spark, rows + shuffled)}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    assert all(out[i][5] > out[i][4] for i in held)
    assert np.mean([out[i][5] / out[i][1] for i in held]) > np.mean([out[i][5] / out[i][1] for i, _ in shuffled]) + 0.3
