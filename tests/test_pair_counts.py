"""Pair counts by differences against counting all words, and learning to the end against greedy learning."""

import random

import numpy as np
import pytest
from test_vocabulary import greedy, learn

from textloom.operators import pair_counts
from textloom.operators import vocabulary as bpe
from textloom.operators.symbols import SHIFT
from textloom.session import stage


def word_table(spark, seed, n=300, letters=6):
    rnd = random.Random(seed)
    rows = [(rnd.randint(1, 9), [rnd.randrange(letters) for _ in range(rnd.randint(0, 9))]) for _ in range(n)]
    return stage(spark.createDataFrame(rows, "n long, syms array<int>").repartition(3), "words")


@pytest.mark.parametrize("seed,most", [(1, 1000), (2, 12)])
def test_followed_counts_are_those_of_all_words(spark, seed, most):
    words = word_table(spark, seed)
    listed = pair_counts.PairList(words, 6, 2, most)
    assert listed.complete == (most == 1000) and len(listed.counts) <= most
    rnd, pending, symbols = random.Random(seed), [], 6
    for step in range(4):
        batch, used = [], set()
        for l, r in sorted(listed.counts, key=lambda p: (-listed.counts[p], p)):
            if not {l, r} & used and rnd.random() < 0.7 and len(batch) < 3:
                batch.append((l, r, symbols))
                symbols += 1
                used |= {l, r}
        pending.append(batch)
        listed.follow(pending)
        rows = pair_counts.count_pairs(words, pending).collect()
        want = {(r["l"], r["r"]): r["n"] for r in rows if r["n"] > listed.floor}
        assert listed.counts == want, step
        if step == 1:
            words, pending = bpe._restage(words, pending), []
            listed.rehold(words, symbols)
    listed.close()


def test_only_words_with_a_sought_pair_are_visited():
    syms = [[1, 2, 3], [2, 3], [1, 1, 2], [], [5], [3, 1, 2, 3]]
    flat = np.array([x for s in syms for x in s])
    ends = np.cumsum([0] + [len(s) for s in syms])
    held = {}
    for w, s in enumerate(syms):
        for pair in zip(s, s[1:]):
            held.setdefault((pair[0] << SHIFT) | pair[1], set()).add(w)
    keys = sorted(held)
    block = dict(
        n=np.ones(6, int), syms=flat, ends=ends, keys=np.array(keys),
        first=np.cumsum([0] + [len(held[k]) for k in keys]),
        held=np.array([w for k in keys for w in sorted(held[k])], np.int32),
    )
    which, words = pair_counts.touched_words(block, np.array([(1 << SHIFT) | 2, (9 << SHIFT) | 9]))
    assert which.tolist() == [0, 2, 5]
    assert words.syms.tolist() == [1, 2, 3, 1, 1, 2, 3, 1, 2, 3] and words.word.tolist() == [0] * 3 + [1] * 3 + [2] * 4
    which, words = pair_counts.touched_words(block, np.zeros(0, np.int64))
    assert not len(which) and not words.n


@pytest.mark.parametrize("list_size", [bpe.LIST_SIZE, 40])
def test_learning_until_no_pair_occurs_twice(spark, monkeypatch, list_size):
    """At the production size, which these words do not reach."""
    monkeypatch.setattr(bpe, "_STAGE_EVERY", 5)
    rnd = random.Random(12)
    syllables = "an be co du el fi go hu".split()
    words = {
        (" " + "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))).encode(): rnd.randint(1, 5) for _ in range(250)
    }
    tokens, merges = greedy(words, bpe.VOCAB_SIZE)
    assert len(merges) > 150 and len(tokens) < bpe.VOCAB_SIZE
    vocab = learn(spark, words, bpe.VOCAB_SIZE, list_size=list_size)
    assert (vocab.tokens, vocab.merges) == (tokens, merges)
