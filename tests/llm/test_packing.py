import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SLOW = Tokenizer.from_file(PATH)
FAST = packing.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80) | st.text("ab 1'\n\té€“.,!st", max_size=200))
def test_same_ids_as_tokenizers(text):
    assert FAST(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000, "x <|endoftext|> y", "日本語 テキスト", "a\n" + " " * 600 + "b"])
def test_slow_path(text):
    assert not FAST.plain(text)
    assert FAST(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("fan_in,size", [(64, 1024), (2, 64)])
def test_every_id_lies_in_one_piece(spark, monkeypatch, fan_in, size):
    """Also with several rounds of merging."""
    monkeypatch.setattr(packing, "MERGE_FAN_IN", fan_in)
    docs = documents(spark).repartition(7)
    got = packing.pack_documents(docs, PATH, size=size, open_windows=4).collect()
    expected = collections.Counter()
    for key, text in texts():
        ids = SLOW.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), size):
            piece = np.array(ids[at : at + size], "<u4")
            expected[key, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert expected == collections.Counter(
        (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got
    )
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    got = packing.pack_documents(docs, PATH).groupBy("sequence_id").sum("length").collect()
    sizes = [r[1] for r in got]
    assert 1 - sum(sizes) / (1024 * len(sizes)) < 0.05


def test_best_fit():
    w = packing.OpenWindows(10, 2)
    assert [w.place(n) for n in (6, 7, 3, 4, 5, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    assert w.place(2) == (2, 5)
    assert w.place(4) == (4, 0)  # the fullest (window 3) was emitted
    assert {x for _, x in w.room} == {2, 4}


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), PATH).collect() == []
