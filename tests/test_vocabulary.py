"""BPE learning, encoding and decoding against greedy learning and the public library."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import symbols
from textloom.operators import vocabulary as bpe


def greedy(words: dict[bytes, int], size: int, specials=bpe.SPECIAL_TOKENS, least=2):
    """One merge at a time, recounting every time."""
    alphabet = sorted({b for w in words for b in w}, key=bpe._byte_order)
    tokens = [s.encode() for s in specials] + [bytes([b]) for b in alphabet]
    ids = {t: i for i, t in enumerate(tokens) if i >= len(specials)}
    table = [([ids[bytes([b])] for b in w], n) for w, n in words.items()]
    merges = []
    while len(tokens) < size:
        counts = Counter()
        for syms, n in table:
            for pair in zip(syms, syms[1:]):
                counts[pair] += n
        if not counts:
            break
        (l, r), n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        made = tokens[l] + tokens[r]
        if made not in ids:
            ids[made] = len(tokens)
            tokens.append(made)
        merges.append((l, r, ids[made]))
        for syms, _ in table:
            i = 0
            while i < len(syms) - 1:
                if syms[i] == l and syms[i + 1] == r:
                    syms[i : i + 2] = [ids[made]]
                i += 1
    return tokens, merges


def learn(spark, words, size, **kw):
    df = spark.createDataFrame([(w.decode(), n) for w, n in words.items()], "word string, n long")
    return bpe.learn_bpe(df, size, **kw)


@pytest.mark.parametrize("seed", range(6))
def test_learns_the_greedy_merges(spark, seed):
    rnd = random.Random(seed)
    letters = ["ab", "abc", "abcdef", "aab", "abcdefghij"][seed % 5]
    words = {
        "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))).encode(): rnd.randint(1, 4)
        for _ in range(120)
    }
    tokens, merges = greedy(words, 70)
    for list_size in (5000, 3):
        vocab = learn(spark, words, 70, list_size=list_size)
        assert vocab.tokens == tokens
        assert vocab.merges == merges


def test_strict_rounds_give_the_same(spark, monkeypatch):
    """A token made twice sends learning into strict rounds; force them early."""
    rnd = random.Random(3)
    words = {
        "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 10))).encode(): rnd.randint(1, 5)
        for _ in range(100)
    }
    tokens, merges = greedy(words, 60)
    choose, calls = bpe._choose, []

    def alarm(top, known, names, strict):
        calls.append(strict)
        if not strict and len(calls) == 5:
            return [], True
        return choose(top, known, names, strict)

    monkeypatch.setattr(bpe, "_choose", alarm)
    vocab = learn(spark, words, 60)
    assert any(calls) and vocab.tokens == tokens and vocab.merges == merges


def test_settled_merges_are_fixed_in_between(spark, monkeypatch):
    rnd = random.Random(8)
    words = {
        "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 10))).encode(): rnd.randint(1, 9)
        for _ in range(100)
    }
    monkeypatch.setattr(bpe, "_SETTLE", 5)
    vocab = learn(spark, words, 60)
    assert (vocab.tokens, vocab.merges) == greedy(words, 60)


def test_matches_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    lib = tokenizers.Tokenizer(tokenizers.models.BPE())
    lib.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel()
    lib.train_from_iterator(
        texts,
        tokenizers.trainers.BpeTrainer(
            vocab_size=600, min_frequency=2, special_tokens=list(bpe.SPECIAL_TOKENS), show_progress=False
        ),
    )
    vocab = bpe.learn_bpe(bpe.pretoken_counts(docs), 600)

    def spelled(i, token):
        return token.decode() if i < 4 else "".join(chr(bpe._byte_order(b)) for b in token)

    names = [spelled(i, t) for i, t in enumerate(vocab.tokens)]
    model = json.loads(lib.to_str())["model"]
    assert {t: i for i, t in enumerate(names)} == model["vocab"]
    assert [[names[l], names[r]] for l, r, _ in vocab.merges] == [list(m) for m in model["merges"]]

    odd = [
        "foo</s>bar <s></s> x", "</s>", "", " ", "  a  b\n\n c\t\t", "it's we'll  <pad>", "a <s> b",
        "　x y ½", "aaaaaaa aaaaa", "żé日本", "x\n\n<unk>\n y", "<s", "<<s>>", "a\x1cb \x85 c",
    ]
    rows = spark.createDataFrame(list(enumerate(texts + odd)), "i int, text string")
    got = bpe.tokenize(rows, vocab).orderBy("i").collect()
    want = lib.encode_batch(texts + odd, add_special_tokens=False)
    assert [r["ids"] for r in got] == [e.ids + [1] for e in want]

    lib.decoder = tokenizers.decoders.ByteLevel()
    back = bpe.detokenize(bpe.tokenize(rows, vocab, eos=None), vocab).orderBy("i").collect()
    assert [r["text"] for r in back] == [lib.decode(e.ids) for e in want]


def toy(spark):
    return learn(spark, {b"ab": 5, b"abc": 3, b" ab": 4, b" c": 2}, 20)


def test_unseen_bytes_are_dropped_and_counted(spark):
    vocab = toy(spark)
    rows = spark.createDataFrame([("zab é",), ("ab",)], "text string")
    back = bpe.detokenize(bpe.tokenize(rows, vocab), vocab).collect()
    assert [r["text"] for r in back] == [" ab ", " ab"]
    assert [r[0] for r in rows.select(bpe.dropped_bytes(vocab)).collect()] == [3, 0]


def test_special_tokens_as_plain_text(spark):
    rows = spark.createDataFrame([("ab</s>ab",)], "text string")
    words = rows.select(bpe.pretokenize("text").alias("p"), bpe.pretokenize("text", "split").alias("s"))
    plain, split = words.first()
    assert plain == [" ab", "</", "s", ">", "ab"]
    assert split == [" ab", "</s>", " ab"]
    with pytest.raises(ValueError):
        bpe.pretokenize("text", "other")


def test_tables_round_trip(spark):
    vocab = toy(spark)
    again = bpe.Vocabulary.from_tables(vocab.vocab_table(spark), vocab.merge_table(spark))
    assert (again.tokens, again.merges, again.specials) == (vocab.tokens, vocab.merges, vocab.specials)
    words = spark.createDataFrame([("abab",), ("",), ("</s>",)], "word string")
    ids = [r["ids"] for r in bpe.encode_words(words, again).collect()]
    assert ids[1] == [] and ids[2] == [1]
    assert b"".join(vocab.tokens[i] for i in ids[0]) == b"abab"


def test_nothing_to_learn(spark):
    vocab = learn(spark, {b"a": 3, b"b": 1}, 50)
    assert vocab.merges == [] and vocab.size() == 6


def test_own_special_tokens(spark):
    """Also ones with characters that mean something in a pattern, and one inside another."""
    specials = ("<a>", "<e>", "[x]", "<e><e>")
    df = spark.createDataFrame([("ab", 9)], "word string, n long")
    vocab = bpe.learn_bpe(df, 10, specials=specials)
    rows = ["ab<e>ab", "[x]", "<e><e>ab", None, "", "ab"]
    docs = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    got = {r["i"]: r["ids"] for r in bpe.tokenize(docs, vocab).collect()}
    ab = got[5][:-1]
    assert got[0] == [*ab, 1, *ab, 1]
    assert got[1] == [2, 1] and got[2] == [3, *ab, 1]
    assert 3 not in got and got[4] == [1]


def test_vocabulary_bound(spark):
    df = spark.createDataFrame([("ab", 9)], "word string, n long")
    assert bpe.learn_bpe(df, 100_000).size() > 0
    with pytest.raises(ValueError):
        bpe.learn_bpe(df, bpe.MAX_VOCAB + 1)


def test_decoding_of_broken_bytes(spark):
    tokens = [s.encode() for s in bpe.SPECIAL_TOKENS] + ["é".encode()[:1], "é".encode()[1:], b"a"]
    vocab = bpe.Vocabulary(tokens)
    rows = [[4, 5, 6, 1], [4], [], None, [0, 6]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<int>")
    got = {r["i"]: r["text"] for r in bpe.detokenize(df, vocab).collect()}
    assert got == {0: "éa", 1: "\ufffd", 2: "", 3: None, 4: "a"}


def test_batches_are_coded_in_spans(monkeypatch):
    """Ids and texts are those of rows taken alone, however few are put together at once."""
    import pyarrow as pa

    vocab = bpe.Vocabulary([b"<s>", b"</s>", b"a", b"b", b"\xc3", b"\xa9", b"ab", b"\xc3\xa9"], [(2, 3, 6), (4, 5, 7)], [2, 2], ("<s>", "</s>"))
    encoder = bpe._Encoder(vocab.tokens, vocab.merges, vocab.specials)
    decoder = bpe._Decoder(vocab.tokens, 2)
    rng = random.Random(5)
    docs = [[rng.choice(["ab", "ba", "é", "</s>", "x", "abab" * 9]) for _ in range(rng.choice([0, 1, 7, 40]))] for _ in range(60)]
    docs = pa.array([["unused"], *docs], pa.list_(pa.string())).slice(1)
    alone = [encoder.documents(docs.slice(i, 1), True, 1)[0].as_py() for i in range(60)]
    for most in (1, 13, 1 << 20):
        monkeypatch.setattr(bpe, "WORK_ITEMS", most)
        coded = encoder.documents(docs, True, 1)
        assert coded.to_pylist() == alone
        ids = pa.array([*alone[:30], None, *alone[30:], [4, 2]], pa.list_(pa.int32()))
        texts = decoder.texts(ids).to_pylist()
        assert texts[30] is None and texts[-1] == "�a"
        want = ["".join(w for w in d if w not in ("</s>", "x")) for d in docs.to_pylist()]
        assert texts[:30] + texts[31:-1] == want
    assert encoder.documents(docs.slice(0, 0), True, 1).to_pylist() == [] == decoder.texts(ids.slice(0, 0)).to_pylist()


def test_decoding_memory_does_not_follow_the_batch():
    import tracemalloc

    import pyarrow as pa

    decoder = bpe._Decoder([b"", b"", *[bytes([97 + i]) * 4 for i in range(20)]], 2)
    peaks = []
    for rows in (1_000, 4_000):
        ids = pa.array([[2 + i % 20 for i in range(1000)]] * rows, pa.list_(pa.int32()))
        tracemalloc.start()
        assert len(decoder.texts(ids)) == rows
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 100e6


def test_only_distinct_units_are_pretokenized(spark):
    """Texts are cut before spaces between two characters that are no white space; equal units are one row."""
    import pyarrow as pa

    white = "\t \n\x0b\x85\xa0\u1680\u2000\u200a\u2028\u202f\u205f\u3000"
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(white + "    aé\u0420\xe0\u4e00\U0001f600\x1c1'") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", "one two", " two", "x" * 50, None]
    cut = [u for part in symbols.units(pa.array(texts)) for u in part.to_pylist()]
    want = [re.sub(f"(?<=[^{white}]) (?=[^{white}])", "\0 ", t).split("\0") for t in texts if t]
    assert cut == [u for w in want for u in w]

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = df.select(F.explode(bpe.pretokenize("text")).alias("word")).groupBy("word").count()
    for length in (1 << 16, 7):
        assert sorted(bpe.pretoken_counts(df, length=length).collect()) == sorted(plain.collect())
    (counted,) = bpe._count_units(iter([pa.record_batch([pa.array(["one two two", " two two", "one"] * 1000)], names=["text"])]))
    assert dict(zip(*counted.to_pydict().values())) == {"one": 2000, " two": 4000}
