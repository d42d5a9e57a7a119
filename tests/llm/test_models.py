import numpy as np
import pyarrow as pa
import pytest
from cases import documents
from pyspark.sql import functions as F

from textloom.llm import arrays, language, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(4).cache()


def test_language_of_the_held_out_fold(docs):
    network = language.learn(docs)
    rows = docs.withColumnRenamed("lang", "truth").withColumn("held_out", language.held_out())
    out = language.predict(rows, network).filter("held_out AND n_chars > 40").collect()
    assert len(out) > 200
    assert sum(r.lang_pred == r.truth for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_awkward_rows(spark, docs):
    network = language.learn(docs)
    odd = documents(spark)
    out = language.predict(odd, network)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert set(out.columns) == set(odd.columns) and len(out.collect()) == odd.count()
    for text in (None, "", " \n\t ", "\x00\x00"):
        assert {v for (_, t), v in got.items() if t == text} == {("und", 0.0)}
    assert got[54, "ÄÖ é 日本 😀"][0] in network.languages
    assert language.predict(odd.limit(0), network).collect() == []


def test_few_texts_with_very_many_copies(spark, monkeypatch):
    """Every language is learned, and copies do not fill the sample."""
    texts = [(f"text {k} of language {k % 30}", f"l{k % 30:02d}") for k in range(90)]
    one = spark.createDataFrame(texts, "text string, label string")
    rows = one.crossJoin(spark.range(2_000).select()).repartition(4)
    network = language.train_network(rows)
    assert network.languages == [f"l{k:02d}" for k in range(30)]
    sample = language.training_sample(rows).collect()
    assert sorted(map(tuple, sample)) == sorted(texts)
    fewer = language.training_sample(rows, 1).collect()
    assert {r.label for r in fewer} == set(network.languages) and len(fewer) < 90
    monkeypatch.setattr(language, "SAMPLE_ALL", 10)
    least = language.training_sample(rows).collect()
    assert {r.label for r in least} == set(network.languages) and len(least) < 60


def test_nothing_learned(spark):
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.learn(none) is None
    assert language.predict(none, None).first().lang_pred == "und"


def test_network_pooling_matches_plain_convolution():
    network = language.Network(["a", "b"])
    network.start()
    text = np.frombuffer(b"some text of a window, no more", np.uint8)
    _, start, held = language.place_windows(np.array([0, len(text)]))
    windows = language.read_windows(text, start, held)
    pooled, _ = network.pooled(windows)
    k = 0
    for width in language.WIDTHS:
        for _ in range(language.FILTERS):
            f = network.filters[: width * language.EMBEDDING, k]
            seen = [
                network.embedding[windows[0, i : i + width]].reshape(-1) @ f
                for i in range(language.WINDOW - max(language.WIDTHS) + 1)
            ]
            assert abs(max(0, max(seen)) - pooled[0, k]) < 1e-4
            k += 1


def test_quality_of_the_held_out_fold(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    out = quality.score(docs.join(labels, "doc_id"), model).filter(quality.held_out()).collect()
    good = [r.score for r in out if r.quality == 1]
    bad = [r.score for r in out if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in out]) > 0.93


def test_quality_of_awkward_rows(spark, docs):
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    odd = documents(spark)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    assert quality.score(odd.limit(0), model).collect() == []


def test_quality_with_one_label_or_none(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn(docs, labels) is None
    assert quality.score(docs.limit(1), None).first().score == 0.5
    one = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.learn(docs, one) is None


def test_quality_sample_is_bounded_in_rows_and_bytes(spark, docs, monkeypatch):
    """Repeated rows count once; long texts are thinned out or left out."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = []
    monkeypatch.setattr(quality, "train_model", lambda rows: seen.append(rows.collect()))
    quality.learn(docs, labels)
    copies = docs.filter("doc_id < 100")
    quality.learn(docs.unionByName(copies).unionByName(copies), labels)
    assert len(seen[0]) == len(seen[1])
    size = sum(len(r.text.encode()) for r in seen[0])
    quality.learn(docs, labels, most_bytes=size // 2)
    thinned = sum(len(r.text.encode()) for r in seen[2])
    assert 0 < thinned < 0.75 * size
    assert max(len(r.text.encode()) for r in seen[2]) <= size // 32
    quality.learn(docs, labels, most=20)
    assert 0 < len(seen[3]) < 45


def test_dual_descent_separates():
    rng = np.random.default_rng(3)
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    rows = [np.array([1 if t > 0 else 2, int(rng.integers(3, 9))], np.int32) for t in y]
    w, bias = quality.dual_descent(rows, [np.ones(2)] * 80, y)
    assert all(t * (w[r].sum() + bias) > 0 for r, t in zip(rows, y))


def test_indicators_never_cross_texts():
    column = pa.array(["abc", "abd", "", None, "a"])
    data, bounds = arrays.utf8(column)
    bucket, owner = quality.indicators(data, bounds)
    alone = [set(quality.indicators(*arrays.utf8(pa.array([t])))[0].tolist()) for t in column]
    assert [set(bucket[owner == k].tolist()) for k in range(5)] == alone


def test_words_by_pieces():
    table = np.zeros(256, bool)
    table[97:123] = True
    data, bounds = arrays.utf8(pa.array(["ab c", "", "d", "!e", None, "f "]))
    starts, ends, count = arrays.words(data, bounds, table)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"c", b"d", b"e", b"f"]
    assert count.tolist() == [2, 0, 1, 1, 0, 1]
    prefix = arrays.prefix_hash(np.frombuffer(b"xabyyab", np.uint8))
    h = arrays.range_hash(prefix, np.array([1, 5, 2]), np.array([3, 7, 4]))
    assert h[0] == h[1] != h[2]
