"""Registered queries against their SQL and against plain versions, and the pipeline."""

import itertools
import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from cases import CLASHES, words
from oracle import connect, difference

import __spark_entry__ as contract
from textloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert difference(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF) is None


def test_all_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names


def test_held_out_folds(spark, docs):
    for name, folds, fold in (("op3_quality", 5, 0), ("op4_language", 3, 1)):
        got = queries.QUERIES[name](spark, SF).toPandas()
        assert sorted(got["doc_id"]) == sorted(docs.index)
        expected = [zlib.crc32(str(i).encode()) % folds == fold for i in got["doc_id"]]
        assert got["held_out"].tolist() == expected
        assert got["score"].between(0, 1).all()
        if name == "op3_quality":
            assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_op8_columns(spark, docs):
    got = queries.op8_sharding(spark, SF).toPandas()
    assert set(got["law"]) == {"key"}
    for r in got.itertuples():
        data = docs.loc[r.doc_id, "text"].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 24)


def first_of_each(texts):
    """Smallest id of every group that links at 80 per cent of five-word shingles join."""
    sets = {}
    for i, t in texts.items():
        w = words(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in texts}


def test_near_duplicates_count_five_words():
    """Pairs between the rules of four and of five words, and chains, by the plain version itself."""
    base = [f"w{k}" for k in range(80)]
    near = ["x" if k in (20, 60) else w for k, w in enumerate(base)]
    assert first_of_each({1: " ".join(base), 2: " ".join(near)}) == {1, 2}  # 66 of 86
    once = ["x" if k == 20 else w for k, w in enumerate(base)]
    assert first_of_each({1: " ".join(base), 2: " ".join(once), 3: "a b"}) == {1, 3}  # 71 of 81


def test_near_duplicate_stage_counts_five_words(spark):
    base = [f"w{k}" for k in range(80)]
    rows = {1: base, 2: ["x" if k in (20, 60) else w for k, w in enumerate(base)]}
    rows[3] = ["x" if k == 40 else w for k, w in enumerate([f"v{k}" for k in range(80)])]
    rows[4] = [f"v{k}" for k in range(80)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, SF).collect()}
    assert kept == first_of_each({i: " ".join(w) for i, w in rows.items()}) == {1, 2, 3}


def test_pipeline_stage_by_stage(spark, docs):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    columns = rows.columns
    kept = {}
    for name, fn in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.stage(fn(spark, rows, SF), name)
        assert rows.columns == columns
        kept[name] = rows.toPandas().set_index("doc_id")
    assert set(kept["language"].index) == set(docs.index)  # every text here has a language
    assert set(kept["near_dedup"].index) == first_of_each(kept["language"]["text"].to_dict())
    hits = queries.op10_decontamination(spark, SF).toPandas().set_index("doc_id")
    for i, r in kept["decontamination"].iterrows():
        assert (r["text"] == docs.loc[i, "text"]) == (not hits.loc[i, "contaminated"])
        assert r["n_chars"] == len(r["text"])
    spans = queries.op6_pii(spark, SF).toPandas().set_index("doc_id")["spans"]
    for i, r in kept["pii"].iterrows():
        if not hits.loc[i, "contaminated"]:
            assert (r["text"] == docs.loc[i, "text"]) == (spans[i] == "")
    pieces = corpus_pipeline.packed(spark, rows, SF).toPandas()
    assert set(pieces["doc_id"]) == set(kept["pii"].index)
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 1024


def test_pipeline_keeps_rows_without_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "the of and to in is you that it he was for on are with as his they be at one have this"
    rows = spark.createDataFrame(
        [(None, long, "en", "s", 1), (1, long + " x", "en", "s", 1), (1, long + " x", "en", "s", 1), (2, None, None, None, None)],
        schema,
    )
    out = corpus_pipeline.one_of_each(spark, rows, SF).collect()
    assert sorted((r.doc_id or 0) for r in out) == [1, 2]  # the row without an id is a near copy
    masked = corpus_pipeline.without_personal_data(spark, rows, SF).collect()
    assert sorted(np.sign(r.doc_id or 0) for r in masked) == [0, 1, 1, 1]


def test_stages_with_clashing_columns_and_empty_tables(spark):
    """Every stage but the last returns the columns it got, with their values."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    extra = [c for c in CLASHES if c not in docs.columns]
    for k, name in enumerate(extra):
        docs = docs.selectExpr("*", f"{k} + doc_id AS `{name}`")
    plain = {r.doc_id: tuple(r[c] for c in extra) for r in docs.collect()}
    for name, fn in corpus_pipeline.STAGES[:-1]:
        out = fn(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(tuple(r[c] for c in extra) == plain[r.doc_id] for r in out.collect()), name
        assert fn(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.packed(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """One row of every group, also where ids are missing or stand for two texts."""
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(None, text), (None, text), (None, other), (5, other), (5, text), (5, text), (6, text), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id or 0), r.text) for r in corpus_pipeline.one_of_each(spark, df, SF).collect())
    assert out == sorted([(5, text), (5, other), (0, "alone here")])


def test_run(spark, docs):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:3] == ["doc_id", "start", "length"]
    assert 0 < got.select("doc_id").distinct().count() <= len(docs)
