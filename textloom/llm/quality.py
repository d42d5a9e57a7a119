"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of byte n-grams (hashed into a fixed number of buckets) and of repetition
patterns in runs of four words (which words equal the one before) are scaled by the log
ratio of their class counts; a linear hinge-loss model is fitted on the scaled,
length-normalized vectors by dual coordinate descent; a logistic curve turns its margin
into a score. Fitting happens in one task on a bounded sample of labelled rows. Scoring
takes every whole text: the n-grams of all of it count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm import arrays

#: Lengths of the n-grams in bytes.
GRAMS = (1, 2, 3)
#: Buckets that n-grams are hashed into (single bytes and pairs keep places of their own).
BUCKETS = 1 << 18
#: Buckets at the end for repetition patterns, and for their share in a text.
PATTERNS = 8
SHARES = 16
#: Labelled rows that the model is fitted on, about.
SAMPLE = 8_000
#: Bytes of their texts together, about; a text of more than a sixteenth of it is not learned from.
SAMPLE_BYTES = 64 << 20
#: Added to the class counts.
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 12


@dataclass
class Model:
    """``weight`` and ``scale`` by bucket; the score is a logistic curve of the margin."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

    def margins(self, buckets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(owner, self.weight[buckets], n)
        norm = np.sqrt(np.bincount(owner, self.scale[buckets].astype(np.float64) ** 2, n))
        return total / np.maximum(norm, 1e-9) + self.bias


def indicators(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every text and the text each belongs to, sorted by text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    wide = data.astype(np.uint32)
    keys, key = [], np.zeros(len(data), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        count = max(len(data) - n + 1, 0)
        key = (key[:count] << np.uint32(8)) | wide[n - 1 :]
        if n not in GRAMS or not count:
            continue
        if n == 1:
            bucket = key
        elif n == 2:
            bucket = key + np.uint32(256)
        else:
            spread = key * np.uint32(0x9E3779B1)
            room = BUCKETS - PATTERNS - SHARES - 65_792
            bucket = (spread >> np.uint32(8)) % np.uint32(room) + np.uint32(65_792)
        inside = owner[:count] == owner[n - 1 :]
        keys.append((owner[:count].astype(np.int64) * BUCKETS + bucket)[inside])
    keys.append(_repetitions(data, bounds))
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found % BUCKETS, found // BUCKETS


def _repetitions(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys (text times BUCKETS plus bucket) of word repetition patterns."""
    starts, ends, count = arrays.words(data, bounds, _WORD)
    of = np.repeat(np.arange(len(count)), count)
    word = arrays.range_hash(arrays.prefix_hash(data), starts, ends)
    same = np.zeros(len(word) + 1, np.int64)
    same[1:-1] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    n = max(len(word) - 3, 0)
    code = same[1 : 1 + n] + 2 * same[2 : 2 + n] + 4 * same[3 : 3 + n]
    whole = of[:n] == of[3:]
    share = np.bincount(of, same[:-1], len(count)) / np.maximum(count, 1)
    level = np.minimum((share * SHARES).astype(np.int64), SHARES - 1)
    first = BUCKETS - PATTERNS - SHARES
    return np.concatenate(
        [
            (of[:n] * BUCKETS + first + code)[whole],
            (np.arange(len(count)) * BUCKETS + first + PATTERNS + level)[count > 0],
        ]
    )


#: Words are what ASCII white space leaves.
_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _gram_task(schema: pa.Schema):
    """(label, its text's buckets as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in arrays.work(batch.column(1)):
                buckets, owner = indicators(data, bounds)
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                rows = [buckets[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])]
                label = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([label, pa.array(rows, pa.binary())], schema=schema)

    return run


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights and bias (a constant feature) by dual coordinate descent."""
    rng = np.random.default_rng(5)
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    balance = len(y) / (2 * np.maximum(1, np.array([(y < 0).sum(), (y > 0).sum()])))
    cap = PENALTY * balance[(y > 0).astype(int)]
    square = np.array([float(v @ v) for v in values]) + 1.0
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slack = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), cap[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with the targets pulled in from 0 and 1."""
    good, bad = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, beta = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1, 0]))
    return float(beta[0]), float(beta[1])


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    if frame["label"].nunique() < 2:
        return pd.DataFrame({"model": []})
    frame = frame.sort_values(["label", "grams"])
    rows = [np.frombuffer(g, "<i4") for g in frame["grams"]]
    label = frame["label"].to_numpy()
    counts = []
    for c in (0, 1):
        own = [r for r, y in zip(rows, label) if y == c]
        count = np.bincount(np.concatenate([*own, np.zeros(0, np.int32)]), minlength=BUCKETS)
        counts.append((count + SMOOTHING) / (count.sum() + SMOOTHING * BUCKETS))
    ratio = np.log(counts[1] / counts[0])
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / max(np.sqrt(float(v @ v)), 1e-9))
    w, bias = dual_descent(rows, values, np.where(label == 1, 1.0, -1.0))
    model = Model((w * ratio).astype(np.float32), ratio.astype(np.float32), bias, 1.0, 0.0)
    size = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    margin = model.margins(np.concatenate([*rows, np.zeros(0, np.int32)]), owner, len(rows))
    model.slope, model.shift = _logistic(margin, label)
    return pd.DataFrame({"model": [pickle.dumps(vars(model))]})


def train_model(labelled: DataFrame) -> Model | None:
    """A model fitted on ``text`` and ``label`` (0 or 1); None unless both labels occur.

    Null labels and null texts take no part.
    """
    rows = labelled.filter("label IN (0, 1) AND text IS NOT NULL")
    schema = StructType.fromDDL("label int, grams binary")
    grams = rows.select(F.col("label").cast("int"), "text").mapInArrow(
        _gram_task(to_arrow_schema(schema)), schema
    )
    fitted = grams.groupBy().applyInPandas(_fit, "model binary").collect()
    if not fitted:
        return None
    model = Model(**pickle.loads(fitted[0]["model"]))
    return model if np.isfinite(model.bias) else None


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a key falls into the fold that is never learned from; null keys do not."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))


def _draw(rate: float, *keys: Column) -> Column:
    """Whether a row is drawn, by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / F.lit(float(1 << 20)) < rate


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES
) -> Model | None:
    """The model of a corpus, from about ``most`` labelled documents outside the held-out fold.

    They are drawn by a hash of their ids, at a rate that follows from the measured
    count of labels, so the broadcast side of the join is bounded. A document with
    several labels takes the smallest; equal rows count once. If the texts drawn have more
    than ``most_bytes`` together, they are thinned out at a second rate, by a hash of id and text.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    rate = min(1.0, most / max(1, usable.count()))
    sample = usable.filter(_draw(rate, F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("label"))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes // 16)
    joined = texts.join(F.broadcast(sample), "doc_id")
    size = joined.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = joined.filter(_draw(min(1.0, most_bytes / max(1, size)), F.col("doc_id"), F.col("text")))
    rows = kept.groupBy("doc_id", "text").agg(F.min("label").alias("label"))
    return train_model(rows.select("text", "label"))


def _score_task(model: Model | None, place: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for i, j, data, bounds in arrays.work(batch.column(place)):
                    out[i:j] = model.score(model.margins(*indicators(data, bounds), j - i))
            columns = [c.cast(f.type) for c, f in zip(batch.columns, list(schema)[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], schema=schema)

    return run


def score(
    docs: DataFrame,
    model: Model | None,
    text: str = "text",
    out: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """The ``keep`` columns (all by default), and the score of every whole text, from 0 to 1.

    Null and empty texts get the score of no n-gram at all; without a model every
    score is 0.5. A column named like the result is replaced. Repeated rows stay.
    """
    names = [c for c in keep or docs.columns if c != out]
    sent = names if text in names else [*names, text]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(sent)))
    schema = StructType(
        [*rows.schema.fields[: len(names)], *StructType.fromDDL("_score double").fields]
    )
    task = _score_task(model, sent.index(text), to_arrow_schema(schema))
    scored = rows.mapInArrow(task, schema)
    return scored.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), F.col("_score").alias(out))
