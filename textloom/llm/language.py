"""Language ID by a small convolutional network over bytes.

Texts are cut into fixed-length byte windows. A window's bytes are embedded,
convolved with filters of several widths, pooled by their maxima, and classified by
softmax; a text's languages are the mean of its windows' log-probabilities, weighted
by their bytes. Training is numpy in one task, on a bounded sample; the fitted network
is a few kilobytes and goes to every task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm import arrays

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Distinct labelled texts per language that the network is fitted on, about.
SAMPLE = 1_500
#: Labelled texts in all, about; with very many languages each gets fewer.
SAMPLE_ALL = 60_000
#: Windows of each of them, evenly spaced.
SAMPLE_WINDOWS = 3
#: Windows that a task handles at once.
BATCH = 512

UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray = field(default=None)
    filters: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)
    out: np.ndarray = field(default=None)
    out_bias: np.ndarray = field(default=None)

    def start(self, seed: int = 7) -> None:
        """Small random weights; filters of all widths share one matrix, with zeros where one is short."""
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (wide * EMBEDDING, n)).astype(np.float32)
        self.filters *= self.mask()
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.2, (n, len(self.languages))).astype(np.float32)
        self.out_bias = np.zeros(len(self.languages), np.float32)

    @staticmethod
    def mask() -> np.ndarray:
        wide = max(WIDTHS)
        rows = np.repeat(np.arange(wide), EMBEDDING)
        return (rows[:, None] < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)

    def patches(self, windows: np.ndarray) -> np.ndarray:
        wide, e = max(WIDTHS), self.embedding[windows]
        n, length, d = e.shape
        a, b, c = e.strides
        shape = (n, length - wide + 1, wide * d)
        view = np.lib.stride_tricks.as_strided(e, shape, (a, b, c), writeable=False)
        return view.reshape(-1, wide * d)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of every filter over each window, and where they are."""
        n = len(windows)
        seen = (self.patches(windows) @ self.filters).reshape(n, -1, len(self.bias))
        top = seen.argmax(axis=1)
        best = np.take_along_axis(seen, top[:, None, :], axis=1)[:, 0, :] + self.bias
        return np.maximum(best, 0), top

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        n = len(windows)
        seen = (self.patches(windows) @ self.filters).reshape(n, -1, len(self.bias))
        z = np.maximum(seen.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 64) -> None:
        """Cross-entropy by Adam; the gradient of a maximum goes to where it was."""
        rng = np.random.default_rng(11)
        names = ("embedding", "filters", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        wide, mask, step = max(WIDTHS), self.mask(), 0
        for epoch in range(epochs):
            rate = 0.01 / (1 + epoch)
            for at in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
                x, y = windows[at], labels[at]
                pooled, top = self.pooled(x)
                z = pooled @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * (pooled > 0)
                places = top[:, :, None] + np.arange(wide)[None, None, :]
                read = x[np.arange(len(x))[:, None, None], places]
                patch = self.embedding[read].reshape(len(x), len(self.bias), -1)
                g_embedding = np.zeros_like(self.embedding)
                through = back[:, :, None] * self.filters.T[None, :, :]
                np.add.at(g_embedding, read.reshape(-1), through.reshape(-1, EMBEDDING))
                grads = {
                    "embedding": g_embedding,
                    "filters": np.einsum("nf,nfk->kf", back, patch) * mask,
                    "bias": back.sum(axis=0),
                    "out": pooled.T @ p,
                    "out_bias": p.sum(axis=0),
                }
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    up = first[k] / (1 - 0.9**step)
                    down = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                    setattr(self, k, (getattr(self, k) - rate * up / down).astype(np.float32))


def place_windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and size of all windows of all texts; an empty text has none."""
    size = np.diff(bounds)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][owner] + (np.arange(len(owner)) - first) * WINDOW
    return owner, start, np.minimum(bounds[1:][owner] - start, WINDOW)


def read_windows(data: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The bytes of windows, filled up with zeros."""
    inside = np.arange(WINDOW)[None, :]
    windows = data[np.minimum(start[:, None] + inside, len(data) - 1)]
    windows[inside >= held[:, None]] = 0
    return windows


def _train(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["label", "text"]).reset_index(drop=True)
    data, bounds = arrays.utf8(pa.array(frame["text"], pa.string()))
    owner, start, held = place_windows(bounds)
    # Evenly spaced windows of each text.
    count = np.bincount(owner, minlength=len(frame))
    place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    kept = (place * SAMPLE_WINDOWS) // np.maximum(count[owner], 1) != (
        (place - 1) * SAMPLE_WINDOWS
    ) // np.maximum(count[owner], 1)
    languages = sorted(set(frame["label"]))
    label = np.searchsorted(languages, frame["label"].to_numpy())[owner[kept]]
    network = Network(languages)
    network.start()
    network.fit(read_windows(data, start[kept], held[kept]), label)
    return pd.DataFrame({"network": [pickle.dumps(vars(network))]})


def training_sample(labelled: DataFrame, per_language: int = SAMPLE) -> DataFrame | None:
    """``(text, label)``: about ``per_language`` distinct texts of each language, at least one.

    Distinct texts are counted and drawn, by a hash of themselves, so copies change neither
    the rate nor the sample. Only ``SAMPLE_WINDOWS`` windows' worth of each is kept.
    ``SAMPLE_ALL`` bounds them all, unless there are more languages than that.
    """
    rows = labelled.filter("label IS NOT NULL AND text IS NOT NULL AND text <> ''").select(
        "label", "text", F.xxhash64("text").alias("hash")
    )
    distinct = rows.select("label", "hash").distinct()
    seen = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least"))
    counts = sorted((r["label"], r["n"], r["least"]) for r in seen.collect())
    if not counts:
        return None
    less = min(1.0, SAMPLE_ALL / sum(min(n, per_language) for _, n, _ in counts))
    rates = [(label, less * min(1.0, per_language / n), least) for label, n, least in counts]
    chances = F.broadcast(
        rows.sparkSession.createDataFrame(rates, "label string, chance double, least long")
    )
    draw = F.pmod("hash", F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = (draw < F.col("chance")) | (F.col("hash") == F.col("least"))
    # Evenly spaced slices, as long as the windows that are used.
    length, part = F.length("text"), WINDOW
    slices = [
        F.substring(F.col("text"), (length * k / SAMPLE_WINDOWS).cast("int") + 1, F.lit(part))
        for k in range(SAMPLE_WINDOWS)
    ]
    text = F.when(length <= part * SAMPLE_WINDOWS, F.col("text")).otherwise(F.concat(*slices))
    sample = rows.join(chances, "label").filter(drawn).select(text.alias("text"), "label", "hash")
    return sample.dropDuplicates(["label", "hash"]).select("text", "label")


def train_network(labelled: DataFrame, per_language: int = SAMPLE) -> Network | None:
    """A network fitted on about ``per_language`` distinct texts of each language.

    ``labelled`` has ``text`` and ``label``; ``training_sample`` draws the texts. Null
    labels, null and empty texts take no part; without any row there is no network.
    """
    sample = training_sample(labelled, per_language)
    if sample is None:
        return None
    fitted = sample.groupBy().applyInPandas(_train, "network binary").collect()
    return Network(**pickle.loads(fitted[0]["network"])) if fitted else None


def _predict_task(network: Network | None, place: int, schema: pa.Schema):
    def scores(column: pa.Array) -> tuple[list[str | None], np.ndarray]:
        has_letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(False)
        names, best = [UNKNOWN] * len(column), np.zeros(len(column))
        if network is None:
            return names, best
        for i, j, data, bounds in arrays.work(column):
            total = np.zeros((j - i, len(network.languages)))
            owner, start, held = place_windows(bounds)
            for at in range(0, len(owner), BATCH):
                part = slice(at, at + BATCH)
                logs = network.log_probabilities(read_windows(data, start[part], held[part]))
                np.add.at(total, owner[part], logs * held[part, None])
            mean = total / np.maximum(np.diff(bounds), 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            top = p.argmax(axis=1)
            for row in np.flatnonzero(has_letter[i:j]):
                names[i + row] = network.languages[top[row]]
                best[i + row] = p[row, top[row]]
        return names, best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, best = scores(batch.column(place))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.cast(f.type) for c, f in zip(batch.columns, list(schema)[:-2])),
                    pa.array(names, pa.string()),
                    pa.array(best),
                ],
                schema=schema,
            )

    return run


def predict(
    docs: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The ``keep`` columns (all by default), and ``lang_pred`` and ``score`` of every whole text.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for a null text, one
    without a letter, or where nothing was learned. Ties go to the language that comes
    first. Columns named like the results are replaced. Repeated rows stay.
    """
    names = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]
    sent = names if text in names else [*names, text]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(sent)))
    results = StructType.fromDDL("lang_pred string, score double").fields
    schema = StructType([*rows.schema.fields[: len(names)], *results])
    task = _predict_task(network, sent.index(text), to_arrow_schema(schema))
    out = rows.mapInArrow(task, schema)
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), "lang_pred", "score")


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row's key falls into the fold that is never learned from; null keys do not."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))


def learn(docs: DataFrame) -> Network | None:
    """The network of the corpus: from text and language of the documents not held out."""
    rows = docs.filter(~held_out() & F.col("doc_id").isNotNull())
    return train_network(rows.select("text", F.col("lang").alias("label")))
