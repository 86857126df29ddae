"""Toxicity by a classifier regularised with counterfactuals.

A logistic model over words and word beginnings.  For every labelled text that
names a group of people a copy is made with the name swapped for another group's;
the loss adds the squared change of the model's score between the two, so that a
group's name alone does not make a text toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common, labelled

# Parameters of the fit: labelled documents, features kept, least documents of a
# feature, ridge, weight of the counterfactual penalty, steps.
SAMPLE, FEATURES, LEAST, RIDGE, PENALTY, STEPS = 12_000, 4096, 4, 2e-4, 5.0, 300
# Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
# Words whose features a worker remembers.
KEPT_WORDS = 1 << 17

# Names of groups that are swapped within their row.
IDENTITIES = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "foreigner", "refugee", "native"), ("disabled", "blind", "deaf", "elderly", "young"),
    ("femme", "homme"), ("femmes", "hommes"), ("chrétien", "musulman", "juif"),
    ("frau", "mann"), ("frauen", "männer"), ("christ", "muslim", "jude"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("cristiano", "musulmán", "judío"),
)
SWAP = {name: row[(i + 1) % len(row)] for row in reversed(IDENTITIES) for i, name in enumerate(row)}

WORD = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> Counter:
    return Counter(WORD(text.lower()))


def names(word: str) -> list[str]:
    """Features of a word: itself and its beginnings, marked."""
    return [word, *["^" + word[:n] for n in BEGINNINGS if len(word) > n]]


def swapped(counts: Counter) -> Counter | None:
    """``counts`` with every group's name swapped; nothing where none is named."""
    if not counts.keys() & SWAP.keys():
        return None
    out: Counter = Counter()
    for word, n in counts.items():
        out[SWAP.get(word, word)] += n
    return out


@dataclass
class Model:
    places: dict[str, int]
    weights: np.ndarray
    bias: float
    kept: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def row(self, counts: Counter) -> dict[int, float]:
        """Place and value of the features present: log2 of one more than their occurrences."""
        sums: dict[int, int] = {}
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for word, n in counts.items():
            at = kept.get(word)
            if at is None:
                at = tuple(self.places[f] for f in names(word) if f in self.places)
                kept[word] = at
            for i in at:
                sums[i] = sums.get(i, 0) + n
        return {i: math.log2(1 + n) for i, n in sums.items()}

    def score(self, text: str) -> float:
        margin = self.bias + sum(self.weights[i] * v for i, v in self.row(words(text)).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


class Rows:
    """Sparse rows as arrays."""

    def __init__(self, rows: Iterable[tuple[list[int], list[float]]]):
        places, values = zip(*rows, strict=True) if rows else ((), ())
        self.count = len(places)
        self.places = np.array([i for row in places for i in row], dtype=np.int64)
        self.values = np.array([v for row in values for v in row], dtype=np.float64)
        self.rows = np.repeat(np.arange(self.count), [len(row) for row in places])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.places], minlength=self.count)

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.places, self.values * values[self.rows], minlength=width)


def fit(
    x: Rows, toxic: np.ndarray, before: Rows, after: Rows, width: int, *, penalty: float = PENALTY, ridge: float = RIDGE
) -> tuple[np.ndarray, float]:
    """Weights and bias: logistic loss, ridge and ``penalty`` times the mean squared score change of ``before`` to ``after``."""
    weights, share = np.zeros(width), (toxic.sum() + 0.5) / (len(toxic) + 1)
    bias = math.log(share / (1 - share))
    if not len(toxic) or toxic.all() or not toxic.any():
        return weights, bias
    pairs = max(1, before.count)
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(weights) + bias, -30, 30)))
        error = (p - toxic) / len(toxic)
        slope = x.back(error, width) + ridge * weights
        if before.count:
            change = before.dot(weights) - after.dot(weights)
            slope += 2 * penalty / pairs * (before.back(change, width) - after.back(change, width))
        slope = np.append(slope, error.sum())
        # Steps of even size per feature, so that rare and frequent ones settle alike.
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def vocabulary(sample: DataFrame, *, features: int = FEATURES, least: int = LEAST) -> list[str]:
    """The features that tell the labels apart best, and all group names that occur."""

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = {f for word in words(text) for f in names(word)}
                (toxic if label else clean).update(found)
        keys = list(toxic.keys() | clean.keys())
        for start in range(0, len(keys), 10_000):
            some = keys[start : start + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array([toxic[k] for k in some], pa.int64()), pa.array([clean[k] for k in some], pa.int64())],
                ["feature", "toxic", "clean"],
            )

    counted = sample.mapInArrow(count, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    sizes = sample.groupBy("label").count().collect()
    total = {row.label: row["count"] for row in sizes}
    # Difference of the shares against its own deviation.
    a, b = F.col("toxic") / max(1, total.get(1, 0)), F.col("clean") / max(1, total.get(0, 0))
    pooled = (F.col("toxic") + F.col("clean") + 1) / (sum(total.values()) + 2)
    gain = F.abs(a - b) / F.sqrt(pooled * (1 - pooled))
    named = F.col("feature").isin(*sorted(SWAP))
    chosen = counted.where(named | (F.col("toxic") + F.col("clean") >= least)).orderBy(
        named.desc(), gain.desc(), "feature"
    ).limit(features)
    return [row.feature for row in chosen.select("feature").collect()]


def learn(sample: DataFrame, *, penalty: float = PENALTY) -> Model:
    """Model from ``sample (text, label)``, which has a bounded number of rows."""
    sample = sample.withColumn("order", F.xxhash64("text"))
    model = Model({f: i for i, f in enumerate(vocabulary(sample))}, np.zeros(0), 0.0)
    blank = Model(model.places, np.zeros(len(model.places)), 0.0)

    def describe(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                counts = words(text)
                other = swapped(counts)
                x, y = blank.row(counts), blank.row(other) if other is not None else {}
                out.append((list(x), list(x.values()), other is not None, list(y), list(y.values())))
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(out, columns=["x", "xv", "named", "y", "yv"]).assign(
                    label=batch.column("label").to_pandas(), order=batch.column("order").to_pandas()
                ),
                schema=pa.schema([
                    ("x", pa.list_(pa.int32())), ("xv", pa.list_(pa.float64())), ("named", pa.bool_()),
                    ("y", pa.list_(pa.int32())), ("yv", pa.list_(pa.float64())), ("label", pa.int32()), ("order", pa.int64()),
                ]),
                preserve_index=False,
            )

    schema = "x array<int>, xv array<double>, named boolean, y array<int>, yv array<double>, label int, order bigint"
    found = sample.mapInArrow(describe, schema).collect()
    found.sort(key=lambda r: (r.order, r.label))
    named = [r for r in found if r.named]
    weights, bias = fit(
        Rows([(r.x, r.xv) for r in found]), np.array([r.label for r in found], dtype=float),
        Rows([(r.x, r.xv) for r in named]), Rows([(r.y, r.yv) for r in named]), len(model.places), penalty=penalty,
    )
    return Model(model.places, weights, bias)


def scored(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, held: int = 0, sample: int = SAMPLE
) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs (doc_id, text)``.

    Learned from about ``sample`` labelled documents outside the held-out fold, at
    most; ids, labels and other columns are never inputs of a score.  A null text
    is the empty one, whose score is the model's bias.  Without labels of both
    kinds all scores are the labels' share.  Repeated rows are each reported; a
    null doc_id is in no fold; no rows give no rows.
    """
    model = learn(labelled.training_sample(docs, labels, label, folds, held, sample))

    def score(batches):
        for batch in batches:
            scores = pa.array([model.score(text) for text in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    return common.texts(docs).mapInArrow(score, "doc_id bigint, score double").select(
        "doc_id", labelled.in_fold(F.col("doc_id"), folds, held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
