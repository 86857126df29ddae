"""Document quality by pairwise ranking (Bradley-Terry).

Every document has a strength, a weighted sum of features of its text.  The
weights maximise the likelihood that in pairs of a good and a bad document the
good one wins: logistic loss on feature differences.  All labelled documents take
part: they are dealt over blocks, and in a block every good one meets every bad one.
Documents are accepted from the quantile of the labelled documents' strengths on
that leaves out the bad ones' share.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import stats
from sensorloom.llm import common, labelled

# Parameters of the fit: ridge, accepted score, Newton steps at most.
RIDGE, ACCEPT, STEPS = 1e-3, 0.7, 30
# Labelled documents of a block, and those of each kind it holds on average at least.
BLOCK, LEAST = 2048, 64
# Standardised features are cut off at this many deviations, strengths at this many units.
CLIP, REACH = 4.0, 30.0

PLAIN = b".,;:'\"()-!?"


def _mask(*, upper=False, letters=False, digits=False, space=False, odd=False, loud=False, high=False) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for b in range(256):
        c = bytes([b])
        out[b] = (
            upper and c.isupper() or letters and c.isalpha() or digits and c.isdigit() or space and c.isspace()
            or loud and c in b"!?" or high and b >= 128
            or odd and b > 32 and b < 127 and not c.isalnum() and c not in PLAIN
        )
    return out


UPPER, LETTER, DIGIT, SPACE = _mask(upper=True), _mask(letters=True), _mask(digits=True), _mask(space=True)
ODD, LOUD, HIGH = _mask(odd=True), _mask(loud=True), _mask(high=True)
NAMES = (
    "words", "word_length", "upper", "odd", "loud", "digits", "space", "adjacent_repeats", "variety", "repeated_lines",
    "line_words", "odd_endings", "lone_symbols", "stops",
)


def features(text: str) -> list[float]:
    """The values of ``NAMES``; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    total, n = len(raw), len(words)
    letters = int(counts[LETTER].sum()) + 1
    distinct = set(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    endings = sum(1 for w in distinct if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1] in PLAIN))
    lone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    return [
        math.log1p(n),
        math.log(total / n),
        math.sqrt(counts[UPPER].sum() / letters),
        math.sqrt(counts[ODD].sum() / total),
        math.sqrt(counts[LOUD].sum() / total),
        math.sqrt(counts[DIGIT].sum() / total),
        counts[SPACE].sum() / total,
        math.sqrt(sum(map(operator.eq, words, words[1:])) / n),
        math.log1p(len(distinct)) / math.log1p(n),
        1.0 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        math.sqrt(endings / len(distinct)),
        math.sqrt(lone / n),
        math.sqrt(raw.count(b". ") / n),
    ]


@dataclass
class Ranking:
    """Strength of a document as a weighted sum, and the strength that is accepted."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    accepted: float

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.deviation, -CLIP, CLIP)

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return self.standard(rows) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Chance to win against a document at the border, set off so that the border has ``ACCEPT``."""
        above = np.clip(self.strengths(rows) - self.accepted, -REACH, REACH)
        # One summand rounds alike on both sides of the border.
        score = 1 / (1 + np.exp(-(above + math.log(ACCEPT / (1 - ACCEPT)))))
        return np.where(above >= 0, np.maximum(score, ACCEPT), np.minimum(score, np.nextafter(ACCEPT, 0)))


def pair_sums(good: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number of pairs of good and bad rows, gradient of their log likelihood and its negative curvature, in one row."""
    width = len(weights)
    gradient, curve = np.zeros(width), np.zeros((width, width))
    against = bad @ weights
    # Some rows at a time against all of the block's other kind.
    for start in range(0, len(good) if len(bad) else 0, BLOCK):
        x = good[start : start + BLOCK]
        lost = 1 / (1 + np.exp(np.clip((x @ weights)[:, None] - against, -REACH, REACH)))
        gradient += lost.sum(axis=1) @ x - lost.sum(axis=0) @ bad
        both = lost * (1 - lost)
        cross = x.T @ (both @ bad)
        curve += (x * both.sum(axis=1)[:, None]).T @ x + (bad * both.sum(axis=0)[:, None]).T @ bad - cross - cross.T
    return np.concatenate([[float(len(good)) * len(bad)], gradient, curve.ravel()])


def climbed(sums: Callable[[np.ndarray], np.ndarray], ridge: float = RIDGE) -> np.ndarray:
    """Weights of the largest likelihood, by Newton steps over ``sums`` of :func:`pair_sums`."""
    width = len(NAMES)
    weights = np.zeros(width)
    for _ in range(STEPS):
        found = sums(weights)
        gradient = found[1 : width + 1] / found[0] - ridge * weights
        curve = found[width + 1 :].reshape(width, width) / found[0] + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _flat() -> Ranking:
    width = len(NAMES)
    return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)


def _scaled(mean: np.ndarray, deviation: np.ndarray) -> Ranking:
    return Ranking(mean, np.where(deviation > 1e-9, deviation, 1.0), np.zeros(len(NAMES)), 0.0)


def fit(rows: np.ndarray, good: np.ndarray, *, ridge: float = RIDGE) -> Ranking:
    """:func:`fitted` for one block: Bradley-Terry weights from all pairs; all zero where one kind is missing."""
    if not len(rows) or good.all() or not good.any():
        return _flat()
    model = _scaled(rows.mean(axis=0), rows.std(axis=0))
    x = model.standard(rows)
    model.weights = climbed(lambda weights: pair_sums(x[good], x[~good], weights), ridge)
    ordered = np.sort(model.strengths(rows))
    border = int((~good).sum())
    model.accepted = float((ordered[border - 1] + ordered[border]) / 2)
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _totals(rows: DataFrame, column: str = "x") -> np.ndarray:
    """Sums over the rows of each place of an array, exact in decimals and so the same in every run."""
    parts = rows.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(28,10)")).alias("v")
    )
    # One row for each place of the array.
    return np.array([float(r.v) for r in sorted(parts.collect(), key=lambda r: r.i)])


def dealt(known: DataFrame, n_good: int, n_bad: int, *, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """``good, bad``: features of the ``known (label, place, x)`` documents of each block, in a row.

    Every document is in a block.  Where a kind is so rare that a block would hold
    fewer than ``least`` of it, each of its documents is in several.
    """
    blocks = max(1, -(-(n_good + n_bad) // block))
    copies = [min(blocks, -(-least * blocks // n)) for n in (n_bad, n_good)]
    turns = F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1)
    placed = known.withColumn("turn", F.explode(turns)).withColumn("block", F.pmod(F.col("place") + F.col("turn"), F.lit(blocks)))
    kind = lambda k: F.flatten(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("label") == k, F.struct("place", "x")))), lambda r: r["x"]
    ))
    return placed.groupBy("block").agg(kind(1).alias("good"), kind(0).alias("bad")).drop("block")


def fitted(known: DataFrame, *, ridge: float = RIDGE, block: int = BLOCK) -> Ranking:
    """Bradley-Terry weights and border from all ``known (label, place, x)`` documents; all zero where one kind is missing."""
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    if not n_good or not n_bad:
        return _flat()
    mean = _totals(known) / (n_good + n_bad)

    def squared(batches):
        for batch in batches:
            off = (_matrix(batch.column("x")) - mean) ** 2
            yield pa.RecordBatch.from_arrays([pa.array(list(off), pa.list_(pa.float64()))], ["x"])

    spread = _totals(known.select("x").mapInArrow(squared, "x array<double>"))
    model = _scaled(mean, np.sqrt(spread / (n_good + n_bad)))
    blocks = common.saved(dealt(known, n_good, n_bad, block=block))

    def sums(weights: np.ndarray) -> np.ndarray:
        def run(batches):
            for batch in batches:
                for i in range(len(batch)):
                    good, bad = (model.standard(_matrix(batch.column(c).slice(i, 1))) for c in ("good", "bad"))
                    found = pair_sums(good, bad, weights)
                    yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64()))], ["x"])

        return _totals(blocks.mapInArrow(run, "x array<double>"))

    model.weights = climbed(sums, ridge)

    def strong(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strengths(_matrix(batch.column("x"))))], ["s"])

    strengths = known.select("x").mapInArrow(strong, "s double").withColumn("all", F.lit(0))
    # Half-way between the last strength left out and the next one.
    share = (n_bad - 0.5) / (n_good + n_bad - 1)
    model.accepted = stats.quantiles(strengths, ["all"], F.col("s"), {"border": share}).first()["border"]
    return model


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the features of every row of ``docs (doc_id, text)``."""

    def run(batches):
        for batch in batches:
            rows = [features(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return common.texts(docs).mapInArrow(run, "doc_id bigint, x array<double>")


def scored(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs (doc_id, text)``.

    Fitted on all labelled documents outside the held-out fold; ids, labels and
    other columns are never inputs of a score.  A null text is the empty one and is
    scored by zero features.  Without labels of both kinds every document has the
    score 0.7 and is accepted.  Repeated rows are each reported; a null doc_id is in
    no fold; no rows give no rows.
    """
    rows = common.saved(described(docs))
    known = rows.join(labelled.training_labels(labels, label, folds, held), "doc_id")
    model = fitted(common.saved(known.select("label", F.xxhash64("doc_id", F.lit("block")).alias("place"), "x")))

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.scores(_matrix(batch.column("x"))))], ["doc_id", "score"]
            )

    scores = rows.mapInArrow(score, "doc_id bigint, score double")
    return scores.select(
        "doc_id", labelled.in_fold(F.col("doc_id"), folds, held).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that are accepted; rows without a doc_id stay."""
    # A doc_id with several texts goes when all of them are rejected.
    verdicts = scored(docs, labels, **options).groupBy(F.col("doc_id").alias("gone")).agg(F.max("predicted").alias("best"))
    rejected = verdicts.where("best = 0 and gone is not null").select("gone")
    return docs.join(rejected, docs["doc_id"].cast("bigint") == rejected["gone"], "left_anti")
