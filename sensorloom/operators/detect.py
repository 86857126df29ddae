"""Per-series anomaly scores.

Each detector takes rows ``(series, segment, blk, ts, value)`` without nulls and
returns ``(series, segment, ts, score)``.  ``keys`` name what one model is
fitted on: a series, or a segment of it.  ``ready`` says that the rows lie in a
table and may be read several times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.blocks import BLOCK_ROWS, HOUR, SERIES, attach, carry, halo
from sensorloom.functions.stats import median_and_mad, quantiles, rank_blocks

EPSILON = 1e-6
MAD_TO_SIGMA = 1.4826
Z_FACTOR = 0.6745


def modified_z(df: DataFrame, *, keys: Sequence[str] = SERIES, ready: bool = False, **_) -> DataFrame:
    """``0.6745 * |x - median| / max(MAD, 1e-6)``."""
    stats = median_and_mad(df, keys, "value", ready=ready)
    score = F.lit(Z_FACTOR) * F.abs(F.col("value") - F.col("median")) / F.greatest("mad", F.lit(EPSILON))
    return attach(df, stats, keys).select(*keys, "ts", score.alias("score"))


def iqr_fence(
    df: DataFrame, *, keys: Sequence[str] = SERIES, fence_scale: float = 1.5, ready: bool = False, **_
) -> DataFrame:
    """Distance outside the Tukey fences in units of the IQR, 0 inside."""
    stats = quantiles(df, keys, F.col("value"), {"q1": 0.25, "q3": 0.75}, ready=ready)
    iqr = F.greatest(F.col("q3") - F.col("q1"), F.lit(EPSILON))
    below = F.col("q1") - fence_scale * iqr - F.col("value")
    above = F.col("value") - F.col("q3") - fence_scale * iqr
    score = F.greatest(below, above, F.lit(0.0)) / iqr
    return attach(df, stats, keys).select(*keys, "ts", score.alias("score"))


def _array_median(values: Column) -> Column:
    ordered = F.sort_array(values)
    size = F.size(ordered)
    low = F.floor((size - 1) / 2).cast("int")
    high = F.floor(size / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / 2


def hampel(
    df: DataFrame, *, keys: Sequence[str] = SERIES, window: int = 24, step: int = HOUR,
    rows: int = BLOCK_ROWS, **_,
) -> DataFrame:
    """Distance from a centred rolling median in units of the rolling MAD.

    The frame holds ``window`` rows and is cut off at the ends.
    """
    left, right = window // 2, window - 1 - window // 2
    spread = halo(df.select(*keys, "ts", "value"), left, right, step=step, rows=rows, keys=keys)
    near = Window.partitionBy(*keys, "blk").orderBy("ts").rowsBetween(-left, right)
    framed = spread.withColumn("_near", F.collect_list("value").over(near)).where("own")
    centred = framed.withColumn("_m", _array_median(F.col("_near")))
    off = F.transform("_near", lambda x: F.abs(x - F.col("_m")))
    scale = F.greatest(F.lit(MAD_TO_SIGMA) * _array_median(off), F.lit(EPSILON))
    return centred.select(*keys, "ts", (F.abs(F.col("value") - F.col("_m")) / scale).alias("score"))


def hampel6(df: DataFrame, **options) -> DataFrame:
    return hampel(df, **{**options, "window": 6})


# --- isolation forest ---------------------------------------------------------

EULER_GAMMA = 0.5772156649


def leaf_length(n: float) -> float:
    """Mean path length left in a leaf of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, low: float, high: float, depth: int, limit: int, rng, out: list) -> None:
    """Split one dimension at random until single values or the depth limit;
    each leaf is an interval ``(low, high, path length)``."""
    if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
        out.append((low, high, depth + leaf_length(len(values))))
        return
    at = rng.uniform(values[0], values[-1])
    left = np.searchsorted(values, at, side="right")
    _grow(values[:left], low, at, depth + 1, limit, rng, out)
    _grow(values[left:], at, high, depth + 1, limit, rng, out)


def _forest(key: tuple, pdf: pd.DataFrame, keys: Sequence[str], seed: int) -> pd.DataFrame:
    """Trees of one series as one step function of the mean path length."""
    edges, changes, total = [], [], 0.0
    trees = 0
    for tree, part in pdf.groupby("tree", sort=True):
        values = np.sort(part["value"].to_numpy())
        limit = int(np.ceil(np.log2(max(len(values), 2))))
        leaves: list = []
        _grow(values, -np.inf, np.inf, 0, limit, np.random.default_rng([seed, int(tree)]), leaves)
        lengths = np.array([leaf[2] for leaf in leaves])
        edges.append(np.array([leaf[1] for leaf in leaves[:-1]]))
        changes.append(np.diff(lengths))
        total += lengths[0]
        trees += 1
    at = np.concatenate(edges) if edges else np.empty(0)
    order = np.argsort(at, kind="stable")
    path = (total + np.concatenate([[0.0], np.cumsum(np.concatenate(changes)[order])])) / trees
    usual = leaf_length(len(part))
    return pd.DataFrame(
        [[*key, at[order].tolist(), path.tolist(), float(usual)]],
        columns=[*keys, "edges", "path", "usual"],
    )


def forest_rows(df: DataFrame, keys: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """For each tree the ``sample`` rows of a group with the smallest hash for that tree, over all its rows.

    Hashes beyond the place where four times as many and 64 more are expected are left
    out before the sort; fewer than wanted lie below it in one of e^60 cases at most.
    A tree that fell short raises an error.
    """
    keys = list(keys)
    ident = [F.col(k) for k in keys] + [F.col("ts")]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = attach(df.select(*keys, "blk", "ts", "value"), sizes, keys)
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("tree"), *ident))
    limit = F.lit(4.0 * sample + 64) / F.col("_n") * F.lit(2.0**64) - F.lit(2.0**63)
    low = rows.where((F.col("_n") <= 4 * sample + 64) | (F.col("_h").cast("double") < limit))
    first = Window.partitionBy(*keys, "tree").orderBy("_h", "ts")
    ranked = low.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= sample)
    every = Window.partitionBy(*keys, "tree")
    short = F.count(F.lit(1)).over(every) < F.least(F.col("_n"), F.lit(sample))
    failure = F.raise_error(F.lit("too few rows below the hash limit")).cast("double")
    return ranked.withColumn("value", F.when(short, failure).otherwise(F.col("value")))


def isolation_forest(
    df: DataFrame, *, keys: Sequence[str] = SERIES, trees: int = 100, sample: int = 256, seed: int = 13, **_
) -> DataFrame:
    """``2^(-mean path / expected path)`` over random trees of one value.

    In one dimension a forest is a step function, so scoring a row is one lookup.
    """
    keys = list(keys)
    drawn = forest_rows(df, keys, trees, sample, seed)
    types = dict(df.dtypes)
    model_schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", edges array<double>, path array<double>, usual double"
    )
    model = drawn.select(*keys, "tree", "value").groupBy(*keys).applyInPandas(
        lambda key, pdf: _forest(key, pdf, keys, seed), model_schema
    )

    def score(pdf: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        edges, path = forest["edges"].iloc[0], forest["path"].iloc[0]
        depth = np.asarray(path)[np.searchsorted(np.asarray(edges), pdf["value"].to_numpy(), side="left")]
        usual = forest["usual"].iloc[0]
        out = pdf[[*keys, "ts"]].copy()
        out["score"] = np.power(2.0, -depth / usual) if usual > 0 else 0.5
        return out

    return by_block(df.select(*keys, "blk", "ts", "value"), model, score, keys)


def by_block(rows: DataFrame, model: DataFrame, score: Callable, keys: Sequence[str]) -> DataFrame:
    """Score bounded row blocks against the model of their series.

    The model row is copied to each block of its series, never the rows to one
    place.
    """
    keys = list(keys)
    places = rows.select(*keys, "blk").distinct().join(model, keys)
    # Own names on this side: both sides come from the same rows.
    places = places.withColumnsRenamed({c: f"{c}_of_model" for c in (*keys, "blk")})
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", ts timestamp, score double"

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0][[*keys, "ts"]].assign(score=pd.Series(dtype="float64"))
        return score(left.sort_values("ts"), right)

    return rows.groupBy(*keys, "blk").cogroup(
        places.groupBy(*[f"{c}_of_model" for c in (*keys, "blk")])
    ).applyInPandas(apply, schema)


# --- local outlier factor -----------------------------------------------------


def _lof_block(pdf: pd.DataFrame, keys: Sequence[str], neighbours: int) -> pd.DataFrame:
    """Outlier factors of one stretch of sorted distinct values (with margins).

    A value that occurs m times stands for m rows; more than ``k + 1`` copies
    cannot change any k nearest neighbours, so copies end there.
    """
    pdf = pdf.sort_values("value")
    k = int(min(neighbours, pdf["n"].iloc[0] - 1))
    own = pdf["own"].to_numpy()
    if k < 1:
        out = pdf.loc[own, [*keys, "value"]].copy()
        out["score"] = 1.0
        return out
    copies = np.minimum(pdf["c"].to_numpy(), k + 1)
    x = np.repeat(pdf["value"].to_numpy(), copies)
    first = np.cumsum(copies) - copies
    n = len(x)
    # The k nearest rows of x[i] are k+1 neighbours in order, x[i] included.
    starts = np.arange(n)[:, None] + np.arange(-k, 1)[None, :]
    fits = (starts >= 0) & (starts + k < n)
    left = np.where(fits, x[:, None] - x[np.clip(starts, 0, n - 1)], np.inf)
    right = np.where(fits, x[np.clip(starts + k, 0, n - 1)] - x[:, None], np.inf)
    reach = np.maximum(left, right)
    kdist = reach.min(axis=1)
    # Equal reach: everything strictly nearer must be in, then the lower side.
    tied = reach == kdist[:, None]
    by_left = tied & (left == reach)
    last_left = k - by_left[:, ::-1].argmax(axis=1)
    pick = np.where(by_left.any(axis=1), last_left, tied.argmax(axis=1))
    low = starts[np.arange(n), pick]
    members = np.minimum(low[:, None] + np.arange(k + 1)[None, :], n - 1)
    others = members != np.arange(n)[:, None]
    reach = np.maximum(kdist[members], np.abs(x[members] - x[:, None]))
    lrd = 1.0 / ((reach * others).sum(axis=1) / k + 1e-10)
    factor = (lrd[members] * others).sum(axis=1) / k / lrd
    out = pdf[[*keys, "value"]].copy()
    out["score"] = factor[first]
    return out[own]


def local_outlier_factor(
    df: DataFrame, *, keys: Sequence[str] = SERIES, neighbours: int = 50, stretch: int = 4096, **_
) -> DataFrame:
    """Local outlier factor of the values of each series, k = min(50, n-1).

    In one dimension the neighbours of a value lie next to it in value order:
    distinct values are ranked in blocks of equally many, cut into stretches with a
    margin of 3k ranks on each side, and every stretch is worked on alone.  Factors go
    back by block and value, so rows of one frequent value stay spread out.
    """
    keys = list(keys)
    rows = df.select(*keys, "blk", "ts", "value")
    # Per block first: a value that fills a third of a group is one row of each block.
    distinct = rows.groupBy(*keys, "blk", "value").agg(F.count(F.lit(1)).alias("c"))
    distinct = distinct.groupBy(*keys, "value").agg(F.sum("c").alias("c"))
    ranked = carry(
        rank_blocks(distinct, keys, ["value"]),
        {"rank": ("sum", F.lit(1).cast("bigint")), "n": ("total", F.col("c"))}, order="value", keys=keys,
    )
    margin = 3 * neighbours
    home = F.floor(F.col("rank") / stretch)
    first = F.floor((F.col("rank") - margin) / stretch)
    last = F.floor((F.col("rank") + margin) / stretch)
    spread = ranked.withColumn("part", F.explode(F.sequence(first, last))).withColumn(
        "own", home == F.col("part")
    )
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", value double, score double"
    factors = spread.select(*keys, "part", "value", "c", "n", "own").groupBy(*keys, "part").applyInPandas(
        lambda pdf: _lof_block(pdf, keys, neighbours), schema
    )
    return attach(rows, factors, [*keys, "value"]).select(*keys, "ts", "score")


def predict(scores: DataFrame, threshold: Column | float) -> DataFrame:
    """Label 1 from the threshold up, else 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scores.withColumn("label", F.when(F.col("score") >= limit, 1).otherwise(0))
