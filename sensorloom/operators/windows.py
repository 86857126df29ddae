"""Sliding windows: tables of them, folding their scores back, corrupting them.

Input rows are gap-free per group: ``keys`` (a series, or a segment of it),
``ts`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import chance, moments
from sensorloom.functions.blocks import BLOCK_ROWS, HOUR, MICROS, attach, halo, micros
from sensorloom.functions.stats import beside
from sensorloom.operators.detect import by_block

SEGMENT = ("series", "segment")


def window_table(
    df: DataFrame, width: int, *, stride: int = 1, keys: Sequence[str] = SEGMENT, step: int = HOUR,
    rows: int = BLOCK_ROWS, back: int = 0,
) -> DataFrame:
    """Full windows ``w`` of ``width`` values, one every ``stride`` rows.

    ``start_pos`` counts rows from the start of the group.  With ``back`` the
    values of that many rows before the window come along in ``before``.
    """
    bounds = df.groupBy(*keys).agg(F.min("ts").alias("_t0"))
    spread = halo(df.select(*keys, "ts", "value"), back, width - 1, step=step, rows=rows, keys=keys)
    line = Window.partitionBy(*keys, "blk").orderBy("ts")
    framed = spread.withColumn("w", F.collect_list("value").over(line.rowsBetween(0, width - 1)))
    if back:
        framed = framed.withColumn("before", F.collect_list("value").over(line.rowsBetween(-back, -1)))
    start = ((micros("ts") - micros("_t0")) / F.lit(step * MICROS)).cast("bigint")
    full = attach(framed.where(F.col("own") & (F.size("w") == width)), bounds, keys)
    extra = ["before"] if back else []
    return full.withColumn("start_pos", start).where(F.col("start_pos") % stride == 0).select(
        *keys, "start_pos", "ts", "w", *extra
    )


def capped_stride(n: Column, most: int) -> Column:
    """Stride that keeps the number of windows near ``most``."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(most))).cast("bigint")


# Parts of a group whose first windows are found apart.
PARTS = 64


def sample_windows(
    windows: DataFrame, most: int, seed: int, *, keys: Sequence[str] = ("series",), order: str = "ts"
) -> DataFrame:
    """``most`` windows per group, or all if there are fewer, drawn by a seeded hash.

    The windows with the smallest hashes are kept, first of every part of a group
    (and, before the shuffle, of every task), then of the parts' ones: no task holds
    more of a group than a part and ``most`` windows of each part.
    """
    drawn = windows.withColumns(
        {"_u": chance.whole(seed, "window", *[F.col(k) for k in keys], F.col(order)),
         "_part": F.pmod(F.xxhash64(order), F.lit(PARTS))}
    )
    for group in ([*keys, "_part"], list(keys)):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("_u", order))
        drawn = drawn.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")
    return drawn.drop("_u", "_part")


def _fold(
    scored: DataFrame, width: int, tail: int, keys: Sequence[str], step: int, rows: int
) -> DataFrame:
    spread = halo(scored.select(*keys, "ts", "score"), width - 1, 0, step=step, rows=rows, keys=keys)
    over = Window.partitionBy(*keys, "blk").orderBy("ts").rowsBetween(1 - width, tail - width)
    mean = F.coalesce(F.avg("score").over(over), F.lit(0.0))
    return spread.withColumn("score", mean).where("own").select(*keys, "ts", "score")


def fold_windows(
    scored: DataFrame, width: int, *, keys: Sequence[str] = SEGMENT, step: int = HOUR, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean score of all windows that cover a row, 0 where none does.

    ``scored`` has every row of the group; ``score`` is the score of the window
    that starts there, or null.
    """
    return _fold(scored, width, width, keys, step, rows)


def fold_tails(
    scored: DataFrame, width: int, tail: int, *, keys: Sequence[str] = SEGMENT, step: int = HOUR,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """As :func:`fold_windows`, but a window only scores its last ``tail`` rows."""
    return _fold(scored, width, max(1, min(tail, width)), keys, step, rows)


# --- window corruption --------------------------------------------------------


def window_draws(size: int, *labels: Column | str | int) -> dict[str, Column]:
    """Random choices for :func:`corrupt_window`, to be added as columns once."""
    low, high = int(size * 0.1), max(int(size * 0.1) + 1, int(size * 0.9))
    length = chance.integer(low, high, *labels, "length").cast("int")
    offset = F.lit(1.0) + F.lit(0.5) * chance.normal(*labels, "trend")
    return {
        "_length": length,
        "_start": chance.integer(F.lit(0), F.lit(size) - length, *labels, "start").cast("int"),
        "_speed": chance.integer(2, 5, *labels, "speed").cast("int"),
        "_offset": F.when(chance.uniform(*labels, "sign") < 0.5, -offset).otherwise(offset),
        "_bump": chance.uniform(*labels, "bump") * F.lit(0.1),
        "_kind": chance.integer(0, 5, *labels, "kind"),
    }


def corrupt_window(w: Column) -> Column:
    """One of five corruptions of a stretch of the window, by ``_kind``.

    seasonal: the stretch runs 2 to 4 times as fast; trend: an offset from the
    stretch's start to the window's end; global: 2 values times 8; contextual:
    4 values times 3; shapelet: the stretch flattened near its first value.
    """
    length, start, kind = F.col("_length"), F.col("_start"), F.col("_kind")

    def inside(i: Column, n: Column | int) -> Column:
        return (i >= start) & (i < start + n)

    sped = F.transform(
        w,
        lambda x, i: F.when(
            inside(i, length), F.get(w, start + F.pmod((i - start) * F.col("_speed"), length))
        ).otherwise(x),
    )
    trend = F.transform(w, lambda x, i: F.when(i >= start, x + F.col("_offset")).otherwise(x))
    spike = F.transform(w, lambda x, i: F.when(inside(i, 2), x * 8.0).otherwise(x))
    context = F.transform(w, lambda x, i: F.when(inside(i, 4), x * 3.0).otherwise(x))
    flat = F.transform(w, lambda x, i: F.when(inside(i, length), F.get(w, start) + F.col("_bump")).otherwise(x))
    return (
        F.when(kind == 0, sped).when(kind == 1, trend).when(kind == 2, spike).when(kind == 3, context).otherwise(flat)
    )


def corrupt_tail(table: DataFrame, size: int, seed: int, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """One of six corruptions of each window's end, picked at random.

    0: tail to 0; 1: tail to 1; 2 and 3: last value to the mean of the last ten
    plus or minus 0.5; 4: last value to 2; 5: last value to -2.
    """
    labels = (seed, *[F.col(k) for k in keys], F.col("start_pos"))
    recent = F.slice("w", max(1, size - 9), min(10, size))
    drawn = table.withColumns(
        {"cut": F.lit(size) - chance.integer(1, max(2, size // 2), *labels, "cut"),
         "kind": chance.integer(0, 6, *labels, "kind"),
         "_mean": F.aggregate(recent, F.lit(0.0), lambda a, x: a + x) / F.size(recent)}
    )
    kind = F.col("kind")
    last = (
        F.when(kind == 2, F.col("_mean") + 0.5)
        .when(kind == 3, F.col("_mean") - 0.5)
        .when(kind == 4, F.lit(2.0))
        .otherwise(F.lit(-2.0))
    )
    changed = F.transform(
        "w",
        lambda x, i: F.when((kind < 2) & (i >= F.col("cut")), kind.cast("double"))
        .when((kind >= 2) & (i == size - 1), last)
        .otherwise(x),
    )
    return drawn.withColumn("negative", changed).drop("_mean")


def triplets(
    df: DataFrame, width: int, seed: int, *, keys: Sequence[str] = SEGMENT, step: int = HOUR,
    sigma: float = 0.1, reach: int = 10, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Anchor, weak positive and corrupted negative of every window, standardised.

    The positive is one of the ``reach`` previous windows.  Windows overlap, so
    it is a slice of the values that lead up to the anchor; the first windows,
    which lack that lead, get the anchor plus noise.
    """
    table = window_table(df, width, keys=keys, step=step, rows=rows, back=reach)
    stats = df.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    labels = (seed, *[F.col(k) for k in keys], F.col("start_pos"))
    drawn = beside(table, stats, keys).withColumns(
        {**window_draws(width, *labels), "_shift": chance.integer(1, reach + 1, *labels, "shift").cast("int")}
    )
    led = F.concat("before", "w")
    earlier = F.slice(led, F.lit(reach) - F.col("_shift") + 1, F.lit(width))
    noisy = F.transform("w", lambda x, i: x + F.lit(sigma) * chance.normal(*labels, "noise", i))
    positive = F.when(F.col("start_pos") > reach, earlier).otherwise(noisy)
    scale = F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std"))
    unit = lambda array: F.transform(array, lambda x: (x - F.col("_mean")) / scale)
    return drawn.select(
        *keys, "start_pos",
        unit(F.col("w")).alias("anchor"),
        unit(positive).alias("positive"),
        unit(corrupt_window(F.col("w"))).alias("negative"),
    )


# --- principal components of windows ------------------------------------------


def pca(
    df: DataFrame, *, keys: Sequence[str] = SEGMENT, window: int = 100, step: int = HOUR,
    rows: int = BLOCK_ROWS, selected: int | None = None, weighted: bool = True, **_,
) -> DataFrame:
    """Weighted distance of standardised windows to the principal axes, folded
    back to rows.

    Sums of outer products per block give one correlation matrix per group; its
    axes (largest entry positive) travel to the blocks for scoring.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"))
    long_enough = attach(df, sizes.where(F.col("_n") >= window), keys)
    centred = long_enough.withColumn("value", F.col("value") - F.col("_mean"))
    spread = halo(centred.select(*keys, "ts", "value"), 0, window - 1, step=step, rows=rows, keys=keys)

    def cut_windows(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("ts")
        cut = moments.sliding(pdf["value"].to_numpy(), window)
        own = pdf["own"].to_numpy()[: len(cut)]
        return pdf.iloc[: len(cut)][own], cut[own]

    def build(pdf: pd.DataFrame) -> np.ndarray:
        cut = cut_windows(pdf)[1]
        return np.hstack([np.ones((len(cut), 1)), cut])

    def axes(sums: np.ndarray) -> dict:
        n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
        cov = sums[1:, 1:] / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov), 0.0))
        std[std < 1e-12] = 1.0
        values, vectors = np.linalg.eigh(cov / np.outer(std, std))
        order = np.argsort(values)[::-1][: int(min(n, window))]
        values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
        top = np.abs(vectors).argmax(axis=1)
        vectors *= np.sign(vectors[np.arange(len(vectors)), top])[:, None]
        share = values / values.sum() if weighted else np.ones(len(values))
        kept = max(1, min(selected or len(values), len(values)))
        return {
            "mean": mean.tolist(), "std": std.tolist(),
            "axes": vectors[-kept:].ravel().tolist(),
            "share": np.maximum(share[-kept:], 1e-12).tolist(),
        }

    sums = moments.gram(spread, keys, build, [*keys, "blk"])
    model = moments.fit(
        sums, keys, axes, "mean array<double>, std array<double>, axes array<double>, share array<double>"
    )

    def score(pdf: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        one = fitted.iloc[0]
        starts, cut = cut_windows(pdf)
        z = (cut - np.asarray(one["mean"])) / np.asarray(one["std"])
        v = np.asarray(one["axes"]).reshape(-1, window)
        far = (z * z).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2.0 * z @ v.T
        out = starts[[*keys, "ts"]].copy()
        out["score"] = (np.sqrt(np.maximum(far, 0.0)) / np.asarray(one["share"])).sum(axis=1)
        return out

    starts = by_block(spread, model, score, keys)
    scored = long_enough.select(*keys, "ts").join(starts, [*keys, "ts"], "left")
    return fold_windows(scored, window, keys=keys, step=step, rows=rows)
