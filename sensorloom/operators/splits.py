"""Hold-outs, train/validation/test roles, scalers and covariates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.blocks import HOUR, MICROS, SERIES, attach, micros
from sensorloom.functions.stats import beside
from sensorloom.operators.grid import longest_run, observed_segments, positions


def enough_points(obs: DataFrame, *, min_points: int, min_ratio: float = 0.0) -> DataFrame:
    """Series with enough rows and a large enough share of observed ones."""
    good = (
        obs.groupBy("series")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").isNotNull().cast("int")).alias("ratio"))
        .where((F.col("n") >= min_points) & (F.col("ratio") >= min_ratio))
    )
    return _only(obs, good)


def enough_observed(obs: DataFrame, min_points: int) -> DataFrame:
    """Series with at least ``min_points`` observed rows."""
    good = obs.groupBy("series").agg(F.count("value").alias("n")).where(F.col("n") >= min_points)
    return _only(obs, good)


def _only(rows: DataFrame, good: DataFrame) -> DataFrame:
    if "blk" in rows.columns:
        return attach(rows, good.select("series"))
    return beside(rows, good.select("series"), SERIES)


def rows_before(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows strictly before each series' ``holdout_start``."""
    return attach(rows, starts.select("series", "holdout_start")).where("ts < holdout_start").drop("holdout_start")


def hold_out(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Null the held-out ``(series, ts)`` rows; ``masked`` marks them."""
    hits = held.select("series", "ts", F.lit(True).alias("_hit")).distinct()
    marked = rows.join(hits, ["series", "ts"], "left").withColumn("masked", F.col("_hit").isNotNull())
    return marked.withColumn("value", F.when(~F.col("masked"), F.col("value"))).drop("_hit")


def held_out_counts(masked: DataFrame) -> DataFrame:
    return masked.groupBy("series").agg(F.count_if("masked").alias("n_held_out"))


def segment_tails(
    rows: DataFrame, *, val_size: int, min_train_len: int, val_context: int, step: int = HOUR
) -> DataFrame:
    """Roles of rows inside each long enough segment.

    A segment needs ``max(min_train_len, val_context) + val_size`` rows.  Its
    ``train`` rows are all but the last ``val_size``; its ``valid`` rows are the
    last ``val_context + val_size``, so some rows have both roles.  Without a
    validation size every row trains.
    """
    if val_size < 0 or val_context < 0:
        raise ValueError("sizes must not be negative")
    needed = max(min_train_len, val_context) + val_size if val_size else min_train_len
    segments = observed_segments(rows, max(1, needed))
    left = ((micros("segment_end") - micros("ts")) / F.lit(step * MICROS)).cast("bigint")
    tagged = segments.withColumn("_left", left)
    if val_size == 0:
        return tagged.withColumn("role", F.lit("train")).drop("_left", "segment_end")
    roles = F.array_compact(
        F.array(
            F.when(F.col("_left") >= val_size, F.lit("train")),
            F.when(F.col("_left") < val_context + val_size, F.lit("valid")),
        )
    )
    return tagged.withColumn("role", F.explode(roles)).drop("_left", "segment_end")


def scalers(rows: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean and population deviation per series, 1 in place of a zero deviation."""
    std = F.stddev_pop("value")
    return rows.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std")
    )


def scale(rows: DataFrame, fitted: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return _with(rows, fitted, keys).withColumn(
        "value", (F.col("value") - F.col("mean")) / F.col("std")
    ).drop("mean", "std")


def _with(rows: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach(rows, fitted, keys) if "blk" in rows.columns else beside(rows, fitted, keys)


def unscale(rows: DataFrame, fitted: DataFrame, column: str = "value", keys: Sequence[str] = SERIES) -> DataFrame:
    return _with(rows, fitted, keys).withColumn(
        column, F.col(column) * F.col("std") + F.col("mean")
    ).drop("mean", "std")


def split_long(rows: DataFrame, *, valid_fraction: float, context: int) -> DataFrame:
    """Cut every series by position; validation starts ``context`` rows early.

    The cut is ``int(n * (1 - fraction))`` kept within 1 and n - 1; series with
    fewer than two rows drop out.
    """
    if not 0.0 < valid_fraction < 1.0:
        raise ValueError("valid_fraction must lie between 0 and 1")
    cut_at = F.floor(F.col("n") * F.lit(1.0 - valid_fraction)).cast("bigint")
    cut_at = F.greatest(F.lit(1), F.least(cut_at, F.col("n") - 1))
    placed = positions(rows).where("n >= 2").withColumn("_cut", cut_at)
    roles = F.array_compact(
        F.array(
            F.when(F.col("row") < F.col("_cut"), F.lit("train")),
            F.when(F.col("row") >= F.col("_cut") - context, F.lit("valid")),
        )
    )
    return placed.withColumn("role", F.explode(roles)).drop("_cut", "n")


def benchmark_bundle(
    rows: DataFrame, held: DataFrame, *, val_size: int, min_train_len: int, val_context: int,
    test_only: DataFrame | None = None, train_fraction: float = 0.6, step: int = HOUR,
) -> tuple[DataFrame, DataFrame]:
    """Scaled test rows and the scalers.

    Test rows are the held-out block of the series that still have training
    segments without it.  Series of ``test_only`` are cut by position: the first
    part fits the scaler, the rest is the test block.
    """
    training = segment_tails(
        hold_out(rows, held).drop("masked"),
        val_size=val_size, min_train_len=min_train_len, val_context=val_context, step=step,
    ).where("role = 'train'")
    fitted = scalers(training)
    tests = rows.join(held.select("series", "ts"), ["series", "ts"], "left_semi").select("series", "ts", "value")
    if test_only is not None:
        at = F.floor(F.col("n") * F.lit(train_fraction)).cast("bigint")
        placed = positions(test_only).withColumn("_cut", F.greatest(F.lit(1), F.least(at, F.col("n") - 1)))
        fitted = fitted.unionByName(scalers(placed.where("row < _cut")))
        tests = tests.unionByName(placed.where("row >= _cut").select("series", "ts", "value"))
    scaled = scale(tests.withColumn("actual", F.col("value")), fitted)
    return scaled.withColumnRenamed("value", "scaled").select("series", "ts", "actual", "scaled"), fitted


def holdout_window(rows: DataFrame, *, holdout: int, context: int, step: int = HOUR) -> DataFrame:
    """``eval_start, holdout_start, eval_end`` at the end of the longest observed
    run; series whose longest run is too short drop out."""
    best = longest_run(rows).where(F.col("run_len") >= holdout + context)
    back = lambda n: F.timestamp_micros(micros("run_end") - F.lit(n * step * MICROS))
    return best.select(
        "series",
        back(context + holdout - 1).alias("eval_start"),
        back(holdout - 1).alias("holdout_start"),
        F.col("run_end").alias("eval_end"),
    )


def backtest_runs(rows: DataFrame, *, lags: int, k: int, step: int = HOUR, val_most: int = 48) -> DataFrame:
    """Training and validation rows of a backtest.

    Observed runs of at least ``lags + k`` rows train.  The end of the longest
    (the first of equals) is kept for validation together with ``lags`` rows of
    context; series whose longest run cannot spare it drop out.
    """
    segments = observed_segments(rows, lags + k)
    best = segments.groupBy("series").agg(
        F.max_by(
            F.struct("segment", "segment_len"), F.struct(F.col("segment_len"), -micros("segment"))
        ).alias("b")
    )
    block = F.greatest(F.lit(k), F.least(F.lit(val_most), F.floor(F.col("b.segment_len") / 5))).cast("bigint")
    best = best.select("series", F.col("b.segment").alias("_longest"), F.col("b.segment_len").alias("_len"), block.alias("_val"))
    best = best.where(F.col("_len") >= lags + 2 * k + F.col("_val"))
    left = ((micros("segment_end") - micros("ts")) / F.lit(step * MICROS)).cast("bigint")
    joined = attach(segments, best).withColumns({"_left": left, "_is": F.col("segment") == F.col("_longest")})
    roles = F.array_compact(
        F.array(
            F.when(~F.col("_is") | (F.col("_left") >= F.col("_val")), F.lit("train")),
            F.when(F.col("_is") & (F.col("_left") < F.col("_val") + lags), F.lit("valid")),
        )
    )
    return joined.withColumn("role", F.explode(roles)).select("series", "segment", "blk", "ts", "value", "role")


def covariates(rows: DataFrame) -> DataFrame:
    """Month on the circle, hour, weekday (Monday 0) and relative position."""
    angle: Column = F.lit(2.0 * math.pi) * F.month("ts") / F.lit(12.0)
    return positions(rows).select(
        "series", "ts",
        F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"),
        F.hour("ts").cast("bigint").alias("hour"), F.weekday("ts").cast("bigint").alias("weekday"),
        F.try_divide(F.col("row"), F.col("n") - 1).alias("position"),
    )
