"""Imputation benchmark: models x series x gap sizes x seeds in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.blocks import HOUR
from sensorloom.functions.stats import finite
from sensorloom.operators import gaps as gap_ops
from sensorloom.operators import impute, report
from sensorloom.operators.registry import IMPUTERS, resolve_imputers
from sensorloom.session import cut

RESULT = ("model", "series", "gap_size", "seed", "run")
GAP = ("gap_id", "start_ts", "len")


@dataclass(frozen=True)
class Benchmark:
    results: DataFrame  # RESULT, mae, rmse, mase
    predictions: DataFrame  # RESULT, GAP, ts, actual, pred, naive
    failures: DataFrame


def predict_gaps(
    rows: DataFrame, gaps: DataFrame, names: Sequence[str] | None, *, step: int = HOUR, **options
) -> tuple[DataFrame, DataFrame]:
    """Predictions and failures of every imputer on every gap."""
    preds, failures = [], []
    for name in resolve_imputers(names):
        pred, failed = IMPUTERS[name].fill(rows, gaps, step=step, **options)
        preds.append(pred.withColumn("model", F.lit(name)).select(*RESULT, *GAP, "ts", "pred"))
        failures.append(failed.withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, preds), reduce(DataFrame.unionByName, failures)


def gap_mase(predictions: DataFrame, scales: DataFrame) -> DataFrame:
    """Length-weighted mean over the gaps of MAE / seasonal-naive error."""
    known = predictions.where(finite(F.col("actual")) & finite(F.col("pred")))
    per_gap = known.groupBy(*RESULT, *GAP).agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("_mae"))
    scored = per_gap.join(scales, ["series", "start_ts"]).withColumn("_m", F.try_divide("_mae", "scale"))
    counted = scored.where(F.col("_m").isNotNull())
    return counted.groupBy(*RESULT).agg((F.sum(F.col("_m") * F.col("len")) / F.sum("len")).alias("mase"))


def result_rows(predictions: DataFrame, scales: DataFrame) -> DataFrame:
    """MAE, RMSE and MASE per model, series, gap size, seed and run.

    A masked row counts once, also where windows of a set overlap.
    """
    pooled = predictions.where(finite(F.col("actual")) & finite(F.col("pred"))).dropDuplicates([*RESULT, "ts"])
    every = predictions.select(*RESULT).distinct()
    return (
        every.join(report.errors(pooled, RESULT), list(RESULT), "left")
        .join(gap_mase(predictions, scales), list(RESULT), "left")
    )


def run_benchmark(
    rows: DataFrame, gaps: DataFrame, names: Sequence[str] | None = None, *, m: int = 24, step: int = HOUR, **options
) -> Benchmark:
    """Impute artificial gaps of gridded series and score every model.

    ``rows`` (``series, blk, pos, ts, value``) and ``gaps`` must lie in tables.
    The series are read once whatever the number of seeds and sizes; the trend and
    forecasting imputers read them once more each.
    """
    # Looked up by the interpolating imputers and by the scale of the error alike.
    near = cut(impute.neighbours(rows.select("series", "blk", "pos", "ts", "value")))
    anchors = cut(impute.gap_anchors(rows, gaps, step, near=near))
    preds, failures = predict_gaps(rows, gaps, names, step=step, anchors=anchors, **options)
    truth = rows.select("series", "ts", F.col("value").alias("actual"))
    mask = gap_ops.gap_rows(gaps, step).select("series", "ts").distinct()
    naive = impute.seasonal_naive(rows, mask, m, step=step)
    predictions = cut(
        preds.join(truth, ["series", "ts"], "left").join(naive, ["series", "ts"], "left")
    )
    scales = cut(impute.history_scale(rows, gaps.select("series", "start_ts"), m, step=step, near=near))
    return Benchmark(result_rows(predictions, scales), predictions, failures)


def monte_carlo(
    rows: DataFrame, tests: DataFrame, names: Sequence[str] | None, *, gap_sizes: Sequence[int] = (1, 2, 5, 10),
    num_gaps: int = 3, strategy: str = "block", seeds: DataFrame | None = None, m: int = 24, step: int = HOUR,
    **options,
) -> Benchmark:
    """Benchmark over many seeds: one job, seeds are rows of a table.

    ``tests`` is ``series, first_ts, n``: the stretch of each series that gaps
    are placed in.
    """
    seeds = seeds if seeds is not None else gap_ops.seed_table(rows.sparkSession)
    planned = cut(gap_ops.plan_gaps(tests, gap_sizes, seeds, num_gaps, strategy=strategy, step=step))
    return run_benchmark(rows, planned, names, m=m, step=step, **options)
