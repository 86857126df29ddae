"""Does cleaning the training data help the forecasters?"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.blocks import HOUR
from sensorloom.operators import forecast, impute, report, screen, splits
from sensorloom.plans.cleaning import detect_anomalies
from sensorloom.session import cut

HOLDOUT = 168
CONTEXT = 72
ARM = ("series", "arm")


def compare(
    rows: DataFrame, models: Sequence[str] = ("NLinear",), *, detectors: Sequence[str] | None = None,
    imputer: Callable = impute.seasonal_imputer, holdout: int = HOLDOUT, context: int = CONTEXT,
    lags: int = forecast.LAGS, k: int = forecast.HORIZON, m: int = 24, min_points: int = 600, step: int = HOUR,
    budget: float = screen.MAX_DETECTION_RATE,
) -> tuple[DataFrame, DataFrame]:
    """Backtest models trained on raw and on cleaned rows over one hold-out.

    ``rows`` is a regular grid (``series, blk, pos, ts, value``).  Only rows
    before the hold-out are cleaned and filled; both arms forecast the same
    observed window.  Result: one row per series, model and arm, and the arms
    side by side.
    """
    rows = cut(splits.enough_observed(rows, min_points))
    windows = cut(splits.holdout_window(rows, holdout=holdout, context=context, step=step))
    raw = cut(splits.rows_before(rows, windows))
    cleaning = detect_anomalies(raw, detectors=detectors, step=step, budget=budget)
    cleaned = cut(screen.remove_flagged(raw, cleaning.flags))
    filled = cut(impute.impute_series(cleaned, imputer, step=step))
    results = None
    for arm, history in (("raw", raw), ("preprocessed", filled)):
        train = splits.backtest_runs(history, lags=lags, k=k, step=step)
        forecasts = cut(forecast.backtest(train, rows, windows, models, lags=lags, k=k, step=step))
        part = forecast.backtest_metrics(forecasts, history, windows, m=m, step=step).withColumn("arm", F.lit(arm))
        results = part if results is None else results.unionByName(part)
    counts = cleaning.totals.select("series", F.col("n_flagged").alias("n_anomalies"))
    results = cut(results.join(counts, ["series"], "left"))
    return results, report.compare_arms(results)
