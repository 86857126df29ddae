"""Error metrics, rankings and the tables behind reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.stats import finite, median, quantiles

METRICS = ("mae", "rmse", "mase")


def truth_pairs(truth: DataFrame, preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows at common timestamps where truth and prediction are both finite."""
    on = [*keys, "ts"]
    return truth.join(preds, on).where(finite(F.col("actual")) & finite(F.col("pred")))


def errors(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE and RMSE per group of truth/prediction pairs."""
    off = F.col("actual") - F.col("pred")
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse")
    )


def mean_absolute_error(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae"))


def rank_models(results: DataFrame) -> DataFrame:
    """Mean metrics per model, best first."""
    return results.groupBy("model").agg(*[F.avg(m).alias(m) for m in METRICS]).orderBy(
        *[F.col(m).asc_nulls_last() for m in ("mase", "rmse", "mae")]
    )


def rank_by_seed(results: DataFrame) -> DataFrame:
    """Mean metrics per seed, run and model."""
    return results.groupBy("seed", "run", "model").agg(*[F.avg(m).alias(m) for m in METRICS])


def summarise_runs(ranking: DataFrame) -> DataFrame:
    """Mean, sample deviation, P05 and P95 over the runs of each model."""
    base = ranking.groupBy("model").agg(
        F.countDistinct("seed").alias("runs"),
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in METRICS],
    )
    return _with_tails(ranking, base, ["model"]).orderBy(
        *[F.col(f"{m}_mean").asc_nulls_last() for m in ("mase", "rmse", "mae")]
    )


def by_gap_size(results: DataFrame) -> DataFrame:
    """Mean, P05 and P95 per model and gap size."""
    base = results.groupBy("model", "gap_size").agg(*[F.avg(m).alias(f"{m}_mean") for m in METRICS])
    return _with_tails(results, base, ["model", "gap_size"])


def _with_tails(rows: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    # One long pass for all metrics instead of one pass each.
    long = rows.unpivot(list(keys), list(METRICS), "metric", "x")
    tails = quantiles(long, [*keys, "metric"], F.col("x"), {"p05": 0.05, "p95": 0.95})
    wide = tails.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(q))).alias(f"{m}_{q}") for m in METRICS for q in ("p05", "p95")]
    )
    return base.join(wide, list(keys), "left")


def compare_arms(results: DataFrame) -> DataFrame:
    """Raw and preprocessed metrics side by side with delta and percent gain."""
    pick = [
        F.first(F.when(F.col("arm") == arm, F.col(m)), ignorenulls=True).alias(f"{m}_{short}")
        for m in ("rmse", "mae", "mase")
        for arm, short in (("raw", "raw"), ("preprocessed", "pre"))
    ]
    wide = results.groupBy("series", "model").agg(*pick)
    for m in ("rmse", "mae", "mase"):
        raw, pre = F.col(f"{m}_raw"), F.col(f"{m}_pre")
        wide = wide.withColumns(
            {f"{m}_delta": pre - raw, f"{m}_improve_pct": F.try_divide(100.0 * (raw - pre), raw)}
        )
    return wide


def merge_predictions(parts: Sequence[DataFrame]) -> DataFrame:
    """One table over per-model prediction sets; the first known truth is kept."""
    tagged = [df.withColumn("_i", F.lit(i)) for i, df in enumerate(parts)]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df)
    row = ["gap_size", "series", "ts"]
    truth = merged.groupBy(*row).agg(
        F.min_by("actual", F.when(F.col("actual").isNotNull(), F.col("_i"))).alias("actual"),
        F.min_by("naive", F.when(F.col("naive").isNotNull(), F.col("_i"))).alias("naive"),
    )
    preds = merged.groupBy(*row, "model").agg(F.max_by("pred", "_i").alias("pred"))
    return preds.join(truth, row)


def prediction_window(preds: DataFrame) -> DataFrame:
    """First and last timestamp of all predictions that are not null."""
    return preds.where(F.col("pred").isNotNull()).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )


def model_order(per_series: DataFrame, macro: DataFrame) -> DataFrame:
    """Sort value of each model: its macro metric, else the median over series."""
    middle = median(per_series, ["model"], F.col("metric"))
    return middle.join(macro, ["model"], "full").select(
        "model",
        F.coalesce("macro_metric", "median", F.lit(float("inf"))).alias("order_value"),
    ).orderBy("order_value", "model")


def distribution(per_series: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of a metric across series per model."""
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles(per_series, ["model"], F.col("metric"), probs)


def fit_times(per_series: DataFrame) -> DataFrame:
    """Mean fit time per model and the median of those means."""
    means = per_series.groupBy("model").agg(F.avg("fit_seconds").alias("mean_fit_seconds"))
    # Only positive means enter the median line.
    middle = median(
        means.where("mean_fit_seconds > 0").withColumn("all", F.lit(1)), ["all"], F.col("mean_fit_seconds"),
        "median_fit_seconds",
    )
    return means.join(F.broadcast(middle.drop("all")), how="left")


def manifest(preds: DataFrame) -> DataFrame:
    """Number of models with predictions per gap size and series."""
    return preds.groupBy("gap_size", "series").agg(F.countDistinct("model").alias("model_count"))
