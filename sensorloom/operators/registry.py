"""Names of detectors and imputers, and the contract for new ones.

A detector is ``fn(df, *, keys, step, ready, seed, **options) -> DataFrame`` from
gap-free rows to ``(*keys, ts, score)``, one score per row; rows may carry an ``error``
in place of a score where a group failed.  :func:`by_segment` makes one from a function
of one group's values.  An imputer is ``fn(obs, gaps, *, step, **options) ->
(predictions, failures)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import moments
from sensorloom.functions.blocks import attach
from sensorloom.operators import detect, forecast, impute, windows

# Rows of the longest group that a function of one group's values is given.
SEGMENT_ROWS = 1_000_000


@dataclass(frozen=True)
class Detector:
    score: Callable
    min_len: int = 1


DETECTORS: dict[str, Detector] = {
    "ModifiedZScore": Detector(detect.modified_z),
    "IQR": Detector(detect.iqr_fence),
    "IsolationForest": Detector(detect.isolation_forest),
    "LOF": Detector(detect.local_outlier_factor),
    "PCA": Detector(windows.pca, min_len=100),
    "Hampel_w24": Detector(detect.hampel),
    "Hampel_w6": Detector(detect.hampel6),
    "TrendBand": Detector(forecast.trend_band),
    "ForecastError": Detector(forecast.forecast_error, min_len=115),
}

def by_segment(score: Callable[[np.ndarray, int], np.ndarray], *, most: int = SEGMENT_ROWS) -> Callable:
    """Detector from ``score(values, seed)``, called on each group's values in order of time.

    An exception, or scores that do not fit the values, becomes the ``error`` of that
    group's rows; other groups are not touched.  A group of more than ``most`` rows is
    not brought into one task but fails likewise.
    """

    def detector(df: DataFrame, *, keys: Sequence[str], seed: int = 13, **_) -> DataFrame:
        keys = list(keys)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        sized = attach(df.select(*keys, "blk", "ts", "value"), sizes, keys)
        failed = F.concat(F.lit("group of "), F.col("_n").cast("string"), F.lit(f" rows, at most {most} are scored"))
        long = sized.where(F.col("_n") > most).select(*keys, "ts", F.lit(None).cast("double").alias("score"), failed.alias("error"))

        def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts")
            out = pdf[[*keys, "ts"]].copy()
            try:
                scores = np.asarray(score(pdf["value"].to_numpy(dtype=float), seed), dtype=float)
                if scores.shape != (len(out),):
                    raise ValueError(f"{scores.shape} scores of {len(out)} rows")
            except Exception as problem:  # noqa: BLE001 - whatever the function raises ends here
                return out.assign(score=None, error=f"{type(problem).__name__}: {problem}")
            return out.assign(score=scores, error=None)

        schema = f"{moments.key_schema(df, keys)}, ts timestamp, score double, error string"
        short = sized.where(F.col("_n") <= most).drop("_n", "blk")
        return short.groupBy(*keys).applyInPandas(one_group, schema).unionByName(long)

    return detector


INTERPOLATION, LINEAR, TREND, GLOBAL = "interpolation", "linear", "trend", "global"


@dataclass(frozen=True)
class Imputer:
    family: str
    fill: Callable


IMPUTERS: dict[str, Imputer] = {
    "interp": Imputer(INTERPOLATION, impute.seasonal_imputer),
    "LinearInterp": Imputer(LINEAR, impute.linear_imputer),
    "TrendFit": Imputer(TREND, impute.trend_imputer),
    "LinearRegression": Imputer(GLOBAL, forecast.model_imputer("LinearRegression")),
    "NLinear": Imputer(GLOBAL, forecast.model_imputer("NLinear")),
    "DLinear": Imputer(GLOBAL, forecast.model_imputer("DLinear")),
}


def _resolve(names: Sequence[str] | None, known: dict, what: str) -> list[str]:
    wanted = [n.strip() for n in names or ["all"] if n.strip()]
    if len(wanted) == 1 and wanted[0].lower() == "all":
        return list(known)
    unknown = [n for n in wanted if n not in known]
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(unknown)}")
    if not wanted:
        raise ValueError(f"no {what} named")
    return list(dict.fromkeys(wanted))


def resolve_detectors(names: Sequence[str] | None = None, extra: Mapping[str, Detector] | None = None) -> list[str]:
    """Valid detector names, those of ``extra`` included; none or ``all`` means every one."""
    return _resolve(names, DETECTORS | dict(extra or {}), "detector")


def resolve_imputers(names: Sequence[str] | None = None) -> list[str]:
    """Valid imputer names without duplicates; none or ``all`` means every one."""
    return _resolve(names, IMPUTERS, "imputer")


def trainable(names: Sequence[str]) -> list[str]:
    """The names that stand for global forecasters; an error when none does."""
    found = [n for n in resolve_imputers(names) if IMPUTERS[n].family == GLOBAL]
    if not found:
        raise ValueError("no trainable model named")
    return found


def register_detector(name: str, score: Callable, min_len: int = 1) -> None:
    DETECTORS[name] = Detector(score, min_len)


def register_imputer(name: str, fill: Callable, family: str = INTERPOLATION) -> None:
    IMPUTERS[name] = Imputer(family, fill)
