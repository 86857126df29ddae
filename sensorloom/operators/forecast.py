"""Linear forecasters, backtests and the detectors built on fits.

All models here are least squares on the same lag windows, so one pass over the
rows sums ``zᵀz`` with ``z = (1, lags, targets)`` and every model is a small solve
on that matrix.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import moments
from sensorloom.functions.blocks import BLOCK_ROWS, HOUR, MICROS, SERIES, attach, halo, micros
from sensorloom.operators import grid, splits
from sensorloom.operators.gaps import SET, gap_rows
from sensorloom.operators.impute import context_counts, failure_table, history_scale, left_context
from sensorloom.operators.windows import SEGMENT, window_table
from sensorloom.session import cut

LAGS = 72
HORIZON = 5
SMOOTH = 25
RIDGE = 1e-6
EVERY = "every"
MODEL_SCHEMA = "k int, coef array<double>, bias array<double>"


# --- fitting ------------------------------------------------------------------


def lag_sums(
    rows: DataFrame, *, lags: int, k: int, model_keys: Sequence[str], group: Sequence[str] = SEGMENT,
    step: int = HOUR, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sums of outer products over all windows of ``lags`` inputs and ``k`` targets.

    ``group`` are the gap-free stretches windows may not leave; ``model_keys``
    say what shares a model.
    """
    width = lags + k
    spread = halo(rows, 0, width - 1, step=step, rows=block_rows, keys=group)

    def build(pdf: pd.DataFrame) -> np.ndarray:
        pdf = pdf.sort_values("ts")
        cut_up = moments.sliding(pdf["value"].to_numpy(), width)
        cut_up = cut_up[pdf["own"].to_numpy()[: len(cut_up)]]
        return np.hstack([np.ones((len(cut_up), 1)), cut_up])

    return moments.gram(spread, model_keys, build, [*group, "blk"])


def _least_squares(sums: np.ndarray, lags: int, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Map from lags to targets, ridge-regularised in the coordinates ``basis``."""
    n = sums[0, 0]
    mean = sums[0] / n
    cov = sums / n - np.outer(mean, mean)
    xx, xy = cov[1 : lags + 1, 1 : lags + 1], cov[1 : lags + 1, lags + 1 :]
    left = basis @ xx @ basis.T
    weights = np.linalg.solve(left + RIDGE * np.eye(len(left)), basis @ xy)
    coef = (basis.T @ weights).T
    return coef, mean[lags + 1 :] - coef @ mean[1 : lags + 1]


def _one_step(sums: np.ndarray, lags: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lagged regression for the next value; longer horizons feed it back."""
    coef, bias = _least_squares(sums, lags, np.eye(lags))
    return coef[:1], bias[:1]


def _level_free(sums: np.ndarray, lags: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets measured from the last input, one map per step ahead."""
    size = 1 + lags + k
    shift = np.eye(size)
    shift[1:, lags] -= 1.0
    shift[lags, lags] = 1.0
    moved = shift @ sums @ shift.T
    basis = np.eye(lags)[: lags - 1]
    coef, bias = _least_squares(moved, lags, basis)
    # Back to plain inputs: y - last = coef (x - last).
    coef = coef.copy()
    coef[:, lags - 1] = 1.0 - coef[:, : lags - 1].sum(axis=1)
    return coef, bias


def _two_part(sums: np.ndarray, lags: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Moving-average trend and remainder, a map each, summed."""
    half = (SMOOTH - 1) // 2
    smooth = np.zeros((lags, lags))
    for i in range(lags):
        for j in range(i - half, i + SMOOTH - half):
            smooth[i, min(max(j, 0), lags - 1)] += 1.0 / SMOOTH
    return _least_squares(sums, lags, np.vstack([smooth, np.eye(lags) - smooth]))


MODELS: dict[str, Callable] = {"LinearRegression": _one_step, "NLinear": _level_free, "DLinear": _two_part}


def fit_models(
    rows: DataFrame, names: Sequence[str], *, lags: int = LAGS, k: int = HORIZON,
    model_keys: Sequence[str] = (EVERY,), group: Sequence[str] = SEGMENT, step: int = HOUR,
) -> DataFrame:
    """``model, keys, k, coef, bias`` per model name; one pass over the rows.

    ``k`` is the number of values a model gives at once, ``coef`` its map row by
    row.
    """
    unknown = set(names) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown forecast model: {', '.join(sorted(unknown))}")
    rows = rows.withColumn(EVERY, F.lit(0)) if EVERY in model_keys else rows
    sums = cut(lag_sums(rows, lags=lags, k=k, model_keys=model_keys, group=group, step=step))

    def solver(name: str) -> Callable:
        def solve(matrix: np.ndarray) -> dict:
            coef, bias = MODELS[name](matrix, lags, k)
            return {"k": len(bias), "coef": coef.ravel().tolist(), "bias": bias.tolist()}

        return solve

    parts = [
        moments.fit(sums, model_keys, solver(name), MODEL_SCHEMA).withColumn("model", F.lit(name)) for name in names
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def train_models(rows: DataFrame, names: Sequence[str], **options) -> tuple[DataFrame, DataFrame]:
    """Fit the models one after the other; also one row per model with the time."""
    fitted, times = [], []
    for name in names:
        start = time.perf_counter()
        fitted.append(cut(fit_models(rows, [name], **options)))
        times.append((name, 0, None, None, time.perf_counter() - start))
    models = fitted[0]
    for part in fitted[1:]:
        models = models.unionByName(part)
    schema = "model_name string, epoch int, train_loss double, val_loss double, training_time_seconds double"
    return models, rows.sparkSession.createDataFrame(times, schema)


# --- applying -----------------------------------------------------------------


def step_ahead(context: Column, lags: int) -> Column:
    """The model's ``k`` next values after a context array of ``lags`` values."""
    products = lambda h: F.zip_with(context, F.slice("coef", h * lags + 1, lags), lambda x, c: x * c)
    return F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda h: F.aggregate(products(h), F.get("bias", h), lambda a, x: a + x),
    )


def roll_ahead(context: Column, steps: Column, lags: int) -> Column:
    """``steps`` next values, feeding predictions back where ``k`` is shorter."""
    rounds = F.ceil(steps / F.col("k"))
    grown = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), rounds.cast("bigint")),
        context,
        lambda seen, _: F.concat(seen, step_ahead(F.slice(seen, -lags, lags), lags)),
    )
    return F.slice(grown, F.lit(lags + 1), steps.cast("int"))


def model_imputer(name: str) -> Callable:
    """Imputer that forecasts each gap from the clean rows before it.

    ``train`` are the gap-free rows to fit on (``series, segment, blk, ts,
    value``); without it the given rows are used with every gap masked.
    """

    def fill(
        rows: DataFrame, gaps: DataFrame, *, step: int = HOUR, lags: int = LAGS, k: int = HORIZON,
        train: DataFrame | None = None, **_,
    ) -> tuple[DataFrame, DataFrame]:
        if train is None:
            masked = gap_rows(gaps, step).select("series", "ts")
            train = grid.observed_segments(splits.hold_out(rows, masked).drop("masked"), lags + k)
        train = cut(train.select("series", "segment", "blk", "ts", "value"))
        fitted = cut(splits.scalers(train))
        models = fit_models(splits.scale(train, fitted), [name], lags=lags, k=k, step=step)
        context = left_context(rows, gaps, lags, step=step)
        scaled = cut(splits.scale(context, fitted))
        counted = context_counts(scaled, gaps)
        lists = scaled.groupBy(*SET, "gap_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(-F.col("back"), F.col("value")))), lambda s: s["value"]
            ).alias("x")
        )
        ready = counted.where(F.col("available") >= lags).join(lists, [*SET, "gap_id"])
        model = models.select("k", "coef", "bias")  # one row
        ahead = ready.join(F.broadcast(model)).withColumn(
            "p", roll_ahead(F.col("x"), F.col("len"), lags)
        )
        preds = ahead.select(*gaps.columns, F.posexplode("p").alias("offset", "pred")).withColumn(
            "ts", F.timestamp_micros(micros("start_ts") + F.col("offset") * (step * MICROS))
        )
        out = splits.unscale(preds, fitted, "pred").select(*gaps.columns, "ts", "pred")
        return out, failure_table(counted.where(F.col("available") < lags), name, lags)

    return fill


# --- backtest -----------------------------------------------------------------


def backtest(
    train: DataFrame, rows: DataFrame, windows: DataFrame, names: Sequence[str], *, lags: int = LAGS,
    k: int = HORIZON, step: int = HOUR, keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Forecasts over the hold-out, ``k`` rows at a time, without refitting.

    ``train`` has the training rows (:func:`splits.backtest_runs`), ``rows`` the
    observed series, ``windows`` the hold-out of :func:`splits.holdout_window`;
    ``keys`` may add the arm to the series.  Result: ``keys, model, ts, actual,
    pred``.
    """
    training = cut(train.where("role = 'train'"))
    fitted = cut(splits.scalers(training, keys))
    models = cut(
        fit_models(
            splits.scale(training, fitted, keys), names, lags=lags, k=k, model_keys=keys,
            group=[*keys, "segment"], step=step,
        )
    )
    held = attach(rows, windows).where("ts between eval_start and eval_end")
    lead = ((micros("holdout_start") - micros("eval_start")) / F.lit(step * MICROS)).cast("bigint")
    shifts = windows.select("series", (lead - lags).alias("_shift"))
    table = window_table(held.select("series", "ts", "value"), lags + k, keys=SERIES, step=step)
    origins = table.join(shifts, "series").where(
        (F.col("start_pos") >= F.col("_shift")) & (F.pmod(F.col("start_pos") - F.col("_shift"), F.lit(k)) == 0)
    )
    scaled = origins.join(fitted, "series").withColumn(
        "x", F.transform(F.slice("w", 1, lags), lambda v: (v - F.col("mean")) / F.col("std"))
    )
    named = scaled.withColumnRenamed("series", "_s").join(
        models.withColumnRenamed("series", "_s"), ["_s", *[c for c in keys if c != "series"]]
    ).withColumnRenamed("_s", "series")
    ahead = named.withColumn("p", roll_ahead(F.col("x"), F.lit(k).cast("bigint"), lags))
    pairs = F.arrays_zip(F.slice("w", lags + 1, k).alias("a"), F.col("p").alias("p"))
    return ahead.select(*keys, "model", "ts", "mean", "std", F.posexplode(pairs).alias("h", "v")).select(
        *keys, "model",
        F.timestamp_micros(micros("ts") + (F.col("h") + lags) * (step * MICROS)).alias("ts"),
        F.col("v.a").alias("actual"), (F.col("v.p") * F.col("std") + F.col("mean")).alias("pred"),
    )


def backtest_metrics(
    forecasts: DataFrame, history: DataFrame, windows: DataFrame, *, m: int = 24, step: int = HOUR
) -> DataFrame:
    """RMSE, MAE and MASE per series and model; MASE is null when the history
    before the hold-out is too short."""
    off = F.col("actual") - F.col("pred")
    errors = forecasts.where("actual is not null and pred is not null").groupBy("series", "model").agg(
        F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), F.count(F.lit(1)).alias("n_eval")
    )
    starts = windows.select("series", F.col("holdout_start").alias("start_ts"))
    scale = history_scale(history, starts, m, step=step).select("series", "scale")
    return errors.join(scale, ["series"], "left").select(
        "series", "model", "rmse", "mae", F.try_divide("mae", "scale").alias("mase"), "n_eval"
    )


# --- detectors ----------------------------------------------------------------

KNOTS = 25
KNOT_RANGE = 0.8
BAND = 1.959963984540054


def _hinges(share: np.ndarray) -> np.ndarray:
    knots = np.linspace(0.0, KNOT_RANGE, KNOTS + 1)[1:]
    return np.hstack([np.ones((len(share), 1)), share[:, None], np.maximum(share[:, None] - knots, 0.0)])


def trend_band(
    df: DataFrame, *, keys: Sequence[str] = SERIES, step: int = HOUR, epsilon: float = 1e-6, **_
) -> DataFrame:
    """Distance outside a 95% band around a piecewise-linear trend, in half-widths.

    The trend bends at 25 places in the first four fifths of the series.
    """
    keys = list(keys)
    bounds = df.groupBy(*keys).agg(
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.avg("value").alias("_mean")
    )
    span = micros("_t1") - micros("_t0")
    placed = attach(df, bounds, keys).select(
        *keys, "blk", "ts", (F.col("value") - F.col("_mean")).alias("value"),
        F.coalesce(F.try_divide(micros("ts") - micros("_t0"), span), F.lit(0.0)).alias("share"),
    )

    def build(pdf: pd.DataFrame) -> np.ndarray:
        return np.hstack([_hinges(pdf["share"].to_numpy()), pdf[["value"]].to_numpy()])

    def solve(sums: np.ndarray) -> dict:
        n, xx, xy, yy = sums[0, 0], sums[:-1, :-1], sums[:-1, -1], sums[-1, -1]
        # The bends are held back a little, as they are many.
        penalty = np.full(len(xx), 1e-3 * n)
        penalty[:2] = 1e-9 * n
        b = np.linalg.solve(xx + np.diag(penalty), xy)
        rest = max(yy - 2.0 * b @ xy + b @ xx @ b, 0.0)
        return {"b": b.tolist(), "half": float(max(BAND * np.sqrt(rest / n), epsilon))}

    sums = moments.gram(placed, keys, build, [*keys, "blk"])
    model = moments.fit(sums, keys, solve, "b array<double>, half double")
    knots = np.linspace(0.0, KNOT_RANGE, KNOTS + 1)[1:]
    share = F.col("share")
    features = F.array(F.lit(1.0), share, *[F.greatest(share - float(c), F.lit(0.0)) for c in knots])
    fit = F.aggregate(F.zip_with(features, F.col("b"), lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    excess = F.greatest(F.abs(F.col("value") - fit) - F.col("half"), F.lit(0.0))
    return attach(placed, model, keys).select(*keys, "ts", (excess / F.col("half")).alias("score"))


def forecast_error(
    df: DataFrame, *, keys: Sequence[str] = SERIES, window: int = 100, horizon: int = 8, step: int = HOUR,
    rows: int = BLOCK_ROWS, ridge: float = 1e-6, **_,
) -> DataFrame:
    """Squared Mahalanobis distance of each row's forecast errors.

    A row is forecast from ``horizon`` windows, 1 to ``horizon`` steps ahead; a
    Gaussian is fitted to those error stacks.  Rows without a full stack score 0.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= window + 2 * horizon - 1)
    usable = attach(df, sizes.select(*keys), keys)
    scaled = cut(splits.scale(usable.select(*keys, "blk", "ts", "value"), splits.scalers(usable, keys), keys))
    sums = lag_sums(scaled, lags=window, k=horizon, model_keys=keys, group=keys, step=step, block_rows=rows)

    def solve(matrix: np.ndarray) -> dict:
        coef, bias = _least_squares(matrix, window, np.eye(window))
        return {"coef": coef.ravel().tolist(), "bias": bias.tolist()}

    model = moments.fit(sums, keys, solve, "coef array<double>, bias array<double>")
    spread = halo(scaled, window + horizon - 1, 0, step=step, rows=rows, keys=keys)
    places = spread.select(*keys, "blk").distinct().join(model, keys)
    places = places.withColumnsRenamed({c: f"{c}_of_model" for c in (*keys, "blk")})

    def stacks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        width = window + horizon
        if right.empty or len(left) < width:
            return left.iloc[:0][[*keys, "blk", "ts"]].assign(e=pd.Series(dtype="object"))
        left = left.sort_values("ts")
        x = left["value"].to_numpy()
        coef = np.asarray(right["coef"].iloc[0]).reshape(horizon, window)
        inputs = moments.sliding(x, window)
        ahead = inputs @ coef.T + np.asarray(right["bias"].iloc[0])
        at = np.arange(width - 1, len(x))
        errors = np.stack([x[at] - ahead[at - window - h, h] for h in range(horizon)], axis=1)
        out = left.iloc[at][[*keys, "blk", "ts"]].copy()
        out["e"] = list(errors)
        return out[left["own"].to_numpy()[at]]

    schema = f"{moments.key_schema(df, keys)}, blk bigint, ts timestamp, e array<double>"
    errors = cut(
        spread.groupBy(*keys, "blk")
        .cogroup(places.groupBy(*[f"{c}_of_model" for c in (*keys, "blk")]))
        .applyInPandas(stacks, schema)
    )

    def gaussian(matrix: np.ndarray) -> dict:
        n = matrix[0, 0]
        mean = matrix[0, 1:] / n
        cov = (matrix[1:, 1:] - n * np.outer(mean, mean)) / max(1.0, n - 1.0)
        return {"mean": mean.tolist(), "inv": np.linalg.inv(cov + ridge * np.eye(horizon)).ravel().tolist()}

    build = lambda pdf: np.hstack([np.ones((len(pdf), 1)), np.stack(pdf["e"].to_numpy())])
    normal = moments.fit(
        moments.gram(errors, keys, build, [*keys, "blk"]), keys, gaussian, "mean array<double>, inv array<double>"
    )
    off = F.zip_with("e", "mean", lambda e, m: e - m)
    scored = attach(errors, normal, keys).withColumn("_o", off)
    rows_of = lambda i: F.slice("inv", i * horizon + 1, horizon)
    dot = lambda i: F.aggregate(
        F.zip_with("_o", rows_of(i), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x
    )
    distance = F.aggregate(
        F.transform("_o", lambda o, i: o * dot(i)), F.lit(0.0), lambda a, x: a + x
    )
    known = scored.select(*keys, "ts", distance.alias("score"))
    return usable.select(*keys, "ts").join(known, [*keys, "ts"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )
