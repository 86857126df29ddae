import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import T0, by_time, series
from sensorloom.functions.blocks import FIVE_MINUTES, HOUR, in_blocks
from sensorloom.operators import forecast, grid, impute, report, screen, splits
from sensorloom.plans import cleaning, comparison
from sensorloom.sources import feed, files, store

RNG = np.random.default_rng(11)
HOURS = np.arange(1200)
SIGNAL = 30 + 8 * np.sin(HOURS / 24 * 2 * np.pi) + 4 * np.sin(HOURS / 168 * 2 * np.pi) + RNG.normal(0, 1, len(HOURS))


def seasonal_grid(spark):
    values = list(SIGNAL)
    for i in (200, 320, 410):
        values[i] += 60
    for i in list(range(130, 135)) + list(range(500, 520)):
        values[i] = None
    return grid.regular_grid(series(spark, values), HOUR, rows=256)


def scores(spark, values, detector="d"):
    rows = [(detector, "a", T0 + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "detector string, series string, ts timestamp, score double")


KEYS = ["detector", "series"]


def test_threshold_and_flags(spark):
    def flags(values):
        return by_time(screen.flag(scores(spark, values), KEYS), "flag")

    found = screen.thresholds(scores(spark, [0, 1, 2, 3, 100]), KEYS).first().threshold
    assert found == pytest.approx(2 + 3.5 * 1.4826)
    assert flags([0, 0, 0, 1, 0]) == [False, False, False, True, False]
    assert flags([3.3] * 5) == [False] * 5
    assert flags([0, 0.1, float("nan"), 99, float("inf"), 0, 0.1]) == [False, False, False, True, False, False, False]
    assert flags([float("nan"), None]) == [False, False]


def test_normalise_rank_and_consensus(spark):
    assert by_time(screen.normalise(scores(spark, [0, 5, 10]), KEYS), "norm") == [0, 0.5, 1]
    assert by_time(screen.normalise(scores(spark, [5, 5]), KEYS), "norm") == [0, 0]
    m = spark.createDataFrame([("a", d, v) for d, v in (("b", 0.5), ("a", 0.5), ("c", 0.1))], "series string, detector string, metric double")
    assert [r.detector for r in screen.rank_top_k(m, 2).orderBy("rank").collect()] == ["a", "b"]
    both = screen.normalise(scores(spark, [0, 0, 1, 1], "x").unionByName(scores(spark, [1, 1, 0, 0], "y")), KEYS)
    weights = spark.createDataFrame([("x", 0.9), ("y", 0.1)], "detector string, weight double")
    assert by_time(screen.consensus(both, ["series"], "avg", weights=weights), "score") == pytest.approx([0.1, 0.1, 0.9, 0.9])
    assert by_time(screen.consensus(both, ["series"], "MAX"), "score") == [1, 1, 1, 1]
    assert by_time(screen.consensus(both, ["series"], "AOM"), "score") == [1, 1, 1, 1]
    zero = weights.withColumn("weight", F.lit(0.0))
    assert by_time(screen.consensus(both, ["series"], weights=zero), "score") == [None] * 4
    with pytest.raises(ValueError):
        screen.consensus(both, ["series"], "median")


def test_budget_is_inclusive(spark):
    rates = spark.createDataFrame([("a", 0.07), ("b", 0.08)], "detector string, rate double")
    assert {r.detector: r.kept for r in screen.split_by_rate(rates, 0.07).collect()} == {"a": True, "b": False}


def test_cleaning_flags_the_spikes_only(spark):
    rows = seasonal_grid(spark)
    found = cleaning.detect_anomalies(rows, detectors=["ModifiedZScore", "Hampel_w24", "IQR", "LOF"])
    flagged = {r.ts for r in found.flags.where("flag").collect()}
    spikes = {T0 + dt.timedelta(hours=i) for i in (200, 320, 410)}
    assert spikes <= flagged and len(flagged) < 30
    assert found.flags.count() == 1200
    total = found.totals.first()
    assert total.n_flagged == len(flagged) and total.n_points == 1175
    cleaned = screen.remove_flagged(rows, found.flags)
    assert cleaned.where("value is null").count() == 25 + len(flagged)
    assert impute.impute_series(cleaned).where("value is null").count() == 0


def test_series_without_segments_is_left_alone(spark):
    rows = grid.regular_grid(series(spark, [1, None, 2, None, 3]), HOUR)
    found = cleaning.detect_anomalies(rows, detectors=["IQR"])
    assert found.flags.where("flag").count() == 0 and found.flags.count() == 5


def test_comparison_runs_both_arms(spark):
    results, wide = comparison.compare(
        seasonal_grid(spark), ["NLinear", "LinearRegression"], detectors=["ModifiedZScore", "Hampel_w24"], holdout=48, lags=24, context=24,
    )
    rows = results.collect()
    assert {(r.model, r.arm) for r in rows} == {(m, a) for m in ("NLinear", "LinearRegression") for a in ("raw", "preprocessed")}
    assert all(0 < r.mae < 6 and r.mase < 2 and r.n_eval == 45 for r in rows)
    both = wide.where("model = 'NLinear'").first()
    assert both.rmse_delta == pytest.approx(both.rmse_pre - both.rmse_raw)


def test_synthetic_benchmark_prefers_good_detectors(spark):
    values = pd.Series(SIGNAL)
    cases = in_blocks(series(spark, values).withColumnRenamed("event_id", "pos"), HOUR)
    out = {r.detector: r for r in cleaning.benchmark_synthetic(cases, ["Hampel_w24", "IQR"]).collect()}
    assert set(out) == {"Hampel_w24", "IQR", "Ensemble"}
    assert all(0 <= out[d][m] <= 1 for d in out for m in ("auroc", "aupr", "vus_roc", "vus_pr", "affiliation_f1"))
    assert out["Hampel_w24"].auroc > 0.6


def test_evaluation_cases_join_over_removed_hours(spark):
    hour = lambda v: [v + 0.1 * i for i in range(12)]
    readings = hour(10) + hour(11) + hour(11) + hour(12) + [None] * 12 + hour(13)
    df = series(spark, readings, step=FIVE_MINUTES)
    cases = cleaning.build_cases(df, 3.762, min_points=2).orderBy("pos").collect()
    assert [r.pos for r in cases] == [0, 1, 2]
    assert [r.orig_ts.hour for r in cases] == [0, 1, 3]


def test_forecasters_equal_numpy_least_squares(spark):
    lags, k = 12, 3
    x = (SIGNAL - SIGNAL.mean()) / SIGNAL.std()
    df = in_blocks(series(spark, x).drop("event_id"), HOUR, 100).withColumn("segment", F.lit(T0))
    models = {r.model: r for r in forecast.fit_models(df, list(forecast.MODELS), lags=lags, k=k).collect()}
    cut = np.lib.stride_tricks.sliding_window_view(x, lags + k)
    a, b = cut[:, :lags], cut[:, lags:]
    full = np.hstack([np.ones((len(a), 1)), a])
    w = np.linalg.lstsq(full, b, rcond=None)[0]
    one = models["LinearRegression"]
    assert one.k == 1 and one.coef == pytest.approx(w[1:, 0], abs=1e-3)
    last = a[:, -1:]
    free = np.linalg.lstsq(np.hstack([np.ones((len(a), 1)), (a - last)[:, :-1]]), b - last, rcond=None)[0]
    coef = np.array(models["NLinear"].coef).reshape(k, lags)
    assert coef[:, :-1] == pytest.approx(free[1:].T, abs=1e-3)
    assert coef.sum(axis=1) == pytest.approx(np.ones(k))
    assert np.array(models["DLinear"].coef).reshape(k, lags) == pytest.approx(w[1:].T, abs=1e-3)
    ctx = x[:lags]
    table = spark.createDataFrame([(ctx.tolist(),)], "x array<double>")
    ahead = table.join(forecast.fit_models(df, ["LinearRegression"], lags=lags, k=k)).select(
        forecast.roll_ahead(F.col("x"), F.lit(4).cast("bigint"), lags).alias("p")
    ).first().p
    state = list(ctx)
    for _ in range(4):
        state.append(one.bias[0] + float(np.dot(one.coef, state[-lags:])))
    assert ahead == pytest.approx(state[lags:])


def test_model_imputer_reports_short_contexts(spark):
    rows = grid.regular_grid(series(spark, SIGNAL), HOUR)
    from test_impute import gap_table

    gaps = gap_table(spark, [(5, 2), (300, 7)])
    pred, failed = forecast.model_imputer("NLinear")(rows, gaps, lags=24, k=5)
    got = by_time(pred, "pred")
    assert len(got) == 7 and np.abs(np.array(got) - SIGNAL[300:307]).mean() < 3
    assert [(r.available, r.required) for r in failed.collect()] == [(5, 24)]


def test_backtest_error_scale_matches_its_definition(spark):
    values = [None if 30 <= i < 35 else float(v) for i, v in enumerate(SIGNAL[:448])]
    rows = grid.regular_grid(series(spark, values), HOUR, rows=64)
    windows = spark.createDataFrame(
        [("a", T0, T0 + dt.timedelta(hours=400), T0 + dt.timedelta(hours=447))],
        "series string, eval_start timestamp, holdout_start timestamp, eval_end timestamp",
    )
    noise = RNG.normal(0, 0.7, 48)
    pred = [("a", "m", T0 + dt.timedelta(hours=400 + i), float(SIGNAL[400 + i]), float(SIGNAL[400 + i] + noise[i])) for i in range(48)]
    forecasts = spark.createDataFrame(pred, "series string, model string, ts timestamp, actual double, pred double")
    out = forecast.backtest_metrics(forecasts, rows, windows).first()
    filled = pd.Series([np.nan if v is None else v for v in values[:400]]).interpolate().to_numpy()
    assert out.mase == pytest.approx(np.abs(noise).mean() / np.abs(filled[24:] - filled[:-24]).mean())
    assert out.n_eval == 48
    short = windows.withColumn("holdout_start", F.lit(T0 + dt.timedelta(hours=10)))
    assert forecast.backtest_metrics(forecasts, rows, short).first().mase is None


def test_segment_tails_and_long_split(spark):
    rows = grid.regular_grid(series(spark, [1, 2, None, 4, 5, 6]), HOUR)
    only = splits.segment_tails(rows, val_size=0, min_train_len=2, val_context=1)
    assert only.select("segment").distinct().count() == 2 and only.count() == 5
    rows = grid.regular_grid(series(spark, [1, 2, 3, 4, 5]), HOUR)
    both = splits.segment_tails(rows, val_size=2, min_train_len=2, val_context=3)
    assert by_time(both, role="train") == [1, 2, 3] and by_time(both, role="valid") == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        splits.segment_tails(rows, val_size=-1, min_train_len=2, val_context=1)
    rows = in_blocks(series(spark, range(10)), HOUR, 3)
    cut = splits.split_long(rows, valid_fraction=0.2, context=2)
    assert by_time(cut, role="train") == list(range(8)) and by_time(cut, role="valid") == [6, 7, 8, 9]


def test_test_only_series_are_cut_by_fraction(spark):
    rows = grid.regular_grid(series(spark, range(12), name="a"), HOUR)
    held = rows.where("pos >= 9").select("series", "ts")
    extra = in_blocks(series(spark, range(10, 20), name="b"), HOUR, 4)
    bundle, fitted = splits.benchmark_bundle(
        rows, held, val_size=1, min_train_len=2, val_context=1, test_only=extra, train_fraction=0.6
    )
    assert by_time(bundle, "actual", series="b") == [16, 17, 18, 19]
    assert {r.series: r["mean"] for r in fitted.collect()} == {"a": pytest.approx(3.5), "b": pytest.approx(12.5)}


def test_holdout_window_comes_from_the_longest_run(spark):
    rows = grid.regular_grid(series(spark, [1, 2, 3, 4, 5, 6, None, 1, 2, 3]), HOUR)
    found = splits.holdout_window(rows, holdout=2, context=3).first()
    assert [found.eval_start.hour, found.holdout_start.hour, found.eval_end.hour] == [1, 4, 5]
    assert splits.holdout_window(rows, holdout=4, context=3).count() == 0
    assert by_time(splits.rows_before(rows, splits.holdout_window(rows, holdout=2, context=3))) == [1, 2, 3, 4]


def test_zero_deviation_scales_by_one(spark):
    rows = series(spark, [5, 5, 5])
    fitted = splits.scalers(rows)
    assert by_time(splits.scale(rows, fitted)) == [0, 0, 0]
    assert by_time(splits.unscale(splits.scale(rows, fitted), fitted)) == [5, 5, 5]


def test_station_files(spark, tmp_path):
    for station, body in {
        "Centro": "fecha,NO2\n2024-01-01 01:00:00,2\n2024-01-01 00:00:00,1\njunk,9\n2024-01-01 02:00:00,n/a\n",
        "Vacia": "fecha,NO2\n",
    }.items():
        (tmp_path / station).mkdir()
        (tmp_path / station / f"{station}_NO2.csv").write_text(body)
        (tmp_path / station / f"{station}_CO.csv").write_text("fecha,CO\n2024-01-01 00:00:00,7\n")
    rows = files.read_stations(spark, str(tmp_path), "NO2")
    assert {r.station for r in rows.collect()} == {"Centro"} and by_time(rows) == [1, 2, None]
    (tmp_path / "Centro" / "Centro_NO2_media.json").write_text(
        json.dumps({"rows": [[1704067200000, 1.5], [1704074400000, None]], "cols": ["time", "NO2"]})
    )
    hourly = files.read_payload_series(spark, files.dataset_glob(str(tmp_path), "NO2", "json"))
    assert {r.series for r in hourly.collect()} == {"Centro"} and by_time(hourly) == [1.5, None, None]


def test_series_names(spark):
    rows = [("p1", "  Río  Alto/1 ", "a b", "NO2"), ("p2", "  Río  Alto/1 ", "a b", "NO2"), ("p3", "x", "a_no2", "NO2")]
    df = spark.createDataFrame(rows, "path string, parent string, stem string, value string")
    named = df.select("path", files.long_name(F.col("parent"), F.col("stem"), F.col("value")).alias("name"))
    got = {r.path: r.name for r in files.unique_names(named).collect()}
    assert got == {"p1": "Río_Alto_1__a_b__NO2", "p2": "Río_Alto_1__a_b__NO2_1", "p3": "x__a_no2"}
    assert df.select(files.short_name(F.lit("Centro_NO2_h")).alias("s")).first().s == "Centro"


def test_value_column_by_position(spark):
    df = spark.createDataFrame([("2024-01-01", "1", "x"), ("bad", "2", "3")], "fecha string, a string, b string")
    assert files.value_at(df, None) is None
    assert [r.value for r in files.value_at(df, 0).collect()] == [1.0]
    assert [r.value for r in files.value_at(df, 1).collect()] == [None]
    with pytest.raises(ValueError, match="out of range"):
        files.value_at(df, 2)


def test_stores_and_reports(spark, tmp_path):
    first = scores(spark, [1, 2], "x").unionByName(scores(spark, [3], "y")).withColumn("run", F.lit("r1"))
    store.write_scores(first, str(tmp_path / "s"))
    store.write_scores(scores(spark, [9], "x").withColumn("run", F.lit("r2")), str(tmp_path / "s"))
    assert store.read_scores(spark, str(tmp_path / "s"), "r1").count() == 3
    old = spark.createDataFrame([("A", 0, 1.0), ("B", 0, 2.0)], "model_name string, epoch int, loss double")
    new = spark.createDataFrame([("A", 1, 5.0)], "model_name string, epoch int, loss double")
    assert sorted(map(tuple, store.replace_rows(old, new).collect())) == [("A", 1, 5.0), ("B", 0, 2.0)]
    store.write_report(old, str(tmp_path / "r"), ["model_name"])
    assert store.read_report(spark, str(tmp_path / "r"), old.schema.simpleString()[7:-1].replace(":", " ")).count() == 2


def test_feed(spark):
    rows = [("a", 1704067200000 + ms, v, i) for i, (ms, v) in enumerate([(1000, 1.0), (2000, 2.0), (600000, 3.0)])]
    df = spark.createDataFrame(rows, "series string, ms bigint, value double, event_id bigint")
    assert by_time(feed.grid_feed(df)) == [1.0, None, 3.0]
    lists = spark.createDataFrame([("no2, pm2.5",), ("PM2_5,1x",)], "names string")
    valid, rejected = feed.pollutant_names(lists, "names")
    assert sorted(r.pollutant for r in valid.collect()) == ["NO2", "PM25", "PM25"]
    assert [r.pollutant for r in rejected.collect()] == ["1X"]


def test_mask_errors_and_reports(spark):
    pairs = spark.createDataFrame([("m", 2.0, 1.0), ("m", 4.0, 4.0), ("m", 6.0, 5.0)], "model string, actual double, pred double")
    r = report.errors(pairs, ["model"]).first()
    assert (r.mae, r.rmse) == (pytest.approx(2 / 3), pytest.approx((2 / 3) ** 0.5))
    rows = [("A", s, 1.0 + s, 2.0 + s, None) for s in range(3)] + [("B", 0, 1.0, 1.0, 0.5)]
    ranking = spark.createDataFrame(rows, "model string, seed bigint, mae double, rmse double, mase double")
    got = {r.model: r for r in report.summarise_runs(ranking).collect()}
    assert (got["A"].runs, got["A"].mae_mean, got["A"].mae_std) == (3, 2.0, 1.0)
    assert got["A"].mae_p05 == pytest.approx(1.1) and got["A"].mae_p95 == pytest.approx(2.9)
    assert got["B"].mae_std is None and got["A"].mase_mean is None
    assert [r.model for r in report.rank_models(ranking).collect()] == ["B", "A"]
