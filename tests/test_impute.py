import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import T0, by_time, series
from sensorloom.functions.blocks import HOUR
from sensorloom.operators import gaps as G
from sensorloom.operators import grid, impute
from sensorloom.plans import imputation


def gridded(spark, values, rows=4, name="a"):
    return grid.regular_grid(series(spark, values, name=name), HOUR, rows=rows)


def gap_table(spark, windows, name="a", size=0, seed=1):
    rows = [(name, size, seed, 1, s, s, T0 + dt.timedelta(hours=s), n) for s, n in windows]
    return spark.createDataFrame(
        rows, "series string, gap_size bigint, seed bigint, run bigint, gap_id bigint, start_pos bigint, start_ts timestamp, len bigint"
    )


def test_a_line_is_drawn_past_the_masked_values(spark):
    # One masked row between 5 and 9, then two between 7 and 16; what they held is not looked at.
    rows = gridded(spark, [3, 5, -500, 9, 14, 13])
    assert by_time(impute.linear_imputer(rows, gap_table(spark, [(2, 1)]))[0], "pred") == [7]
    rows = gridded(spark, [4, 7, -500, 800, 16, 1])
    assert by_time(impute.linear_imputer(rows, gap_table(spark, [(2, 2)]))[0], "pred") == [10, 13]


def test_touching_gaps_and_holes_share_their_anchors(spark):
    values = [0, 999, 999, None, 999, None, 60, 70, 999]
    rows = gridded(spark, values, rows=2)
    got = impute.linear_imputer(rows, gap_table(spark, [(1, 1), (2, 1), (4, 1), (8, 1)]))[0]
    assert by_time(got, "pred") == [10, 20, 40, 70]


def seasonal_reference(values, mask):
    s = pd.Series(values, index=pd.date_range(T0, periods=len(values), freq="h"), dtype=float)
    s.iloc[mask] = np.nan
    linear = s.interpolate(method="time", limit_direction="both")
    mean = s.groupby(s.index.hour).transform("mean")
    wave = mean + (s - mean).interpolate(method="time", limit_direction="both")
    return wave.where(wave.notna(), linear).ffill().bfill()


def test_seasonal_fill_equals_pandas(spark):
    rng = np.random.default_rng(2)
    values = 30 + 8 * np.sin(np.arange(120) / 24 * 2 * np.pi) + rng.normal(0, 1, 120)
    holes = [0, 1, 40, 41, 42, 77, 118, 119]
    gappy = [None if i in holes else v for i, v in enumerate(values)]
    windows = [(5, 4), (60, 10), (74, 3), (90, 1)]
    masked = [i for s, n in windows for i in range(s, s + n)]
    rows = gridded(spark, gappy, rows=7)
    got = by_time(impute.seasonal_imputer(rows, gap_table(spark, windows))[0], "pred")
    want = seasonal_reference([np.nan if v is None else v for v in gappy], masked)
    assert got == pytest.approx(want.iloc[masked].tolist())
    filled = by_time(impute.impute_series(rows))
    assert filled == pytest.approx(seasonal_reference([np.nan if v is None else v for v in gappy], []).tolist())


def test_hour_without_data_falls_back_to_the_line(spark):
    rows = gridded(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    got = by_time(impute.seasonal_imputer(rows, gap_table(spark, [(2, 1)]))[0], "pred")
    assert got == [3.0]


def test_clean_left_context_stops_at_a_hole(spark):
    rows = gridded(spark, [1, None, 3, 4, 5, 6])
    gaps = gap_table(spark, [(4, 1), (1, 1), (2, 1), (0, 2)])
    context = impute.left_context(rows, gaps, 4)
    counts = {r.gap_id: r.available for r in impute.context_counts(context, gaps).collect()}
    assert counts == {4: 2, 1: 1, 2: 0, 0: 0}
    assert by_time(context.where("gap_id = 4")) == [3, 4]
    failed = impute.failure_table(impute.context_counts(context, gaps).where("available < 2"), "m", 2)
    assert {r.start_ts.hour for r in failed.collect()} == {0, 1, 2}


def test_trend_imputer_fits_the_run_before_the_gap(spark):
    rng = np.random.default_rng(4)
    values = list(5 + 0.3 * np.arange(60) + 2 * np.sin(np.arange(60) / 24 * 2 * np.pi) + rng.normal(0, 0.2, 60))
    values[7] = None
    start, size = 50, 6
    rows = gridded(spark, values, rows=9)
    got, failed = impute.trend_imputer(rows, gap_table(spark, [(start, size), (1, 1)]))
    t, y = np.arange(8, start), np.array(values[8:start], dtype=float)
    b, a = np.polyfit(t, y, 1)
    want = []
    for p in range(start, start + size):
        same = (t % 24) == (p % 24)
        want.append(a + b * p + (y[same] - a - b * t[same]).mean())
    assert by_time(got, "pred") == pytest.approx(want)
    assert failed.first().available == 1 and failed.first().required == 3


def test_context_frame_keeps_the_mask_open(spark):
    rows = gridded(spark, [1, 2, None, 4, 5, 6, 7])
    mask = grid.mask_times(gap_table(spark, [(4, 1)]), HOUR)
    ends = spark.createDataFrame([("a", T0 + dt.timedelta(hours=6))], "series string, end_ts timestamp")
    frame = impute.context_frame(rows, mask, ends, 6)
    assert by_time(frame) == [2, 3, 4, None, 6, 7]


def scale_reference(values, start, m):
    s = pd.Series(values[:start], index=pd.date_range(T0, periods=start, freq="h"), dtype=float)
    f = s.interpolate(method="time", limit_direction="both").ffill().bfill().to_numpy()
    return np.mean(np.abs(f[m:] - f[:-m])) if start > m else None


def test_error_scale_uses_only_the_history(spark):
    rng = np.random.default_rng(6)
    values = [None if rng.random() < 0.35 else float(v) for v in rng.normal(10, 3, 80)]
    values[:3] = [None, None, 7.0]
    starts = [4, 7, 20, 33, 50, 79]
    rows = gridded(spark, values, rows=6)
    got = {
        r.start_ts: r.scale
        for r in impute.history_scale(rows, gap_table(spark, [(s, 1) for s in starts]), 5).collect()
    }
    clean = [np.nan if v is None else v for v in values]
    for s in starts:
        want = scale_reference(clean, s, 5)
        have = got.get(T0 + dt.timedelta(hours=s))
        assert (have is None) if want is None else have == pytest.approx(want)


def test_benchmark_errors_by_hand(spark):
    from sensorloom.operators.registry import IMPUTERS, register_imputer

    guesses = {4: 15.0, 5: 27.0, 6: 33.0, 9: 85.0, 10: 94.0}

    def guess(rows, gaps, *, step, **_):
        at = F.create_map(*[F.lit(x) for pair in guesses.items() for x in pair])
        slots = G.gap_rows(gaps, step)
        return slots.select(*gaps.columns, "ts", F.try_element_at(at, F.hour("ts")).alias("pred")), impute._no_failures(gaps)

    register_imputer("Guess", guess)
    try:
        # Squares: the guesses are off by 1, 2, 3 and by 4, 6.
        rows = gridded(spark, [float(i * i) for i in range(12)])
        done = imputation.run_benchmark(rows, gap_table(spark, [(4, 3), (9, 2)], size=5), ["Guess"], m=3)
        r = done.results.first()
        assert r.mae == pytest.approx(16 / 5) and r.rmse == pytest.approx((66 / 5) ** 0.5)
        # Steps of three: 9 before the first gap, 9, 15, ..., 39 before the second.
        assert r.mase == pytest.approx((3 * 2 / 9 + 2 * 5 / 24) / 5)
        rows = gridded(spark, [2.0, 3.0, 5.0, 8.0, 12.0, 17.0, 23.0])
        guesses.update({5: 20.0, 6: 18.0})
        r = imputation.run_benchmark(rows, gap_table(spark, [(5, 2)], size=2), ["Guess"], m=1).results.first()
        assert (r.mae, r.rmse, r.mase) == (pytest.approx(4), pytest.approx(17**0.5), pytest.approx(4 / 2.5))
    finally:
        del IMPUTERS["Guess"]


def bounds(spark, n):
    return spark.createDataFrame([("a", T0, n), ("b", T0, n)], "series string, first_ts timestamp, n bigint")


@pytest.mark.parametrize("n", [40, 4000])
@pytest.mark.parametrize("strategy", ["block", "hybrid"])
def test_planned_gaps_do_not_touch_and_depend_on_the_seed_only(spark, n, strategy):
    seeds = G.seed_table(spark, n_runs=6, start=42)
    plan = lambda: G.plan_gaps(bounds(spark, n), [1, 2, 5], seeds, 3, strategy=strategy)
    first = sorted(map(tuple, plan().collect()))
    assert first == sorted(map(tuple, plan().collect()))
    sets = {}
    for r in plan().collect():
        sets.setdefault((r.series, r.gap_size, r.seed), []).append((r.start_pos, r.len))
    assert len(sets) == 2 * 3 * 6
    for (_, size, _), windows in sets.items():
        windows.sort()
        apart = 1 if strategy == "hybrid" else 0
        assert all(a + n_a + apart <= b for (a, n_a), (b, _) in zip(windows, windows[1:], strict=False))
        assert windows[0][0] >= 0 and windows[-1][0] + windows[-1][1] <= n
        if strategy == "block":
            assert [w[1] for w in windows] == [size] * 3
        else:
            total = size * 3
            single = int(total * 0.75)
            blocks = max(1, (total - single) // size)
            if size > 1:
                assert sum(w[1] == size for w in windows) == blocks
                assert sum(w[1] == 1 for w in windows) == max(1, single)
    assert len({tuple(w) for w in sets.values()}) > len(sets) / 2


def test_too_short_series_get_what_fits(spark):
    seeds = G.seed_table(spark, [1])
    assert G.plan_gaps(bounds(spark, 4), [5], seeds, 3).count() == 0
    assert G.plan_gaps(bounds(spark, 6), [5], seeds, 3).count() == 2


def test_explicit_gaps_must_lie_in_the_grid(spark):
    rows = gridded(spark, range(10))
    spec = spark.createDataFrame(
        [("a", T0 + dt.timedelta(hours=3), 2), ("a", T0 + dt.timedelta(hours=9), 2)],
        "series string, start_ts timestamp, len bigint",
    )
    planned = G.plan_gaps(bounds(spark, 10), [2], G.seed_table(spark, [7]), 2, spec=spec, grid=rows).collect()
    assert [(r.start_pos, r.len) for r in planned if r.series == "a"] == [(3, 2)]
    assert sum(r.series == "b" for r in planned) == 2


def test_seed_table_checks_its_arguments(spark):
    assert [r.seed for r in G.seed_table(spark, n_runs=3, start=10, step=5).orderBy("run").collect()] == [10, 15, 20]
    assert [r.seed for r in G.seed_table(spark, [5, 3]).orderBy("run").collect()] == [5, 3]
    for bad in ({"seeds": []}, {"n_runs": 0}, {"step": 0}):
        with pytest.raises(ValueError):
            G.seed_table(spark, **bad)
