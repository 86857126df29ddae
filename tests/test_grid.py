import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import T0, by_time, series
from sensorloom.functions.blocks import FIVE_MINUTES, HOUR, in_blocks
from sensorloom.operators import grid


def hours_of(spark, values, **options):
    df = series(spark, values, step=FIVE_MINUTES)
    return by_time(grid.hourly_mean(df, 3.762, **options))


def test_grid_keeps_the_last_duplicate_and_drops_off_grid_readings(spark):
    rows = [
        ("a", T0, 1.0, 0), ("a", T0 + dt.timedelta(hours=1), 2.0, 1), ("a", T0 + dt.timedelta(hours=1), 3.0, 2),
        ("a", T0 + dt.timedelta(hours=1, minutes=30), 9.0, 3), ("a", T0 + dt.timedelta(hours=3), 4.0, 4),
    ]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double, event_id bigint")
    for block_rows in (1, 2, 1000):
        out = grid.regular_grid(df, HOUR, rows=block_rows).orderBy("ts").collect()
        assert [(r.pos, r.value) for r in out] == [(0, 1.0), (1, 3.0), (2, None), (3, 4.0)]


def test_grid_before_1970(spark):
    df = series(spark, [1, 2, 3], start=dt.datetime(1969, 12, 31, 22))
    assert by_time(grid.regular_grid(df, HOUR, rows=2)) == [1, 2, 3]


@pytest.mark.parametrize(
    "values, want",
    [
        ([1, 2, 2, 2, 2, 2, 2, 3], [False] + [True] * 6 + [False]),
        ([2, 2, 2, 3], [False] * 4),
        ([2, 2, None, 2, 2, None, 2, 2], [True, True, False, True, True, False, True, True]),
        ([1, 2, 2, 2, 2, 2, 3], [False] * 7),
        ([None, None, None], [False] * 3),
    ],
)
def test_frozen_runs(spark, values, want):
    df = in_blocks(series(spark, values, step=FIVE_MINUTES), FIVE_MINUTES, 3).drop("event_id")
    assert by_time(grid.frozen_runs(df), "frozen") == want


def test_hourly_mean_uses_only_useful_readings(spark):
    falling = [14.25, 12.5, 9.75, 6.0, 4.5, 3.5, 2.75, 2.25, 1.75, 1.25, 0.75, 0.25]
    assert hours_of(spark, falling) == [pytest.approx(sum(falling[:5]) / 5)]
    assert hours_of(spark, [17.0, 16.0] + [0.5] * 10) == [None]
    assert hours_of(spark, [23.0] * 12) == [None]
    assert hours_of(spark, [11.0, 17.0, 35.0] + [0.5] * 9) == [21.0]


def test_hourly_mean_has_a_row_for_an_empty_hour(spark):
    block = [10.0 + i for i in range(12)]
    assert hours_of(spark, block + [None] * 12 + block) == [15.5, None, 15.5]


def test_limits_by_pollutant(spark):
    df = spark.createDataFrame([("CO",), ("NO2",)], "p string")
    assert {r.p: r.l for r in df.select("p", grid.limit_of(F.col("p")).alias("l")).collect()} == {"CO": 6.0, "NO2": 3.762}
    with pytest.raises(Exception, match="no detection limit for O3"):
        spark.createDataFrame([("O3",)], "p string").select(grid.limit_of(F.col("p"))).collect()


def test_repeats_compare_with_the_row_before(spark):
    df = in_blocks(series(spark, [1, 1, 1, None, 1, 2, 2]), HOUR, 2).drop("event_id")
    kept, counts = grid.drop_repeats(df)
    assert by_time(kept) == [1, None, 1, 2]
    assert counts.first().n_repeats == 3


def test_segments_gaps_and_longest_run(spark):
    values = [1, 2, None, 4, 5, 6, None, None, 9, 8, 7]
    df = in_blocks(series(spark, values), HOUR, 2).drop("event_id")
    segments = grid.segment_table(df, 3).orderBy("segment").collect()
    assert [s.segment_len for s in segments] == [3, 3]
    assert [g.len for g in grid.gap_windows(df).orderBy("start_ts").collect()] == [1, 2]
    best = grid.longest_run(df).first()
    assert (best.run_len, best.run_start) == (3, T0 + dt.timedelta(hours=3))


def test_mask_times_are_distinct(spark):
    gaps = spark.createDataFrame(
        [("a", T0, 3), ("a", T0 + dt.timedelta(hours=2), 2)], "series string, start_ts timestamp, len bigint"
    )
    assert grid.mask_times(gaps, HOUR).count() == 4


def test_best_block_prefers_the_complete_stretch(spark):
    a = series(spark, [1, 2, None, 4, 5, 6], name="A")
    b = series(spark, [1, 2, None, 4, 5, 6], name="B")
    rows = grid.best_block(a.unionByName(b).where("value is not null"), HOUR).collect()
    assert {r.series for r in rows} == {"A", "B"}
    assert rows[0].run_len == 3 and rows[0].run_start == T0 + dt.timedelta(hours=3)
    assert rows[0].score == pytest.approx(2**0.6 * 3**0.4)


def test_series_collections(spark):
    wide = spark.createDataFrame([(T0, 1.0, 2.0)], "t timestamp, x double, y double")
    assert {(r.series, r.value) for r in grid.to_long(wide, ["x", "y"], ts="t").collect()} == {("x", 1.0), ("y", 2.0)}
    one = wide.select(F.col("t").alias("ts"), F.col("x").alias("value"))
    assert [r.series for r in grid.collect_series([one, one], "s").orderBy("series").collect()] == ["s_0", "s_1"]
    with pytest.raises(ValueError):
        grid.collect_series([])


def test_outer_alignment_counts_series(spark):
    a, b = series(spark, [1, None, 3], name="A"), series(spark, [5, 6], name="B")
    out = grid.align_wide(a.unionByName(b), ["A", "B"], HOUR).orderBy("ts").collect()
    assert [(r.n_observed, r.A, r.B) for r in out] == [(2, 1.0, 5.0), (1, None, 6.0), (1, 3.0, None)]
