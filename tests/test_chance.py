"""Shuffled numbers, and gaps placed with them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorloom.functions import chance
from sensorloom.operators import gaps

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 97, 576, 577, 2500])
def test_every_number_comes_once(spark, n):
    got = spark.range(n).select(chance.permuted(F.col("id"), F.lit(n).cast("bigint"), "x", 5).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    if n >= 40:
        assert [r.p for r in got] != list(range(n))


@pytest.mark.parametrize("n", [4_000_000, 10**12])
def test_draws_of_a_long_range_differ_and_reach_everywhere(spark, n):
    got = [r.p for r in spark.range(4000).select(chance.permuted(F.col("id"), F.lit(n), "x").alias("p")).collect()]
    assert len(set(got)) == 4000 and min(got) >= 0 and max(got) < n
    tenths = [0] * 10
    for p in got:
        tenths[p * 10 // n] += 1
    assert min(tenths) > 300


def test_labels_decide(spark):
    draw = lambda *labels: [r.p for r in spark.range(50).select(chance.permuted(F.col("id"), F.lit(50).cast("bigint"), *labels).alias("p")).collect()]
    assert draw("a", 1) == draw("a", 1) != draw("a", 2)


LENGTHS = (1, 5, 40, 720, 4_000_000)


@pytest.mark.parametrize("strategy", ["block", "hybrid"])
def test_gaps_fit_at_any_length(spark, strategy):
    bounds = spark.createDataFrame([(f"{s}{n}", T0, n) for s in "ab" for n in LENGTHS], "series string, first_ts timestamp, n bigint")
    rows = gaps.plan_gaps(bounds, [1, 4], gaps.seed_table(spark, n_runs=3), 3, strategy=strategy).collect()
    by = {}
    for r in rows:
        by.setdefault((int(r.series[1:]), r.series, r.gap_size, r.seed), []).append((r.start_pos, r.len))
    for (n, _, size, _), windows in by.items():
        windows.sort()
        assert all(0 <= s and s + m <= n for s, m in windows)
        apart = 0 if strategy == "block" else 1
        assert all(a + m + apart <= b for (a, m), (b, _) in zip(windows, windows[1:], strict=False))
        if n >= 40:
            singles = int(3 * size * 0.75)
            assert len(windows) == (3 if strategy == "block" else max(1, singles) + max(1, (3 * size - singles) // size))
    for n in LENGTHS[2:]:
        own = [tuple(w) for key, w in by.items() if key[0] == n]
        assert len(own) == len(set(own)) == 12


def test_short_series_use_every_place_that_is_left(spark):
    # Three blocks of two into six places: the first may stand so that only two fit.
    bounds = spark.createDataFrame([("a", T0, 6)], "series string, first_ts timestamp, n bigint")
    rows = gaps.plan_gaps(bounds, [2], gaps.seed_table(spark, n_runs=40), 3).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r.seed, []).append(r.start_pos)
    for starts in counts.values():
        free = [p for p in range(5) if all(abs(p - s) >= 2 for s in starts)]
        assert len(starts) == 3 or not free
    assert {len(s) for s in counts.values()} == {2, 3}
