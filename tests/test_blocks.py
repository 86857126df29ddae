import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import series
from sensorloom.functions.blocks import HOUR, carry, expand, halo, in_blocks, runs


def brute_runs(values):
    out = []
    for _, group in itertools.groupby(enumerate(values), key=lambda p: p[1]):
        group = list(group)
        out += [(group[0][0], group[-1][0], len(group))] * len(group)
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("rows", [1, 2, 3, 7, 1000])
def test_runs_match_groupby_for_any_block_size(spark, seed, rows):
    rng = random.Random(seed * 10 + rows)
    values = [rng.choice([1, 1, 1, 2, None] if seed % 2 else [1, 2, 3]) for _ in range(60)]
    if seed == 5:
        values = [4] * 60
    df = in_blocks(series(spark, values), HOUR, rows)
    got = runs(df, F.col("value"), order="event_id").orderBy("event_id").collect()
    assert [(r.run_start, r.run_end, r.run_len) for r in got] == brute_runs(values)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_carry_equals_unbounded_windows(spark, rows):
    rng = random.Random(rows)
    values = [rng.choice([None, rng.random()]) for _ in range(50)]
    df = in_blocks(series(spark, values), HOUR, rows)
    x = F.col("value")
    got = carry(
        df,
        {"a": ("last", x), "b": ("before", x), "c": ("next", x), "d": ("after", x),
         "s": ("sum", F.coalesce(x, F.lit(0.0))), "m": ("max_before", x), "t": ("total", x)},
    )
    w = Window.partitionBy("series").orderBy("ts")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    want = df.select(
        "ts",
        F.last("value", True).over(w.rowsBetween(first, 0)).alias("a"),
        F.last("value", True).over(w.rowsBetween(first, -1)).alias("b"),
        F.first("value", True).over(w.rowsBetween(0, last)).alias("c"),
        F.first("value", True).over(w.rowsBetween(1, last)).alias("d"),
        F.sum(F.coalesce("value", F.lit(0.0))).over(w).alias("s"),
        F.max("value").over(w.rowsBetween(first, -1)).alias("m"),
        F.sum("value").over(Window.partitionBy("series")).alias("t"),
    )
    left = got.orderBy("ts").collect()
    right = want.orderBy("ts").collect()
    for a, b in zip(left, right, strict=True):
        for name in "abcdsmt":
            assert (a[name] is None) == (b[name] is None), (name, a, b)
            assert a[name] is None or a[name] == pytest.approx(b[name])


def test_halo_frames_equal_whole_frames(spark):
    df = series(spark, range(40))
    spread = halo(df, 5, 3, step=HOUR, rows=4)
    near = Window.partitionBy("series", "blk").orderBy("ts").rowsBetween(-5, 3)
    got = spread.withColumn("s", F.sum("value").over(near)).where("own")
    values = [r.s for r in got.orderBy("ts").collect()]
    assert values == [sum(range(max(0, i - 5), min(40, i + 4))) for i in range(40)]


def test_expand_counts(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 10)], "k string, n bigint")
    got = expand(df, F.col("n"), "i", chunk=10).groupBy("k").agg(F.count("*").alias("c"), F.max("i").alias("m"))
    assert {(r.k, r.c, r.m) for r in got.collect()} == {("a", 25, 24), ("c", 10, 9)}
