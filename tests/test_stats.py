"""Quantiles and rank blocks at several sizes, against numpy and whole windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.blocks import carry
from sensorloom.functions.stats import beside, median_and_mad, quantiles, rank_blocks

PROBS = {"low": 0.0, "p05": 0.05, "q1": 0.25, "m": 0.5, "q3": 0.75, "p95": 0.95, "top": 1.0}


SIZES = (1, 2, 7, 1000, 120_000, 400_000)


def values(kind):
    x = F.pow(F.rand(7) * 10, F.lit(3))
    if kind == "frequent":
        return F.when(F.col("id") % 3 == 0, F.lit(1.5)).otherwise(x)
    if kind == "outlier":
        return F.when(F.col("id") == 0, F.lit(1e300)).when(F.col("id") == 1, F.lit(-1e300)).otherwise(x)
    if kind == "few":
        return (F.col("id") % 4).cast("double")
    return F.when(F.col("id") < 5, F.lit(float("inf"))).otherwise(F.col("id") * 1e-9)


@pytest.mark.parametrize("kind", ["frequent", "outlier", "few", "infinite"])
def test_quantiles_equal_numpy_at_any_size(spark, kind):
    sizes = spark.createDataFrame([(size,) for size in SIZES], "k bigint")
    df = sizes.withColumn("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))).select("k", values(kind).alias("v"))
    pdf = df.toPandas()
    got = {r.k: r for r in quantiles(spark.createDataFrame(pdf), ["k"], F.col("v"), PROBS).collect()}
    assert set(got) == set(SIZES)
    for k, part in pdf.groupby("k"):
        x = np.sort(part.v.to_numpy())
        assert got[k].n == len(x) == k
        for name, p in PROBS.items():
            rank = p * (len(x) - 1)
            low, high = x[int(rank)], x[min(int(rank) + 1, len(x) - 1)]
            assert got[k][name] == pytest.approx(low if low == high else low + (high - low) * (rank - int(rank)), rel=1e-12)


def test_nulls_have_no_rank_and_empty_groups_no_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in quantiles(df, ["k"], F.col("v"), {"m": 0.5}).collect()] == [("a", 2, 2.0)]
    assert quantiles(df.where("false"), ["k"], F.col("v"), {"m": 0.5}).count() == 0


def test_median_and_mad_of_large_and_small_groups(spark):
    df = spark.range(150_000).select(F.when(F.col("id") < 149_000, "a").otherwise("b").alias("k"), F.round(F.randn(3), 2).alias("v"))
    pdf = df.toPandas()
    got = {r.k: r for r in median_and_mad(spark.createDataFrame(pdf), ["k"], "v").collect()}
    for k, part in pdf.groupby("k"):
        middle = np.median(part.v)
        assert got[k].median == pytest.approx(middle) and got[k].mad == pytest.approx(np.median(np.abs(part.v - middle)))


def test_a_far_value_crowds_no_rank_block(spark):
    rows = spark.range(200_001).select(
        F.lit("a").alias("k"), F.when(F.col("id") == 0, F.lit(1e6)).otherwise(F.col("id") / 40_000).alias("v")
    )
    laid = rank_blocks(rows, ["k"], ["v"])
    cells = laid.groupBy("blk").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("blk").collect()
    assert sum(c.c for c in cells) == 200_001 and max(c.c for c in cells) <= 0.05 * 200_001
    assert all(a.hi < b.lo for a, b in zip(cells, cells[1:], strict=False))
    ranked = carry(laid, {"r": ("sum", F.lit(1).cast("bigint"))}, order="v", keys=["k"])
    assert ranked.where(F.col("v") == 1e6).first().r == 200_001
    assert ranked.where(F.col("r") != F.round(F.col("v") * 40_000)).where("v < 1e6").count() == 0


def test_statistics_meet_rows_by_broadcast_and_by_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.max("id").alias("top"))
    for few in (0, 100):
        got = beside(rows, stats, ["k"], few=few).collect()
        assert len(got) == 100 and all(r.top % 7 == r.k for r in got)
