"""Packed sums of outer products against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import moments


@pytest.mark.parametrize("slots", [1, 3, 1024])
def test_sums_of_blocks_equal_the_whole(spark, monkeypatch, slots):
    monkeypatch.setattr(moments, "SLOTS", slots)
    df = spark.range(5000).select(
        F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("k"), F.floor(F.col("id") / 37).alias("blk"),
        F.randn(1).alias("x"), F.randn(2).alias("y"),
    )
    df = spark.createDataFrame(df.toPandas())
    build = lambda pdf: np.hstack([np.ones((len(pdf), 1)), pdf[["x", "y"]].to_numpy()])[pdf["x"].to_numpy() > -3]
    sums = moments.gram(df, ["k"], build, ["k", "blk"])
    want = {k: build(part) for k, part in df.toPandas().groupby("k")}
    got = {r.k: moments.unpacked(r.g) for r in sums.collect()}
    assert set(got) == {"a", "b"}
    for k, z in want.items():
        assert np.allclose(got[k], z.T @ z)
    models = moments.fit(sums, ["k"], lambda m: {"n": float(m[0, 0]), "diag": np.diag(m).tolist()}, "n double, diag array<double>")
    assert {r.k: r.n for r in models.collect()} == {k: len(z) for k, z in want.items()}


def test_groups_without_samples_have_no_row(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "k string, blk bigint, x double")
    sums = moments.gram(df, ["k"], lambda pdf: np.empty((0, 3)), ["k", "blk"])
    assert sums.count() == 0 and moments.fit(sums, ["k"], lambda m: {"n": 0.0}, "n double").count() == 0


def test_packing_is_undone():
    matrix = np.arange(16.0).reshape(4, 4)
    matrix = matrix + matrix.T
    assert (moments.unpacked(moments.packed(matrix)) == matrix).all() and moments.unpacked([]).shape == (0, 0)
