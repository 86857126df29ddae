"""Nearest and furthest vectors: what travels, short numbers, many equal distances."""

import numpy as np
from pyspark.sql import functions as F

from sensorloom.operators import nearest


def test_vectors_travel_once_for_some_blocks():
    # Of 100,000 vectors each was sent for 100 cells before, with its numbers.
    assert nearest.cell_count(100_000, nearest.BLOCK) <= 16 and nearest.cell_count(0, nearest.BLOCK) == 1


def test_floats_with_equal_distances_over_blocks(spark):
    # Unit vectors: all are equally far from each other, but for copies.
    rows = [(i, [float(i % 12 == j) for j in range(12)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").withColumn("v", F.col("v").cast("array<float>"))
    found = {}
    for r in nearest.neighbours(df, 3, block=4, cells=3).collect():
        found.setdefault((r.id, r.kind), []).append((r.rank, r.other, r.distance))
    for i, v in rows:
        far = [(float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, w in rows if j != i]
        for kind, want in (("near", sorted(far)[:3]), ("far", sorted((-d, j) for d, j in far)[:3])):
            assert sorted(found[i, kind]) == [(n + 1, j, abs(d)) for n, (d, j) in enumerate(want)]
