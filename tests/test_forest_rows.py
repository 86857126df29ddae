from pyspark.sql import functions as F

from helpers import series
from sensorloom.functions.blocks import HOUR, in_blocks
from sensorloom.operators import detect


def test_trees_draw_from_all_rows(spark):
    rows = in_blocks(series(spark, range(3000)).drop("event_id"), HOUR)
    got = detect.forest_rows(rows, ["series"], 10, 64, 13)
    hashes = rows.select("ts", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tree"), F.xxhash64(
        F.lit(13), F.col("tree"), "series", "ts").alias("h")).collect()
    want = set()
    for tree in range(10):
        want |= {(tree, r.ts) for r in sorted((r for r in hashes if r.tree == tree), key=lambda r: r.h)[:64]}
    assert {(r.tree, r.ts) for r in got.collect()} == want
