"""Synthetic anomalies put into clean series.

Rows have ``series, blk, pos, ts, value`` with ``pos`` counted from 0.  Where an
anomaly starts, how long it is and which way it goes are hashes of the seed, the
kind, the series and the anomaly's number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import chance
from sensorloom.functions.blocks import attach, carry, expand, floor_div
from sensorloom.session import cut

# Rows per anomaly and (shortest, longest) length of each kind.
PROFILE = {
    "spikes": (150, (1, 1)),
    "scale": (300, (2, 16)),
    "noise": (300, (2, 16)),
    "drift": (900, (16, 48)),
}
KINDS = tuple(PROFILE)
MIN_POINTS = 8


def _length(kind: str, seed: int, number: Column) -> Column:
    low, high = PROFILE[kind][1]
    if low == high:
        return F.lit(low).cast("bigint")
    return chance.integer(low, high + 1, seed, kind, F.col("series"), number, "length")


def anomaly_table(sizes: DataFrame, kind: str, seed: int) -> DataFrame:
    """``series, kind, j, start, len, up`` for series with ``n`` rows."""
    rate = PROFILE[kind][0]
    many = F.when(
        F.col("n") >= MIN_POINTS, F.greatest(F.lit(1).cast("bigint"), floor_div(F.col("n"), rate))
    ).otherwise(F.lit(0).cast("bigint"))
    numbered = expand(sizes.select("series", "n"), many, "j")
    sized = numbered.withColumn("len", F.least(_length(kind, seed, F.col("j")), F.col("n")))
    room = F.greatest(F.lit(1).cast("bigint"), F.col("n") - F.col("len"))
    return sized.select(
        "series", F.lit(kind).alias("kind"), "j",
        chance.integer(F.lit(0), room, seed, kind, F.col("series"), F.col("j"), "start").alias("start"),
        "len", (chance.uniform(seed, kind, F.col("series"), F.col("j"), "way") >= 0.5).alias("up"),
    )


def slot_table(sizes: DataFrame, seed: int) -> DataFrame:
    """One anomaly of each kind, each inside its own quarter of the series."""
    parts = []
    for i, kind in enumerate(KINDS):
        slot = F.greatest(F.lit(1).cast("bigint"), floor_div(F.col("n"), len(KINDS)))
        zero = F.lit(0)
        length = F.least(_length(kind, seed, zero), F.greatest(F.lit(1), F.col("_slot") - 2))
        low = F.col("_slot") * i + 1
        high = F.greatest(low + 1, F.col("_slot") * (i + 1) - F.col("len") - 1)
        start = chance.integer(low, high, seed, kind, F.col("series"), zero, "start")
        parts.append(
            sizes.withColumn("_slot", slot).withColumn("len", length).select(
                "series", F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("j"),
                F.least(start, F.col("n") - F.col("len")).alias("start"), "len",
                (chance.uniform(seed, kind, F.col("series"), zero, "way") >= 0.5).alias("up"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def case_sizes(cases: DataFrame) -> DataFrame:
    """``series, n, std`` with std 1 for constant series."""
    std = F.stddev_pop("value")
    return cases.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std")
    )


def inject(cases: DataFrame, seed: int, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Cases with anomalies of the given kinds and a 0/1 ``label``.

    Kinds are applied in the order spikes, scale, noise, drift, each on top of
    the ones before.
    """
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown anomaly kind: {', '.join(sorted(unknown))}")
    sizes = cut(case_sizes(cases))
    tables = [anomaly_table(sizes, kind, seed) for kind in KINDS if kind in kinds]
    return apply(cases, sizes, cut(reduce(DataFrame.unionByName, tables)), seed)


def inject_one_of_each(cases: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """One anomaly of every kind, and the table of where they are."""
    sizes = cut(case_sizes(cases))
    table = cut(slot_table(sizes, seed))
    return apply(cases, sizes, table, seed), table


def points_of(table: DataFrame) -> DataFrame:
    """One row per position of every anomaly."""
    return table.withColumn(
        "pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))
    )


def apply(cases: DataFrame, sizes: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """Put the anomalies of ``table`` into ``cases``."""
    points = points_of(table)
    kind, up = F.col("kind"), F.col("up")
    draw = chance.normal(seed, "noise", F.col("series"), F.col("j"), F.col("pos"))
    # The first three kinds commute with themselves, so each is one number per
    # row: an offset, a factor and a noise term.
    changes = points.groupBy("series", "pos").agg(
        F.sum(F.when(kind == "spikes", F.when(up, 4.0).otherwise(-4.0)).otherwise(0.0)).alias("_add"),
        F.product(F.when(kind == "scale", F.when(up, 2.0).otherwise(0.25)).otherwise(1.0)).alias("_by"),
        F.sum(F.when(kind == "noise", draw * 2.0).otherwise(0.0)).alias("_noise"),
    )
    changed = (F.col("value") + F.col("_add") * F.col("std")) * F.col("_by") + F.col("_noise") * F.col("std")
    rows = (
        attach(cases, sizes.select("series", "std"))
        .join(changes, ["series", "pos"], "left")
        .withColumns(
            {"value": F.when(F.col("_add").isNull(), F.col("value")).otherwise(changed),
             "label": F.when(F.col("_add").isNull(), 0).otherwise(1)}
        )
        .drop("_add", "_by", "_noise")
    )
    return _drift(rows, table.where("kind = 'drift'"), seed).drop("std")


def _drift(rows: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """Loss of calibration: a growing offset, gain and noise along the anomaly.

    Drifts that overlap must be applied one after the other, so they are joined
    into clusters and each cluster's values pass as one short array.
    """
    placed = table.withColumns(
        {"blk": floor_div(F.col("start"), 100_000), "_end": F.col("start") + F.col("len") - 1}
    )
    reached = carry(placed, {"_reach": ("max_before", F.col("_end"))}, order=("start", "j"))
    opens = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start"))
    clustered = carry(reached, {"cluster": ("last", opens)}, order=("start", "j"))
    groups = clustered.groupBy("series", "cluster").agg(
        F.array_sort(F.collect_list(F.struct("j", "start", "len", "up"))).alias("drifts")
    )
    where = points_of(clustered).select("series", "cluster", "pos").distinct()
    values = (
        rows.select("series", "pos", "value", "std")
        .join(where, ["series", "pos"])
        .groupBy("series", "cluster")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("rows"), F.first("std").alias("std"))
        .join(groups, ["series", "cluster"])
    )

    def step(array: Column, drift: Column) -> Column:
        offset = drift["start"] - F.col("cluster")
        part = F.slice(array, (offset + 1).cast("int"), drift["len"].cast("int"))
        mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / drift["len"]
        way = F.when(drift["up"], 1.0).otherwise(-1.0)

        def change(x: Column, i: Column, centre: Column) -> Column:
            share = F.try_divide(i - offset, drift["len"] - 1)
            share = F.coalesce(share, F.lit(0.0))
            noise = chance.normal(seed, "drift", F.col("series"), drift["j"], i - offset)
            moved = centre + (x - centre) * (1.0 + share) + F.col("std") * (
                way * 3.0 * share * share + noise * 0.3 * share
            )
            return F.when((i >= offset) & (i < offset + drift["len"]), moved).otherwise(x)

        # The one-element array computes the mean once, not once per value.
        inner = F.transform(F.array(mean), lambda m: F.transform(array, lambda x, i: change(x, i, m)))
        return F.get(inner, F.lit(0))

    moved = values.select(
        "series", "cluster",
        F.posexplode(F.aggregate("drifts", F.transform("rows", lambda r: r["value"]), step)).alias("i", "_moved"),
    ).select("series", (F.col("cluster") + F.col("i")).alias("pos"), "_moved")
    return rows.join(moved, ["series", "pos"], "left").withColumns(
        {"value": F.coalesce("_moved", "value"),
         "label": F.when(F.col("_moved").isNotNull(), 1).otherwise(F.col("label"))}
    ).drop("_moved")
