"""Artificial gaps for judging imputers.

A gap set belongs to one series, gap size and seed; its gaps are ``(start_pos,
len)`` on the series' grid.  The planning works on one row per set and needs only
the length of the series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import chance
from sensorloom.functions.blocks import HOUR, MICROS, expand, micros

SET = ("series", "gap_size", "seed")
RANDOM_FRACTION = 0.75


def gap_sets(bounds: DataFrame, gap_sizes: Sequence[int], seeds: DataFrame) -> DataFrame:
    """Every series with every gap size and every seed of the seed table."""
    if any(int(g) <= 0 for g in gap_sizes):
        raise ValueError("gap sizes must be positive")
    sizes = F.explode(F.array(*[F.lit(int(g)).cast("bigint") for g in gap_sizes]))
    packed = seeds.agg(F.sort_array(F.collect_list(F.struct("run", "seed"))).alias("_seeds"))
    return (
        bounds.withColumn("gap_size", sizes)
        .join(F.broadcast(packed))
        .withColumn("_s", F.explode("_seeds"))
        .select("series", "first_ts", "n", "gap_size", F.col("_s.seed").alias("seed"), F.col("_s.run").alias("run"))
    )


def _candidates(room: Column, excluded: int, *labels) -> Column:
    """Different positions below ``room`` in random order, enough of them for sure.

    ``excluded`` is one more than all but the last position taken can rule out: of
    that many different ones at least one is left for the last.
    """
    some = F.sequence(F.lit(0).cast("bigint"), F.least(room, F.lit(excluded).cast("bigint")) - 1)
    order = F.transform(some, lambda j: chance.permuted(j, room, *labels))
    return F.when(room <= 0, F.array().cast("array<bigint>")).otherwise(order)


def _accept(candidates: Column, wanted: int, clashes) -> Column:
    """Take candidates in order unless they clash with one already taken."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(
        candidates,
        none,
        lambda taken, c: F.when(
            (F.size(taken) >= wanted) | clashes(taken, c), taken
        ).otherwise(F.concat(taken, F.array(c))),
    )


def _block_starts(sets: DataFrame, size: int, wanted: int, apart: int) -> DataFrame:
    excluded = (wanted - 1) * (2 * (size + apart) - 1) + 1
    wide = size + apart
    # Candidates become a column once: each is a chain of hashes.
    placed = sets.withColumn("_cand", _candidates(F.col("n") - (size - 1), excluded, "gap", F.col("seed"), F.col("series"), size))
    taken = _accept(
        F.col("_cand"), wanted, lambda taken, c: F.exists(taken, lambda s: (c < s + wide) & (s < c + wide))
    )
    return placed.withColumn("starts", F.array_sort(taken)).drop("_cand")


def _as_gaps(sets: DataFrame, step: int) -> DataFrame:
    start = F.timestamp_micros(micros("first_ts") + F.col("start_pos") * (step * MICROS))
    return sets.withColumns({"start_ts": start, "gap_id": F.col("start_pos")}).select(
        *SET, "run", "gap_id", "start_pos", "start_ts", "len"
    )


def block_gaps(sets: DataFrame, gap_sizes: Sequence[int], num_gaps: int, *, step: int = HOUR, apart: int = 0) -> DataFrame:
    """``num_gaps`` blocks per set that do not overlap, in random places.

    Places are tried in a random order of all of them; a series too short for so
    many gets fewer.
    """
    parts = []
    for size in gap_sizes:
        chosen = _block_starts(sets.where(F.col("gap_size") == size), size, num_gaps, apart)
        parts.append(
            chosen.withColumn("start_pos", F.explode("starts")).withColumn("len", F.lit(size).cast("bigint"))
        )
    return _as_gaps(reduce(DataFrame.unionByName, [p.drop("starts") for p in parts]), step)


def hybrid_gaps(
    sets: DataFrame, gap_sizes: Sequence[int], num_gaps: int, *, step: int = HOUR,
    random_fraction: float = RANDOM_FRACTION,
) -> DataFrame:
    """Isolated points for most of the masked rows, separated blocks for the rest.

    At least one point and one block are placed, so slightly more rows than
    ``size * num_gaps`` can be masked.
    """
    parts = []
    for size in gap_sizes:
        total = max(1, size * num_gaps)
        singles = int(total * random_fraction)
        blocks = max(1, (total - singles) // size)
        points = max(1, singles)
        chosen = _block_starts(sets.where(F.col("gap_size") == size), size, blocks, 1)
        excluded = blocks * (size + 2) + (points - 1) * 3 + 1
        labels = ("point", F.col("seed"), F.col("series"), size)
        chosen = chosen.withColumn("_cand", _candidates(F.col("n"), excluded, *labels))
        near_block = lambda c: F.exists("starts", lambda s: (c >= s - 1) & (c <= s + size))
        taken = _accept(
            F.col("_cand"), points,
            lambda taken, c: near_block(c) | F.exists(taken, lambda p: F.abs(p - c) <= 1),
        )
        chosen = chosen.withColumn("_points", F.array_sort(taken))
        windows = F.concat(
            F.transform("starts", lambda s: F.struct(s.alias("s"), F.lit(size).cast("bigint").alias("l"))),
            F.transform("_points", lambda s: F.struct(s.alias("s"), F.lit(1).cast("bigint").alias("l"))),
        )
        parts.append(
            chosen.withColumn("_w", F.explode(windows)).withColumns(
                {"start_pos": F.col("_w.s"), "len": F.col("_w.l")}
            ).drop("_w", "_cand", "_points", "starts")
        )
    return _as_gaps(reduce(DataFrame.unionByName, parts), step)


def plan_gaps(
    bounds: DataFrame, gap_sizes: Sequence[int], seeds: DataFrame, num_gaps: int, *,
    strategy: str = "block", step: int = HOUR, spec: DataFrame | None = None, grid: DataFrame | None = None,
) -> DataFrame:
    """Gaps for every series, size and seed.

    ``bounds`` is ``series, first_ts, n``.  Series named in ``spec (series,
    start_ts, len)`` get those gaps instead; of them only windows wholly inside
    the grid are kept.
    """
    sets = gap_sets(bounds, gap_sizes, seeds)
    if strategy not in ("block", "hybrid"):
        raise ValueError("gap strategy must be 'block' or 'hybrid'")
    make = block_gaps if strategy == "block" else hybrid_gaps
    if spec is None:
        return make(sets, gap_sizes, num_gaps, step=step)
    named = spec.select("series").distinct()
    free = make(sets.join(named, "series", "left_anti"), gap_sizes, num_gaps, step=step)
    given = explicit_gaps(sets, spec, step)
    return free.unionByName(given if grid is None else inside_grid(given, grid, step))


def explicit_gaps(sets: DataFrame, spec: DataFrame, step: int = HOUR) -> DataFrame:
    """The given windows for every set of their series."""
    start = ((micros("start_ts") - micros("first_ts")) / F.lit(step * MICROS)).cast("bigint")
    rows = sets.join(spec.where("len > 0").select("series", "start_ts", "len"), "series")
    return rows.withColumn("start_pos", start).select(
        *SET, "run", F.col("start_pos").alias("gap_id"), "start_pos", "start_ts", F.col("len").cast("bigint").alias("len")
    )


def inside_grid(gaps: DataFrame, grid: DataFrame, step: int = HOUR) -> DataFrame:
    """Keep windows whose every slot is a row of the grid."""
    slots = expand(gaps, F.col("len"), "_i").withColumn(
        "ts", F.timestamp_micros(micros("start_ts") + F.col("_i") * (step * MICROS))
    )
    found = slots.join(grid.select("series", "ts"), ["series", "ts"])
    return (
        found.groupBy(*gaps.columns).agg(F.count(F.lit(1)).alias("_hits")).where("_hits = len").drop("_hits")
    )


def gap_rows(gaps: DataFrame, step: int = HOUR) -> DataFrame:
    """One row per masked timestamp of every gap."""
    return expand(gaps, F.col("len"), "_i").select(
        *gaps.columns, F.timestamp_micros(micros("start_ts") + F.col("_i") * (step * MICROS)).alias("ts"),
        F.col("_i").alias("offset"),
    )


def seed_table(
    spark, seeds: Sequence[int] | None = None, *, n_runs: int = 20, start: int = 42, step: int = 1
) -> DataFrame:
    """``run, seed`` from an explicit list or from start, step and number."""
    if seeds is not None:
        if not list(seeds):
            raise ValueError("the seed list is empty")
        rows = [(i, int(s)) for i, s in enumerate(seeds, 1)]
        return spark.createDataFrame(rows, "run bigint, seed bigint")
    if n_runs <= 0 or step == 0:
        raise ValueError("n_runs must be positive and step not 0")
    return spark.range(1, n_runs + 1).select(
        F.col("id").alias("run"), (F.lit(start) + (F.col("id") - 1) * step).cast("bigint").alias("seed")
    )
