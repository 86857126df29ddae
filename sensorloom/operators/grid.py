"""Regular grids, hourly means, runs, gaps and segments."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.blocks import (
    BLOCK_ROWS,
    FIVE_MINUTES,
    HOUR,
    MICROS,
    SERIES,
    carry,
    expand,
    floor_div,
    floor_ts,
    in_blocks,
    micros,
    run_table,
    runs,
    time_block,
)
from sensorloom.session import cut

# Detection limits by pollutant, in the units of the readings.
DETECTION_LIMITS = {"CO": 6.0, "NO2": 3.762}
MIN_RUN = 6
MIN_USEFUL = 3


def last_readings(
    obs: DataFrame, step: int, *, tie: str = "event_id", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Readings laid out by ``(series, blk)``, the last one of each timestamp.

    ``tie`` says which is last; without that column it is the largest value.
    Duplicates fall to a look at the next row; the sort serves later windows too.
    """
    order = [tie] if tie in obs.columns else []
    placed = in_blocks(obs.select("series", "ts", "value", *order), step, rows)
    following = F.lead("ts").over(Window.partitionBy("series", "blk").orderBy("ts", *(order or ["value"])))
    return (
        placed.withColumn("_next", following)
        .where(F.col("_next").isNull() | (F.col("_next") > F.col("ts")))
        .select("series", "blk", "ts", F.col("value").cast("double").alias("value"))
    )


def regular_grid(
    obs: DataFrame, step: int, *, tie: str = "event_id", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Put every series on a fixed step counted from its first timestamp.

    The last duplicate of a timestamp is kept (``tie`` decides), readings off
    the grid are dropped, empty slots are null.  Result: ``series, blk, pos, ts,
    value`` laid out by ``(series, blk)``.
    """
    clean = obs.where(F.col("ts").isNotNull())
    readings = last_readings(clean, step, tie=tie, rows=rows)
    return skeleton(series_bounds(clean), step, rows).join(
        readings, ["series", "blk", "ts"], "left"
    ).select("series", "blk", "pos", "ts", "value")


def series_bounds(obs: DataFrame) -> DataFrame:
    return obs.groupBy("series").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def block_bounds(bounds: DataFrame, step: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of each series with the series' ``_first`` and ``_last``
    timestamp in microseconds."""
    span = step * MICROS * rows
    first, last = micros("first_ts"), micros("last_ts")
    blocks = bounds.select(
        "series", first.alias("_first"), last.alias("_last"),
        floor_div(first, span).alias("_b0"), floor_div(last, span).alias("_b1"),
    )
    return expand(blocks, F.col("_b1") - F.col("_b0") + 1, "_i").select(
        "series", "_first", "_last", (F.col("_b0") + F.col("_i")).alias("blk")
    )


def skeleton(bounds: DataFrame, step: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """All slots of ``first_ts .. last_ts``, made block by block."""
    size = step * MICROS
    span = size * rows
    blocks = block_bounds(bounds, step, rows)
    # First and last slot number that fall into the block.
    begin = F.col("blk") * span - F.col("_first")
    low = F.greatest(F.lit(0), floor_div(begin + F.lit(size - 1), size))
    high = floor_div(F.least(F.col("_last"), (F.col("blk") + 1) * span - 1) - F.col("_first"), size)
    slots = blocks.withColumns({"_low": low.cast("bigint"), "_high": high}).where("_low <= _high")
    slots = slots.repartition("series", "blk")
    slots = slots.withColumn("pos", F.explode(F.sequence("_low", "_high")))
    return slots.select(
        "series", "blk", "pos",
        F.timestamp_micros(F.col("_first") + F.col("pos") * size).alias("ts"),
    )


def floor_slots(obs: DataFrame, step: int, *, tie: str = "event_id") -> DataFrame:
    """Cut timestamps to their slot and keep the first reading of each slot."""
    order = F.struct("ts", tie) if tie in obs.columns else F.struct("ts", "value")
    return (
        obs.withColumn("_slot", floor_ts("ts", step))
        .groupBy("series", "_slot")
        .agg(F.min_by("value", order).alias("value"))
        .select("series", F.col("_slot").alias("ts"), "value")
    )


def to_long(df: DataFrame, columns: Sequence[str], *, ts: str = "ts") -> DataFrame:
    """Wide frame (one column per series) to long rows."""
    return df.unpivot([ts], list(columns), "series", "value").withColumnRenamed(ts, "ts").select(
        "series", "ts", F.col("value").cast("double").alias("value")
    )


def collect_series(parts: Mapping[str, DataFrame] | Sequence[DataFrame], prefix: str = "series") -> DataFrame:
    """One long table from named or unnamed ``(ts, value)`` frames.

    Unnamed frames are called ``prefix_0``, ``prefix_1``, ...
    """
    named = parts.items() if isinstance(parts, Mapping) else (
        (f"{prefix}_{i}", df) for i, df in enumerate(parts)
    )
    tables = [
        df.select(F.lit(name).alias("series"), "ts", F.col("value").cast("double").alias("value"))
        for name, df in named
    ]
    if not tables:
        raise ValueError("no series given")
    return reduce(DataFrame.unionByName, tables)


def observed_counts(obs: DataFrame, step: int) -> DataFrame:
    """Number of series observed at each slot of the union time span."""
    span = obs.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    slots = skeleton(span.select(F.lit("all").alias("series"), "first_ts", "last_ts"), step)
    seen = obs.groupBy("ts").agg(F.count("value").alias("n_observed"))
    return slots.select("ts").join(seen, "ts", "left").select(
        "ts", F.coalesce("n_observed", F.lit(0)).cast("bigint").alias("n_observed")
    )


def align_wide(obs: DataFrame, names: Sequence[str], step: int) -> DataFrame:
    """Outer-joined wide frame on the union grid, one column per name."""
    wide = obs.groupBy("ts").pivot("series", list(names)).agg(F.first("value"))
    return observed_counts(obs, step).join(wide, "ts", "left")


def frozen_runs(grid: DataFrame, *, min_run: int = MIN_RUN) -> DataFrame:
    """Add ``frozen``: the reading sits in a run of at least ``min_run`` equal
    readings.  Nulls neither break nor lengthen a run."""
    measured = runs(grid.where(F.col("value").isNotNull()), F.col("value"))
    flags = measured.select(
        *grid.columns, (F.col("run_len") >= F.lit(min_run)).alias("frozen")
    )
    return flags.unionByName(
        grid.where(F.col("value").isNull()).withColumn("frozen", F.lit(False))
    )


def hourly_mean(
    obs: DataFrame,
    limit: Column | float,
    *,
    min_run: int = MIN_RUN,
    min_useful: int = MIN_USEFUL,
    step: int = FIVE_MINUTES,
    tie: str = "event_id",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the trustworthy readings of each hour, on an hourly grid.

    Readings count on the regular grid only (see :func:`regular_grid`).  Frozen
    readings count as 0.  A reading is useful from the detection limit up; an
    hour with fewer than ``min_useful`` of them is null.  Empty slots change
    neither runs nor means, so only the hours are laid out, not every slot.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    clean = obs.where(F.col("ts").isNotNull())
    bounds = series_bounds(clean)
    off_grid = F.pmod(micros("ts") - F.col("_first"), F.lit(step * MICROS))
    # Joined per block, so that the rows of a long series stay spread out.
    readings = (
        last_readings(clean, step, tie=tie, rows=rows)
        .where(F.col("value").isNotNull())
        .join(block_bounds(bounds, step, rows).drop("_last"), ["series", "blk"])
        .where(off_grid == 0)
        .drop("_first")
    )
    frozen = runs(readings, F.col("value")).withColumn("frozen", F.col("run_len") >= min_run)
    reading = F.when(F.col("frozen"), F.lit(0.0)).otherwise(F.col("value"))
    useful = F.when(reading >= limit, reading)
    means = (
        frozen.withColumn("ts", floor_ts("ts", HOUR))
        .groupBy("series", time_block("ts", HOUR).alias("blk"), "ts")
        .agg(F.count(useful).alias("n_useful"), F.avg(useful).alias("mean_useful"))
        .where(F.col("n_useful") >= min_useful)
    )
    hours = skeleton(
        bounds.select(
            "series", floor_ts("first_ts", HOUR).alias("first_ts"), floor_ts("last_ts", HOUR).alias("last_ts")
        ),
        HOUR,
    )
    return hours.join(means, ["series", "blk", "ts"], "left").select(
        "series", "blk", "pos", "ts", F.col("mean_useful").alias("value")
    )


def limit_of(pollutant: Column) -> Column:
    """Detection limit of a pollutant column; an unknown name is an error."""
    known = F.create_map(*[F.lit(x) for pair in DETECTION_LIMITS.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("no detection limit for "), pollutant)).cast("double")
    return F.coalesce(F.try_element_at(known, pollutant), unknown)


def drop_repeats(hourly: DataFrame, step: int = HOUR) -> tuple[DataFrame, DataFrame]:
    """Drop hours equal to the hour before; also count them per series."""
    blocked = hourly if "blk" in hourly.columns else in_blocks(hourly, step)
    both = carry(blocked.select("series", "blk", "ts", "value"), {"_prev": ("before", F.struct("value"))}).withColumn(
        "_repeat",
        F.col("value").isNotNull() & F.coalesce(F.col("_prev")["value"] == F.col("value"), F.lit(False)),
    )
    counts = both.groupBy("series").agg(F.count_if("_repeat").alias("n_repeats"))
    return both.where(~F.col("_repeat")).drop("_prev", "_repeat"), counts


def observed_segments(grid: DataFrame, min_len: int = 1) -> DataFrame:
    """Rows of the stretches without nulls, with ``segment`` (its first ts) and
    ``segment_len``; shorter stretches are left out."""
    measured = runs(grid, F.col("value").isNotNull())
    return measured.where(F.col("value").isNotNull() & (F.col("run_len") >= min_len)).select(
        *grid.columns,
        F.col("run_start").alias("segment"),
        F.col("run_end").alias("segment_end"),
        F.col("run_len").alias("segment_len"),
    )


def segment_table(grid: DataFrame, min_len: int = 1) -> DataFrame:
    """``series, segment, segment_end, segment_len`` of the observed stretches."""
    return (
        observed_segments(grid, min_len)
        .groupBy("series", "segment")
        .agg(F.first("segment_end").alias("segment_end"), F.first("segment_len").alias("segment_len"))
    )


def longest_run(grid: DataFrame) -> DataFrame:
    """Longest observed stretch of each series; the first one wins a tie."""
    found = segment_table(grid)
    rank = F.struct(F.col("segment_len"), -micros("segment"))
    best = found.groupBy("series").agg(
        F.max_by(F.struct("segment", "segment_end", "segment_len"), rank).alias("b")
    )
    return best.select(
        "series",
        F.col("b.segment").alias("run_start"),
        F.col("b.segment_end").alias("run_end"),
        F.col("b.segment_len").alias("run_len"),
    )


def gap_windows(grid: DataFrame) -> DataFrame:
    """Start and length of every stretch of nulls."""
    measured = runs(grid, F.col("value").isNull()).where(F.col("value").isNull())
    return run_table(measured).select(
        "series", F.col("run_start").alias("start_ts"), F.col("run_len").alias("len")
    )


def mask_times(gaps: DataFrame, step: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Distinct timestamps covered by gap windows ``(start_ts, len)``."""
    slots = expand(gaps.select(*keys, "start_ts", "len"), F.col("len"), "_i")
    return slots.select(
        *keys, F.timestamp_micros(micros("start_ts") + F.col("_i") * (step * MICROS)).alias("ts")
    ).distinct()


# Stretches whose series are counted in the first and in any later round.
FIRST_LOOK, LOOK = 64, 1024


def best_block(obs: DataFrame, step: int, *, w_col: float = 0.6, w_row: float = 0.4) -> DataFrame:
    """Block of time and series without holes that covers most.

    For every k, each stretch of slots with at least k observed series is a
    candidate; the series complete in it count.  Score: ``columns^w_col *
    rows^w_row``; ties go to the smaller k, then the earlier stretch.  Result:
    one row per series of the winning block.

    No more series can be complete than are observed at the stretch's poorest slot.
    Stretches are looked at from the best such bound down, some at a time, until no
    bound reaches the best score found.
    """
    spark = obs.sparkSession
    own = cut(segment_table(regular_grid(obs, step)).select("series", "segment", "segment_end"))
    bound = F.pow(F.col("n"), F.lit(w_col)) * F.pow(F.col("run_len"), F.lit(w_row))
    spans = cut(stretches(observed_counts(obs, step), step).withColumn("bound", F.round(bound, 9)))
    order = [F.col("bound").desc(), "k", "run_start"]
    best, seen, look = None, 0, FIRST_LOOK
    while True:
        # At most a thousand rows: the stretches of this round, and the first of the next one.
        page = spans.orderBy(*order).offset(seen).limit(look + 1).collect()
        if not page or (best is not None and page[0]["bound"] < best[0]):
            break
        asked = spark.createDataFrame(page[:look], spans.schema)
        covered = own.join(F.broadcast(asked), (F.col("segment") <= F.col("run_start")) & (F.col("run_end") <= F.col("segment_end")))
        counted = covered.groupBy("k", "run_start", "run_end", "run_len").agg(F.count(F.lit(1)).alias("n_series"))
        score = F.pow(F.col("n_series"), F.lit(w_col)) * F.pow(F.col("run_len"), F.lit(w_row))
        # Score alone decides first; comparing rounded keeps equal blocks equal.
        ranked = counted.withColumn("score", score).withColumn("_r", F.round("score", 9))
        top = ranked.orderBy(F.col("_r").desc(), "k", "run_start").first()
        if top is not None:
            found = (top["_r"], -top["k"], top["run_start"], top)
            if best is None or found[:2] > best[:2] or (found[:2] == best[:2] and found[2] < best[2]):
                best = found
        seen, look = seen + len(page[:look]), LOOK
    if best is None:
        return own.where("false").selectExpr(
            "series", "segment AS run_start", "segment_end AS run_end", "0L AS run_len", "0L AS n_series", "0D AS score"
        )
    won = spark.createDataFrame([best[3]], ranked.schema).drop("k", "_r")
    inside = own.join(F.broadcast(won), (F.col("segment") <= F.col("run_start")) & (F.col("run_end") <= F.col("segment_end")))
    return inside.select("series", "run_start", "run_end", "run_len", "n_series", "score")


def stretches(counts: DataFrame, step: int, *, rows: int = BLOCK_ROWS) -> DataFrame:
    """Longest stretches of slots with at least k observed series, for every k: ``k, n, run_start, run_end, run_len``.

    ``n`` is the number at the poorest slot of a stretch, ``k`` the smallest one that
    gives the same stretch.  Only slots where ``counts (ts, n_observed)`` changes
    matter.  A stack of growing numbers finds the stretches that begin and end
    within a block of changes; of the others, only the changes lower than all before
    or all behind them in their block can be the poorest or the border, and one more
    stack goes over those alone.
    """
    size = step * MICROS
    line = in_blocks(counts.withColumn("series", F.lit("all")), step, rows)
    changes = carry(line, {"_before": ("before", F.col("n_observed"))})
    changes = changes.where(F.col("_before").isNull() | (F.col("_before") != F.col("n_observed")))
    last = counts.agg(F.max("ts").alias("last"))
    ends = carry(changes.select("series", "blk", "ts", "n_observed"), {"_next": ("after", F.col("ts"))})
    changes = ends.join(F.broadcast(last)).select(
        "blk", micros("ts").alias("s"), F.coalesce(micros("_next") - size, micros("last")).alias("e"), F.col("n_observed").alias("n")
    )
    schema = "s bigint, e bigint, n bigint, k bigint"

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        found = pd.DataFrame(_closed(pdf, size, [], whole=False), columns=["s", "e", "n", "k"])
        n = pdf["n"].to_numpy()
        low = (np.minimum.accumulate(n) == n) | (np.minimum.accumulate(n[::-1])[::-1] == n)
        # Changes that the whole line needs have no k yet.
        return pd.concat([found, pdf.loc[low, ["s", "e", "n"]].assign(k=-1)])

    near = cut(changes.groupBy("blk").applyInPandas(within, schema))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list = []
        end = None
        for pdf in batches:
            yield pd.DataFrame(_closed(pdf, size, stack, whole=True), columns=["s", "e", "n", "k"])
            end = pdf["e"].iloc[-1] if len(pdf) else end
        if stack:
            rest = [(left, end, n, (stack[i - 1][1] if i else 0) + 1) for i, (left, n, _) in enumerate(stack)]
            yield pd.DataFrame(rest, columns=["s", "e", "n", "k"])

    borders = near.where("k = -1").drop("k").repartition(1).sortWithinPartitions("s")
    found = near.where("k > 0").unionByName(borders.mapInPandas(across, schema)).where("n > 0")
    return found.select(
        "k", "n", F.timestamp_micros("s").alias("run_start"), F.timestamp_micros("e").alias("run_end"),
        (floor_div(F.col("e") - F.col("s"), size) + 1).alias("run_len"),
    )


def _closed(changes: pd.DataFrame, size: int, stack: list, *, whole: bool) -> list[tuple]:
    """Stretches that end at one of ``changes``: ``(start, end, n, k)``.

    ``stack`` holds ``[start, n, end of the last such slots]`` with growing n.  Stretches
    without a poorer slot on the left end are given only where the line is ``whole``.
    """
    out = []
    for s, e, n in zip(changes["s"].tolist(), changes["e"].tolist(), changes["n"].tolist(), strict=True):
        left = stack[-1][2] + size if stack else s
        while stack and stack[-1][1] > n:
            left, most, _ = stack.pop()
            if stack or whole:
                out.append((left, s - size, most, max(stack[-1][1] if stack else 0, n) + 1))
        if stack and stack[-1][1] == n:
            stack[-1][2] = e
        else:
            stack.append([left, n, e])
    return out


def positions(df: DataFrame, keys: Sequence[str] = SERIES, order: str = "ts") -> DataFrame:
    """Add ``row`` (0-based rank along time) and ``n`` (rows of the series)."""
    one = F.lit(1).cast("bigint")
    return carry(df, {"_r": ("sum", one), "n": ("total", one)}, keys=keys, order=order).withColumn(
        "row", F.col("_r") - 1
    ).drop("_r")


def time_window(*keys: str) -> Window:
    return Window.partitionBy(*keys, "blk").orderBy("ts")
