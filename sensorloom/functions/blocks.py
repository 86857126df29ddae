"""Ordered computations over series of any length.

A series may hold a third of all rows, so nothing here opens a window over a
whole series.  Rows are laid out by ``(series, blk)`` where ``blk`` numbers
fixed spans of time; ordered work happens inside one block, and what has to
cross a block border travels through a table with one row per block:

* :func:`halo` copies border rows into the neighbouring blocks, for frames of a
  known width,
* :func:`carry` brings in the latest, next or summed value of other blocks,
* :func:`runs` measures runs of equal state that may span many blocks.

``blk`` can be any column that never decreases along the order, so the same
functions serve orders by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("series",)
BLOCK_ROWS = 32768
MICROS = 1_000_000
FIVE_MINUTES = 300
HOUR = 3600
DAY = 86400

START = Window.unboundedPreceding


def micros(ts: Column | str) -> Column:
    return F.unix_micros(ts)


def floor_div(number: Column, size: int) -> Column:
    """Whole-number division rounding down, also for times before 1970."""
    return ((number - F.pmod(number, F.lit(size))) / F.lit(size)).cast("bigint")


def floor_ts(ts: Column | str, step: int) -> Column:
    """``ts`` cut down to a multiple of ``step`` seconds."""
    size = step * MICROS
    return F.timestamp_micros(micros(ts) - F.pmod(micros(ts), F.lit(size)))


def time_block(ts: Column | str, step: int, rows: int = BLOCK_ROWS) -> Column:
    """Number of the time span of ``rows`` grid steps that ``ts`` falls in."""
    return floor_div(micros(ts), step * MICROS * rows)


def in_blocks(
    df: DataFrame, step: int, rows: int = BLOCK_ROWS, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Add ``blk`` and lay the rows out by ``(keys, blk)``: the one big exchange."""
    return df.withColumn("blk", time_block("ts", step, rows)).repartition(*keys, "blk")


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str] = SERIES, blk: str = "blk") -> DataFrame:
    """Join one row of ``stats`` per group to the rows of that group.

    A join on the group would bring all its rows to one task.  So the statistics
    go to the blocks of their group, and rows meet them where they already lie.
    Groups without statistics drop out.
    """
    places = rows.select(*keys, blk).distinct().join(stats, list(keys))
    return rows.join(places, [*keys, blk])


def halo(
    df: DataFrame,
    before: int,
    after: int,
    *,
    step: int,
    rows: int = BLOCK_ROWS,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Copy each row into every block whose frames can reach it.

    ``before`` and ``after`` are frame widths in grid steps.  ``own`` is true on
    the one copy that belongs to the block; the others only feed frames.
    """
    size = step * MICROS * rows
    first = floor_div(micros("ts") - F.lit(after * step * MICROS), size)
    last = floor_div(micros("ts") + F.lit(before * step * MICROS), size)
    home = floor_div(micros("ts"), size)
    spread = df.drop("blk").withColumn("blk", F.explode(F.sequence(first, last)))
    return spread.withColumn("own", home == F.col("blk")).repartition(*keys, "blk")


def expand(df: DataFrame, count: Column, name: str, chunk: int = 10_000) -> DataFrame:
    """One row per number ``0 .. count-1``; long ranges are spread over tasks."""
    pieces = F.sequence(F.lit(0).cast("bigint"), floor_div(count - F.lit(1), chunk))
    coarse = (
        df.withColumn("_count", count.cast("bigint"))
        .where(F.col("_count") > 0)
        .withColumn("_piece", F.explode(pieces))
    )
    spread = coarse.repartition(*df.columns, "_piece")
    low = F.col("_piece") * F.lit(chunk)
    high = F.least(low + F.lit(chunk), F.col("_count")) - F.lit(1)
    return spread.withColumn(name, F.explode(F.sequence(low, high))).drop("_count", "_piece")


def carry(
    df: DataFrame,
    specs: Mapping[str, tuple[str, Column]],
    *,
    order: str | Sequence[str] = "ts",
    keys: Sequence[str] = SERIES,
    blk: str = "blk",
) -> DataFrame:
    """Add ordered columns that look across blocks.

    ``order`` must tell the rows of a group apart.
    ``specs`` maps an output name to ``(kind, expression)``:

    ``last`` / ``before``   latest non-null value up to / strictly before the row
    ``next`` / ``after``    first non-null value from / strictly after the row
    ``sum``                 running sum including the row
    ``max_before``          largest value strictly before the row
    ``total``               sum over the whole series
    """
    by = [order] if isinstance(order, str) else list(order)
    here = Window.partitionBy(*keys, blk).orderBy(*by)
    # Backwards in place of "until the end": such frames start anew on every row.
    back = Window.partitionBy(*keys, blk).orderBy(*[F.col(c).desc() for c in by])
    frames = {
        "last": (START, 0), "before": (START, -1), "next": (START, 0), "after": (START, -1),
        "sum": (START, 0), "max_before": (START, -1),
    }
    local, summary, across, final = {}, [], {}, {}
    earlier = Window.partitionBy(*keys).orderBy(blk).rowsBetween(START, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(blk).desc()).rowsBetween(START, -1)
    whole = Window.partitionBy(*keys)
    work = df.withColumns({f"_x_{name}": expr for name, (_, expr) in specs.items()})
    for name, (kind, _) in specs.items():
        x = F.col(f"_x_{name}")
        held = F.when(x.isNotNull(), F.col(by[0]) if len(by) == 1 else F.struct(*by))
        if kind in ("last", "before"):
            local[name] = F.last(x, ignorenulls=True).over(here.rowsBetween(*frames[kind]))
            summary.append(F.max_by(x, held).alias(f"_b_{name}"))
            across[name] = F.last(f"_b_{name}", ignorenulls=True).over(earlier)
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))
        elif kind in ("next", "after"):
            local[name] = F.last(x, ignorenulls=True).over(back.rowsBetween(*frames[kind]))
            summary.append(F.min_by(x, held).alias(f"_b_{name}"))
            across[name] = F.last(f"_b_{name}", ignorenulls=True).over(later)
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))
        elif kind == "sum":
            local[name] = F.sum(x).over(here.rowsBetween(*frames[kind]))
            summary.append(F.sum(x).alias(f"_b_{name}"))
            across[name] = F.sum(f"_b_{name}").over(earlier)
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(
                F.col(f"_c_{name}"), F.lit(0)
            )
        elif kind == "max_before":
            local[name] = F.max(x).over(here.rowsBetween(*frames[kind]))
            summary.append(F.max(x).alias(f"_b_{name}"))
            across[name] = F.max(f"_b_{name}").over(earlier)
            final[name] = F.greatest(F.col(f"_l_{name}"), F.col(f"_c_{name}"))
        elif kind == "total":
            local[name] = F.lit(None)
            summary.append(F.sum(x).alias(f"_b_{name}"))
            across[name] = F.sum(f"_b_{name}").over(whole)
            final[name] = F.col(f"_c_{name}")
        else:
            raise ValueError(f"unknown carry kind {kind!r}")
    per_block = (
        work.groupBy(*keys, blk)
        .agg(*summary)
        .select(*keys, blk, *[column.alias(f"_c_{name}") for name, column in across.items()])
    )
    rows = work.withColumns({f"_l_{name}": column for name, column in local.items()})
    joined = rows.join(per_block, [*keys, blk])
    kept = [c for c in df.columns if c not in specs]
    return joined.select(*kept, *[column.alias(name) for name, column in final.items()])


def runs(
    df: DataFrame,
    state: Column,
    *,
    order: str = "ts",
    keys: Sequence[str] = SERIES,
    blk: str = "blk",
) -> DataFrame:
    """Add ``run_start``, ``run_end`` and ``run_len`` of the run each row is in.

    A run is a maximal stretch of neighbouring rows with equal ``state``.  Runs
    are measured inside each block; the block table then joins a block's last
    run with the first run of the next one where the state goes on.
    """
    here = Window.partitionBy(*keys, blk).orderBy(order)
    back = Window.partitionBy(*keys, blk).orderBy(F.col(order).desc())
    near = df.withColumn("_state", state).withColumns(
        {"_r": F.row_number().over(here), "_before": F.lag("_state").over(here), "_o": F.lag(order).over(here)}
    )
    starts = (F.col("_r") == 1) | ~F.col("_before").eqNullSafe(F.col("_state"))
    near = near.withColumn("_starts", starts).drop("_before")

    # What a block shows its neighbours: its first and its last run.
    second = F.col("_starts") & (F.col("_r") > 1)
    ends = F.min(F.when(second, F.col("_r")))
    blocks = near.groupBy(*keys, blk).agg(
        F.min(order).alias("lo"),
        F.max(order).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("_state", order).alias("first_state"),
        F.max_by("_state", order).alias("last_state"),
        F.coalesce(ends - 1, F.count(F.lit(1))).cast("bigint").alias("head_n"),
        F.coalesce(F.min_by("_o", F.when(second, F.col("_r"))), F.max(order)).alias("head_e"),
        F.max(F.when(F.col("_starts"), F.col(order))).alias("tail_s"),
        (F.count(F.lit(1)) - F.max(F.when(F.col("_starts"), F.col("_r"))) + 1).alias("tail_n"),
    )

    # Row numbers at both ends give the length; a window per run would be many
    # tiny ones.
    stops = F.coalesce(F.lead("_starts").over(here), F.lit(True))
    work = near.withColumn("_stops", stops)
    upto, onward = here.rowsBetween(START, 0), back.rowsBetween(START, 0)
    work = work.withColumns(
        {"_s": F.last(F.when(F.col("_starts"), F.col(order)), ignorenulls=True).over(upto),
         "_sr": F.last(F.when(F.col("_starts"), F.col("_r")), ignorenulls=True).over(upto),
         "_e": F.last(F.when(F.col("_stops"), F.col(order)), ignorenulls=True).over(onward),
         "_er": F.last(F.when(F.col("_stops"), F.col("_r")), ignorenulls=True).over(onward)}
    ).withColumn("_n", (F.col("_er") - F.col("_sr") + 1).cast("bigint"))

    line = Window.partitionBy(*keys).orderBy(blk)
    prior = F.lag("last_state").over(line)
    first_block = F.row_number().over(line) == 1
    blocks = blocks.withColumns(
        {"goes_on": ~first_block & prior.eqNullSafe(F.col("first_state")),
         "single": F.col("tail_s") == F.col("lo")}
    )
    # ``opens``: block in which the run reaching this block's end has begun.
    through = F.col("goes_on") & F.col("single")
    blocks = blocks.withColumn(
        "opens", F.last(F.when(~through, F.col(blk)), ignorenulls=True).over(line.rowsBetween(START, 0))
    )
    closing = F.lead(F.col("goes_on") & ~F.col("single")).over(line)
    blocks = blocks.withColumns(
        {"close_n": F.when(closing, F.lead("head_n").over(line)),
         "close_e": F.when(closing, F.lead("head_e").over(line))}
    )
    group = Window.partitionBy(*keys, "opens")
    own = F.col("opens") == F.col(blk)
    blocks = blocks.withColumns(
        {"t_start": F.min(F.when(own, F.col("tail_s"))).over(group),
         "t_end": F.max(F.coalesce("close_e", "hi")).over(group),
         "t_len": F.sum(F.when(own, F.col("tail_n")).otherwise(F.col("n"))).over(group)
         + F.coalesce(F.max("close_n").over(group), F.lit(0))}
    )
    blocks = blocks.select(
        *keys, blk, "lo", "tail_s", "t_start", "t_end", "t_len", "goes_on",
        F.lag("t_start").over(line).alias("h_start"),
        F.lag("t_end").over(line).alias("h_end"),
        F.lag("t_len").over(line).alias("h_len"),
    )
    at_tail = F.col("_s") == F.col("tail_s")
    at_head = F.col("goes_on") & (F.col("_s") == F.col("lo"))

    def pick(tail: str, head: str, mine: str) -> Column:
        return F.when(at_tail, F.col(tail)).when(at_head, F.col(head)).otherwise(F.col(mine))

    joined = work.join(blocks, [*keys, blk])
    return joined.select(
        *df.columns,
        pick("t_start", "h_start", "_s").alias("run_start"),
        pick("t_end", "h_end", "_e").alias("run_end"),
        pick("t_len", "h_len", "_n").alias("run_len"),
    )


def run_table(df: DataFrame, *, keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per run from the output of :func:`runs`."""
    return df.groupBy(*keys, "run_start").agg(
        F.first("run_end").alias("run_end"), F.first("run_len").alias("run_len")
    )
