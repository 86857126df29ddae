"""Exact grouped statistics that do not gather a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import cut

# Values one task sorts at most, edges of one pass, accuracy of the sketch they come from.
INNER, EDGES, ACCURACY = 50_000, 256, 10_000
# Rows of statistics that are sent to all tasks; larger tables are joined by a shuffle.
FEW = 100_000
# Rows of a rank block, and blocks of a table of some thousand rows.
BLOCK, BLOCKS = 32_768, 64


def finite(value: Column) -> Column:
    """True on numbers; false on null, NaN and infinities."""
    huge = F.lit(float("inf"))
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < huge)


def beside(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], *, count: int | None = None, few: int = FEW, how: str = "inner"
) -> DataFrame:
    """Join one row of ``stats`` per group to the rows, wherever these lie.

    ``stats`` are counted (written first, unless ``count`` says how many there are).
    Up to ``few`` are sent to the rows; more are joined by a shuffle, where the
    skew join splits hot groups.
    """
    if count is None:
        stats = cut(stats)
        count = stats.count()
    return rows.join(F.broadcast(stats) if count <= few else stats, list(keys), how)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float], *, ready: bool = False
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, plus the count ``n``.

    Every quantile has a range of values its two ranks lie in, at first all of its
    group.  While a range holds more values than a task should sort, a pass cuts
    it at the edges of a sketch, counts the values at and between the edges, and goes
    on with the cells of the two ranks.  The counts are exact, so the sketch only
    decides how fast ranges shrink.  In the end the values of a range are counted
    one by one and the ranks read off.

    The rows are read several times, so they are written once first; ``ready`` says
    that they already lie in a table or follow cheaply from one.
    """
    keys = list(keys)
    rows = df.where(value.isNotNull()).select(*keys, value.cast("double").alias("_v"))
    rows = rows if ready else cut(rows)
    return _selected(rows, keys, probs)[0]


def _selected(
    rows: DataFrame, keys: list[str], probs: Mapping[str, float], known: tuple[int, int] | None = None
) -> tuple[DataFrame, tuple[int, int]]:
    """The quantiles of ``rows (keys, _v)``, and the values of the largest range and the number of ranges at first.

    ``known`` are these two from other values of the same rows.
    """
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("_q"), F.lit(float(p)).alias("_p")) for q, p in probs.items()]))
    rank = F.col("_a._p") * (F.col("_n") - 1)
    state = groups.withColumn("_a", asked).select(
        *keys, "_a._q", "_n", F.floor(rank).alias("_k"), (rank - F.floor(rank)).alias("_part"),
        "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_inner"),
    )

    def widest() -> tuple[int, int]:
        most, count = state.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_inner"))), F.count(F.lit(1))).first()
        return most or 0, count

    # Values no more than this lie in any range; where that is known to be few, nothing is counted.
    begun = most, count = known if known is not None and known[0] <= INNER else widest()
    while most > INNER:
        state = cut(_narrowed(rows, state, keys, count))
        most, _ = widest()

    last = F.least(F.col("_k") + 1, F.col("_n") - 1)
    ranges = state.groupBy(*keys, "_lo", "_hi").agg(F.first("_below").alias("_below"))
    near = beside(rows, ranges, keys, count=count).where("_v between _lo and _hi")
    counted = near.groupBy(*keys, "_lo", "_hi", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    line = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")
    upto = F.col("_below") + F.sum("_c").over(line)
    ranked = counted.select(*keys, "_lo", "_hi", "_v", (upto - F.col("_c")).alias("_from"), upto.alias("_to"))
    held = ranked.join(state.drop("_below", "_inner"), [*keys, "_lo", "_hi"]).where((F.col("_to") > F.col("_k")) & (F.col("_from") <= last))
    at = lambda q, rank: F.max(F.when((F.col("_q") == q) & (F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
    found = held.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(q, F.col("_k")).alias(f"_lo_{q}") for q in probs],
        *[at(q, last).alias(f"_hi_{q}") for q in probs],
        *[F.max(F.when(F.col("_q") == q, F.col("_part"))).alias(f"_part_{q}") for q in probs],
    )
    between = lambda q: F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_part_{q}")
    # Equal neighbours need no sum: it would make infinities undefined.
    exact = lambda q: F.when(F.col(f"_lo_{q}") == F.col(f"_hi_{q}"), F.col(f"_lo_{q}")).otherwise(between(q))
    return found.select(*keys, F.col("_n").alias("n"), *[exact(q).alias(q) for q in probs]), begun


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Ranges of ``state`` with too many values cut down to the cells of their ranks."""
    wide = (F.col("_inner") > INNER) & (F.col("_lo") < F.col("_hi"))
    todo, group = state.where(wide), [*keys, "_q"]
    ends = todo.select(*group, "_lo", "_hi")
    near = beside(rows, ends, keys, count=count)
    grid = [i / EDGES for i in range(1, EDGES)]
    # Of the values inside alone: a frequent end cannot take all edges.
    inside = near.where("_v > _lo and _v < _hi").groupBy(*group).agg(F.percentile_approx("_v", grid, ACCURACY).alias("_e"))
    edges = F.array_distinct(F.concat(F.array("_lo"), F.coalesce("_e", F.array().cast("array<double>")), F.array("_hi")))
    cutters = cut(ends.join(inside, group, "left").withColumn("_e", edges))
    # A row of edges is some kilobytes.
    cells = beside(rows, cutters, keys, count=count, few=FEW // EDGES).where("_v between _lo and _hi").withColumn("_at", F.lit(0))
    step = EDGES
    while step:
        # The number of edges below the value, by halving.
        ahead = F.get("_e", F.col("_at") + (step - 1)) < F.col("_v")
        cells, step = cells.withColumn("_at", F.when(ahead, F.col("_at") + step).otherwise(F.col("_at"))), step // 2
    on_edge = F.coalesce(F.get("_e", F.col("_at")) == F.col("_v"), F.lit(False))
    counted = cells.groupBy(*group, (F.col("_at") * 2 + on_edge.cast("int")).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    line = Window.partitionBy(*group).orderBy("_cell")
    upto = F.col("_below") + F.sum("_c").over(line)
    placed = counted.join(todo, group).withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    last = F.least(F.col("_k") + 1, F.col("_n") - 1)
    holds = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_to"))
    # Cells between edges count; a single value is one value however often it occurs.
    open_cell = (holds(F.col("_k")) | holds(last)) & (F.col("_cell") % 2 == 0)
    cutdown = placed.groupBy(*group, "_n", "_k", "_part").agg(
        F.max(F.when(holds(F.col("_k")), F.col("_least"))).alias("_lo"),
        F.max(F.when(holds(last), F.col("_most"))).alias("_hi"),
        F.max(F.when(holds(F.col("_k")), F.col("_from"))).alias("_below"),
        F.coalesce(F.sum(F.when(open_cell, F.col("_c"))), F.lit(0)).alias("_inner"),
    )
    return state.where(~wide).unionByName(cutdown.select(*state.columns))


def median(
    df: DataFrame, keys: Sequence[str], value: Column, name: str = "median", *, ready: bool = False
) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, ready=ready).select(*keys, name)


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str, *, ready: bool = False) -> DataFrame:
    """``(keys, median, mad)`` with the raw median absolute deviation."""
    return counted_median_and_mad(df, keys, value, ready=ready)[0]


def counted_median_and_mad(
    df: DataFrame, keys: Sequence[str], value: str, *, ready: bool = False
) -> tuple[DataFrame, int]:
    """As :func:`median_and_mad`, and the number of groups."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows if ready else cut(rows)
    found, (most, count) = _selected(rows, keys, {"median": 0.5})
    centre = cut(found.select(*keys, "median"))
    off = beside(rows, centre, keys, count=count).select(*keys, F.abs(F.col("_v") - F.col("median")).alias("_v"))
    spread, _ = _selected(off, keys, {"mad": 0.5}, (most, count))
    return centre.join(spread.select(*keys, "mad"), keys), count


def rank_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, block: int = BLOCK) -> DataFrame:
    """Add ``blk``: stretches of about equally many rows along ``keys`` and ``order``.

    The stretches are cut at ranks, estimated from samples of all partitions, so a
    far value widens one of them and crowds none.  ``order`` must tell the rows of a
    group apart; then no row, however frequent what it stands for, outgrows a block.
    Where the cuts fall changes no result of :func:`~sensorloom.functions.blocks.carry`.
    """
    rows = cut(rows)
    count = rows.count()
    blocks = max(1, -(-count // block), min(BLOCKS, count // (block // 32)))
    if blocks == 1:
        return rows.withColumn("blk", F.lit(0).cast("bigint"))
    # Written at once: from then on the numbers are a column like any other.
    laid = rows.repartitionByRange(blocks, *keys, *order)
    return cut(laid.withColumn("blk", F.spark_partition_id().cast("bigint")))
