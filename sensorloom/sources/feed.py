"""Raw feeds: range query, slots, pollutant names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.blocks import FIVE_MINUTES, HOUR
from sensorloom.operators.grid import floor_slots, regular_grid

# Readings outside [0, 100000) are never valid.
LOWEST, TOO_HIGH = 0, 100_000
HOUR_MS = 3_600_000
# Spellings of one pollutant.
ALIASES = {"PM2.5": "PM25", "PM2_5": "PM25"}
NAME_PATTERN = "^[A-Z][A-Z0-9_]*$"


def observations(
    raw: DataFrame, from_ms: int, to_ms: int, *, entities: Sequence[str] | None = None, hourly: bool = False
) -> DataFrame:
    """Valid readings ``series, ts, value`` between two epoch milliseconds, both
    included.  Hourly form: bounds are cut to the hour and readings averaged."""
    if hourly:
        from_ms, to_ms = (t // HOUR_MS * HOUR_MS for t in (from_ms, to_ms))
    low, high = (F.timestamp_millis(F.lit(int(t))) for t in (from_ms, to_ms))
    rows = raw.where((F.col("ts") >= low) & (F.col("ts") <= high))
    rows = rows.where((F.col("value") >= LOWEST) & (F.col("value") < TOO_HIGH))
    if entities is not None:
        rows = rows.where(F.col("series").isin(*entities))
    if not hourly:
        return rows.select("series", "ts", "value")
    return rows.groupBy("series", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))


def grid_feed(feed: DataFrame, *, hourly: bool = False) -> DataFrame:
    """Feed rows ``series, ms, value`` on a regular grid, first reading per slot."""
    step = HOUR if hourly else FIVE_MINUTES
    timed = feed.withColumn("ts", F.timestamp_millis("ms"))
    return regular_grid(floor_slots(timed, step), step)


def pollutant_names(lists: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Names in a column of comma lists: ``(valid, rejected)`` rows with
    ``pollutant``.  Names are trimmed, put in capitals and mapped by alias."""
    items = F.transform(F.split(column, ","), lambda x: F.upper(F.trim(x)))
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = lists.withColumn("pollutant", F.explode(items)).withColumn(
        "pollutant", F.coalesce(F.try_element_at(aliases, F.col("pollutant")), F.col("pollutant"))
    )
    valid = F.col("pollutant").rlike(NAME_PATTERN)
    return named.where(valid), named.where(~valid)
