"""Input views of the queries, in Spark and in SQL.

``obs``    readings of ``events``, one series per event type
``slots``  the same, first reading of every 5-minute slot
``grid5``  slots on the regular 5-minute grid
``hourly`` trustworthy hourly means
``daily``  daily order totals per priority
``ship``   daily mean line price per return flag

Prices are turned from marks into thousands of euros at the fixed rate, and
micrograms into parts per billion where a query needs values without a short
decimal form, which two engines could round to different sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY, FIVE_MINUTES
from sensorloom.operators import grid

# Marks per thousand euros; ppb of NO2 per microgram at 25 degrees.
RATE = 1955.83
PPB = 24.45 / 46.0055

LIMIT = grid.DETECTION_LIMITS["NO2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id"
    )


def slots(spark, sf_dir) -> DataFrame:
    return grid.floor_slots(obs(spark, sf_dir), FIVE_MINUTES)


def grid5(spark, sf_dir) -> DataFrame:
    return grid.regular_grid(slots(spark, sf_dir), FIVE_MINUTES)


def hourly(spark, sf_dir, min_useful: int = grid.MIN_USEFUL) -> DataFrame:
    return grid.hourly_mean(slots(spark, sf_dir), LIMIT, min_useful=min_useful)


def hourly_ppb(spark, sf_dir) -> DataFrame:
    return hourly(spark, sf_dir).withColumn("value", F.col("value") * F.lit(PPB))


def daily(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("timestamp").alias("ts"))
        .agg((F.sum("o_totalprice") / RATE).alias("value"))
    )


def daily_grid(spark, sf_dir) -> DataFrame:
    return grid.regular_grid(daily(spark, sf_dir), DAY)


def ship(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("timestamp").alias("ts"))
        .agg((F.avg("l_extendedprice") / RATE).alias("value"))
    )


def ship_grid(spark, sf_dir) -> DataFrame:
    return grid.regular_grid(ship(spark, sf_dir), DAY)


def floor_sql(ts: str, seconds: int) -> str:
    size = seconds * 1_000_000
    return f"make_timestamp(epoch_us({ts}) // {size} * {size})"


def grid_sql(source: str, interval: str) -> str:
    return f"""SELECT g.series, g.pos, g.ts, s.value FROM (
      SELECT series, i AS pos, first_ts + i * INTERVAL {interval} AS ts FROM (
        SELECT series, first_ts, unnest(range(0, n)) AS i FROM (
          SELECT series, min(ts) AS first_ts,
                 (epoch_us(max(ts)) - epoch_us(min(ts))) // epoch_us(TIMESTAMP '1970-01-01' + INTERVAL {interval}) + 1 AS n
          FROM {source} GROUP BY series))) g
      LEFT JOIN {source} s ON s.series = g.series AND s.ts = g.ts"""


OBS = "obs AS (SELECT event_type AS series, ts, value, event_id FROM events)"
SLOTS = f"""slots AS (SELECT series, slot AS ts, value FROM (
  SELECT series, {floor_sql('ts', FIVE_MINUTES)} AS slot, value,
         row_number() OVER (PARTITION BY series, {floor_sql('ts', FIVE_MINUTES)} ORDER BY ts, event_id) AS rn
  FROM obs) WHERE rn = 1)"""
GRID5 = f"grid5 AS ({grid_sql('slots', '5 MINUTE')})"


def frozen_sql(source: str, min_run: int = 6) -> str:
    return f"""frozen AS (
  SELECT g.series, g.pos, g.ts, g.value, coalesce(f.run_len >= {min_run}, false) AS frozen FROM {source} g
  LEFT JOIN (
    SELECT series, ts, count(*) OVER (PARTITION BY series, run) AS run_len FROM (
      SELECT series, ts, sum(brk) OVER (PARTITION BY series ORDER BY ts) AS run FROM (
        SELECT series, ts, CASE WHEN lag(value) OVER (PARTITION BY series ORDER BY ts) = value THEN 0 ELSE 1 END AS brk
        FROM {source} WHERE value IS NOT NULL))) f
  ON f.series = g.series AND f.ts = g.ts)"""


def hourly_sql(min_useful: int = 3) -> str:
    return f"""hourly AS (
  SELECT series, {floor_sql('ts', 3600)} AS ts,
         CASE WHEN count(CASE WHEN v >= {LIMIT} THEN 1 END) >= {min_useful}
              THEN avg(CASE WHEN v >= {LIMIT} THEN v END) END AS value
  FROM (SELECT series, ts, CASE WHEN frozen THEN 0.0 ELSE value END AS v FROM frozen)
  GROUP BY 1, 2)"""


def segments_sql(source: str, name: str = "segments") -> str:
    """Observed stretches: rows with segment (first ts), its length and position."""
    return f"""{name} AS (
  SELECT series, ts, value, min(ts) OVER w AS segment, max(ts) OVER w AS segment_end, count(*) OVER w AS segment_len FROM (
    SELECT series, ts, value,
           row_number() OVER (PARTITION BY series ORDER BY ts)
         - row_number() OVER (PARTITION BY series, value IS NULL ORDER BY ts) AS island
    FROM {source}) WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY series, island))"""


HOURLY = f"WITH {OBS}, {SLOTS}, {GRID5}, {frozen_sql('grid5')}, {hourly_sql()}"
HOURLY_PPB = HOURLY + f", ppb AS (SELECT series, ts, value * CAST('{PPB!r}' AS DOUBLE) AS value FROM hourly)"
DAILY = f"""WITH daily AS (SELECT o_orderpriority AS series, o_orderdate AS ts, sum(o_totalprice) / {RATE} AS value
  FROM orders GROUP BY 1, 2), daily_grid AS ({grid_sql('daily', '1 DAY')})"""
SHIP = f"""WITH ship AS (SELECT l_returnflag AS series, l_shipdate AS ts, avg(l_extendedprice) / {RATE} AS value
  FROM lineitem GROUP BY 1, 2), ship_grid AS ({grid_sql('ship', '1 DAY')})"""
