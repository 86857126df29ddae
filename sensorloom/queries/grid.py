"""Queries G1 to G13: grids, hours, runs, segments, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY, FIVE_MINUTES, HOUR, attach, floor_ts
from sensorloom.operators import grid
from sensorloom.queries import views as V
from sensorloom.queries.registry import query


_HALF_SLOT = 150


@query(
    "G1_regular_grid",
    f"""WITH raw AS (SELECT event_type AS series, {V.floor_sql('ts', _HALF_SLOT)} AS ts, value, event_id FROM events),
    latest AS (SELECT series, ts, arg_max(value, event_id) AS value FROM raw GROUP BY 1, 2),
    placed AS ({V.grid_sql('latest', '5 MINUTE')}) SELECT series, pos, ts, round(value, 6) AS value FROM placed""",
)
def g1(spark, sf):
    # Times cut to half a slot: some readings share one, and every second one is off the grid.
    raw = V.obs(spark, sf).withColumn("ts", floor_ts("ts", _HALF_SLOT))
    return grid.regular_grid(raw, FIVE_MINUTES).select("series", "pos", "ts", "value")


@query(
    "G2_series_collection",
    """SELECT 'l_quantity' AS series, l_shipdate AS ts, round(l_quantity, 6) AS value FROM lineitem
    UNION ALL SELECT 'l_discount', l_shipdate, round(l_discount, 6) FROM lineitem
    UNION ALL SELECT 'total_0', o_orderdate, round(o_totalprice, 6) FROM orders""",
)
def g2(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("t"), "l_quantity", "l_discount")
    totals = V.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("value"))
    return grid.to_long(lines, ["l_quantity", "l_discount"], ts="t").unionByName(
        grid.collect_series([totals], "total")
    )


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "G3_outer_alignment",
    V.DAILY
    + """, span AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM daily)
    SELECT s.ts, count(d.value) AS n_observed, """
    + ", ".join(f"""round(max(CASE WHEN d.series = '{p}' THEN d.value END), 6) AS "{p}\"""" for p in _PRIORITIES)
    + " FROM span s LEFT JOIN daily d ON d.ts = s.ts GROUP BY s.ts",
)
def g3(spark, sf):
    return grid.align_wide(V.daily(spark, sf), _PRIORITIES, DAY)


_COARSE = "coarse AS (SELECT series, pos, ts, floor(value / 50) AS value FROM grid5)"


@query(
    "G4_frozen_runs",
    f"WITH {V.OBS}, {V.SLOTS}, {V.GRID5}, {_COARSE}, {V.frozen_sql('coarse')} SELECT series, ts, value, frozen FROM frozen",
)
def g4(spark, sf):
    coarse = V.grid5(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return grid.frozen_runs(coarse).select("series", "ts", "value", "frozen")


@query("G5_hourly_useful_mean", V.HOURLY + " SELECT series, ts, round(value, 6) AS value FROM hourly")
def g5(spark, sf):
    return V.hourly(spark, sf).select("series", "ts", "value")


_STEPPED = "stepped AS (SELECT series, ts, floor(value / 10) AS value FROM hourly)"


@query(
    "G6_hourly_repeats",
    V.HOURLY
    + f""", {_STEPPED}, marked AS (SELECT series, ts, value,
      coalesce(lag(value) OVER (PARTITION BY series ORDER BY ts) = value, false) AS rep FROM stepped)
    SELECT m.series, m.ts, m.value, c.n_repeats FROM marked m
    JOIN (SELECT series, count(*) FILTER (rep) AS n_repeats FROM marked GROUP BY 1) c ON c.series = m.series
    WHERE NOT m.rep""",
)
def g6(spark, sf):
    stepped = V.hourly(spark, sf).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    kept, counts = grid.drop_repeats(stepped)
    return attach(kept, counts).select("series", "ts", "value", "n_repeats")


def hourly_blocks(spark, sf):
    return V.hourly(spark, sf)


@query(
    "G7_observed_segments",
    V.HOURLY + f", {V.segments_sql('hourly')} SELECT DISTINCT series, segment, segment_end, segment_len FROM segments WHERE segment_len >= 3",
)
def g7(spark, sf):
    return grid.segment_table(hourly_blocks(spark, sf), 3)


@query(
    "G8_longest_run",
    V.HOURLY
    + f""", {V.segments_sql('hourly')} SELECT series, run_start, run_end, run_len FROM (
      SELECT DISTINCT series, segment AS run_start, segment_end AS run_end, segment_len AS run_len,
             dense_rank() OVER (PARTITION BY series ORDER BY segment_len DESC, segment) AS r FROM segments) WHERE r = 1""",
)
def g8(spark, sf):
    return grid.longest_run(hourly_blocks(spark, sf))


_BEST = (
    V.DAILY
    + """, counts AS (SELECT s.ts, count(d.value) AS n FROM
      (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM daily) s
      LEFT JOIN daily d ON d.ts = s.ts GROUP BY s.ts),
    levels AS (SELECT k, ts FROM counts, (SELECT unnest(generate_series(1, 5)) AS k) WHERE n >= k),
    spans AS (SELECT k, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_len FROM (
      SELECT k, ts, ts - row_number() OVER (PARTITION BY k ORDER BY ts) * INTERVAL 1 DAY AS g FROM levels) GROUP BY k, g),
    members AS (SELECT p.k, p.run_start, p.run_end, p.run_len, d.series FROM spans p
      JOIN daily d ON d.ts BETWEEN p.run_start AND p.run_end GROUP BY p.k, p.run_start, p.run_end, p.run_len, d.series HAVING count(*) = p.run_len),
    scored AS (SELECT k, run_start, run_end, run_len, count(*) AS n_series,
      pow(count(*), 0.6) * pow(run_len, 0.4) AS score FROM members GROUP BY k, run_start, run_end, run_len),
    best AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, k, run_start LIMIT 1)"""
)


@query(
    "G9_best_block",
    _BEST
    + """ SELECT m.series, b.run_start, b.run_end, b.run_len, b.n_series, round(b.score, 6) AS score
    FROM best b JOIN members m ON m.k = b.k AND m.run_start = b.run_start""",
)
def g9(spark, sf):
    return grid.best_block(V.daily(spark, sf), DAY)


_GAPS = """gaps AS (SELECT series, min(ts) AS start_ts, count(*) AS len FROM (
      SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts)
           - row_number() OVER (PARTITION BY series, value IS NULL ORDER BY ts) AS island FROM hourly)
      WHERE value IS NULL GROUP BY series, island)"""


@query("G10_gap_windows", V.HOURLY + f", {_GAPS} SELECT series, start_ts, len FROM gaps")
def g10(spark, sf):
    return grid.gap_windows(hourly_blocks(spark, sf))


@query(
    "G11_mask_times",
    V.HOURLY
    + f""", {_GAPS}, twice AS (SELECT series, start_ts, len + 1 AS len FROM gaps)
    SELECT DISTINCT series, start_ts + i * INTERVAL 1 HOUR AS ts FROM (
      SELECT series, start_ts, unnest(range(0, len)) AS i FROM twice)""",
)
def g11(spark, sf):
    # One hour more than each gap, so that some windows touch.
    gaps = grid.gap_windows(hourly_blocks(spark, sf)).withColumn("len", F.col("len") + 1)
    return grid.mask_times(gaps, HOUR)
