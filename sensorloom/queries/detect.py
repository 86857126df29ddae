"""Queries D1 to D11 and W1 to W6, G12 and G13: scores and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY, attach
from sensorloom.functions.stats import beside
from sensorloom.operators import detect, grid, nearest, windows
from sensorloom.queries import views as V
from sensorloom.queries.registry import query


def observed(spark, sf):
    return V.hourly(spark, sf).where(F.col("value").isNotNull())


def daily_segments(spark, sf, min_len=8):
    return grid.observed_segments(V.daily_grid(spark, sf), min_len).select("series", "segment", "blk", "ts", "value")


def ship_run(spark, sf):
    """Longest observed run of each daily shipping series."""
    rows = V.ship_grid(spark, sf)
    best = grid.longest_run(rows)
    return attach(rows, best).where("ts between run_start and run_end").select(
        "series", F.col("run_start").alias("segment"), "blk", "ts", "value"
    )


def ship_stretches(spark, sf):
    """All observed stretches of the daily shipping series, one row at least."""
    return grid.observed_segments(V.ship_grid(spark, sf)).select("series", "segment", "blk", "ts", "value")


OBSERVED = V.HOURLY + ", obsd AS (SELECT series, ts, value FROM hourly WHERE value IS NOT NULL)"
SEGMENTS = V.DAILY + f", {V.segments_sql('daily_grid')}, seg AS (SELECT series, segment, ts, value FROM segments WHERE segment_len >= 8)"
RUN = V.SHIP + f""", {V.segments_sql('ship_grid')}, run AS (
  SELECT series, segment, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos FROM (
    SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY segment_len DESC, segment) AS r FROM segments) WHERE r = 1)"""

STRETCHES = V.SHIP + f""", {V.segments_sql('ship_grid')}, run AS (
  SELECT series, segment, ts, value, row_number() OVER (PARTITION BY series, segment ORDER BY ts) - 1 AS pos, segment_len FROM segments)"""


def z_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"s.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, s.ts,
      0.6745 * abs(s.value - m.median) / greatest(d.mad, 1e-6) AS score FROM {source} s
      JOIN (SELECT {keys}, quantile_cont(value, 0.5) AS median FROM {source} GROUP BY {keys}) m ON {on}
      JOIN (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, quantile_cont(abs(s.value - m.median), 0.5) AS mad
            FROM {source} s JOIN (SELECT {keys}, quantile_cont(value, 0.5) AS median FROM {source} GROUP BY {keys}) m ON {on}
            GROUP BY {', '.join('s.' + k.strip() for k in keys.split(','))}) d ON {on.replace('m.', 'd.')}"""


def iqr_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"s.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, s.ts,
      greatest(q1 - 1.5 * iqr - value, value - q3 - 1.5 * iqr, 0) / iqr AS score FROM {source} s
      JOIN (SELECT {keys}, q1, q3, greatest(q3 - q1, 1e-6) AS iqr FROM (
        SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY {keys})) m ON {on}"""


def hampel_sql(source: str, keys: str, width: int) -> str:
    left, right = width // 2, width - 1 - width // 2
    return f"""SELECT {keys}, ts, abs(value - med) / greatest(1.4826 * list_aggregate(
        list_transform(near, lambda x: abs(x - med)), 'median'), 1e-6) AS score
      FROM (SELECT {keys}, ts, value, near, list_aggregate(near, 'median') AS med FROM (
        SELECT {keys}, ts, value, list(value) OVER (PARTITION BY {keys} ORDER BY ts
          ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) AS near FROM {source}))"""


@query("D1_modified_zscore", OBSERVED + f" SELECT series, ts, round(score, 6) AS score FROM ({z_sql('obsd', 'series')})")
def d1(spark, sf):
    return detect.modified_z(observed(spark, sf))


@query("D2_iqr_fence", OBSERVED + f" SELECT series, ts, round(score, 6) AS score FROM ({iqr_sql('obsd', 'series')})")
def d2(spark, sf):
    return detect.iqr_fence(observed(spark, sf))


@query(
    "D3_hampel_24",
    STRETCHES + f" SELECT series, ts, round(score, 6) AS score FROM ({hampel_sql('run', 'series, segment', 24)})",
)
def d3(spark, sf):
    return detect.hampel(ship_stretches(spark, sf), keys=windows.SEGMENT, step=DAY).drop("segment")


@query(
    "D4_hampel_6",
    SEGMENTS + f" SELECT series, segment, ts, round(score, 6) AS score FROM ({hampel_sql('seg', 'series, segment', 6)})",
)
def d4(spark, sf):
    return detect.hampel6(daily_segments(spark, sf), keys=windows.SEGMENT, step=DAY)


@query("D5_isolation_forest")
def d5(spark, sf):
    return detect.isolation_forest(observed(spark, sf))


_LOF = """, v AS (SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY value, ts) AS id,
      count(*) OVER (PARTITION BY series) AS n FROM (SELECT series, ts, round(value, 6) AS value FROM obsd)),
    near AS (SELECT a.series, a.id, b.id AS other, abs(a.value - b.value) AS d,
      row_number() OVER (PARTITION BY a.series, a.id ORDER BY abs(a.value - b.value), b.id) AS r, a.n
      FROM v a JOIN v b ON a.series = b.series AND a.id <> b.id AND abs(a.id - b.id) <= 60),
    knn AS (SELECT * FROM near WHERE r <= least(50, n - 1)),
    kd AS (SELECT series, id, max(d) AS kdist FROM knn GROUP BY 1, 2),
    lrd AS (SELECT k.series, k.id, 1 / (avg(greatest(k.d, o.kdist)) + 1e-10) AS lrd FROM knn k
      JOIN kd o ON o.series = k.series AND o.id = k.other GROUP BY 1, 2)
    SELECT v.series, v.ts, round(f.score, 6) AS score FROM v JOIN (
      SELECT k.series, k.id, avg(o.lrd) / any_value(m.lrd) AS score FROM knn k
      JOIN lrd o ON o.series = k.series AND o.id = k.other JOIN lrd m ON m.series = k.series AND m.id = k.id
      GROUP BY 1, 2) f ON f.series = v.series AND f.id = v.id"""


@query("D6_local_outlier_factor", OBSERVED + _LOF)
def d6(spark, sf):
    return detect.local_outlier_factor(observed(spark, sf).withColumn("value", F.round("value", 6)))


@query("D7_window_pca")
def d7(spark, sf):
    return windows.pca(ship_stretches(spark, sf), step=DAY, window=100)


@query(
    "D10_threshold_predict",
    OBSERVED + f" SELECT series, ts, round(score, 6) AS score, CASE WHEN score >= 2.5 THEN 1 ELSE 0 END AS label FROM ({z_sql('obsd', 'series')})",
)
def d10(spark, sf):
    return detect.predict(detect.modified_z(observed(spark, sf)), 2.5)


_W = 24


@query(
    "G12_window_table",
    STRETCHES
    + f""" SELECT series, segment, pos AS start_pos, ts, round(w[1], 6) AS first, round(w[{_W}], 6) AS last,
      round(list_aggregate(w, 'sum'), 6) AS total, len(w) AS size FROM (
      SELECT series, segment, pos, ts, list(value) OVER (PARTITION BY series, segment ORDER BY ts ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING) AS w
      FROM run) WHERE len(w) = {_W} AND pos % 5 = 0""",
)
def g12(spark, sf):
    table = windows.window_table(ship_stretches(spark, sf), _W, stride=5, step=DAY)
    return table.select(
        "series", "segment", "start_pos", "ts", F.get("w", F.lit(0)).alias("first"), F.get("w", F.lit(_W - 1)).alias("last"),
        F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("w").cast("bigint").alias("size"),
    )


@query(
    "G13_window_cap",
    RUN
    + f""", w AS (SELECT series, pos AS start_pos, count(*) OVER (PARTITION BY series) AS n_windows FROM (
        SELECT series, pos, max(pos) OVER (PARTITION BY series) AS top FROM run) WHERE pos <= top - {_W - 1}),
      s AS (SELECT *, ceil(n_windows / 512.0)::BIGINT AS stride FROM w),
      t AS (SELECT series, start_pos, stride, row_number() OVER (PARTITION BY series ORDER BY
        ('0x' || substr(md5(concat_ws('|', '13', 'window', series, start_pos)), 1, 13))::BIGINT, start_pos) AS k
        FROM s WHERE start_pos % stride = 0)
      SELECT series, start_pos, stride FROM t WHERE k <= 300""",
)
def g13(spark, sf):
    table = windows.window_table(ship_run(spark, sf), _W, step=DAY).select("series", "start_pos")
    sizes = table.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    strided = beside(table, sizes, ["series"]).withColumn("stride", windows.capped_stride(F.col("n"), 512))
    kept = strided.where("start_pos % stride = 0").drop("n")
    return windows.sample_windows(kept, 300, 13, order="start_pos")


def _scored_rows(spark, sf):
    """The value of the first row as window score, for starts of full windows."""
    rows = ship_stretches(spark, sf)
    starts = windows.window_table(rows, _W, step=DAY).select("series", "segment", "ts", F.get("w", F.lit(0)).alias("score"))
    return rows.select("series", "segment", "ts").join(starts, ["series", "segment", "ts"], "left")


_STARTS = f", st AS (SELECT series, segment, ts, pos, CASE WHEN pos <= segment_len - {_W} THEN value END AS score FROM run)"


@query(
    "W1_fold_windows",
    STRETCHES + _STARTS + f""" SELECT series, ts, round(coalesce(avg(score) OVER (PARTITION BY series, segment ORDER BY ts
      ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW), 0), 6) AS score FROM st""",
)
def w1(spark, sf):
    return windows.fold_windows(_scored_rows(spark, sf), _W, step=DAY).drop("segment")


@query(
    "W2_fold_tails",
    STRETCHES + _STARTS + f""" SELECT series, ts, round(coalesce(avg(score) OVER (PARTITION BY series, segment ORDER BY ts
      ROWS BETWEEN {_W - 1} PRECEDING AND {_W - 5} PRECEDING), 0), 6) AS score FROM st""",
)
def w2(spark, sf):
    return windows.fold_tails(_scored_rows(spark, sf), _W, 5, step=DAY).drop("segment")


@query(
    "W3_nearest_and_furthest",
    """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT a.id, b.id AS other, power(list_distance(a.v, b.v), 2) AS distance FROM e a JOIN e b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), other) AS near,
      row_number() OVER (PARTITION BY id ORDER BY round(distance, 9) DESC, other) AS far FROM d)
    SELECT id, 'near' AS kind, near AS rank, other, round(distance, 6) AS distance FROM r WHERE near <= 5
    UNION ALL SELECT id, 'far', far, other, round(distance, 6) FROM r WHERE far <= 5""",
)
def w3(spark, sf):
    vectors = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest.neighbours(vectors, 5)


# All windows of all stretches, as the stretch's values and the place of the first.
_WINDOWS = STRETCHES + f""", whole AS (SELECT series, segment, list(value ORDER BY ts) AS vals, avg(value) AS mean, stddev_pop(value) AS std
      FROM run GROUP BY 1, 2),
    t AS (SELECT *, vals[start_pos + 1:start_pos + {_W}] AS w FROM (
      SELECT *, unnest(range(0, len(vals) - {_W - 1})) AS start_pos FROM whole))"""


def _uniform(*what: str) -> str:
    labels = ", ".join(["'13'", "series", "strftime(segment, '%Y-%m-%d %H:%M:%S')", "start_pos", *what])
    return f"(('0x' || substr(md5(concat_ws('|', {labels})), 1, 13))::BIGINT / 4503599627370496.0)"


def _draw(what: str, low: int, high: int | str) -> str:
    return f"({low} + floor({_uniform(repr(what))} * ({high} - {low}))::BIGINT)"


def _normal(*what: str) -> str:
    return f"sqrt(-2.0 * ln(1.0 - {_uniform(*what, repr('r'))})) * cos(2.0 * pi() * {_uniform(*what, repr('a'))})"


# The draws of a corruption, and the corrupted value ``v`` at place ``i``.
_LOW, _HIGH = int(_W * 0.1), int(_W * 0.9)
_DRAWN = f""", d0 AS (SELECT *, {_draw('length', _LOW, _HIGH)} AS length, {_draw('speed', 2, 5)} AS speed,
      (1.0 + 0.5 * {_normal(repr('trend'))}) * CASE WHEN {_uniform(repr('sign'))} < 0.5 THEN -1 ELSE 1 END AS "offset",
      {_uniform(repr('bump'))} * 0.1 AS bump, {_draw('kind', 0, 5)} AS kind FROM t),
    d AS (SELECT *, {_draw('start', 0, f'({_W} - length)')} AS start FROM d0),
    x AS (SELECT *, unnest(range(0, {_W})) AS i FROM d),
    corrupted AS (SELECT *, CASE
      WHEN kind = 0 AND i >= start AND i < start + length THEN w[start + (i - start) * speed % length + 1]
      WHEN kind = 1 AND i >= start THEN w[i + 1] + "offset"
      WHEN kind = 2 AND i >= start AND i < start + 2 THEN w[i + 1] * 8
      WHEN kind = 3 AND i >= start AND i < start + 4 THEN w[i + 1] * 3
      WHEN kind = 4 AND i >= start AND i < start + length THEN w[start + 1] + bump
      ELSE w[i + 1] END AS v FROM x)"""
_UNIT = "CASE WHEN std = 0 THEN 1 ELSE std END"
_REACH = 10


@query(
    "W4_window_triplets",
    _WINDOWS + _DRAWN + f""", s AS (SELECT *, {_draw('shift', 1, _REACH + 1)} AS shift, 0.1 * {_normal(repr('noise'), 'i')} AS noise FROM corrupted)
    SELECT series, segment, start_pos, i, round((w[i + 1] - mean) / {_UNIT}, 6) AS anchor,
      round((CASE WHEN start_pos > {_REACH} THEN vals[start_pos - shift + i + 1] ELSE w[i + 1] + noise END - mean) / {_UNIT}, 6) AS positive,
      round((v - mean) / {_UNIT}, 6) AS negative FROM s""",
)
def w4(spark, sf):
    found = windows.triplets(ship_stretches(spark, sf), _W, 13, step=DAY)
    rows = found.select("series", "segment", "start_pos", F.posexplode(F.arrays_zip("anchor", "positive", "negative")).alias("i", "x"))
    return rows.select("series", "segment", "start_pos", F.col("i").cast("bigint").alias("i"), "x.anchor", "x.positive", "x.negative")


@query(
    "W5_window_corruptions",
    _WINDOWS + _DRAWN + " SELECT series, segment, start_pos, kind, i, round(v, 6) AS negative FROM corrupted",
)
def w5(spark, sf):
    table = windows.window_table(ship_stretches(spark, sf), _W, step=DAY)
    drawn = table.withColumns(windows.window_draws(_W, 13, F.col("series"), F.col("segment"), F.col("start_pos")))
    changed = drawn.withColumn("kind", F.col("_kind")).withColumn("c", windows.corrupt_window(F.col("w")))
    return changed.select(
        "series", "segment", "start_pos", "kind", F.posexplode("c").alias("i", "negative")
    ).withColumn("i", F.col("i").cast("bigint"))


@query(
    "W6_tail_corruptions",
    _WINDOWS
    + f""", d AS (SELECT *, {_W} - {_draw('cut', 1, max(2, _W // 2))} AS cut, {_draw('kind', 0, 6)} AS kind FROM t),
    x AS (SELECT series, segment, start_pos, kind, cut, list_aggregate(w[len(w) - 9:], 'avg') AS mean, unnest(w) AS v, unnest(range(0, {_W})) AS i FROM d)
    SELECT series, segment, start_pos, kind, cut, i, round(CASE WHEN kind < 2 AND i >= cut THEN kind
      WHEN kind = 2 AND i = {_W - 1} THEN mean + 0.5 WHEN kind = 3 AND i = {_W - 1} THEN mean - 0.5
      WHEN kind = 4 AND i = {_W - 1} THEN 2 WHEN kind = 5 AND i = {_W - 1} THEN -2 ELSE v END, 6) AS value FROM x""",
)
def w6(spark, sf):
    table = windows.window_table(ship_stretches(spark, sf), _W, step=DAY)
    changed = windows.corrupt_tail(table, _W, 13)
    return changed.select(
        "series", "segment", "start_pos", "kind", "cut", F.posexplode("negative").alias("i", "value")
    ).withColumn("i", F.col("i").cast("bigint"))
