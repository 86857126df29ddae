"""Queries I1 to I13 and R1 to R10: gaps, imputation, errors, Monte Carlo."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY, HOUR
from sensorloom.operators import gaps as G
from sensorloom.operators import grid, impute, report
from sensorloom.plans import imputation
from sensorloom.queries import linear
from sensorloom.queries import views as V
from sensorloom.queries.registry import query
from sensorloom.session import cut

M = 24


def hours(spark, sf):
    return cut(V.hourly_ppb(spark, sf))


def spec(rows):
    """Fixed gaps in two sets; the second has windows that touch."""
    one = rows.where("pos % 97 = 5").select(
        "series", F.lit(0).cast("bigint").alias("gap_size"), F.lit(1).cast("bigint").alias("seed"),
        F.lit(1).cast("bigint").alias("run"), F.col("pos").alias("gap_id"), F.col("pos").alias("start_pos"),
        F.col("ts").alias("start_ts"), (1 + F.col("pos") % 4).alias("len"),
    )
    two = rows.where("pos % 61 in (7, 10)").select(
        "series", F.lit(3).cast("bigint").alias("gap_size"), F.lit(2).cast("bigint").alias("seed"),
        F.lit(2).cast("bigint").alias("run"), F.col("pos").alias("gap_id"), F.col("pos").alias("start_pos"),
        F.col("ts").alias("start_ts"), F.lit(3).cast("bigint").alias("len"),
    )
    return one.unionByName(two)


def gaps_of(rows, step=HOUR):
    return cut(G.inside_grid(spec(rows), rows, step))


GAPS = V.HOURLY_PPB + """, hg AS (SELECT series, ts, value, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY series))) // 3600000000 AS pos,
      max(ts) OVER (PARTITION BY series) AS top FROM ppb),
    spec AS (SELECT series, 0 AS gap_size, 1 AS seed, 1 AS run, pos AS gap_id, ts AS start_ts, 1 + pos % 4 AS len, top FROM hg WHERE pos % 97 = 5
      UNION ALL SELECT series, 3, 2, 2, pos, ts, 3, top FROM hg WHERE pos % 61 IN (7, 10)),
    gaps AS (SELECT series, gap_size, seed, run, gap_id, start_ts, len FROM spec WHERE start_ts + (len - 1) * INTERVAL 1 HOUR <= top),
    mask AS (SELECT series, gap_size, seed, run, gap_id, start_ts, len, start_ts + i * INTERVAL 1 HOUR AS ts FROM (
      SELECT *, unnest(range(0, len)) AS i FROM gaps)),
    sr AS (SELECT s.gap_size, s.seed, h.series, h.ts, h.value AS actual,
      CASE WHEN EXISTS (SELECT 1 FROM mask m WHERE m.series = h.series AND m.ts = h.ts AND m.gap_size = s.gap_size AND m.seed = s.seed)
        THEN NULL ELSE h.value END AS v
      FROM hg h, (SELECT DISTINCT gap_size, seed FROM gaps) s),
    wave AS (SELECT *, avg(v) OVER (PARTITION BY gap_size, seed, series, hour(ts)) AS clim FROM sr),
    near AS (SELECT *, epoch(ts) AS t,
      epoch(last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER a) AS t0, last_value(v IGNORE NULLS) OVER a AS v0,
      epoch(first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b) AS t1, first_value(v IGNORE NULLS) OVER b AS v1,
      last_value(v - clim IGNORE NULLS) OVER a AS r0, first_value(v - clim IGNORE NULLS) OVER b AS r1
      FROM wave WINDOW a AS (PARTITION BY gap_size, seed, series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY gap_size, seed, series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT gap_size, seed, series, ts, actual, v,
      CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS linear,
      clim + CASE WHEN v IS NOT NULL THEN v - clim WHEN r0 IS NULL THEN r1 WHEN r1 IS NULL THEN r0 ELSE r0 + (r1 - r0) * (t - t0) / (t1 - t0) END AS seasonal
      FROM near),
    """ + V.segments_sql("hg") + """,
    ctx AS (SELECT g.series, g.gap_size, g.seed, g.gap_id, g.start_ts, g.len, (epoch(s.ts) - epoch(g.start_ts)) / 3600 AS x, s.value AS y FROM gaps g
      JOIN segments e ON e.series = g.series AND e.ts = g.start_ts - INTERVAL 1 HOUR
      JOIN segments s ON s.series = g.series AND s.segment = e.segment AND s.ts < g.start_ts),
    fit AS (SELECT series, gap_size, seed, gap_id, start_ts, unnest(range(0, len)) AS i, b, a FROM (
      SELECT series, gap_size, seed, gap_id, start_ts, len, coalesce(regr_slope(y, x), 0) AS b, regr_intercept(y, x) AS a FROM ctx
      GROUP BY series, gap_size, seed, gap_id, start_ts, len HAVING count(*) >= 3)),
    trend AS (SELECT f.series, f.gap_size, f.seed, f.gap_id, f.start_ts + f.i * INTERVAL 1 HOUR AS ts,
        any_value(f.a) + any_value(f.b) * f.i + coalesce(avg(c.y - f.a - f.b * c.x), 0) AS pred FROM fit f
      LEFT JOIN ctx c ON c.series = f.series AND c.gap_size = f.gap_size AND c.seed = f.seed AND c.gap_id = f.gap_id
        AND (f.i - c.x)::BIGINT % 24 = 0 GROUP BY f.series, f.gap_size, f.seed, f.gap_id, f.start_ts, f.i),
    preds AS (SELECT 'TrendFit' AS model, m.*, h.value AS actual, t.pred FROM mask m
        JOIN trend t ON t.series = m.series AND t.gap_size = m.gap_size AND t.seed = m.seed AND t.gap_id = m.gap_id AND t.ts = m.ts
        JOIN hg h ON h.series = m.series AND h.ts = m.ts
      UNION ALL SELECT 'LinearInterp' AS model, m.*, f.actual, f.linear AS pred FROM mask m
        JOIN filled f ON f.series = m.series AND f.ts = m.ts AND f.gap_size = m.gap_size AND f.seed = m.seed
      UNION ALL SELECT 'interp', m.*, f.actual, coalesce(f.seasonal, f.linear) FROM mask m
        JOIN filled f ON f.series = m.series AND f.ts = m.ts AND f.gap_size = m.gap_size AND f.seed = m.seed)"""

# Mean seasonal-naive error of the history before each gap.
SCALES = f""", lin AS (SELECT series, ts, value, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t0,
        last_value(value IGNORE NULLS) OVER a AS v0,
        first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t1, first_value(value IGNORE NULLS) OVER b AS v1
      FROM hg WINDOW a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    starts AS (SELECT DISTINCT series, start_ts FROM gaps),
    hist AS (SELECT s.series, s.start_ts, l.ts, CASE WHEN l.value IS NOT NULL THEN l.value
        WHEN l.t0 IS NULL AND l.t1 < s.start_ts THEN l.v1 WHEN l.t0 IS NULL THEN NULL
        WHEN l.t1 IS NULL OR l.t1 >= s.start_ts THEN l.v0
        ELSE l.v0 + (l.v1 - l.v0) * (epoch(l.ts) - epoch(l.t0)) / (epoch(l.t1) - epoch(l.t0)) END AS f
      FROM starts s JOIN lin l ON l.series = s.series AND l.ts < s.start_ts),
    scales AS (SELECT series, start_ts, CASE WHEN avg(d) > 0 THEN avg(d) END AS scale FROM (
      SELECT series, start_ts, abs(f - lag(f, {M}) OVER (PARTITION BY series, start_ts ORDER BY ts)) AS d FROM hist)
      GROUP BY 1, 2),
    gapmae AS (SELECT model, series, gap_size, seed, run, gap_id, start_ts, len, avg(abs(actual - pred)) AS mae FROM preds
      WHERE actual IS NOT NULL GROUP BY ALL),
    results AS (SELECT p.model, p.series, p.gap_size, p.seed, p.run, p.mae, p.rmse, g.mase FROM (
        SELECT model, series, gap_size, seed, run, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse
        FROM preds GROUP BY 1, 2, 3, 4, 5) p
      LEFT JOIN (SELECT model, g.series, gap_size, seed, run, sum(mae / scale * len) / sum(len) AS mase FROM gapmae g
        JOIN scales s ON s.series = g.series AND s.start_ts = g.start_ts WHERE scale IS NOT NULL GROUP BY 1, 2, 3, 4, 5) g
      ON g.model = p.model AND g.series = p.series AND g.gap_size = p.gap_size AND g.seed = p.seed)"""
SCALES = SCALES.replace("GROUP BY ALL", "GROUP BY model, series, gap_size, seed, run, gap_id, start_ts, len")
RESULTS = GAPS + SCALES
MODELS = ["interp", "LinearInterp", "TrendFit"]


def benchmark(spark, sf):
    rows = hours(spark, sf)
    return imputation.run_benchmark(rows, gaps_of(rows), MODELS, m=M)


def bounds(rows):
    return rows.groupBy("series").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))


def some_seeds(spark):
    return G.seed_table(spark, n_runs=4, start=42)


def _hash(kind: str, r: str, x: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{kind}', seed, series, gap_size, {r}, {x})), 1, 13))::BIGINT"


def _order(kind: str, room: str, count: str) -> str:
    """The first ``count`` of the places below ``room`` in their random order, on a grid of ``a`` by ``b``."""

    def mixed(v: str) -> str:
        return f"""list_reduce([{v}, 0, 1, 2, 3], lambda x, r: CASE WHEN r % 2 = 0
          THEN ((x // b + {_hash(kind, 'r', 'x % b')}) % a) * b + x % b
          ELSE (x // b) * b + (x % b + {_hash(kind, 'r', 'x // b')}) % b END)"""

    return f"""list_transform(range(0, least({room}, {count})), lambda j: list_reduce(list_prepend({mixed('j')}, range(24)),
      lambda y, step: CASE WHEN y < {room} THEN y ELSE {mixed('y')} END))"""


def _grid(name: str, source: str, room: str) -> str:
    """``source`` with the sides ``a`` and ``b`` of the grid of its places."""
    return f"""{name} AS (SELECT *, ({room} + a - 1) // a AS b FROM (
      SELECT * EXCLUDE (a, b), ceil(sqrt({room}))::BIGINT AS a FROM (SELECT *, 0 AS a, 0 AS b FROM {source})))"""


def _taken(candidates: str, wanted: str, clash: str) -> str:
    """Candidates ``c[1]`` in order, unless ``clash`` with those ``taken`` before."""
    return f"""list_reduce(list_prepend([]::BIGINT[], list_transform({candidates}, lambda c: [c])), lambda taken, c:
      CASE WHEN len(taken) >= {wanted} OR {clash} THEN taken ELSE list_concat(taken, c) END)"""


def _near(apart: int) -> str:
    return f"len(list_filter(taken, lambda s: c[1] < s + gap_size + {apart} AND s < c[1] + gap_size + {apart})) > 0"


_ROOM = "(n - gap_size + 1)"
# Three random blocks per set.
_DRAWN = f"""{_grid('spaced', 'sets', _ROOM)},
    random_gaps AS (SELECT series, gap_size, seed, run, pos AS gap_id, pos AS start_pos, first_ts + pos * INTERVAL 1 HOUR AS start_ts, gap_size AS len
      FROM (SELECT *, unnest({_taken(_order('gap', _ROOM, '2 * (2 * gap_size - 1) + 1'), '3', _near(0))}) AS pos FROM spaced))"""
# Points for three quarters of the rows, separated blocks for the rest.
_POINTS = "greatest(1, floor(3 * gap_size * 0.75)::BIGINT)"
_BLOCKS = "greatest(1, (3 * gap_size - floor(3 * gap_size * 0.75)::BIGINT) // gap_size)"
_HYBRID = f"""{_grid('spaced', 'sets', _ROOM)},
    blocked AS (SELECT * EXCLUDE (a, b), {_taken(
        _order('gap', _ROOM, f'({_BLOCKS} - 1) * (2 * (gap_size + 1) - 1) + 1'), _BLOCKS, _near(1))} AS starts FROM spaced),
    {_grid('pointed', 'blocked', 'n')},
    hybrid AS (SELECT *, {_taken(
        _order('point', 'n', f'{_BLOCKS} * (gap_size + 2) + ({_POINTS} - 1) * 3 + 1'), _POINTS,
        "len(list_filter(taken, lambda p: abs(p - c[1]) <= 1)) > 0 "
        "OR len(list_filter(starts, lambda s: c[1] >= s - 1 AND c[1] <= s + gap_size)) > 0")} AS points FROM pointed),
    hybrid_gaps AS (SELECT series, gap_size, seed, run, pos AS gap_id, pos AS start_pos, first_ts + pos * INTERVAL 1 HOUR AS start_ts, len FROM (
      SELECT series, gap_size, seed, run, first_ts, unnest(starts) AS pos, gap_size AS len FROM hybrid
      UNION ALL SELECT series, gap_size, seed, run, first_ts, unnest(points), 1 FROM hybrid))"""


def _sets(sizes: str, runs: int) -> str:
    return f"""sets AS (SELECT series, min(ts) AS first_ts, count(*) AS n, gap_size, seed, seed - 41 AS run FROM hg,
      (SELECT unnest({sizes}) AS gap_size), (SELECT unnest(range(42, {42 + runs})) AS seed) GROUP BY series, gap_size, seed)"""


@query(
    "I1_block_gaps",
    GAPS + f", {_sets('[1, 2, 5, 10]', 4)}, {_DRAWN} SELECT series, gap_size, seed, run, start_pos, start_ts, len FROM random_gaps",
)
def i1(spark, sf):
    sets = G.gap_sets(bounds(hours(spark, sf)), [1, 2, 5, 10], some_seeds(spark))
    return G.block_gaps(sets, [1, 2, 5, 10], 3).drop("gap_id")


@query(
    "I2_hybrid_gaps",
    GAPS + f", {_sets('[1, 2, 5, 10]', 4)}, {_HYBRID} SELECT series, gap_size, seed, run, gap_id, start_pos, start_ts, len FROM hybrid_gaps",
)
def i2(spark, sf):
    sets = G.gap_sets(bounds(hours(spark, sf)), [1, 2, 5, 10], some_seeds(spark))
    return G.hybrid_gaps(sets, [1, 2, 5, 10], 3)


@query(
    "I3_explicit_gaps",
    GAPS + """ SELECT g.series, s.gap_size, s.seed, s.run, g.start_ts, g.len FROM spec g, (
      SELECT unnest([1, 2]) AS gap_size) z, (SELECT unnest([42, 43]) AS seed) y, (SELECT 1) x,
      (SELECT a AS gap_size, b AS seed, b - 41 AS run FROM (SELECT unnest([1, 2]) AS a), (SELECT unnest([42, 43]) AS b)) s
      WHERE s.gap_size = z.gap_size AND s.seed = y.seed""",
)
def i3(spark, sf):
    rows = hours(spark, sf)
    sets = G.gap_sets(bounds(rows), [1, 2], G.seed_table(spark, [42, 43]))
    return G.explicit_gaps(sets, spec(rows)).select("series", "gap_size", "seed", "run", "start_ts", "len")


@query("I4_windows_inside_grid", GAPS + " SELECT series, gap_size, seed, run, gap_id, start_ts, len FROM gaps")
def i4(spark, sf):
    return gaps_of(hours(spark, sf)).drop("start_pos")


@query(
    "I5_planned_gaps",
    GAPS + f", {_sets('[2, 5]', 4)}, {_HYBRID} SELECT series, gap_size, seed, run, gap_id, start_pos, start_ts, len FROM hybrid_gaps",
)
def i5(spark, sf):
    return G.plan_gaps(bounds(hours(spark, sf)), [2, 5], some_seeds(spark), 3, strategy="hybrid")


_PRED = " SELECT series, gap_size, seed, gap_id, ts, round(pred, 6) AS pred FROM preds WHERE model = "


@query("I6_linear_interpolation", GAPS + _PRED + "'LinearInterp'")
def i6(spark, sf):
    rows = hours(spark, sf)
    pred, _ = impute.linear_imputer(rows, gaps_of(rows))
    return pred.select("series", "gap_size", "seed", "gap_id", "ts", "pred")


@query("I7_seasonal_interpolation", GAPS + _PRED + "'interp'")
def i7(spark, sf):
    rows = hours(spark, sf)
    pred, _ = impute.seasonal_imputer(rows, gaps_of(rows))
    return pred.select("series", "gap_size", "seed", "gap_id", "ts", "pred")


@query(
    "I8_filled_series",
    V.HOURLY_PPB + """, sr AS (SELECT series, ts, value AS v, avg(value) OVER (PARTITION BY series, hour(ts)) AS clim FROM ppb),
    near AS (SELECT *, epoch(ts) AS t, epoch(last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER a) AS t0,
      epoch(first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b) AS t1,
      last_value(v - clim IGNORE NULLS) OVER a AS r0, first_value(v - clim IGNORE NULLS) OVER b AS r1
      FROM sr WINDOW a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series, ts, round(CASE WHEN v IS NOT NULL THEN v WHEN r0 IS NULL THEN clim + r1 WHEN r1 IS NULL THEN clim + r0
      ELSE clim + r0 + (r1 - r0) * (t - t0) / (t1 - t0) END, 6) AS value FROM near""",
)
def i8(spark, sf):
    return impute.impute_series(hours(spark, sf)).select("series", "ts", "value")


CONTEXT = GAPS + """, back AS (SELECT g.series, g.gap_size, g.seed, g.gap_id, g.start_ts, g.len, b, h.ts, h.value FROM gaps g,
      (SELECT unnest(range(1, 5)) AS b) x JOIN hg h ON h.series = g.series AND h.ts = g.start_ts - b * INTERVAL 1 HOUR),
    clean AS (SELECT * FROM (SELECT *, sum((value IS NULL)::INT) OVER (PARTITION BY series, gap_size, seed, gap_id ORDER BY b) AS holes
      FROM back) WHERE holes = 0)"""


@query(
    "G23_clean_left_context",
    CONTEXT + " SELECT series, gap_size, seed, gap_id, b AS back, ts, round(value, 6) AS value FROM clean",
)
def g23(spark, sf):
    rows = hours(spark, sf)
    context = impute.left_context(rows, gaps_of(rows), 4)
    return context.select("series", "gap_size", "seed", "gap_id", F.col("back").cast("bigint").alias("back"), "ts", "value")


@query(
    "I11_gap_failures",
    CONTEXT + f""", counts AS (SELECT g.series, g.gap_size, g.seed, g.start_ts, g.len, count(c.b) AS available FROM gaps g
      LEFT JOIN clean c ON c.series = g.series AND c.gap_size = g.gap_size AND c.seed = g.seed AND c.gap_id = g.gap_id
      GROUP BY g.series, g.gap_size, g.seed, g.gap_id, g.start_ts, g.len)
    SELECT 'model' AS model, series, gap_size, seed, start_ts, len, 4 AS required, available, '{impute.SHORT_CONTEXT}' AS reason
    FROM counts WHERE available < 4""",
)
def i11(spark, sf):
    rows = hours(spark, sf)
    gaps = gaps_of(rows)
    counted = impute.context_counts(impute.left_context(rows, gaps, 4), gaps)
    return impute.failure_table(counted.where("available < 4"), "model", 4)


# Daily gaps, training stretches without them, and the context of those that have enough.
_DAILY_GAPS = V.SHIP.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    spec AS (SELECT series, 0 AS gap_size, 1 AS seed, pos AS gap_id, ts AS start_ts, 1 + pos % 4 AS len FROM ship_grid WHERE pos % 97 = 5
      UNION ALL SELECT series, 3, 2, pos, ts, 3 FROM ship_grid WHERE pos % 61 IN (7, 10)),
    gaps AS (SELECT s.* FROM spec s JOIN (SELECT series, max(pos) AS top FROM ship_grid GROUP BY 1) t ON t.series = s.series WHERE gap_id + len - 1 <= top),
    masked AS (SELECT DISTINCT series, gap_id + unnest(range(0, len)) AS pos FROM gaps),
    past AS (SELECT g.series, g.ts, CASE WHEN m.pos IS NULL THEN g.value END AS value FROM ship_grid g
      LEFT JOIN masked m ON m.series = g.series AND m.pos = g.pos),
    {V.segments_sql('past', 'pieces')}, train AS (SELECT series, segment, ts, value FROM pieces WHERE segment_len >= {linear.LAGS + linear.K}),
    {linear.samples_sql('train')},
    context AS (SELECT g.series, g.gap_size, g.seed, g.gap_id, g.start_ts, g.len, list((r.value - mean) / std ORDER BY r.pos) AS x FROM gaps g
      JOIN ship_grid r ON r.series = g.series AND r.pos BETWEEN g.gap_id - {linear.LAGS} AND g.gap_id - 1 JOIN unit u ON u.series = g.series
      GROUP BY g.series, g.gap_size, g.seed, g.gap_id, g.start_ts, g.len HAVING count(r.value) = {linear.LAGS})"""


def _imputed(name: str) -> str:
    ahead, base, k = linear.ahead(name), linear.BASE[name], linear.TARGETS[name]
    return f"""{name}_in AS (SELECT 'every' AS every, {linear.SEEN[name]} AS f, list_transform(y[1:{k}], lambda v: v - {base}) AS y FROM samples),
    {linear.solved_sql(f'{name}_in', f'{name}_s', 'every', str(linear.RIDGE))},
    {name}_roll AS (SELECT c.*, []::DOUBLE[] AS p, m.mf, m.my, m.w FROM context c, {name}_s m
      UNION ALL SELECT series, gap_size, seed, gap_id, start_ts, len, list_concat(x, {ahead})[-{linear.LAGS}:], list_concat(p, {ahead}), mf, my, w
      FROM {name}_roll WHERE len(p) < len),
    {name}_out AS (SELECT '{name}' AS model, r.series, gap_size, seed, gap_id, start_ts + h * INTERVAL 1 DAY AS ts, round(p[h + 1] * std + mean, 6) AS pred
      FROM (SELECT *, unnest(range(0, len)) AS h FROM {name}_roll WHERE len(p) >= len) r JOIN unit u ON u.series = r.series)"""


_GLOBAL = ["LinearRegression", "NLinear", "DLinear"]


@query(
    "I9_model_imputation",
    _DAILY_GAPS + ", " + ", ".join(_imputed(n) for n in _GLOBAL) + " " + " UNION ALL ".join(f"SELECT * FROM {n}_out" for n in _GLOBAL),
)
def i9(spark, sf):
    rows = cut(V.ship_grid(spark, sf))
    gaps = gaps_of(rows, DAY)
    preds, failures = imputation.predict_gaps(rows, gaps, _GLOBAL, step=DAY, lags=linear.LAGS)
    return preds.select("model", "series", "gap_size", "seed", "gap_id", "ts", "pred")


@query("I10_trend_imputation", GAPS + " SELECT series, gap_size, seed, gap_id, ts, round(pred, 6) AS pred FROM trend")
def i10(spark, sf):
    rows = hours(spark, sf)
    pred, _ = impute.trend_imputer(rows, gaps_of(rows))
    return pred.select("series", "gap_size", "seed", "gap_id", "ts", "pred")


@query(
    "I12_seasonal_naive",
    GAPS + f""" SELECT m.series, m.ts, round(any_value(h.value), 6) AS naive FROM mask m
      LEFT JOIN hg h ON h.series = m.series AND h.ts = m.ts - INTERVAL {M} HOUR GROUP BY 1, 2""",
)
def i12(spark, sf):
    rows = hours(spark, sf)
    mask = grid.mask_times(gaps_of(rows), HOUR)
    return impute.seasonal_naive(rows, mask, M)


# Rows of context that an imputer cannot do without.
_NEEDS = {"interp": 0, "LinearInterp": 0, "TrendFit": 3, "LinearRegression": 28, "NLinear": 28, "DLinear": 28}


@query(
    "I13_imputer_registry",
    V.SHIP + f""", top AS (SELECT series, max(pos) AS top FROM ship_grid GROUP BY 1),
    spec AS (SELECT series, 0 AS gap_size, 1 AS seed, pos, 1 + pos % 4 AS len FROM ship_grid WHERE pos % 97 = 5
      UNION ALL SELECT series, 3, 2, pos, 3 FROM ship_grid WHERE pos % 61 IN (7, 10)),
    before AS (SELECT series, pos, coalesce(max(CASE WHEN value IS NULL THEN pos END) OVER (
      PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS hole FROM ship_grid),
    asked AS (SELECT s.*, s.pos - 1 - b.hole AS available FROM spec s JOIN before b ON b.series = s.series AND b.pos = s.pos
      JOIN top t ON t.series = s.series WHERE s.pos + s.len - 1 <= t.top)
    SELECT model, series, gap_size, seed, sum(len)::BIGINT AS n_pred FROM asked
    JOIN (VALUES {', '.join(f"('{m}', {n})" for m, n in _NEEDS.items())}) n(model, need) ON available >= need GROUP BY 1, 2, 3, 4""",
)
def i13(spark, sf):
    rows = cut(V.ship_grid(spark, sf))
    preds, _ = imputation.predict_gaps(rows, gaps_of(rows, DAY), ["all"], step=DAY, lags=28)
    return preds.groupBy("model", "series", "gap_size", "seed").agg(F.count("pred").alias("n_pred"))


@query(
    "G24_context_frame",
    GAPS + """, ends AS (SELECT series, max(start_ts) AS end_ts FROM gaps WHERE seed = 1 GROUP BY 1),
    frame AS (SELECT e.series, e.end_ts - b * INTERVAL 1 HOUR AS ts FROM ends e, (SELECT unnest(range(0, 96)) AS b)),
    fr AS (SELECT f.series, f.ts, EXISTS (SELECT 1 FROM mask m WHERE m.series = f.series AND m.ts = f.ts) AS masked, h.value
      FROM frame f LEFT JOIN hg h ON h.series = f.series AND h.ts = f.ts),
    fv AS (SELECT series, ts, masked, CASE WHEN NOT masked THEN value END AS v FROM fr),
    fn AS (SELECT *, epoch(ts) AS t, epoch(last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER a) AS t0,
      last_value(v IGNORE NULLS) OVER a AS v0, epoch(first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b) AS t1,
      first_value(v IGNORE NULLS) OVER b AS v1 FROM fv
      WINDOW a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series, ts, masked, CASE WHEN NOT masked THEN round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1
      WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) END AS value FROM fn""",
)
def g24(spark, sf):
    rows = hours(spark, sf)
    gaps = gaps_of(rows)
    ends = gaps.where("seed = 1").groupBy("series").agg(F.max("start_ts").alias("end_ts"))
    return impute.context_frame(rows, grid.mask_times(gaps, HOUR), ends, 96)


@query(
    "R1_mask_errors",
    GAPS + """ SELECT model, series, gap_size, seed, round(avg(abs(actual - pred)), 6) AS mae,
      round(sqrt(avg((actual - pred) * (actual - pred))), 6) AS rmse FROM preds WHERE actual IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def r1(spark, sf):
    rows = hours(spark, sf)
    preds, _ = imputation.predict_gaps(rows, gaps_of(rows), MODELS)
    truth = rows.select("series", "ts", F.col("value").alias("actual"))
    pairs = report.truth_pairs(truth, preds, ["series"])
    return report.errors(pairs, ["model", "series", "gap_size", "seed"])


@query(
    "R2_gap_mase",
    RESULTS + " SELECT model, series, gap_size, seed, run, round(mase, 6) AS mase FROM results WHERE mase IS NOT NULL",
)
def r2(spark, sf):
    rows = hours(spark, sf)
    gaps = gaps_of(rows)
    preds, _ = imputation.predict_gaps(rows, gaps, MODELS)
    truth = rows.select("series", "ts", F.col("value").alias("actual"))
    scales = impute.history_scale(rows, gaps, M)
    return imputation.gap_mase(preds.join(truth, ["series", "ts"]), scales)


_ROUNDED = "round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mase, 6) AS mase"


@query("R4_benchmark_results", RESULTS + f" SELECT model, series, gap_size, seed, run, {_ROUNDED} FROM results")
def r4(spark, sf):
    return benchmark(spark, sf).results


_MEANS = "avg(mae) AS mae, avg(rmse) AS rmse, avg(mase) AS mase"


@query("R5_model_ranking", RESULTS + f" SELECT model, {_ROUNDED} FROM (SELECT model, {_MEANS} FROM results GROUP BY 1)")
def r5(spark, sf):
    return report.rank_models(benchmark(spark, sf).results)


@query(
    "R7_ranking_by_seed",
    RESULTS + f" SELECT seed, run, model, {_ROUNDED} FROM (SELECT seed, run, model, {_MEANS} FROM results GROUP BY 1, 2, 3)",
)
def r7(spark, sf):
    return report.rank_by_seed(benchmark(spark, sf).results)


def _tails(metrics=("mae", "rmse", "mase"), std=True):
    parts = []
    for m in metrics:
        parts += [f"round(avg({m}), 6) AS {m}_mean"] + ([f"round(stddev_samp({m}), 6) AS {m}_std"] if std else [])
        parts += [f"round(quantile_cont({m}, 0.05), 6) AS {m}_p05", f"round(quantile_cont({m}, 0.95), 6) AS {m}_p95"]
    return ", ".join(parts)


@query(
    "R8_run_summary",
    RESULTS + f", ranking AS (SELECT seed, run, model, {_MEANS} FROM results GROUP BY 1, 2, 3) SELECT model, count(DISTINCT seed) AS runs, {_tails()} FROM ranking GROUP BY 1",
)
def r8(spark, sf):
    return report.summarise_runs(cut(report.rank_by_seed(benchmark(spark, sf).results)))


@query("R9_metrics_by_gap_size", RESULTS + f" SELECT model, gap_size, {_tails(std=False)} FROM results GROUP BY 1, 2")
def r9(spark, sf):
    return report.by_gap_size(cut(benchmark(spark, sf).results))


# The same benchmark with the gaps drawn at random for five seeds.
_MONTE_CARLO = RESULTS.replace(
    "gaps AS (SELECT series, gap_size, seed, run, gap_id, start_ts, len FROM spec WHERE start_ts + (len - 1) * INTERVAL 1 HOUR <= top)",
    f"{_sets('[1, 5]', 5)}, {_DRAWN}, gaps AS (SELECT series, gap_size, seed, run, gap_id, start_ts, len FROM random_gaps)",
)


@query("R6_monte_carlo", _MONTE_CARLO + f" SELECT model, series, gap_size, seed, run, {_ROUNDED} FROM results")
def r6(spark, sf):
    rows = hours(spark, sf)
    done = imputation.monte_carlo(
        rows, bounds(rows), MODELS, gap_sizes=[1, 5], seeds=G.seed_table(spark, n_runs=5), m=M
    )
    return done.results


_NAIVE = f""", naive AS (SELECT m.series, m.ts, any_value(h.value) AS naive FROM mask m
      LEFT JOIN hg h ON h.series = m.series AND h.ts = m.ts - INTERVAL {M} HOUR GROUP BY 1, 2)"""


@query(
    "R10_merged_predictions",
    GAPS + _NAIVE + """ SELECT p.gap_size, p.series, p.ts, p.model, round(p.pred, 6) AS pred, round(p.actual, 6) AS actual, round(n.naive, 6) AS naive
      FROM preds p LEFT JOIN naive n ON n.series = p.series AND n.ts = p.ts""",
)
def r10(spark, sf):
    done = benchmark(spark, sf).predictions
    parts = [
        done.where(F.col("model") == name).select("gap_size", "series", "ts", "model", "pred", "actual", "naive")
        for name in MODELS
    ]
    return report.merge_predictions(parts)


@query("R11_prediction_window", GAPS + " SELECT min(ts) AS start_ts, max(ts) AS end_ts FROM preds WHERE pred IS NOT NULL")
def r11(spark, sf):
    rows = hours(spark, sf)
    preds, _ = imputation.predict_gaps(rows, gaps_of(rows), MODELS)
    return report.prediction_window(preds)


@query(
    "R12_method_errors",
    GAPS + " SELECT model, series, gap_size, round(avg(abs(actual - pred)), 6) AS mae FROM preds WHERE actual IS NOT NULL GROUP BY 1, 2, 3",
)
def r12(spark, sf):
    rows = hours(spark, sf)
    preds, _ = imputation.predict_gaps(rows, gaps_of(rows), MODELS)
    truth = rows.select("series", "ts", F.col("value").alias("actual"))
    return report.mean_absolute_error(report.truth_pairs(truth, preds, ["series"]), ["model", "series", "gap_size"])


@query(
    "R13_truth_pairs",
    GAPS + " SELECT model, series, gap_size, ts, round(actual, 6) AS actual, round(pred, 6) AS pred FROM preds WHERE actual IS NOT NULL AND pred IS NOT NULL",
)
def r13(spark, sf):
    rows = hours(spark, sf)
    preds, _ = imputation.predict_gaps(rows, gaps_of(rows), MODELS)
    truth = rows.select("series", "ts", F.col("value").alias("actual"))
    return report.truth_pairs(truth, preds, ["series"]).select("model", "series", "gap_size", "ts", "actual", "pred")


@query(
    "R16_manifest",
    GAPS + " SELECT gap_size, series, count(DISTINCT model) AS model_count FROM preds GROUP BY 1, 2",
)
def r16(spark, sf):
    rows = hours(spark, sf)
    preds, _ = imputation.predict_gaps(rows, gaps_of(rows), MODELS)
    return report.manifest(preds)
