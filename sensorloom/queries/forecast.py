"""Queries G14 to G22, D8, D9, D11 and F1 to F7: splits, forecasts, backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY
from sensorloom.operators import forecast, grid, registry, report, splits
from sensorloom.plans import cleaning, comparison
from sensorloom.queries import views as V
from sensorloom.queries.detect import RUN, STRETCHES, ship_stretches
from sensorloom.queries.grid import _BEST
from sensorloom.queries.impute import RESULTS, benchmark
from sensorloom.queries.linear import BASE, LAGS, RIDGE, SEEN, TARGETS, K, ahead, eliminated_sql, samples_sql, solved_sql
from sensorloom.queries.registry import query
from sensorloom.session import cut
from sensorloom.sources import store

HOLDOUT, CONTEXT, M = 168, 72, 7

_HELD = _BEST + """, held AS (SELECT m.series, d.ts FROM best b JOIN members m ON m.k = b.k AND m.run_start = b.run_start
      JOIN daily d ON d.series = m.series AND d.ts BETWEEN b.run_start AND b.run_end),
    marked AS (SELECT g.series, g.ts, g.value, g.pos, h.ts IS NOT NULL AS masked FROM daily_grid g
      LEFT JOIN held h ON h.series = g.series AND h.ts = g.ts),
    train AS (SELECT series, ts, pos, masked, CASE WHEN masked THEN NULL ELSE value END AS value FROM marked)"""


def held_rows(spark, sf):
    block = grid.best_block(V.daily(spark, sf), DAY)
    return V.daily_grid(spark, sf).join(block.select("series", "run_start", "run_end"), "series").where(
        "ts between run_start and run_end"
    ).select("series", "ts")


@query("G14_held_out_masking", _HELD + """ SELECT t.series, t.ts, round(t.value, 6) AS value, t.masked, c.n_held_out FROM train t
    JOIN (SELECT series, count(*) FILTER (masked) AS n_held_out FROM train GROUP BY 1) c ON c.series = t.series""")
def g14(spark, sf):
    masked = cut(splits.hold_out(V.daily_grid(spark, sf), cut(held_rows(spark, sf))))
    return masked.join(splits.held_out_counts(masked), "series").select("series", "ts", "value", "masked", "n_held_out")


def _tails(source: str, val: int, need: int, context: int) -> str:
    return f"""{V.segments_sql(source)}, tagged AS (SELECT series, segment, ts, value,
        date_diff('day', ts, segment_end) AS back FROM segments WHERE segment_len >= {need}),
      tails AS (SELECT series, segment, ts, value, 'train' AS role FROM tagged WHERE back >= {val}
        UNION ALL SELECT series, segment, ts, value, 'valid' FROM tagged WHERE back < {val + context})"""


@query("G15_segment_tails", V.DAILY + f", {_tails('daily_grid', 2, 8, 4)} SELECT series, segment, ts, round(value, 6) AS value, role FROM tails")
def g15(spark, sf):
    rows = splits.segment_tails(V.daily_grid(spark, sf), val_size=2, min_train_len=6, val_context=4, step=DAY)
    return rows.select("series", "segment", "ts", "value", "role")


@query(
    "G16_standardise",
    V.DAILY + f""", {_tails('daily_grid', 2, 8, 4)}, sc AS (SELECT series, avg(value) AS m, stddev_pop(value) AS s FROM tails WHERE role = 'train' GROUP BY 1)
    SELECT t.series, t.role, t.ts, round((t.value - m) / s, 6) AS scaled, round(t.value, 6) AS back FROM tails t JOIN sc ON sc.series = t.series""",
)
def g16(spark, sf):
    rows = cut(splits.segment_tails(V.daily_grid(spark, sf), val_size=2, min_train_len=6, val_context=4, step=DAY))
    fitted = splits.scalers(rows.where("role = 'train'"))
    scaled = splits.scale(rows.select("series", "role", "ts", "value"), fitted)
    return splits.unscale(scaled.withColumn("back", F.col("value")), fitted, "back").withColumnRenamed("value", "scaled")


@query(
    "G17_long_split",
    V.DAILY + """, p AS (SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS "row",
        count(*) OVER (PARTITION BY series) AS n FROM daily_grid),
    c AS (SELECT *, greatest(1, least(floor(n * 0.8)::BIGINT, n - 1)) AS edge FROM p)
    SELECT series, ts, round(value, 6) AS value, "row", 'train' AS role FROM c WHERE "row" < edge
    UNION ALL SELECT series, ts, round(value, 6), "row", 'valid' FROM c WHERE "row" >= edge - 30""",
)
def g17(spark, sf):
    rows = V.daily_grid(spark, sf).select("series", "blk", "ts", "value")
    return splits.split_long(rows, valid_fraction=0.2, context=30).drop("blk")


@query(
    "G18_benchmark_bundle",
    _HELD + f""", {V.segments_sql('train')}, fitrows AS (SELECT series, value FROM (SELECT *, date_diff('day', ts, segment_end) AS back
        FROM segments WHERE segment_len >= 8) WHERE back >= 2),
    ship AS (SELECT 'ship_' || l_returnflag AS series, l_shipdate AS ts, avg(l_extendedprice) / {V.RATE} AS value FROM lineitem GROUP BY 1, 2),
    sp AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS "row", count(*) OVER (PARTITION BY series) AS n FROM ship),
    cutat AS (SELECT *, greatest(1, least(floor(n * 0.6)::BIGINT, n - 1)) AS edge FROM sp),
    sc AS (SELECT series, avg(value) AS m, stddev_pop(value) AS s FROM (SELECT series, value FROM fitrows
      UNION ALL SELECT series, value FROM cutat WHERE "row" < edge) GROUP BY 1),
    test AS (SELECT series, ts, value FROM marked WHERE masked UNION ALL SELECT series, ts, value FROM cutat WHERE "row" >= edge)
    SELECT t.series, t.ts, round(t.value, 6) AS actual, round((t.value - m) / s, 6) AS scaled FROM test t JOIN sc ON sc.series = t.series""",
)
def g18(spark, sf):
    from sensorloom.functions.blocks import in_blocks

    extra = V.ship(spark, sf).withColumn("series", F.concat(F.lit("ship_"), "series"))
    bundle, _ = splits.benchmark_bundle(
        V.daily_grid(spark, sf), cut(held_rows(spark, sf)), val_size=2, min_train_len=6, val_context=4,
        test_only=in_blocks(extra, DAY), train_fraction=0.6, step=DAY,
    )
    return bundle


_HOLD = RUN + f""", hw AS (SELECT series, max(ts) AS eval_end, max(ts) - INTERVAL {HOLDOUT - 1} DAY AS holdout_start,
      max(ts) - INTERVAL {HOLDOUT + CONTEXT - 1} DAY AS eval_start FROM run GROUP BY 1 HAVING count(*) >= {HOLDOUT + CONTEXT})"""


def ship_rows(spark, sf):
    return cut(V.ship_grid(spark, sf))


def window(rows):
    return cut(splits.holdout_window(rows, holdout=HOLDOUT, context=CONTEXT, step=DAY))


@query("G19_holdout_window", _HOLD + " SELECT series, eval_start, holdout_start, eval_end FROM hw")
def g19(spark, sf):
    return window(ship_rows(spark, sf))


@query(
    "G20_backtest_runs",
    V.SHIP + f""", {V.segments_sql('ship_grid')}, seg AS (SELECT *, date_diff('day', ts, segment_end) AS back FROM segments WHERE segment_len >= {LAGS + K}),
    best AS (SELECT series, segment AS longest, segment_len AS len, greatest({K}, least(48, segment_len // 5)) AS val FROM (
      SELECT DISTINCT series, segment, segment_len, dense_rank() OVER (PARTITION BY series ORDER BY segment_len DESC, segment) AS r FROM seg) WHERE r = 1),
    j AS (SELECT s.*, b.longest, b.val FROM seg s JOIN best b ON b.series = s.series WHERE b.len >= {LAGS + 2 * K} + b.val)
    SELECT series, segment, ts, round(value, 6) AS value, 'train' AS role FROM j WHERE segment <> longest OR back >= val
    UNION ALL SELECT series, segment, ts, round(value, 6), 'valid' FROM j WHERE segment = longest AND back < val + {LAGS}""",
)
def g20(spark, sf):
    return splits.backtest_runs(V.ship_grid(spark, sf), lags=LAGS, k=K, step=DAY).drop("blk")


@query(
    "G21_rows_before_holdout",
    _HOLD + """ SELECT g.series, g.ts, round(g.value, 6) AS value FROM ship_grid g JOIN hw ON hw.series = g.series
    WHERE g.ts < hw.holdout_start AND g.series IN (SELECT series FROM ship_grid GROUP BY 1 HAVING count(value) >= 600)""",
)
def g21(spark, sf):
    rows = ship_rows(spark, sf)
    gated = splits.enough_observed(rows, 600)
    return splits.rows_before(gated, window(rows)).select("series", "ts", "value")


@query(
    "G22_covariates",
    V.HOURLY + """ SELECT series, ts, round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos,
      hour(ts) AS hour, isodow(ts) - 1 AS weekday, round((row_number() OVER (PARTITION BY series ORDER BY ts) - 1) /
      (count(*) OVER (PARTITION BY series) - 1), 6) AS position FROM hourly""",
)
def g22(spark, sf):
    return splits.covariates(V.hourly(spark, sf))


def _stretches(spark, sf):
    return cut(ship_stretches(spark, sf))


_LENGTHS = ", ".join(f"('{name}', {d.min_len})" for name, d in registry.DETECTORS.items())


@query(
    "D11_all_detectors",
    STRETCHES + f""" SELECT detector, series, segment, count(*) AS n_scored FROM run
    JOIN (VALUES {_LENGTHS}) m(detector, least) ON segment_len >= least GROUP BY 1, 2, 3""",
)
def d11(spark, sf):
    rows = cut(grid.observed_segments(V.ship_grid(spark, sf)))
    scores = cleaning.score_all(rows, ["all"], keys=cleaning.SEGMENT, step=DAY, size="segment_len")
    return scores.groupBy("detector", "series", "segment").agg(F.count("score").alias("n_scored"))


# Scaled training windows of the rows in ``past``.
_TRAIN = f"""{V.segments_sql('past', 'pieces')},
    longest AS (SELECT series, segment AS first, segment_len AS n, greatest({K}, least(48, segment_len // 5)) AS val FROM (
      SELECT DISTINCT series, segment, segment_len, dense_rank() OVER (PARTITION BY series ORDER BY segment_len DESC, segment) AS r
      FROM pieces WHERE segment_len >= {LAGS + K}) WHERE r = 1),
    train AS (SELECT p.series, p.segment, p.ts, p.value FROM pieces p JOIN longest l ON l.series = p.series
      WHERE p.segment_len >= {LAGS + K} AND l.n >= {LAGS + 2 * K} + l.val
        AND (p.segment <> l.first OR date_diff('day', p.ts, p.segment_end) >= l.val)),
    {samples_sql('train')}"""
# Those before the hold-out, and the contexts in it.
_FIT = _HOLD.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    past AS (SELECT g.series, g.ts, g.value FROM ship_grid g JOIN hw ON hw.series = g.series WHERE g.ts < hw.holdout_start), {_TRAIN},
    held AS (SELECT r.series, any_value(eval_start) AS eval_start, list((r.value - mean) / std ORDER BY r.ts) AS vals FROM run r
      JOIN hw ON hw.series = r.series JOIN unit u ON u.series = r.series WHERE r.ts BETWEEN eval_start AND eval_end GROUP BY 1),
    origins AS (SELECT series, s, eval_start, vals[s + 1:s + {LAGS}] AS x, vals[s + {LAGS} + 1:s + {LAGS + K}] AS y FROM (
      SELECT *, unnest(range({CONTEXT - LAGS}, len(vals) - {LAGS + K - 1}, {K})) AS s FROM held))"""


def forecast_sql(name: str) -> str:
    """CTEs to ``<name>_out (series, model, ts, actual, pred)``."""
    base = BASE[name]
    return f"""{name}_in AS (SELECT series, {SEEN[name]} AS f, list_transform(y[1:{TARGETS[name]}], lambda v: v - {base}) AS y FROM samples),
    {solved_sql(f'{name}_in', f'{name}_s', 'series', str(RIDGE))},
    {name}_roll AS (SELECT o.series, s, eval_start, x, y, []::DOUBLE[] AS p, m.mf, m.my, m.w FROM origins o JOIN {name}_s m ON m.series = o.series
      UNION ALL SELECT series, s, eval_start, list_concat(x, {ahead(name)})[-{LAGS}:], y, list_concat(p, {ahead(name)}), mf, my, w
      FROM {name}_roll WHERE len(p) < {K}),
    {name}_out AS (SELECT r.series, '{name}' AS model, eval_start + (s + {LAGS} + h) * INTERVAL 1 DAY AS ts,
      y[h + 1] * std + mean AS actual, p[h + 1] * std + mean AS pred FROM (
        SELECT *, unnest(range(0, {K})) AS h FROM {name}_roll WHERE len(p) >= {K}) r JOIN unit u ON u.series = r.series)"""


def _forecasts(*names: str) -> str:
    return _FIT + ", " + ", ".join(forecast_sql(n) for n in names)


_FORECAST = " SELECT series, model, ts, round(actual, 6) AS actual, round(pred, 6) AS pred FROM {0}_out"


_KNOTS = [forecast.KNOT_RANGE * (i + 1) / forecast.KNOTS for i in range(forecast.KNOTS)]
_HINGES = f"list_concat([1.0, share], list_transform({[repr(k) for k in _KNOTS]}::DOUBLE[], lambda c: greatest(share - c, 0)))"


@query(
    "D8_trend_band",
    STRETCHES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", placed AS (SELECT series, segment, ts, value - avg(value) OVER w AS y,
        coalesce((epoch(ts) - epoch(min(ts) OVER w)) / nullif(epoch(max(ts) OVER w) - epoch(min(ts) OVER w), 0), 0) AS share, row_number() OVER () AS id
      FROM run WINDOW w AS (PARTITION BY series, segment)),
    seen AS (SELECT *, {_HINGES} AS f FROM placed),
    long AS (SELECT series, segment, id, unnest(list_append(f, y)) AS v, unnest(range(1, len(f) + 2)) AS i, len(f) AS nf FROM seen),
    cells AS (SELECT a.series, a.segment, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i <> b.i THEN 0 WHEN a.i <= 2 THEN 1e-9 * count(*) ELSE 1e-3 * count(*) END AS g
      FROM long a JOIN long b ON a.id = b.id WHERE a.i <= a.nf GROUP BY a.series, a.segment, a.i, b.i),
    lines AS (SELECT series, segment, i, list(g ORDER BY j) AS r FROM cells GROUP BY 1, 2, 3),
    system AS (SELECT series, segment, list(r ORDER BY i) AS m FROM lines GROUP BY 1, 2),
    {eliminated_sql('system', 'steps', 'series, segment')},
    model AS (SELECT series, segment, list_transform(m, lambda r: r[len(m) + 1]) AS b FROM steps WHERE k = len(m)),
    off AS (SELECT s.series, s.segment, s.ts, s.y - list_dot_product(s.f, m.b) AS off FROM seen s
      JOIN model m ON m.series = s.series AND m.segment = s.segment),
    band AS (SELECT *, greatest({forecast.BAND!r} * sqrt(avg(off * off) OVER (PARTITION BY series, segment)), 1e-6) AS half FROM off)
    SELECT series, segment, ts, round(greatest(abs(off) - half, 0) / half, 6) AS score FROM band""",
)
def d8(spark, sf):
    return forecast.trend_band(_stretches(spark, sf), keys=cleaning.SEGMENT, step=DAY)


_WIDE, _STEPS = 100, 8


@query(
    "D9_forecast_error",
    STRETCHES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", whole AS (SELECT series, segment, list(ts ORDER BY ts) AS times,
        list_transform(list(value ORDER BY ts), lambda v: (v - avg(value)) / CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END) AS vals
      FROM run GROUP BY 1, 2 HAVING count(*) >= {_WIDE + 2 * _STEPS - 1}),
    samples AS (SELECT series, segment, vals[s + 1:s + {_WIDE}] AS f, vals[s + {_WIDE} + 1:s + {_WIDE + _STEPS}] AS y FROM (
      SELECT *, unnest(range(0, len(vals) - {_WIDE + _STEPS - 1})) AS s FROM whole)),
    {solved_sql('samples', 'fit', 'series, segment', str(RIDGE))},
    stacks AS (SELECT w.series, w.segment, times[place + 1] AS ts, list_transform(range(0, {_STEPS}), lambda h: vals[place + 1] - my[h + 1]
        - list_sum(list_transform(range(1, {_WIDE + 1}), lambda i: (vals[place - {_WIDE} - h + i] - mf[i]) * w[i][h + 1]))) AS e
      FROM (SELECT *, unnest(range({_WIDE + _STEPS - 1}, len(vals))) AS place FROM whole) w JOIN fit ON fit.series = w.series AND fit.segment = w.segment),
    parts AS (SELECT series, segment, ts, unnest(e) AS e, unnest(range(1, {_STEPS + 1})) AS i FROM stacks),
    normal AS (SELECT a.series, a.segment, a.i, b.i AS j, covar_samp(a.e, b.e) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0 END AS g, avg(a.e) AS mean
      FROM parts a JOIN parts b ON a.series = b.series AND a.segment = b.segment AND a.ts = b.ts GROUP BY 1, 2, 3, 4),
    sides AS (SELECT series, segment, i, any_value(mean) AS mean, list_concat(list(g ORDER BY j),
      list_transform(range(1, {_STEPS + 1}), lambda j: CASE WHEN j = i THEN 1.0 ELSE 0.0 END)) AS r FROM normal GROUP BY 1, 2, 3),
    system AS (SELECT series, segment, list(r ORDER BY i) AS m FROM sides GROUP BY 1, 2),
    {eliminated_sql('system', 'steps', 'series, segment')},
    shape AS (SELECT series, segment, list_transform(m, lambda r: r[{_STEPS + 1}:]) AS inv FROM steps WHERE k = {_STEPS}),
    centre AS (SELECT series, segment, list(mean ORDER BY i) AS mean FROM sides GROUP BY 1, 2),
    far AS (SELECT s.series, s.segment, s.ts, list_transform(list_zip(e, mean), lambda p: p[1] - p[2]) AS o, inv FROM stacks s
      JOIN shape p ON p.series = s.series AND p.segment = s.segment JOIN centre c ON c.series = s.series AND c.segment = s.segment),
    known AS (SELECT series, segment, ts, list_sum(list_transform(list_zip(o, inv), lambda p: p[1] * list_dot_product(p[2], o))) AS score FROM far)
    SELECT r.series, r.segment, r.ts, round(coalesce(k.score, 0), 6) AS score FROM run r JOIN whole w ON w.series = r.series AND w.segment = r.segment
    LEFT JOIN known k ON k.series = r.series AND k.segment = r.segment AND k.ts = r.ts""",
)
def d9(spark, sf):
    return forecast.forecast_error(_stretches(spark, sf), keys=cleaning.SEGMENT, step=DAY)


def _backtest(spark, sf, names):
    rows = ship_rows(spark, sf)
    windows = window(rows)
    train = splits.backtest_runs(splits.rows_before(rows, windows), lags=LAGS, k=K, step=DAY)
    return rows, windows, cut(forecast.backtest(train, rows, windows, names, lags=LAGS, k=K, step=DAY))


@query("F1_lagged_regression", _forecasts("LinearRegression") + _FORECAST.format("LinearRegression"))
def f1(spark, sf):
    return _backtest(spark, sf, ["LinearRegression"])[2]


@query("F2_level_free_linear", _forecasts("NLinear") + _FORECAST.format("NLinear"))
def f2(spark, sf):
    return _backtest(spark, sf, ["NLinear"])[2]


@query("F3_trend_remainder_linear", _forecasts("DLinear") + _FORECAST.format("DLinear"))
def f3(spark, sf):
    return _backtest(spark, sf, ["DLinear"])[2]


@query(
    "F4_rolling_backtest",
    _forecasts(*forecast.MODELS) + f""", every AS ({' UNION ALL '.join(f'SELECT * FROM {n}_out' for n in forecast.MODELS)}),
    near AS (SELECT series, ts, value, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t0,
        last_value(value IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t1,
        first_value(value IGNORE NULLS) OVER b AS v1 FROM past
      WINDOW a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT series, ts, CASE WHEN value IS NOT NULL THEN value WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
      ELSE v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END AS f FROM near),
    sc AS (SELECT series, avg(d) AS scale FROM (SELECT series, abs(f - lag(f, {M}) OVER (PARTITION BY series ORDER BY ts)) AS d FROM filled) GROUP BY 1)
    SELECT e.series, model, round(sqrt(avg((actual - pred) * (actual - pred))), 6) AS rmse, round(avg(abs(actual - pred)), 6) AS mae,
      round(avg(abs(actual - pred)) / any_value(scale), 6) AS mase, count(*) AS n_eval FROM every e JOIN sc ON sc.series = e.series GROUP BY 1, 2""",
)
def f4(spark, sf):
    rows, windows, forecasts = _backtest(spark, sf, list(forecast.MODELS))
    return forecast.backtest_metrics(forecasts, splits.rows_before(rows, windows), windows, m=M, step=DAY)


@query("F5_raw_and_cleaned_arms")
def f5(spark, sf):
    results, _ = comparison.compare(
        V.ship_grid(spark, sf), ["NLinear", "LinearRegression"], detectors=["ModifiedZScore", "IQR", "Hampel_w24"],
        holdout=HOLDOUT, context=CONTEXT, lags=LAGS, k=K, m=M, step=DAY,
    )
    return results


_PIVOT = ", ".join(
    f"round(max(CASE WHEN seed = 1 THEN {m} END), 6) AS {m}_raw, round(max(CASE WHEN seed = 2 THEN {m} END), 6) AS {m}_pre, "
    f"round(max(CASE WHEN seed = 2 THEN {m} END) - max(CASE WHEN seed = 1 THEN {m} END), 6) AS {m}_delta, "
    f"round(100 * (max(CASE WHEN seed = 1 THEN {m} END) - max(CASE WHEN seed = 2 THEN {m} END)) / nullif(max(CASE WHEN seed = 1 THEN {m} END), 0), 6) AS {m}_improve_pct"
    for m in ("rmse", "mae", "mase")
)


@query("F6_arms_side_by_side", RESULTS + f" SELECT series, model, {_PIVOT} FROM results GROUP BY 1, 2")
def f6(spark, sf):
    # The two gap sets stand for the two arms.
    arm = F.when(F.col("seed") == 1, "raw").otherwise("preprocessed")
    return report.compare_arms(cut(benchmark(spark, sf).results).withColumn("arm", arm))


# Maps from lags to targets, as lists of (step ahead, lag, weight).
_MAPS = {
    "LinearRegression": "w[j][h]",
    "NLinear": f"CASE WHEN j < {LAGS} THEN w[j][h] ELSE 1 - list_sum(list_transform(w, lambda r: r[h])) END",
    "DLinear": f"""w[{LAGS} + j][h] + list_sum(list_transform(range(1, {LAGS + 1}), lambda i: (w[i][h] - w[{LAGS} + i][h])
      * len(list_filter(range(0, {forecast.SMOOTH}), lambda s: greatest(1, least({LAGS}, i - {(forecast.SMOOTH - 1) // 2} + s)) = j)) / {forecast.SMOOTH}.0))""",
}


def _map_sql(name: str) -> str:
    return f"""SELECT '{name}' AS model, 0 AS epoch, {TARGETS[name]} AS k, h, j AS lag, round({_MAPS[name]}, 6) AS weight FROM {name}_s,
      (SELECT unnest(range(1, {TARGETS[name] + 1})) AS h), (SELECT unnest(range(1, {LAGS + 1})) AS j)"""


@query(
    "F7_trained_models",
    V.SHIP.replace("WITH ", "WITH RECURSIVE ", 1) + f""", past AS (SELECT series, ts, value FROM ship_grid), {_TRAIN},
    """ + ", ".join(f"""{n}_in AS (SELECT 'every' AS every, {SEEN[n]} AS f, list_transform(y[1:{TARGETS[n]}], lambda v: v - {BASE[n]}) AS y FROM samples),
    {solved_sql(f'{n}_in', f'{n}_s', 'every', str(RIDGE))}""" for n in forecast.MODELS) + " " + " UNION ALL ".join(_map_sql(n) for n in forecast.MODELS),
)
def f7(spark, sf):
    rows = ship_rows(spark, sf)
    train = cut(splits.backtest_runs(rows, lags=LAGS, k=K, step=DAY).where("role = 'train'"))
    names = registry.trainable(["LinearInterp", "interp", "LinearRegression", "NLinear", "DLinear"])
    scaled = splits.scale(train, splits.scalers(train))
    models, times = forecast.train_models(scaled, names, lags=LAGS, k=K, step=DAY)
    folder = store.scratch_folder(spark, "curves")
    store.write_curves(times, folder)
    kept = spark.read.parquet(folder).select("model_name", "epoch")
    joined = models.join(kept, F.col("model") == F.col("model_name"))
    weights = joined.select("model", "epoch", "k", F.posexplode("coef").alias("at", "weight"))
    return weights.select(
        "model", "epoch", "k", (F.floor(F.col("at") / LAGS) + 1).alias("h"),
        (F.col("at") % LAGS + 1).cast("bigint").alias("lag"), F.round("weight", 6).alias("weight"),
    )


@query(
    "R3_backtest_errors",
    _HOLD + f""", pairs AS (SELECT r.series, r.ts, r.value AS actual, p.value AS pred FROM run r JOIN hw ON hw.series = r.series
      JOIN run p ON p.series = r.series AND p.ts = r.ts - INTERVAL 3 DAY WHERE r.ts >= hw.holdout_start),
    past AS (SELECT g.series, g.ts, g.value, last_value(CASE WHEN value IS NOT NULL THEN g.ts END IGNORE NULLS) OVER a AS t0,
        last_value(value IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN value IS NOT NULL THEN g.ts END IGNORE NULLS) OVER b AS t1,
        first_value(value IGNORE NULLS) OVER b AS v1 FROM ship_grid g JOIN hw ON hw.series = g.series WHERE g.ts < hw.holdout_start
      WINDOW a AS (PARTITION BY g.series ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY g.series ORDER BY g.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT series, ts, CASE WHEN value IS NOT NULL THEN value WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
      ELSE v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END AS f FROM past),
    sc AS (SELECT series, avg(d) AS scale FROM (SELECT series, abs(f - lag(f, {M}) OVER (PARTITION BY series ORDER BY ts)) AS d FROM f) GROUP BY 1)
    SELECT p.series, 'lag3' AS model, round(sqrt(avg((actual - pred) * (actual - pred))), 6) AS rmse, round(avg(abs(actual - pred)), 6) AS mae,
      round(avg(abs(actual - pred)) / any_value(scale), 6) AS mase, count(*) AS n_eval FROM pairs p JOIN sc ON sc.series = p.series GROUP BY 1""",
)
def r3(spark, sf):
    rows = ship_rows(spark, sf)
    windows = window(rows)
    observed = rows.where("value is not null").select("series", "ts", "value")
    held = observed.join(windows, "series").where("ts >= holdout_start and ts <= eval_end")
    earlier = observed.select("series", (F.col("ts") + F.expr("interval 3 days")).alias("ts"), F.col("value").alias("pred"))
    forecasts = held.join(earlier, ["series", "ts"]).select(
        "series", F.lit("lag3").alias("model"), "ts", F.col("value").alias("actual"), "pred"
    )
    return forecast.backtest_metrics(forecasts, rows, windows, m=M, step=DAY)
