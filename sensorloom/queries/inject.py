"""Queries A1 to A6: synthetic anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import attach
from sensorloom.operators import inject
from sensorloom.queries.detect import RUN, ship_run
from sensorloom.queries.registry import query
from sensorloom.session import cut

SEED = 13


def cases(spark, sf):
    """Longest runs of the shipping series, numbered from 0."""
    rows = ship_run(spark, sf)
    first = rows.groupBy("series").agg(F.min("ts").alias("t0"))
    pos = F.datediff("ts", "t0").cast("bigint")
    return cut(attach(rows, first).select("series", "blk", pos.alias("pos"), "ts", "value"))


def _u(kind: str, what: str, extra: str = "series, j", seed: int = SEED) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{kind}', {extra}, '{what}')), 1, 13))::BIGINT / 4503599627370496.0)"


def _normal(kind: str, extra: str, seed: int) -> str:
    return f"sqrt(-2.0 * ln(1.0 - {_u(kind, 'r', extra, seed)})) * cos(2.0 * pi() * {_u(kind, 'a', extra, seed)})"


def _length(kind: str, seed: int, extra: str = "series, j") -> str:
    low, high = inject.PROFILE[kind][1]
    return f"({low} + floor({_u(kind, 'length', extra, seed)} * {high + 1 - low})::BIGINT)" if low < high else f"{low}"


def _spread(kind: str, seed: int) -> str:
    """Anomalies of one kind anywhere in the series of ``sizes``."""
    return f"""SELECT series, '{kind}' AS kind, j, floor({_u(kind, 'start', seed=seed)} * greatest(1, n - len))::BIGINT AS start, len,
      {_u(kind, 'way', seed=seed)} >= 0.5 AS up FROM (SELECT *, least({_length(kind, seed)}, n) AS len FROM (
        SELECT series, n, unnest(range(0, CASE WHEN n >= {inject.MIN_POINTS} THEN greatest(1, n // {inject.PROFILE[kind][0]}) ELSE 0 END)) AS j FROM sizes))"""


def _slotted(kind: str, seed: int) -> str:
    """One anomaly of a kind in its quarter of each series of ``sizes``."""
    i, j = inject.KINDS.index(kind), "series, 0"
    return f"""SELECT series, '{kind}' AS kind, 0 AS j, least(low + floor({_u(kind, 'start', j, seed)} * (greatest(low + 1, slot * {i + 1} - len - 1) - low))::BIGINT, n - len) AS start,
      len, {_u(kind, 'way', j, seed)} >= 0.5 AS up FROM (
        SELECT *, slot * {i} + 1 AS low, least({_length(kind, seed, j)}, greatest(1, slot - 2)) AS len FROM (
          SELECT *, greatest(1, n // {len(inject.KINDS)}) AS slot FROM sizes))"""


def injected_sql(source: str, kinds, seed: int = SEED, place=_spread) -> str:
    """CTEs from ``source (series, pos, value)`` to ``placed`` and ``injected (series, pos, value, label)``."""
    noise = f"2.0 * {_normal('noise', 'series, j, pos', seed)}"
    drift = _normal("drift", "t.series, p.j, i - 1 - p.start", seed)
    share = "coalesce((i - 1 - p.start) / nullif(p.len - 1, 0), 0)"
    centre = "list_avg(t.vals[p.start + 1:p.start + p.len])"
    return f"""sizes AS (SELECT series, count(*) AS n, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS std FROM {source} GROUP BY 1),
    placed AS ({' UNION ALL '.join(place(k, seed) for k in kinds)}),
    points AS (SELECT *, start + unnest(range(0, len)) AS pos FROM placed),
    change AS (SELECT series, pos, sum(CASE WHEN kind = 'spikes' THEN CASE WHEN up THEN 4.0 ELSE -4.0 END ELSE 0 END) AS more,
      product(CASE WHEN kind = 'scale' THEN CASE WHEN up THEN 2.0 ELSE 0.25 END ELSE 1.0 END) AS times,
      sum(CASE WHEN kind = 'noise' THEN {noise} ELSE 0 END) AS noise FROM points GROUP BY 1, 2),
    still AS (SELECT r.series, r.pos, s.std, (c.pos IS NOT NULL)::INT AS label,
      CASE WHEN c.pos IS NULL THEN r.value ELSE (r.value + c.more * s.std) * c.times + c.noise * s.std END AS value
      FROM {source} r JOIN sizes s ON s.series = r.series LEFT JOIN change c ON c.series = r.series AND c.pos = r.pos),
    drifts AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY j, start) AS k FROM placed WHERE kind = 'drift'),
    turns(series, k, std, vals) AS (SELECT series, 0, any_value(std), list(value ORDER BY pos) FROM still GROUP BY series
      UNION ALL SELECT t.series, t.k + 1, t.std, list_transform(t.vals, lambda x, i: CASE WHEN i - 1 < p.start OR i - 1 >= p.start + p.len THEN x ELSE
        {centre} + (x - {centre}) * (1.0 + {share}) + t.std * (CASE WHEN p.up THEN 3.0 ELSE -3.0 END * {share} * {share} + {drift} * 0.3 * {share}) END)
      FROM turns t JOIN drifts p ON p.series = t.series AND p.k = t.k + 1),
    moved AS (SELECT series, unnest(vals) AS value, unnest(range(0, len(vals))) AS pos FROM (SELECT series, arg_max(vals, k) AS vals FROM turns GROUP BY 1)),
    injected AS (SELECT s.series, s.pos, m.value, s.label FROM still s JOIN moved m ON m.series = s.series AND m.pos = s.pos)"""


# The CTEs of an injection loop, so the whole statement must allow it.
RECURSIVE_RUN = RUN.replace("WITH ", "WITH RECURSIVE ", 1)
_OUT = " SELECT series, pos, round(value, 6) AS value, label FROM injected"


def _query(kinds, place=_spread, out: str = _OUT) -> str:
    return f"{RECURSIVE_RUN}, {injected_sql('run', kinds, place=place)}{out}"


def _injected(spark, sf, kinds):
    return inject.inject(cases(spark, sf), SEED, kinds).select("series", "pos", "value", "label")


@query("A1_spikes", _query(["spikes"]))
def a1(spark, sf):
    return _injected(spark, sf, ["spikes"])


@query("A2_scale", _query(["scale"]))
def a2(spark, sf):
    return _injected(spark, sf, ["scale"])


@query("A3_noise", _query(["noise"]))
def a3(spark, sf):
    return _injected(spark, sf, ["noise"])


@query("A4_drift", _query(["drift"]))
def a4(spark, sf):
    return _injected(spark, sf, ["drift"])


@query("A5_combined_injection", _query(inject.KINDS))
def a5(spark, sf):
    return _injected(spark, sf, list(inject.KINDS))


@query(
    "A6_one_of_each",
    _query(inject.KINDS, _slotted, """ SELECT i.series, i.pos, round(i.value, 6) AS value, i.label, p.kind, p.start, p.len, p.up::INT AS up
      FROM injected i LEFT JOIN points p ON p.series = i.series AND p.pos = i.pos"""),
)
def a6(spark, sf):
    rows, table = inject.inject_one_of_each(cases(spark, sf), SEED)
    where = inject.points_of(table).drop("j").withColumn("up", F.col("up").cast("int"))
    return rows.select("series", "pos", "value", "label").join(where, ["series", "pos"], "left")
