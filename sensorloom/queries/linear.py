"""Least squares and the linear forecasters in SQL: sums, elimination, rolling ahead."""

from __future__ import annotations

from sensorloom.operators import forecast

LAGS, K = 28, 5
RIDGE = forecast.RIDGE
_HALF = (forecast.SMOOTH - 1) // 2


def smoothed(x: str) -> str:
    """Moving average of the list ``x`` of lags, its ends held."""
    return f"""list_transform({x}, lambda v, i: list_avg(list_transform(range(0, {forecast.SMOOTH}),
      lambda s: {x}[greatest(1, least({LAGS}, i - {_HALF} + s))])))"""


# What each model sees of a context ``x`` of lags, and what it adds to its targets' forecast.
SEEN = {
    "LinearRegression": "x",
    "NLinear": f"list_transform(x[1:{LAGS - 1}], lambda v: v - x[{LAGS}])",
    "DLinear": f"list_concat({smoothed('x')}, list_transform(list_zip(x, {smoothed('x')}), lambda p: p[1] - p[2]))",
}
BASE = {"LinearRegression": "0", "NLinear": f"x[{LAGS}]", "DLinear": "0"}
TARGETS = {"LinearRegression": 1, "NLinear": K, "DLinear": K}


def eliminated_sql(source: str, name: str, keys: str) -> str:
    """CTE ``name (keys, k, m)``: ``source (keys, m)``, rows of a square matrix and right sides, after each column.

    At ``k = len(m)`` the matrix is the identity and the right sides are the solution.
    """
    return f"""{name} AS (SELECT {keys}, 0 AS k, m FROM {source}
      UNION ALL SELECT {keys}, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1
        THEN list_transform(r, lambda v: v / r[k + 1])
        ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {name} WHERE k < len(m))"""


def solved_sql(source: str, name: str, keys: str, ridge: str) -> str:
    """CTEs to ``name (keys, mf, my, w)`` from ``source (keys, f, y)``: means, and weights ``w[feature][target]``.

    ``ridge`` is added to the diagonal of the features' covariance; the system is
    eliminated column by column.
    """
    on = " AND ".join(f"s.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    part = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name}_z AS (SELECT {keys}, list_concat(f, y) AS z, len(f) AS nf, row_number() OVER () AS id FROM {source}),
    {name}_l AS (SELECT {keys}, id, nf, unnest(z) AS v, unnest(range(1, len(z) + 1)) AS i FROM {name}_z),
    {name}_m AS (SELECT {keys}, i, avg(v) AS mean, any_value(nf) AS nf FROM {name}_l GROUP BY {keys}, i),
    {name}_c AS (SELECT {part}, s.id, s.i, s.nf, s.v - m.mean AS v FROM {name}_l s JOIN {name}_m m ON {on} AND s.i = m.i),
    {name}_g AS (SELECT {part}, s.i, m.i AS j, avg(s.v * m.v) + CASE WHEN s.i = m.i THEN {ridge} ELSE 0 END AS g
      FROM {name}_c s JOIN {name}_c m ON {on} AND s.id = m.id WHERE s.i <= s.nf GROUP BY {part}, s.i, m.i),
    {name}_r AS (SELECT {keys}, i, list(g ORDER BY j) AS r FROM {name}_g GROUP BY {keys}, i),
    {name}_h AS (SELECT {keys}, list(r ORDER BY i) AS m FROM {name}_r GROUP BY {keys}),
    {eliminated_sql(f'{name}_h', f'{name}_e', keys)},
    {name} AS (SELECT {keys}, mf, my, list_transform(done, lambda r: r[len(done) + 1:]) AS w FROM (
      SELECT {part}, any_value(s.m) AS done, list(m.mean ORDER BY i) FILTER (i <= nf) AS mf,
        list(m.mean ORDER BY i) FILTER (i > nf) AS my FROM {name}_e s JOIN {name}_m m ON {on} WHERE s.k = len(s.m) GROUP BY {part}))"""


def samples_sql(train: str) -> str:
    """CTEs from gap-free ``train (series, segment, ts, value)`` to ``unit (series, mean, std)`` and scaled ``samples (series, x, y)``."""
    return f"""unit AS (SELECT series, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS std FROM {train} GROUP BY 1),
    lines AS (SELECT t.series, segment, list((value - mean) / std ORDER BY ts) AS vals FROM {train} t JOIN unit u ON u.series = t.series GROUP BY 1, 2),
    samples AS (SELECT series, vals[s + 1:s + {LAGS}] AS x, vals[s + {LAGS} + 1:s + {LAGS + K}] AS y FROM (
      SELECT *, unnest(range(0, len(vals) - {LAGS + K - 1})) AS s FROM lines WHERE len(vals) >= {LAGS + K}))"""


def ahead(name: str) -> str:
    """The model's values behind the context ``x``, from the columns of its solution."""
    return f"""list_transform(my, lambda c, h: c + {BASE[name]} + list_sum(list_transform(list_zip({SEEN[name]}, mf, w),
      lambda p: (p[1] - p[2]) * p[3][h])))"""
