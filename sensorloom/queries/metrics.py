"""Queries M1 to M8, E14 and E16: supervised detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY
from sensorloom.operators import metrics, screen
from sensorloom.operators.inject import KINDS
from sensorloom.plans import cleaning
from sensorloom.queries import views as V
from sensorloom.queries.detect import RUN, z_sql
from sensorloom.queries.inject import cases, injected_sql
from sensorloom.queries.registry import query
from sensorloom.session import cut

_DOCS = """WITH s AS (SELECT d.lang AS series, d.n_chars::DOUBLE AS score, l.toxic AS label
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def documents(spark, sf, label="toxic", group="lang"):
    """Document length as score, the toxic label as truth, one case per language."""
    docs = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id")
    return docs.select(
        F.lit("n_chars").alias("detector"), F.col(group).alias("series"),
        F.col("n_chars").cast("double").alias("score"), F.col(label).alias("label"),
    )


_AUROC = """SELECT a.series, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auroc
    FROM s a JOIN s b ON a.series = b.series AND a.label = 1 AND b.label = 0 GROUP BY 1"""


# Languages without a document of either kind have no value.
_ALL = " FROM (SELECT DISTINCT series FROM s) c LEFT JOIN ({0}) m ON m.series = c.series"


@query("M1_auroc", _DOCS + " SELECT c.series, round(auroc, 6) AS auroc" + _ALL.format(_AUROC))
def m1(spark, sf):
    return metrics.ranking_metrics(documents(spark, sf)).select("series", "auroc")


_AP = """SELECT series, sum(p * precision) / max(hits) AS aupr FROM (
      SELECT series, p, sum(p) OVER w AS hits, sum(p) OVER w / sum(c) OVER w AS precision FROM (
        SELECT series, score, sum(label) AS p, count(*) AS c FROM s GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY series ORDER BY score DESC)) GROUP BY 1 HAVING max(hits) > 0"""


@query("M2_average_precision", _DOCS + " SELECT c.series, round(aupr, 6) AS aupr" + _ALL.format(_AP))
def m2(spark, sf):
    return metrics.ranking_metrics(documents(spark, sf)).select("series", "aupr")


# Labelled runs of 9 rows, some of 4, against the modified z-score of the values.
_LABEL = "(pos % 211 < 9 OR pos % 307 BETWEEN 20 AND 23)"
LABELLED = RUN + f""", z AS ({z_sql('run', 'series')}),
    s AS (SELECT r.series, r.pos, round(z.score, 9) AS score, {_LABEL}::INT AS label FROM run r JOIN z ON z.series = r.series AND z.ts = r.ts),
    lr AS (SELECT series, min(pos) AS s, max(pos) AS e FROM (SELECT series, pos,
      pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS g FROM s WHERE label = 1) GROUP BY series, g),
    tol AS (SELECT series, greatest(1, floor(quantile_cont(e - s + 1, 0.5)))::BIGINT AS tolerance FROM lr GROUP BY 1)"""


def labelled(spark, sf):
    from sensorloom.operators import detect

    rows = cases(spark, sf)
    label = (F.pmod("pos", F.lit(211)) < 9) | F.pmod("pos", F.lit(307)).between(20, 23)
    scores = detect.modified_z(rows, ready=True)
    return cut(
        rows.join(scores, ["series", "ts"]).select(
            F.lit("z").alias("detector"), "series", "pos", F.round("score", 9).alias("score"), label.cast("int").alias("label")
        )
    )


@query("M3_tolerance", LABELLED + " SELECT series, tolerance FROM tol")
def m3(spark, sf):
    rows = labelled(spark, sf)
    return metrics.tolerances(rows, metrics.label_runs(rows))


_VUS = LABELLED + """, sizes AS (SELECT series, count(*) AS n, sum(label) AS positives FROM s GROUP BY 1),
    ws AS (SELECT series, unnest(range(0, tolerance + 1)) AS w FROM tol),
    grown AS (SELECT series, w, s, e, sum(opens) OVER (PARTITION BY series, w ORDER BY s) AS span FROM (
      SELECT l.series, w.w, l.s, l.e, CASE WHEN l.s - lag(l.e) OVER (PARTITION BY l.series, w.w ORDER BY l.s) <= 2 * (w.w // 2) THEN 0 ELSE 1 END AS opens
      FROM lr l JOIN ws w ON w.series = l.series)),
    side AS (SELECT g.series, g.w, g.span, s.pos, s.score, s.label,
        CASE WHEN s.pos BETWEEN g.s AND g.e THEN 0 ELSE sqrt(1 - greatest(g.s - s.pos, s.pos - g.e) / g.w) END AS x
      FROM grown g JOIN s ON s.series = g.series AND s.pos BETWEEN g.s - g.w // 2 AND g.e + g.w // 2),
    soft AS (SELECT series, w, span, pos, score, least(1, max(label) + sum(x)) AS soft FROM side GROUP BY 1, 2, 3, 4, 5),
    thr AS (SELECT z.series, i, r.score AS t FROM (SELECT series, n, unnest(range(0, 250)) AS i FROM sizes) z
      JOIN (SELECT series, score, row_number() OVER (PARTITION BY series ORDER BY score DESC) - 1 AS k FROM s) r
      ON r.series = z.series AND r.k = z.i * (z.n - 1) // 249),
    np AS (SELECT t.series, t.i, count(*) AS np FROM thr t JOIN s ON s.series = t.series AND s.score >= t.t GROUP BY 1, 2),
    hit AS (SELECT t.series, t.i, f.w, sum(CASE WHEN f.score >= t.t THEN soft ELSE 0 END) AS hit, sum(soft) AS total,
        count(DISTINCT CASE WHEN f.score >= t.t THEN span END) / count(DISTINCT span) AS ex
      FROM thr t JOIN soft f ON f.series = t.series GROUP BY 1, 2, 3),
    curve AS (SELECT h.series, h.w, h.i, least(1, hit / ((positives + total) / 2)) * ex AS tpr,
        (np - hit) / (n - (positives + total) / 2) AS fpr, hit / np AS prec
      FROM hit h JOIN np ON np.series = h.series AND np.i = h.i JOIN sizes z ON z.series = h.series),
    steps AS (SELECT *, lag(tpr, 1, 0) OVER c AS tpr0, lag(fpr, 1, 0) OVER c AS fpr0 FROM curve
      WINDOW c AS (PARTITION BY series, w ORDER BY i)),
    areas AS (SELECT series, w, sum((fpr - fpr0) * (tpr + tpr0) / 2 + CASE WHEN i = 249 THEN (1 - fpr) * (1 + tpr) / 2 ELSE 0 END) AS roc,
      sum((tpr - tpr0) * prec) AS pr FROM steps GROUP BY 1, 2)"""


def _volumes(spark, sf):
    rows = labelled(spark, sf)
    found = cut(metrics.label_runs(rows))
    return metrics.volumes(rows, found, metrics.tolerances(rows, found))


@query("M4_vus_roc", _VUS + " SELECT series, round(avg(roc), 6) AS vus_roc FROM areas GROUP BY 1")
def m4(spark, sf):
    return _volumes(spark, sf).select("series", "vus_roc")


@query("M5_vus_pr", _VUS + " SELECT series, round(avg(pr), 6) AS vus_pr FROM areas GROUP BY 1")
def m5(spark, sf):
    return _volumes(spark, sf).select("series", "vus_pr")


_MARKS = """, nm AS (SELECT series, pos, label, (score - min(score) OVER (PARTITION BY series)) /
        (max(score) OVER (PARTITION BY series) - min(score) OVER (PARTITION BY series)) AS norm FROM s),
    pe AS (SELECT series, min(pos) AS start, max(pos) + 1 AS stop FROM (SELECT series, pos,
      pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS g FROM nm WHERE norm > 0.5) GROUP BY series, g)"""


@query(
    "M6_events",
    LABELLED + _MARKS + """ SELECT 'predicted' AS kind, series, start, stop FROM pe UNION ALL SELECT 'true', series, s, e + 1 FROM lr""",
)
def m6(spark, sf):
    rows = labelled(spark, sf)
    predicted = metrics.prediction_events(screen.normalise(rows, metrics.CASE, ready=True)).drop("detector")
    truth = metrics.events(rows.withColumn("mark", F.col("label") == 1))
    return predicted.withColumn("kind", F.lit("predicted")).unionByName(truth.withColumn("kind", F.lit("true")))


def _beyond(d1: str, d2: str) -> str:
    """Share of the zone farther away than the distances ``d1 .. d2``, integrated."""
    area = lambda room: f"(power(greatest({room} - {d1}, 0), 2) - power(greatest({room} - {d2}, 0), 2)) / 2"
    return f"CASE WHEN {d2} > {d1} THEN ({area('(start - z0)')} + {area('(z1 - stop)')}) / (z1 - z0) ELSE 0 END"


def _side(low: str, high: str, room: str) -> str:
    turn = f"greatest({low}, least({high}, {room} / 2))"
    return f"({high} - {low}) - (power({turn}, 2) - power({low}, 2) + {room} * ({high} - {turn})) / (z1 - z0)"


_MIDDLE = "greatest(h0, least(h1, CASE WHEN c0 IS NULL THEN z0 WHEN c1 IS NULL THEN z1 ELSE (c0 + c1) / 2 END))"


@query(
    "M7_affiliation",
    LABELLED + _MARKS + f""", zo AS (SELECT l.series, s AS start, e + 1 AS stop,
        coalesce((lag(e + 1) OVER w + s) / 2.0, 0.0) AS z0, coalesce((e + 1 + lead(s) OVER w) / 2.0, n) AS z1
      FROM lr l JOIN (SELECT series, count(*)::DOUBLE AS n FROM s GROUP BY 1) c ON c.series = l.series
      WINDOW w AS (PARTITION BY l.series ORDER BY s)),
    pc AS (SELECT zo.*, greatest(p.start, z0)::DOUBLE AS a, least(p.stop, z1)::DOUBLE AS b FROM zo JOIN pe p
      ON p.series = zo.series AND p.start < z1 AND p.stop > z0),
    pr AS (SELECT series, start, sum(greatest(least(b, stop) - greatest(a, start), 0)) AS covered,
      sum(greatest(least(b, stop) - greatest(a, start), 0)
        + {_beyond('greatest(start - least(b, start), 0)', 'greatest(start - a, 0)')}
        + {_beyond('greatest(greatest(a, stop) - stop, 0)', 'greatest(b - stop, 0)')}) / sum(b - a) AS prec FROM pc GROUP BY 1, 2),
    ends AS (SELECT *, lag(b) OVER w AS c0, a AS c1, lead(a) OVER w AS later FROM pc WINDOW w AS (PARTITION BY series, start ORDER BY a)),
    holes AS (SELECT *, greatest(coalesce(c0, z0), start) AS h0, least(coalesce(c1, z1), stop) AS h1 FROM (
      SELECT series, start, stop, z0, z1, c0, c1 FROM ends UNION ALL
      SELECT series, start, stop, z0, z1, b, NULL FROM ends WHERE later IS NULL)),
    gains AS (SELECT series, start, sum(coalesce(CASE WHEN c0 IS NOT NULL THEN {_side('(h0 - c0)', f'({_MIDDLE} - c0)', '(z1 - c0)')} END, 0)
      + coalesce(CASE WHEN c1 IS NOT NULL THEN {_side('(c1 - h1)', f'(c1 - {_MIDDLE})', '(c1 - z0)')} END, 0)) AS gain
      FROM holes WHERE h1 > h0 GROUP BY 1, 2),
    zs AS (SELECT zo.series, prec, CASE WHEN prec IS NULL THEN 0 ELSE (covered + coalesce(gain, 0)) / (stop - zo.start) END AS rec FROM zo
      LEFT JOIN pr ON pr.series = zo.series AND pr.start = zo.start LEFT JOIN gains g ON g.series = zo.series AND g.start = zo.start),
    af AS (SELECT series, coalesce(avg(prec), 0) AS p, coalesce(avg(rec), 0) AS r FROM zs GROUP BY 1)
    SELECT series, round(p, 6) AS affiliation_precision, round(r, 6) AS affiliation_recall,
      round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS affiliation_f1 FROM af""",
)
def m7(spark, sf):
    rows = labelled(spark, sf)
    keys = metrics.CASE
    predicted = metrics.prediction_events(screen.normalise(rows, keys, ready=True))
    truth = metrics.events(rows.withColumn("mark", F.col("label") == 1), keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return metrics.affiliation(predicted, truth, sizes).drop("detector")


@query(
    "M8_zero_without_positives",
    _DOCS.replace("d.lang", "d.source || '/' || l.quality || '/' || d.n_chars % 40")
    + f""" SELECT c.series, round(CASE WHEN c.p = 0 THEN 0 ELSE auroc END, 6) AS auroc, round(CASE WHEN c.p = 0 THEN 0 ELSE aupr END, 6) AS aupr
      FROM (SELECT series, sum(label) AS p FROM s GROUP BY 1) c LEFT JOIN ({_AUROC}) a ON a.series = c.series LEFT JOIN ({_AP}) b ON b.series = c.series""",
)
def m8(spark, sf):
    # Many small cases, most of them without a toxic document.
    docs = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id")
    small = docs.withColumn(
        "case", F.concat_ws("/", "source", F.col("quality").cast("string"), (F.col("n_chars") % 40).cast("string"))
    ).select(
        F.lit("n_chars").alias("detector"), F.col("case").alias("series"),
        F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"),
    )
    positives = small.groupBy(*metrics.CASE).agg(F.sum("label").alias("_positive"))
    found = positives.join(metrics.ranking_metrics(small), list(metrics.CASE), "left")
    return metrics.zero_without_positives(found, ["auroc", "aupr"]).drop("detector")


# Longest clean runs of trustworthy hours without repeats, and an injection of either seed.
_BUILT = f"""WITH {V.OBS}, {V.SLOTS}, {V.GRID5}, {V.frozen_sql('grid5')}, {V.hourly_sql(1)},
    kept AS (SELECT series, ts, value FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts) AS prev FROM hourly)
      WHERE NOT (value IS NOT NULL AND coalesce(prev = value, false))), {V.segments_sql('kept')},
    run AS (SELECT series, ts AS orig_ts, value, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos FROM (
      SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY segment_len DESC, segment) AS r FROM segments)
      WHERE r = 1 AND segment_len >= 24)"""


def _injection(name: str, seed: int) -> str:
    return f"""SELECT i.series, '{name}' AS injection, i.pos, r.orig_ts, round(i.value, 6) AS value, i.label FROM (
      WITH RECURSIVE {injected_sql('run', KINDS, seed)} SELECT * FROM injected) i JOIN run r ON r.series = i.series AND r.pos = i.pos"""


@query(
    "E14_evaluation_cases",
    f"{_BUILT} {_injection('select', cleaning.SEED)} UNION ALL {_injection('eval', cleaning.EVAL_SEED)}",
)
def e14(spark, sf):
    built = cleaning.build_cases(V.slots(spark, sf), V.LIMIT, min_points=24, min_useful=1)
    return cleaning.synthetic_cases(built).select("series", "injection", "pos", "orig_ts", "value", "label")


@query("E16_synthetic_benchmark")
def e16(spark, sf):
    return cleaning.benchmark_synthetic(cases(spark, sf), ["ModifiedZScore", "IQR", "Hampel_w24", "Hampel_w6"], step=DAY)
