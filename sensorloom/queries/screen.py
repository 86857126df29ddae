"""Queries E1 to E18: thresholds, screening, consensus, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY
from sensorloom.operators import registry, screen
from sensorloom.plans import cleaning
from sensorloom.queries import views as V
from sensorloom.queries.detect import RUN, SEGMENTS, daily_segments, hampel_sql, iqr_sql, ship_run, z_sql
from sensorloom.queries.registry import query
from sensorloom.session import cut
from sensorloom.sources import store

DETECTORS = ["ModifiedZScore", "IQR", "Hampel_w24", "Hampel_w6"]
GROUP = ["detector", "series", "segment"]


def segment_scores(spark, sf):
    """Scores of four detectors on every observed stretch of the daily series."""
    rows = cut(daily_segments(spark, sf))
    return cleaning.score_all(rows, DETECTORS, keys=cleaning.SEGMENT, step=DAY)


def run_scoring(spark, sf):
    """Scores of the same detectors on the longest run of the shipping series, with what they took."""
    rows = cut(ship_run(spark, sf).drop("segment"))
    return cleaning.score_segments(rows, DETECTORS, keys=["series"], step=DAY)


def union_sql(source: str, keys: str) -> str:
    parts = {
        "ModifiedZScore": z_sql(source, keys), "IQR": iqr_sql(source, keys),
        "Hampel_w24": hampel_sql(source, keys, 24), "Hampel_w6": hampel_sql(source, keys, 6),
    }
    return " UNION ALL ".join(f"SELECT '{n}' AS detector, {keys}, ts, score FROM ({s})" for n, s in parts.items())


def flags_sql(source: str, keys: str, name: str) -> str:
    """CTEs <name>_t (thresholds) and <name> (scores with flag)."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    part = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name}_m AS (SELECT {keys}, quantile_cont(score, 0.5) AS med FROM {source} GROUP BY {keys}),
    {name}_t AS (SELECT {part}, any_value(m.med) + 3.5 * 1.4826 * quantile_cont(abs(s.score - m.med), 0.5) AS threshold
      FROM {source} s JOIN {name}_m m ON {on('s', 'm')} GROUP BY {part}),
    {name} AS (SELECT s.*, t.threshold, s.score > t.threshold AS flag FROM {source} s JOIN {name}_t t ON {on('s', 't')})"""


def norm_sql(source: str, keys: str, name: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS norm FROM (
      SELECT *, min(score) OVER (PARTITION BY {keys}) AS lo, max(score) OVER (PARTITION BY {keys}) AS hi FROM {source}))"""


KEYS = "detector, series, segment"
SCORES = SEGMENTS + f", scores AS ({union_sql('seg', 'series, segment')})"
FLAGS = SCORES + f", {flags_sql('scores', KEYS, 'flags')}"
NORMED = SCORES + f", {norm_sql('scores', KEYS, 'normed')}"
RUN_SCORES = RUN + f", scores AS ({union_sql('run', 'series')})"


@query("E1_normalised_scores", NORMED + f" SELECT {KEYS}, ts, round(norm, 6) AS norm FROM normed")
def e1(spark, sf):
    return screen.normalise(segment_scores(spark, sf), GROUP, ready=True).drop("score")


@query("E2_robust_threshold", FLAGS + f" SELECT {KEYS}, round(threshold, 6) AS threshold FROM flags_t")
def e2(spark, sf):
    return screen.thresholds(segment_scores(spark, sf), GROUP, ready=True)


@query("E3_flags", FLAGS + f" SELECT {KEYS}, ts, flag FROM flags")
def e3(spark, sf):
    return screen.flag(segment_scores(spark, sf), GROUP, ready=True).select(*GROUP, "ts", "flag")


@query(
    "E4_detection_rate",
    FLAGS + f" SELECT {KEYS}, count(*) FILTER (flag) AS n_flagged, count(*) AS n_points, round(avg(flag::INT), 6) AS rate FROM flags GROUP BY {KEYS}",
)
def e4(spark, sf):
    return screen.detection_rates(screen.flag(segment_scores(spark, sf), GROUP, ready=True), GROUP)


_POOLED = ", pooled AS (SELECT detector, series, count(*) FILTER (flag) AS n_flagged, count(*) AS n_points, avg(flag::INT) AS rate FROM flags GROUP BY 1, 2)"


@query("E5_pooled_rate", FLAGS + _POOLED + " SELECT detector, series, n_flagged, n_points, round(rate, 6) AS rate FROM pooled")
def e5(spark, sf):
    return screen.pooled_rates(screen.flag(segment_scores(spark, sf), GROUP, ready=True))


@query(
    "E6_macro_rate_screen",
    FLAGS + _POOLED + " SELECT detector, round(avg(rate), 6) AS macro_rate, avg(rate) <= 0.07 AS kept FROM pooled GROUP BY 1",
)
def e6(spark, sf):
    return screen.split_by_rate(screen.pooled_rates(screen.flag(segment_scores(spark, sf), GROUP, ready=True)))


@query(
    "E7_top_detectors",
    FLAGS + _POOLED
    + """ SELECT series, detector, round(metric, 6) AS metric, rank FROM (SELECT series, detector, rate AS metric,
      row_number() OVER (PARTITION BY series ORDER BY rate DESC, detector) AS rank FROM pooled) WHERE rank <= 3""",
)
def e7(spark, sf):
    rates = screen.pooled_rates(screen.flag(segment_scores(spark, sf), GROUP, ready=True))
    metrics = rates.select("series", "detector", F.col("rate").alias("metric"))
    return screen.rank_top_k(metrics, 3).withColumn("rank", F.col("rank").cast("bigint"))


def normed(spark, sf):
    return screen.normalise(segment_scores(spark, sf), GROUP, ready=True)


@query(
    "E8_consensus_average",
    NORMED
    + """, w(detector, weight) AS (VALUES ('ModifiedZScore', 0.5), ('IQR', 0.2), ('Hampel_w24', 0.9), ('Hampel_w6', 0.4))
    SELECT 'plain' AS kind, series, segment, ts, round(avg(norm), 6) AS score FROM normed GROUP BY 2, 3, 4
    UNION ALL SELECT 'weighted', series, segment, ts, round(sum(weight * norm) / sum(weight), 6) FROM normed
      JOIN w ON w.detector = normed.detector GROUP BY 2, 3, 4""",
)
def e8(spark, sf):
    scaled = normed(spark, sf)
    weights = spark.createDataFrame(
        [("ModifiedZScore", 0.5), ("IQR", 0.2), ("Hampel_w24", 0.9), ("Hampel_w6", 0.4)], "detector string, weight double"
    )
    plain = screen.consensus(scaled, cleaning.SEGMENT)
    weighted = screen.consensus(scaled, cleaning.SEGMENT, weights=weights)
    return plain.withColumn("kind", F.lit("plain")).unionByName(weighted.withColumn("kind", F.lit("weighted")))


@query("E9_consensus_max", NORMED + " SELECT series, segment, ts, round(max(norm), 6) AS score FROM normed GROUP BY 1, 2, 3")
def e9(spark, sf):
    return screen.consensus(normed(spark, sf), cleaning.SEGMENT, "MAX")


# Three copies of the detectors, so that buckets of five differ.
@query(
    "E10_consensus_average_of_maxima",
    NORMED
    + """, many AS (SELECT detector || '_' || i AS detector, series, segment, ts, pow(norm, 1 + i) AS norm
      FROM normed, (SELECT unnest(range(0, 3)) AS i)),
    names AS (SELECT DISTINCT detector FROM many),
    buckets AS (SELECT * FROM (SELECT b AS bucket, detector, row_number() OVER (PARTITION BY b ORDER BY
      ('0x' || substr(md5(concat_ws('|', '13', 'bucket', b, detector)), 1, 13))::BIGINT, detector) AS k
      FROM names, (SELECT unnest(range(0, 20)) AS b)) WHERE k <= 5)
    SELECT series, segment, ts, round(avg(peak), 6) AS score FROM (
      SELECT series, segment, ts, bucket, max(norm) AS peak FROM many JOIN buckets ON buckets.detector = many.detector
      GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
)
def e10(spark, sf):
    copies = normed(spark, sf).withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        F.concat_ws("_", "detector", "i").alias("detector"), "series", "segment", "ts",
        F.pow("norm", F.col("i") + 1).alias("norm"),
    )
    return screen.consensus(copies, cleaning.SEGMENT, "AOM", seed=13)


def _brittle(values, seed):
    """Distance from the mean in deviations; cannot cope with short or constant stretches."""
    if len(values) < 12:
        raise ValueError("too short")
    return abs(values - values.mean()) / values.std()


def _broken(df, **_):
    raise RuntimeError("model file not found")


FAILING = {"Brittle": registry.Detector(registry.by_segment(_brittle)), "Broken": registry.Detector(_broken)}


@query(
    "E11_score_segments",
    SCORES + f""", sized AS (SELECT *, count(*) OVER (PARTITION BY series, segment) AS n, avg(value) OVER (PARTITION BY series, segment) AS m,
      stddev_pop(value) OVER (PARTITION BY series, segment) AS sd FROM seg),
    given(detector) AS (VALUES ('ModifiedZScore'), ('IQR'), ('Hampel_w24'), ('Hampel_w6'), ('Brittle'), ('Broken'))
    SELECT 'score' AS kind, {KEYS}, ts, round(score, 6) AS score, NULL AS error FROM scores
    UNION ALL SELECT 'score', 'Brittle', series, segment, ts, round(abs(value - m) / sd, 6), NULL FROM sized WHERE n >= 12
    UNION ALL SELECT DISTINCT 'status', detector, series, segment, NULL::TIMESTAMP, NULL::DOUBLE,
      CASE WHEN detector = 'Broken' THEN 'RuntimeError: model file not found'
        WHEN detector = 'Brittle' AND n < 12 THEN 'ValueError: too short' END FROM sized, given""",
)
def e11(spark, sf):
    rows = cut(daily_segments(spark, sf))
    names = [*DETECTORS, *FAILING]
    done = cleaning.score_segments(rows, names, keys=cleaning.SEGMENT, step=DAY, extra=FAILING)
    nothing = lambda kind: F.lit(None).cast(kind)
    scores = done.scores.select(F.lit("score").alias("kind"), *GROUP, "ts", "score", nothing("string").alias("error"))
    return scores.unionByName(done.status.select(
        F.lit("status").alias("kind"), *GROUP, nothing("timestamp").alias("ts"), nothing("double").alias("score"), "error"
    ))


_FINAL = (
    FLAGS
    + _POOLED
    + f""", {norm_sql('scores', KEYS, 'normed')}, fused AS (SELECT series, segment, ts, avg(norm) AS score FROM normed n
      WHERE EXISTS (SELECT 1 FROM pooled p WHERE p.detector = n.detector AND p.series = n.series AND p.rate <= 0.07)
      GROUP BY 1, 2, 3), {flags_sql('fused', 'series, segment', 'final')},
    mask AS (SELECT g.series, g.ts, g.value, coalesce(f.flag, false) AS flag FROM daily_grid g
      LEFT JOIN final f ON f.series = g.series AND f.ts = g.ts)"""
)


@query("E12_anomaly_mask", _FINAL + " SELECT series, ts, flag FROM mask")
def e12(spark, sf):
    return cleaning.detect_anomalies(cut(V.daily_grid(spark, sf)), detectors=DETECTORS, step=DAY).flags


@query(
    "E13_remove_anomalies",
    _FINAL + " SELECT series, ts, CASE WHEN flag THEN NULL ELSE round(value, 6) END AS value FROM mask",
)
def e13(spark, sf):
    rows = cut(V.daily_grid(spark, sf))
    found = cleaning.detect_anomalies(rows, detectors=DETECTORS, step=DAY)
    return screen.remove_flagged(rows.select("series", "ts", "value"), found.flags)


_BENCH = (
    RUN_SCORES
    + f""", {flags_sql('scores', 'detector, series', 'flags')},
    rates AS (SELECT detector, series, avg(flag::INT) AS rate, count(*) FILTER (flag) AS n_flagged, count(*) AS n_points,
      any_value(threshold) AS threshold FROM flags GROUP BY 1, 2),
    macro AS (SELECT detector, avg(rate) AS macro_rate, avg(rate) <= 0.07 AS kept FROM rates GROUP BY 1),
    {norm_sql('scores', 'detector, series', 'normed')},
    fused AS (SELECT 'Ensemble' AS detector, series, ts, FUSE(norm) AS score FROM normed
      WHERE detector IN (SELECT detector FROM macro WHERE kept) GROUP BY 2, 3),
    {flags_sql('fused', 'detector, series', 'final')},
    joint AS (SELECT detector, series, avg(flag::INT) AS rate, count(*) FILTER (flag) AS n_flagged, count(*) AS n_points,
      any_value(threshold) AS threshold FROM final GROUP BY 1, 2),
    bench AS (SELECT r.*, m.macro_rate, m.kept FROM rates r JOIN macro m ON m.detector = r.detector
      UNION ALL SELECT *, avg(rate) OVER (), true FROM joint)"""
)
_BENCH_OUT = """ SELECT detector, series, round(rate, 6) AS rate, n_flagged, n_points, round(threshold, 6) AS threshold,
      round(macro_rate, 6) AS macro_rate, kept FROM bench"""


@query("E15_unlabelled_benchmark", _BENCH.replace("FUSE", "avg") + _BENCH_OUT)
def e15(spark, sf):
    done = run_scoring(spark, sf)
    # What it took is measured (see the tests); no two runs take the same.
    return cleaning.benchmark_unlabelled(done.scores, seconds=done.seconds).drop(*SECONDS)


SECONDS = ("fit_seconds", "score_seconds")


@query(
    "E17_macro_summary",
    _BENCH.replace("FUSE", "avg")
    + " SELECT detector, round(avg(rate), 6) AS rate, round(avg(threshold), 6) AS threshold FROM bench GROUP BY 1",
)
def e17(spark, sf):
    done = run_scoring(spark, sf)
    results = cleaning.benchmark_unlabelled(done.scores, seconds=done.seconds)
    return screen.macro_summary(results, ["rate", "threshold", *SECONDS]).drop(*SECONDS)


@query("E18_ensemble_from_store", _BENCH.replace("FUSE", "max") + _BENCH_OUT)
def e18(spark, sf):
    folder = store.scratch_folder(spark, "scores")
    cleaning.save_unlabelled(folder, "first", run_scoring(spark, sf))
    return cleaning.rebuild_ensemble(spark, folder, "first", method="MAX")
