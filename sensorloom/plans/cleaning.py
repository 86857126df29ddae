"""Label-free cleaning and the detector benchmark without labels."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.blocks import HOUR, MICROS, attach, in_blocks
from sensorloom.functions.stats import beside
from sensorloom.operators import grid, inject, metrics, screen
from sensorloom.operators.registry import DETECTORS, Detector, resolve_detectors
from sensorloom.session import cut
from sensorloom.sources import store

SEED = 13
EVAL_SEED = 101
MIN_SEGMENT = 8
MIN_SERIES_POINTS = 600
SEGMENT = ("series", "segment")
ENSEMBLE = "Ensemble"


@dataclass(frozen=True)
class Cleaning:
    """Outcome of :func:`detect_anomalies`."""

    rates: DataFrame  # detector, series, n_flagged, n_points, rate, kept
    flags: DataFrame  # series, ts, flag: one row per grid row
    totals: DataFrame  # series, n_flagged, n_points, rate of the final mask
    status: DataFrame  # detector, series, segment, n_points, error

    def lists(self) -> DataFrame:
        """``series, kept, discarded``: names within and over the budget, in order."""
        names = lambda kept: F.sort_array(F.collect_list(F.when(F.col("kept") == kept, F.col("detector"))))
        return self.rates.groupBy("series").agg(names(True).alias("kept"), names(False).alias("discarded"))


@dataclass(frozen=True)
class Scoring:
    """Outcome of :func:`score_segments`."""

    scores: DataFrame  # detector, keys, ts, score: groups that a detector could score
    status: DataFrame  # detector, keys, n_points, error: every group it was given
    seconds: DataFrame  # detector, fit_seconds, score_seconds, n_points


def score_segments(
    rows: DataFrame, names: Sequence[str] | None, *, keys: Sequence[str], step: int = HOUR,
    seed: int = SEED, size: str | None = None, extra: Mapping[str, Detector] | None = None,
) -> Scoring:
    """Scores of every detector on every group, as one long table.

    ``rows`` must lie in a table.  A detector with a minimum length skips the groups
    (column ``size``) that are shorter.  A detector that fails on a group has no
    scores there, and one that fails altogether has none at all; ``status`` says
    why, and the other detectors go on.  ``extra`` are detectors for this call only.

    Detectors run one after the other, each written to a table of its own.
    ``fit_seconds`` is the time from the call of a detector to its plan, in which the
    statistics that need jobs of their own are fitted; ``score_seconds`` the time that
    computing and writing the scores took.
    """
    spark, keys = rows.sparkSession, list(keys)
    known = DETECTORS | dict(extra or {})
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    types = dict(rows.dtypes)
    schema = ", ".join(["detector string", *[f"{k} {types[k]}" for k in keys], "ts timestamp, score double, error string"])
    tables, states, times = [], [], []
    for name in resolve_detectors(names, extra):
        detector = known[name]
        fitting = rows if size is None else rows.where(F.col(size) >= detector.min_len)
        error = failed = F.lit(None).cast("string")
        problems = None
        begun = made = time.perf_counter()
        try:
            scored = detector.score(
                fitting.select(*keys, "blk", "ts", "value"), keys=keys, step=step, ready=True, seed=seed
            )
            made = time.perf_counter()
            error = F.col("error") if "error" in scored.columns else error
            table = cut(scored.select(F.lit(name).alias("detector"), *keys, "ts", "score", error.alias("error")))
            if "error" in scored.columns:
                problems = table.where("error is not null").groupBy(*keys).agg(F.min("error").alias("error"))
        except Exception as problem:  # noqa: BLE001 - a detector's failure is a row, not the end
            if spark.sparkContext._jsc.sc().isStopped():
                raise
            text = f"{type(problem).__name__}: {problem}".splitlines()[0][:500]
            table, failed = spark.createDataFrame([], schema), F.lit(text)
        done = time.perf_counter()
        tables.append(table)
        given = sizes if size is None else sizes.where(F.col("n_points") >= detector.min_len)
        state = given.withColumn("error", failed) if problems is None else given.join(problems, keys, "left")
        states.append(state.select(F.lit(name).alias("detector"), *keys, "n_points", "error"))
        times.append((name, made - begun, done - made))
    every = reduce(DataFrame.unionByName, tables)
    # Worked out only where they are asked for.
    status = reduce(DataFrame.unionByName, states)
    points = status.groupBy("detector").agg(F.sum("n_points").alias("n_points"))
    seconds = spark.createDataFrame(times, "detector string, fit_seconds double, score_seconds double")
    return Scoring(every.where("error is null").drop("error"), status, seconds.join(points, ["detector"], "left"))


def score_all(rows: DataFrame, names: Sequence[str] | None, **options) -> DataFrame:
    """The scores of :func:`score_segments`, in a table."""
    return score_segments(rows, names, **options).scores


def with_seconds(results: DataFrame, seconds: DataFrame, keys: Sequence[str] = ("detector",)) -> DataFrame:
    """Measured seconds beside ``results (detector, n_points)``: a group's share is that of its rows."""
    shares = seconds.withColumnRenamed("n_points", "_all")
    part = lambda name: (F.col(name) * F.try_divide("n_points", "_all")).alias(name)
    joined = results.join(F.broadcast(shares), list(keys), "left")
    return joined.select(*results.columns, part("fit_seconds"), part("score_seconds"))


def detect_anomalies(
    rows: DataFrame, *, detectors: Sequence[str] | None = None, step: int = HOUR, seed: int = SEED,
    k: float = screen.THRESHOLD_K, budget: float = screen.MAX_DETECTION_RATE,
    extra: Mapping[str, Detector] | None = None,
) -> Cleaning:
    """Flag anomalies of gridded series without labels.

    Segments of at least 8 rows are scored by every detector; detectors that
    flag more than the budget on a series are dropped for it; the mean of the
    survivors' normalised scores is thresholded again per segment.  A detector that
    fails on a segment is left out of that segment's mean only.
    """
    segments = cut(grid.observed_segments(rows, MIN_SEGMENT))
    scoring = score_segments(segments, detectors, keys=SEGMENT, step=step, seed=seed, size="segment_len", extra=extra)
    scores = scoring.scores
    group = ["detector", *SEGMENT]
    flags = screen.flag(scores, group, k, ready=True)
    rates = cut(screen.pooled_rates(flags).withColumn("kept", F.col("rate") <= F.lit(budget)))
    survivors = rates.where("kept").select("detector", "series")
    normed = beside(screen.normalise(scores, group, ready=True), survivors, ["detector", "series"])
    fused = screen.consensus(normed, SEGMENT, "AVG")
    final = cut(screen.flag(fused, SEGMENT, k).where("flag").select("series", "ts", "flag"))
    everywhere = rows.select("series", "ts").join(final, ["series", "ts"], "left").select(
        "series", "ts", F.coalesce("flag", F.lit(False)).alias("flag")
    )
    sizes = segments.groupBy("series").agg(F.count(F.lit(1)).alias("n_points"))
    hits = final.groupBy("series").agg(F.count(F.lit(1)).alias("n_flagged"))
    totals = sizes.join(hits, ["series"], "left").select(
        "series", F.coalesce("n_flagged", F.lit(0)).cast("bigint").alias("n_flagged"), "n_points",
        (F.coalesce("n_flagged", F.lit(0)) / F.col("n_points")).alias("rate"),
    )
    return Cleaning(rates, everywhere, totals, scoring.status)


def build_cases(
    readings: DataFrame, limit: Column | float, *, min_points: int = MIN_SERIES_POINTS,
    min_useful: int = grid.MIN_USEFUL,
) -> DataFrame:
    """Longest clean run of each series, renumbered from 0.

    Repeated hours are removed first, and a removed hour does not break a run:
    neighbours are neighbouring rows.  So rows get a position and an artificial
    hourly clock; ``orig_ts`` keeps the real one.
    """
    hours = cut(grid.hourly_mean(readings, limit, min_useful=min_useful))
    kept, _ = grid.drop_repeats(hours)
    kept = cut(kept)
    best = grid.longest_run(kept).where(F.col("run_len") >= min_points)
    chosen = attach(kept, best).where("ts between run_start and run_end")
    placed = grid.positions(chosen.select("series", "blk", "ts", "value"))
    cases = placed.select(
        "series", F.col("row").alias("pos"), F.col("ts").alias("orig_ts"),
        F.timestamp_micros(F.col("row") * (HOUR * MICROS)).alias("ts"), "value",
    )
    return in_blocks(cases, HOUR)


def synthetic_cases(cases: DataFrame, seed: int = SEED, eval_seed: int = EVAL_SEED) -> DataFrame:
    """Two injections of every case: one to select detectors, one to judge."""
    select = inject.inject(cases, seed).withColumn("injection", F.lit("select"))
    judge = inject.inject(cases, eval_seed).withColumn("injection", F.lit("eval"))
    return select.unionByName(judge)


def benchmark_unlabelled(
    scores: DataFrame, *, k: float = screen.THRESHOLD_K, budget: float = screen.MAX_DETECTION_RATE,
    method: str = "AVG", seed: int = SEED, ready: bool = True, seconds: DataFrame | None = None,
) -> DataFrame:
    """Rate, flagged count and threshold per detector and series, plus the
    ensemble of the detectors whose macro rate is within the budget.

    Works on freshly made scores or on scores read from a store.  With the measured
    ``seconds`` of :func:`score_segments` every row has its share of them; the
    ensemble has those of its detectors.
    """
    scores = scores if ready else cut(scores)
    keys = ["detector", "series"]
    rows = cut(_rates_with_threshold(screen.flag(scores, keys, k, ready=True), keys))
    kept = cut(screen.split_by_rate(rows, budget))
    survivors = kept.where("kept").select("detector")
    normed = screen.normalise(scores, keys, ready=True).join(F.broadcast(survivors), "detector", "left_semi")
    fused = screen.consensus(normed, ["series"], method, seed=seed)
    ensemble = fused.withColumn("detector", F.lit(ENSEMBLE))
    joint = cut(_rates_with_threshold(screen.flag(ensemble, keys, k), keys))
    if seconds is not None:
        rows = cut(with_seconds(rows, seconds))
        spent = rows.join(F.broadcast(survivors), "detector", "left_semi").groupBy("series").agg(
            F.sum("fit_seconds").alias("fit_seconds"), F.sum("score_seconds").alias("score_seconds")
        )
        joint = joint.join(spent, ["series"], "left")
    overall = screen.macro_rates(joint).withColumn("kept", F.lit(True))
    return rows.join(F.broadcast(kept), "detector").unionByName(joint.join(F.broadcast(overall), "detector"))


def _rates_with_threshold(flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    return flags.groupBy(*keys).agg(
        F.avg(F.col("flag").cast("int")).alias("rate"),
        F.count_if("flag").alias("n_flagged"),
        F.count(F.lit(1)).alias("n_points"),
        F.first("threshold").alias("threshold"),
    )


def benchmark_synthetic(
    cases: DataFrame, detectors: Sequence[str] | None = None, *, step: int = HOUR, top_k: int = 3,
    seed: int = SEED, eval_seed: int = EVAL_SEED, method: str = "AVG",
) -> DataFrame:
    """Detection metrics per detector and series on injected anomalies.

    Detectors are ranked and weighted by VUS-PR on one injection; everything
    reported, the ensemble included, is measured on the other.
    """
    return run_synthetic(
        cases, detectors, step=step, top_k=top_k, seed=seed, eval_seed=eval_seed, method=method
    ).results


@dataclass(frozen=True)
class Synthetic:
    """Outcome of :func:`run_synthetic`, enough to rebuild the ensemble."""

    results: DataFrame  # detector, series, metrics, vus_pr_select, n_points, seconds
    scores: DataFrame  # detector, series, ts, pos, score on the evaluation injection
    labels: DataFrame  # series, ts, pos, label of the evaluation injection


def run_synthetic(
    cases: DataFrame, detectors: Sequence[str] | None = None, *, step: int = HOUR, top_k: int = 3,
    seed: int = SEED, eval_seed: int = EVAL_SEED, method: str = "AVG",
) -> Synthetic:
    """As :func:`benchmark_synthetic`, with the scores and labels to be stored."""
    cases = cut(cases)
    select = cut(inject.inject(cases, seed))
    judge = cut(inject.inject(cases, eval_seed))
    keys = ["series"]
    size = inject.case_sizes(cases).select("series", "n")
    scored, seconds = {}, None
    for name, rows in (("select", select), ("judge", judge)):
        sized = cut(attach(rows, size))
        scoring = score_segments(sized, detectors, keys=keys, step=step, seed=seed, size="n")
        # Those of the evaluation injection are reported.
        seconds = scoring.seconds
        scored[name] = cut(scoring.scores.join(rows.select("series", "ts", "pos"), ["series", "ts"]))
    ranking = cut(metrics.detection_metrics(scored["select"], select).select(
        "detector", "series", F.col("vus_pr").alias("metric")
    ))
    labels = judge.select("series", "ts", "pos", "label")
    single = metrics.detection_metrics(scored["judge"], labels).join(
        ranking.withColumnRenamed("metric", "vus_pr_select"), ["detector", "series"], "left"
    )
    timed = with_seconds(single.join(size.withColumnRenamed("n", "n_points"), "series"), seconds)
    joint, chosen = weighted_ensemble(scored["judge"], labels, ranking, top_k=top_k, method=method, seed=seed)
    spent = timed.join(chosen.select("detector", "series"), ["detector", "series"], "left_semi").groupBy("series").agg(
        F.max("n_points").alias("n_points"), F.sum("fit_seconds").alias("fit_seconds"), F.sum("score_seconds").alias("score_seconds")
    )
    joint = joint.withColumn("vus_pr_select", F.lit(None).cast("double")).join(spent, ["series"], "left")
    return Synthetic(cut(timed.unionByName(joint)), scored["judge"], labels)


def weighted_ensemble(
    scores: DataFrame, labels: DataFrame, ranking: DataFrame, *, top_k: int = 3, method: str = "AVG", seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Metrics of the ensemble of each series' ``top_k`` detectors, and who they are.

    ``ranking`` is ``detector, series, metric`` on another injection; the metric is
    also the weight.
    """
    chosen = cut(screen.rank_top_k(ranking, top_k))
    normed = beside(
        screen.normalise(scores, ["detector", "series"], ready=True), chosen.select("detector", "series"), ["detector", "series"]
    )
    weights = chosen.select("detector", "series", F.col("metric").alias("weight"))
    fused = screen.consensus(normed, ["series"], method, weights=weights, seed=seed)
    placed = fused.join(labels.select("series", "ts", "pos"), ["series", "ts"]).select(
        F.lit(ENSEMBLE).alias("detector"), "series", "ts", "score", "pos"
    )
    return metrics.detection_metrics(placed, labels), chosen


# --- stored runs --------------------------------------------------------------


def save_unlabelled(
    folder: str, run: str, scoring: Scoring, *, k: float = screen.THRESHOLD_K,
    budget: float = screen.MAX_DETECTION_RATE, method: str = "AVG", seed: int = SEED,
) -> DataFrame:
    """Benchmark without labels, stored as ``run``: scores, results and what was kept."""
    results = cut(benchmark_unlabelled(scoring.scores, k=k, budget=budget, method=method, seed=seed, seconds=scoring.seconds))
    config = {"k": k, "budget": budget, "method": method, "seed": seed}
    store.save_run(folder, run, "unlabelled", scores=scoring.scores, results=results, config=config)
    return results


def save_synthetic(
    folder: str, run: str, done: Synthetic, *, top_k: int = 3, method: str = "AVG", seed: int = SEED
) -> None:
    """A run of :func:`run_synthetic`, stored as ``run`` with its labels."""
    config = {"top_k": top_k, "method": method, "seed": seed}
    store.save_run(folder, run, "synthetic", scores=done.scores, results=done.results, labels=done.labels, config=config)


def rebuild_ensemble(
    spark: SparkSession, folder: str, run: str, *, method: str | None = None, k: float | None = None,
    budget: float | None = None, top_k: int | None = None,
) -> DataFrame:
    """Results of a stored run with another ensemble, from its scores alone.

    What is not given is taken from the run.  Without labels the detectors are
    screened again by ``budget`` and flagged again by ``k``; with them each series'
    ``top_k`` are chosen by the stored VUS-PR of the selection injection.
    """
    kept = store.load_run(spark, folder, run)
    chosen = lambda value, name: kept.config[name] if value is None else value
    method, seed = chosen(method, "method"), kept.config["seed"]
    if kept.mode == "unlabelled":
        return benchmark_unlabelled(kept.scores, k=chosen(k, "k"), budget=chosen(budget, "budget"), method=method, seed=seed)
    single = kept.results.where(F.col("detector") != ENSEMBLE)
    ranking = single.select("detector", "series", F.col("vus_pr_select").alias("metric"))
    joint, _ = weighted_ensemble(
        kept.scores, kept.labels, ranking, top_k=chosen(top_k, "top_k"), method=method, seed=seed
    )
    names = [c for c in joint.columns if c in single.columns]
    return single.select(*names).unionByName(joint.select(*names))
