"""Failing detectors, measured seconds, buckets per group, stored runs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import T0, series
from sensorloom.functions.blocks import HOUR, in_blocks
from sensorloom.operators import grid, registry, screen
from sensorloom.plans import cleaning
from sensorloom.session import cut
from sensorloom.sources import store

SEGMENT = ["series", "segment"]


def stretches(spark, rows=7):
    """Series a: stretches of 30 and 10 rows; series b: one of 40."""
    values = [float(i % 7) for i in range(30)] + [None] + [float(i % 5) for i in range(10)]
    both = series(spark, values, name="a").unionByName(series(spark, [float(i % 11) for i in range(40)], name="b"))
    return cut(grid.observed_segments(grid.regular_grid(both, HOUR, rows=rows)))


def extra():
    def brittle(values, seed):
        if len(values) < 12:
            raise ValueError(f"only {len(values)}")
        return np.cumsum(values) + seed

    def late(df, *, keys, **_):
        return df.select(*keys, "ts", F.raise_error(F.lit("in the task")).cast("double").alias("score"))

    def early(df, **_):
        raise OSError("at once")

    return {
        "Brittle": registry.Detector(registry.by_segment(brittle)),
        "Wrong": registry.Detector(registry.by_segment(lambda values, seed: values[1:])),
        "Small": registry.Detector(registry.by_segment(brittle, most=30)),
        "Late": registry.Detector(late), "Early": registry.Detector(early, min_len=20),
    }


def test_a_failing_detector_loses_only_its_own_segments(spark):
    rows = stretches(spark)
    done = cleaning.score_segments(rows, ["IQR", *extra()], keys=SEGMENT, size="segment_len", extra=extra(), seed=2)
    count = {(r.detector, r.series): r["count"] for r in done.scores.groupBy("detector", "series").count().collect()}
    assert count == {("IQR", "a"): 40, ("IQR", "b"): 40, ("Brittle", "a"): 30, ("Brittle", "b"): 40, ("Small", "a"): 30}
    status = {(r.detector, r.series, r.n_points): r.error for r in done.status.collect()}
    assert len(status) == 5 * 3 + 2
    assert status["IQR", "a", 10] is None and status["Brittle", "b", 40] is None
    assert status["Brittle", "a", 10] == "ValueError: only 10" and "(39,) scores of 40 rows" in status["Wrong", "b", 40]
    assert "group of 40 rows" in status["Small", "b", 40] and status["Early", "a", 30] == "OSError: at once"
    assert all(status["Late", s, n] for s, n in (("a", 30), ("a", 10), ("b", 40))) and ("Early", "a", 10) not in status
    # Values arrive in order of time, whatever the blocks.
    got = [r.score for r in done.scores.where("detector = 'Brittle' and series = 'b'").orderBy("ts").collect()]
    assert got == (np.cumsum([float(i % 11) for i in range(40)]) + 2).tolist()


def test_no_detector_left_is_an_empty_table(spark):
    done = cleaning.score_segments(stretches(spark), ["Early"], keys=SEGMENT, extra=extra())
    assert done.scores.count() == 0 and done.scores.columns == ["detector", *SEGMENT, "ts", "score"]
    assert done.status.where("error is null").count() == 0


def test_cleaning_goes_on_without_a_failing_detector(spark):
    values = [float(np.sin(i / 4)) for i in range(60)]
    values[30] += 40
    rows = grid.regular_grid(series(spark, values), HOUR)
    alone = cleaning.detect_anomalies(rows, detectors=["IQR", "ModifiedZScore"])
    both = cleaning.detect_anomalies(rows, detectors=["IQR", "ModifiedZScore", "Early", "Late"], extra=extra())
    hits = lambda found: {r.ts for r in found.flags.where("flag").collect()}
    assert hits(alone) == hits(both) == {T0 + dt.timedelta(hours=30)}
    assert {r.detector for r in both.status.where("error is not null").collect()} == {"Early", "Late"}
    named = both.lists().first()
    assert sorted([*named.kept, *named.discarded]) == ["IQR", "ModifiedZScore"]


def test_seconds_are_measured_and_shared_by_rows(spark):
    def slow(values, seed):
        import time

        time.sleep(0.4)
        return values

    more = {"Slow": registry.Detector(registry.by_segment(slow))}
    rows = cut(stretches(spark).drop("segment"))
    done = cleaning.score_segments(rows, ["IQR", "Slow"], keys=["series"], extra=more)
    took = {r.detector: r for r in done.seconds.collect()}
    assert took["Slow"].score_seconds >= 0.4 and took["Slow"].n_points == 80 and took["IQR"].fit_seconds > 0
    results = cleaning.benchmark_unlabelled(done.scores, budget=1.0, seconds=done.seconds).collect()
    by = {(r.detector, r.series): r for r in results}
    for name in ("IQR", "Slow"):
        for s, n in (("a", 40), ("b", 40)):
            assert by[name, s].score_seconds == pytest.approx(took[name].score_seconds * n / 80)
    assert by["Ensemble", "a"].score_seconds == pytest.approx(by["IQR", "a"].score_seconds + by["Slow", "a"].score_seconds)
    summary = {r.detector: r for r in screen.macro_summary(spark.createDataFrame(results), ["rate", "fit_seconds"]).collect()}
    assert summary["IQR"].fit_seconds == pytest.approx(took["IQR"].fit_seconds / 2)


def test_buckets_hold_detectors_of_the_group_only(spark):
    draw = random.Random(1)
    members = {"a": [f"d{i}" for i in range(12)], "b": ["d3", "d7"], "c": ["d11"]}
    data = [(d, s, T0, draw.random()) for s, names in members.items() for d in names]
    normed = spark.createDataFrame(data, "detector string, series string, ts timestamp, norm double")
    value = {(d, s): x for d, s, _, x in data}
    got = {r.series: r.score for r in screen.consensus(normed, ["series"], "AOM", seed=4).collect()}
    names = spark.createDataFrame(list(members.items()), "series string, names array<string>")
    for r in names.select("series", screen.buckets_of(F.col("names"), 4).alias("b")).collect():
        assert len(r.b) == 20
        for bucket in r.b:
            assert len(bucket) == len(set(bucket)) == min(5, len(members[r.series])) and set(bucket) <= set(members[r.series])
        assert got[r.series] == pytest.approx(np.mean([max(value[d, r.series] for d in bucket) for bucket in r.b]))
    assert got["c"] == pytest.approx(value["d11", "c"])


def test_a_stored_run_is_seen_when_it_is_whole(spark, tmp_path, monkeypatch):
    rows = cut(stretches(spark).drop("segment"))
    done = cleaning.score_segments(rows, ["IQR", "ModifiedZScore"], keys=["series"])
    folder = str(tmp_path / "store")
    first = cleaning.save_unlabelled(folder, "r", done, budget=0.3)
    kept = store.load_run(spark, folder, "r")
    assert kept.mode == "unlabelled" and kept.config["budget"] == 0.3 and kept.labels is None
    assert kept.series == ["a", "b"] and set(kept.detectors) == {"IQR", "ModifiedZScore", "Ensemble"}
    assert sorted([*kept.kept, *kept.discarded]) == sorted(kept.detectors)
    key = lambda r: (r.detector, r.series, r.rate, r.n_flagged, r.kept)
    again = cleaning.rebuild_ensemble(spark, folder, "r")
    assert sorted(map(key, again.collect())) == sorted(map(key, first.collect()))
    # A save that breaks off before its last row leaves the run as it was.
    with monkeypatch.context() as m:
        m.setattr(store.json, "dumps", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cleaning.save_unlabelled(folder, "r", done, budget=0.9)
    assert store.load_run(spark, folder, "r").config["budget"] == 0.3
    cleaning.save_unlabelled(folder, "r", done, budget=0.8)
    assert store.load_run(spark, folder, "r").config["budget"] == 0.8 and store.runs(spark, folder).count() == 1
    with pytest.raises(ValueError):
        store.load_run(spark, folder, "other")


def test_a_synthetic_ensemble_is_rebuilt_without_scoring(spark, tmp_path):
    draw = np.random.default_rng(3)
    hours = np.arange(700)
    cases = None
    for name in ("a", "b"):
        x = 30 + 8 * np.sin(hours / 24 * 2 * np.pi) + draw.normal(0, 1, len(hours))
        one = in_blocks(series(spark, x, name=name).withColumnRenamed("event_id", "pos"), HOUR)
        cases = one if cases is None else cases.unionByName(one)
    done = cleaning.run_synthetic(cases, ["IQR", "ModifiedZScore", "Hampel_w24"], top_k=2)
    folder = str(tmp_path / "store")
    cleaning.save_synthetic(folder, "r", done, top_k=2)
    want = {(r.detector, r.series): r for r in done.results.collect()}
    got = {(r.detector, r.series): r for r in cleaning.rebuild_ensemble(spark, folder, "r").collect()}
    assert set(got) == set(want) and len(got) == 8
    for key, r in got.items():
        assert all(r[m] == pytest.approx(want[key][m]) for m in ("auroc", "vus_pr", "affiliation_f1"))
    assert all(r.fit_seconds > 0 and r.score_seconds > 0 for r in want.values())
    # With one detector the ensemble is that detector's scores.
    single = {(r.detector, r.series): r for r in cleaning.rebuild_ensemble(spark, folder, "r", top_k=1, method="MAX").collect()}
    for s in ("a", "b"):
        best = max(("IQR", "ModifiedZScore", "Hampel_w24"), key=lambda d: (want[d, s].vus_pr_select, d))
        assert single["Ensemble", s].vus_pr == pytest.approx(want[best, s].vus_pr)
