import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import by_time, series
from sensorloom.functions.blocks import HOUR, in_blocks
from sensorloom.operators import detect, forecast, nearest, registry, windows
from sensorloom.plans import cleaning

RNG = np.random.default_rng(3)
SPIKES = [50, 120, 300]
VALUES = 10 + 3 * np.sin(np.arange(400) / 24 * 2 * np.pi) + RNG.normal(0, 0.4, 400)
VALUES[SPIKES] += 25


@pytest.fixture(scope="module")
def rows(spark):
    df = in_blocks(series(spark, VALUES).drop("event_id"), HOUR, 64).withColumn("segment", F.lit("2024-01-01").cast("timestamp"))
    return df.persist()


def scores_of(df):
    return np.array(by_time(df, "score"))


@pytest.mark.parametrize("name", list(registry.DETECTORS))
def test_every_detector_scores_every_row_and_finds_the_spikes(spark, rows, name):
    scored = registry.DETECTORS[name].score(rows, keys=["series", "segment"], step=HOUR, ready=True, seed=1)
    got = scores_of(scored)
    assert len(got) == 400
    assert np.isfinite(got).all()
    later = [s for s in SPIKES if s > 110]
    rest = np.delete(got, [i for s in SPIKES for i in range(s - 100, s + 101) if 0 <= i < 400])
    if name != "PCA":
        assert min(got[later]) > np.median(got) if len(rest) == 0 else min(got[later]) > np.quantile(rest, 0.9)


def test_modified_z_and_iqr_by_hand(spark, rows):
    med = np.median(VALUES)
    mad = np.median(np.abs(VALUES - med))
    assert scores_of(detect.modified_z(rows)) == pytest.approx(0.6745 * np.abs(VALUES - med) / mad)
    q1, q3 = np.percentile(VALUES, [25, 75])
    want = np.maximum(np.maximum(q1 - 1.5 * (q3 - q1) - VALUES, VALUES - q3 - 1.5 * (q3 - q1)), 0) / (q3 - q1)
    assert scores_of(detect.iqr_fence(rows)) == pytest.approx(want)


@pytest.mark.parametrize("width", [6, 24])
def test_hampel_across_block_borders(rows, width):
    got = scores_of(detect.hampel(rows, window=width, rows=7))
    left, right = width // 2, width - 1 - width // 2
    want = []
    for i in range(400):
        chunk = VALUES[max(0, i - left) : i + right + 1]
        med = np.median(chunk)
        want.append(abs(VALUES[i] - med) / max(1.4826 * np.median(np.abs(chunk - med)), 1e-6))
    assert got == pytest.approx(np.array(want))


def brute_lof(x, k):
    n = len(x)
    near, kdist = [], []
    for i in range(n):
        d = np.abs(x - x[i])
        d[i] = np.inf
        order = np.lexsort((x, d))[:k]
        near.append(order)
        kdist.append(d[order[-1]])
    kdist = np.array(kdist)
    lrd = np.array([1 / (np.mean(np.maximum(kdist[near[i]], np.abs(x[near[i]] - x[i]))) + 1e-10) for i in range(n)])
    return np.array([lrd[near[i]].mean() / lrd[i] for i in range(n)])


def test_outlier_factor_with_many_copies_and_short_stretches(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 300), np.full(120, 0.25), np.repeat(rng.normal(3, 1, 20), 3)])
    df = in_blocks(series(spark, x).drop("event_id"), HOUR)
    want = brute_lof(x, 20)
    for stretch in (37, 4096):
        got = scores_of(detect.local_outlier_factor(df, neighbours=20, stretch=stretch))
        assert got == pytest.approx(want, rel=1e-9)


def test_outlier_factor_of_few_points(spark):
    df = in_blocks(series(spark, [1.0, 2.0, 4.0, 8.5]).drop("event_id"), HOUR)
    assert scores_of(detect.local_outlier_factor(df)) == pytest.approx(brute_lof(np.array([1.0, 2.0, 4.0, 8.5]), 3))


def test_forest_is_seeded_and_prefers_extremes(rows):
    first = scores_of(detect.isolation_forest(rows, trees=30, sample=64))
    assert first == pytest.approx(scores_of(detect.isolation_forest(rows, trees=30, sample=64)))
    assert first.min() > 0 and first.max() < 1
    assert set(np.argsort(first)[-3:]) == set(SPIKES)


def test_pca_equals_numpy(rows):
    w = 20
    z = np.lib.stride_tricks.sliding_window_view(VALUES, w)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    values, vectors = values[::-1], vectors[:, ::-1].T
    top = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(w), top])[:, None]
    scores = (np.linalg.norm(z[:, None, :] - vectors[None], axis=2) / (values / values.sum())).sum(axis=1)
    want = [scores[max(0, i - w + 1) : min(i, len(z) - 1) + 1].mean() for i in range(400)]
    got = scores_of(windows.pca(rows, window=w, rows=33, keys=["series", "segment"]))
    assert got == pytest.approx(np.array(want), rel=1e-6)


def test_forecast_error_equals_numpy(rows):
    w, h = 20, 3
    x = (VALUES - VALUES.mean()) / VALUES.std()
    cut = np.lib.stride_tricks.sliding_window_view(x, w + h)
    a, b = cut[:, :w], cut[:, w:]
    am, bm = a.mean(axis=0), b.mean(axis=0)
    weights = np.linalg.solve((a - am).T @ (a - am) / len(a) + 1e-6 * np.eye(w), (a - am).T @ (b - bm) / len(a))
    ahead = np.lib.stride_tricks.sliding_window_view(x, w) @ weights + (bm - am @ weights)
    errors = np.array([[x[t] - ahead[t - w - j, j] for j in range(h)] for t in range(w + h - 1, 400)])
    off = errors - errors.mean(axis=0)
    inverse = np.linalg.inv(off.T @ off / (len(off) - 1) + 1e-6 * np.eye(h))
    want = np.concatenate([np.zeros(w + h - 1), np.einsum("ij,jk,ik->i", off, inverse, off)])
    got = scores_of(forecast.forecast_error(rows, window=w, horizon=h, rows=41))
    assert got == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_fold_of_window_scores(spark, rows):
    w, tail = 7, 3
    n = 400
    starts = rows.withColumn("score", F.when(F.col("ts") <= F.expr(f"timestamp'2024-01-01' + interval {n - w} hours"), F.col("value")))
    s = VALUES[: n - w + 1]
    got = scores_of(windows.fold_windows(starts, w, rows=11))
    assert got == pytest.approx(np.array([s[max(0, i - w + 1) : min(i, n - w) + 1].mean() for i in range(n)]))
    got = scores_of(windows.fold_tails(starts, w, tail, rows=11))
    want = []
    for i in range(n):
        lo, hi = max(0, i - w + 1), min(i - w + tail, n - w)
        want.append(s[lo : hi + 1].mean() if hi >= lo else 0.0)
    assert got == pytest.approx(np.array(want))


def test_triplets_and_corruptions(rows):
    w = 24
    out = windows.triplets(rows, w, 3, rows=50).orderBy("start_pos").collect()
    assert len(out) == 400 - w + 1
    mean, std = VALUES.mean(), VALUES.std()
    unit = (VALUES - mean) / std
    for r in out:
        assert r.anchor == pytest.approx(unit[r.start_pos : r.start_pos + w])
        if r.start_pos > 10:
            near = [unit[r.start_pos - j : r.start_pos - j + w] for j in range(1, 11)]
            assert min(np.abs(np.array(r.positive) - p).max() for p in near) < 1e-9
        else:
            assert 0 < np.abs(np.array(r.positive) - np.array(r.anchor)).max() < 1.0
    changed = sum(not np.allclose(r.negative, r.anchor) for r in out)
    assert changed > 0.95 * len(out)


def test_tail_corruptions_follow_their_kind(rows):
    w = 24
    table = windows.window_table(rows, w)
    kinds = set()
    for r in windows.corrupt_tail(table, w, 3).collect():
        x, y = np.array(r.w), np.array(r.negative)
        kinds.add(r.kind)
        if r.kind < 2:
            assert w - w // 2 < r.cut <= w - 1
            assert (y[r.cut :] == r.kind).all() and (y[: r.cut] == x[: r.cut]).all()
        else:
            assert (y[:-1] == x[:-1]).all()
            want = {2: x[-10:].mean() + 0.5, 3: x[-10:].mean() - 0.5, 4: 2.0, 5: -2.0}[r.kind]
            assert y[-1] == pytest.approx(want)
    assert kinds == set(range(6))


def test_window_sample_is_capped_and_seeded(rows):
    table = windows.window_table(rows, 24).select("series", "start_pos")
    first = {r.start_pos for r in windows.sample_windows(table, 40, 1, order="start_pos").collect()}
    again = {r.start_pos for r in windows.sample_windows(table, 40, 1, order="start_pos").collect()}
    other = {r.start_pos for r in windows.sample_windows(table, 40, 2, order="start_pos").collect()}
    assert len(first) == 40 and first == again and first != other
    assert windows.sample_windows(table, 1000, 1, order="start_pos").count() == 377


@pytest.mark.parametrize("copies", [0, 30])
@pytest.mark.parametrize("cells, block", [(1, 1000), (6, 20)])
def test_neighbours_equal_brute_force(spark, copies, cells, block):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (90, 4)), rng.normal(6, 0.5, (40, 4))])
    if copies:
        x[20 : 20 + copies] = x[20]
    k = 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = {}
    for r in nearest.neighbours(df, k, cells=cells, block=block).collect():
        got.setdefault((r.id, r.kind), {})[r.rank] = r.other
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i]
        near = sorted(others, key=lambda j: (d[i, j], j))[:k]
        far = sorted(others, key=lambda j: (-d[i, j], j))[:k]
        assert [got[i, "near"][r] for r in range(1, k + 1)] == near
        assert [got[i, "far"][r] for r in range(1, k + 1)] == far


def test_names_are_checked():
    assert registry.resolve_detectors(["all"]) == list(registry.DETECTORS)
    assert registry.resolve_imputers(["interp", "interp", " LinearInterp "]) == ["interp", "LinearInterp"]
    assert registry.trainable(["interp", "NLinear"]) == ["NLinear"]
    for call in (registry.resolve_detectors, registry.resolve_imputers):
        with pytest.raises(ValueError):
            call(["nope"])
    with pytest.raises(ValueError):
        registry.trainable(["interp"])


def test_a_registered_detector_joins_the_plan(spark, rows):
    registry.register_detector("Constant", lambda df, keys, **_: df.select(*keys, "ts", F.lit(1.0).alias("score")))
    try:
        out = cleaning.score_all(rows, ["Constant", "IQR"], keys=["series", "segment"])
        assert {(r.detector, r["count"]) for r in out.groupBy("detector").count().collect()} == {("Constant", 400), ("IQR", 400)}
    finally:
        del registry.DETECTORS["Constant"]
