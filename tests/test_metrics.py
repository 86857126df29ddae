import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import metrics as M


def case(spark, scores, labels, detector="d", series="a"):
    rows = [(detector, series, i, float(s), int(v)) for i, (s, v) in enumerate(zip(scores, labels, strict=True))]
    return spark.createDataFrame(rows, "detector string, series string, pos bigint, score double, label int")


def brute_vus(labels, score, window):
    """Straight from the definition: every tolerance, every threshold."""
    labels = np.asarray(labels, dtype=float)
    n = len(labels)
    edges = np.diff(np.concatenate([[0], labels.astype(int), [0]]))
    seq = list(zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1, strict=True))
    ordered = -np.sort(-score)
    rocs, prs = [], []
    for w in range(window + 1):
        soft = labels.copy()
        h = w // 2
        for s, e in seq:
            for d in range(1, h + 1):
                for p in (s - d, e + d):
                    if 0 <= p < n:
                        soft[p] += np.sqrt(1 - d / w)
        soft = np.minimum(soft, 1)
        grown = []
        for s, e in seq:
            if grown and s - h <= grown[-1][1]:
                grown[-1][1] = e + h
            else:
                grown.append([s - h, e + h])
        tpr, fpr, prec = [0.0], [0.0], [1.0]
        for i in (np.arange(250) * (n - 1)) // 249:
            pred = score >= ordered[i]
            tp = (soft * pred).sum()
            p_new = (labels.sum() + soft.sum()) / 2
            ex = sum(pred[max(a, 0) : b + 1].any() for a, b in grown) / len(grown)
            tpr.append(min(tp / p_new, 1) * ex)
            fpr.append((pred.sum() - tp) / (n - p_new))
            prec.append(tp / pred.sum())
        tpr_all, fpr_all = np.array([*tpr, 1.0]), np.array([*fpr, 1.0])
        rocs.append(((fpr_all[1:] - fpr_all[:-1]) * (tpr_all[1:] + tpr_all[:-1]) / 2).sum())
        prs.append(((tpr_all[1:-1] - tpr_all[:-2]) * np.array(prec[1:])).sum())
    return np.mean(rocs), np.mean(prs)


@pytest.mark.parametrize("seed", range(3))
def test_volumes_equal_the_definition(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    labels = np.zeros(n, dtype=int)
    for start, size in ((10, 5), (19, 6), (100, 9), (250, 4), (395, 5)):
        labels[start : start + size] = 1
    scores = np.round(rng.random(n) + 0.4 * labels, 2 if seed else 6)
    df = case(spark, scores, labels)
    found = M.label_runs(df)
    tolerance = M.tolerances(df, found)
    assert [r.tolerance for r in tolerance.collect()] == [5]
    got = M.volumes(df, found, tolerance).first()
    roc, pr = brute_vus(labels, scores, 5)
    assert got.vus_roc == pytest.approx(roc, abs=1e-9)
    assert got.vus_pr == pytest.approx(pr, abs=1e-9)


def brute_affiliation(pred, truth, n, grid=40):
    """Midpoint sums over a fine grid of points."""
    step = 1.0 / grid
    x = np.arange(0, n, step) + step / 2
    bounds = [0.0] + [(truth[i][1] + truth[i + 1][0]) / 2 for i in range(len(truth) - 1)] + [float(n)]
    inside = lambda events, v: np.any([(a <= v) & (v < b) for a, b in events], axis=0) if events else np.zeros(len(v), bool)
    precision, recall = [], []
    for j, (s, e) in enumerate(truth):
        zone = x[(x >= bounds[j]) & (x < bounds[j + 1])]
        dist = np.maximum(np.maximum(s - zone, zone - e), 0)
        mine = zone[inside(pred, zone)]
        if len(mine) == 0:
            recall.append(0.0)
            continue
        d = np.maximum(np.maximum(s - mine, mine - e), 0)
        precision.append(np.mean([(dist > v).mean() if v > 0 else 1.0 for v in d]))
        own = zone[(zone >= s) & (zone < e)]
        gap = np.abs(own[:, None] - mine[None, :]).min(axis=1)
        gap[inside(pred, own)] = 0
        recall.append(np.mean([(np.abs(zone - y) > g).mean() if g > 0 else 1.0 for y, g in zip(own, gap, strict=True)]))
    return np.mean(precision) if precision else 0.0, np.mean(recall)


@pytest.mark.parametrize(
    "pred, truth",
    [
        ([(2, 4), (9, 12), (14, 15), (30, 36)], [(3, 6), (10, 18), (33, 34)]),
        ([(0, 2), (25, 40)], [(3, 6), (10, 18)]),
        ([(11, 12), (16, 17)], [(5, 30)]),
        ([(2, 3)], [(20, 30), (35, 36)]),
    ],
)
def test_affiliation_equals_numeric_integration(spark, pred, truth):
    n = 40
    frame = lambda events: spark.createDataFrame(
        [("d", "a", a, b) for a, b in events], "detector string, series string, start bigint, stop bigint"
    )
    sizes = spark.createDataFrame([("d", "a", n)], "detector string, series string, n bigint")
    for cell in (4096, 7):
        got = M.affiliation(frame(pred), frame(truth), sizes, cell=cell).first()
        p, r = brute_affiliation(pred, truth, n)
        assert got.affiliation_precision == pytest.approx(p, abs=0.01)
        assert got.affiliation_recall == pytest.approx(r, abs=0.01)


def test_perfect_scores_and_cases_without_labels(spark):
    labels = [0, 0, 1, 1, 0, 0, 1, 0]
    good = case(spark, labels, labels)
    none = case(spark, range(8), [0] * 8, series="b")
    both = good.unionByName(none)
    got = {r.series: r for r in M.detection_metrics(both.drop("label"), both.select("series", "pos", "label")).collect()}
    assert got["a"].auroc == pytest.approx(1.0)
    assert got["a"].aupr == pytest.approx(1.0)
    assert got["a"].vus_pr > 0.5
    assert got["a"].affiliation_f1 == pytest.approx(1.0)
    assert all(got["b"][m] == 0.0 for m in M.METRICS)


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 8, 200)
    labels = (rng.random(200) < 0.3).astype(int)
    got = M.ranking_metrics(case(spark, scores, labels)).first()
    pos, neg = scores[labels == 1], scores[labels == 0]
    auroc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    ap, last = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        hit = scores >= t
        recall = labels[hit].sum() / labels.sum()
        ap += (recall - last) * labels[hit].mean()
        last = recall
    assert got.auroc == pytest.approx(auroc)
    assert got.aupr == pytest.approx(ap)


@pytest.mark.parametrize(
    "runs, n, want", [([(2, 2), (10, 5), (30, 10)], 60, 5), ([(0, 1), (19, 1)], 20, 1), ([(0, 7)], 7, 7), ([], 10, 1)]
)
def test_tolerance_is_the_median_run(spark, runs, n, want):
    labels = np.zeros(n, dtype=int)
    for start, size in runs:
        labels[start : start + size] = 1
    df = case(spark, labels, labels)
    assert M.tolerances(df, M.label_runs(df)).first().tolerance == want
    assert M.label_runs(df).count() == len(runs)
    assert df.agg(F.sum("label")).first()[0] == labels.sum()
