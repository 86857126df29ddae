import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import series
from sensorloom.functions import chance
from sensorloom.functions.blocks import HOUR, in_blocks
from sensorloom.operators import inject

N = 2000
VALUES = 10 + np.sin(np.arange(N) / 24 * 2 * np.pi)


@pytest.fixture(scope="module")
def cases(spark):
    df = in_blocks(series(spark, VALUES).withColumnRenamed("event_id", "pos"), HOUR)
    return df.persist()


def arrays(df):
    pdf = df.select("pos", "value", "label").toPandas().sort_values("pos")
    return pdf["value"].to_numpy(), pdf["label"].to_numpy()


def normals(spark, *labels):
    return spark.range(1).select(chance.normal(*labels).alias("x")).first().x


@pytest.mark.parametrize("kind", inject.KINDS)
def test_only_labelled_rows_change(cases, kind):
    value, label = arrays(inject.inject(cases, 3, [kind]))
    assert len(value) == N
    assert (value[label == 0] == VALUES[label == 0]).all()
    changed = (np.abs(value - VALUES) > 1e-12) & (label == 1)
    assert changed.sum() > 0.8 * label.sum() > 0


def apply_by_hand(spark, table, seed):
    """Segments one after the other, in the order of the kinds."""
    x = VALUES.copy()
    std = VALUES.std()
    for kind in inject.KINDS:
        for r in sorted((r for r in table if r.kind == kind), key=lambda r: r.j):
            s = slice(r.start, r.start + r.len)
            if kind == "spikes":
                x[s] += (4 if r.up else -4) * std
            elif kind == "scale":
                x[s] *= 2.0 if r.up else 0.25
            elif kind == "noise":
                x[s] += [2 * std * normals(spark, seed, "noise", "a", r.j, p) for p in range(r.start, r.start + r.len)]
            else:
                p = np.linspace(0, 1, r.len)
                noise = np.array([normals(spark, seed, "drift", "a", r.j, i) for i in range(r.len)])
                mean = x[s].mean()
                x[s] = mean + (x[s] - mean) * (1 + p) + (1 if r.up else -1) * 3 * std * p**2 + noise * 0.3 * std * p
    return x


def test_overlapping_anomalies_compound_in_order(spark, cases):
    sizes = inject.case_sizes(cases)
    rows = [
        ("a", "spikes", 0, 100, 1, True), ("a", "spikes", 1, 100, 1, True), ("a", "scale", 0, 95, 10, True),
        ("a", "scale", 1, 100, 3, False), ("a", "noise", 0, 98, 4, True), ("a", "drift", 0, 90, 20, True),
        ("a", "drift", 1, 85, 30, False), ("a", "drift", 2, 85, 16, True), ("a", "drift", 3, 300, 16, False),
        ("a", "drift", 4, 316, 20, True),
    ]
    table = spark.createDataFrame(rows, "series string, kind string, j bigint, start bigint, len bigint, up boolean")
    value, label = arrays(inject.apply(cases, sizes, table, 5))
    assert value == pytest.approx(apply_by_hand(spark, table.collect(), 5))
    marked = np.zeros(N, dtype=int)
    for r in rows:
        marked[r[3] : r[3] + r[4]] = 1
    assert (label == marked).all()


def test_counts_lengths_and_places(cases):
    sizes = inject.case_sizes(cases)
    for kind, (rate, (low, high)) in inject.PROFILE.items():
        found = inject.anomaly_table(sizes, kind, 7).collect()
        assert len(found) == max(1, N // rate)
        assert all(low <= r.len <= high and 0 <= r.start and r.start + r.len <= N for r in found)
    again = inject.anomaly_table(sizes, "scale", 7).orderBy("j").collect()
    assert again == inject.anomaly_table(sizes, "scale", 7).orderBy("j").collect()
    assert again != inject.anomaly_table(sizes, "scale", 8).orderBy("j").collect()


def test_short_series_stay_as_they_are(spark):
    df = in_blocks(series(spark, [1, 2, 3, 4, 5, 6, 7]).withColumnRenamed("event_id", "pos"), HOUR)
    out = inject.inject(df, 1)
    assert out.agg(F.sum("label"), F.sum("value")).first() == (0, 28.0)


def test_one_of_each_in_its_own_quarter(cases):
    rows, table = inject.inject_one_of_each(cases, 3)
    found = {r.kind: r for r in table.collect()}
    for i, kind in enumerate(inject.KINDS):
        assert i * 500 < found[kind].start and found[kind].start + found[kind].len <= (i + 1) * 500
    assert rows.count() == N


def test_unknown_kind(cases):
    with pytest.raises(ValueError):
        inject.inject(cases, 1, ["wobble"])
