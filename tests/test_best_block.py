"""Stretches by the stack, and the best block, against looking at every interval."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from helpers import T0, series
from sensorloom.functions.blocks import HOUR
from sensorloom.operators import grid


def hour(i):
    return T0 + dt.timedelta(hours=i)


def all_stretches(counts):
    """``(k, n, first, last)`` of the longest stretches of every level; the smallest k of each."""
    found = {}
    for k in range(max(counts), 0, -1):
        for high, group in itertools.groupby(range(len(counts)), key=lambda i: counts[i] >= k):
            group = list(group)
            if high:
                found[group[0], group[-1]] = (k, min(counts[group[0] : group[-1] + 1]))
    return sorted((k, n, first, last) for (first, last), (k, n) in found.items())


@pytest.mark.parametrize("rows", [1, 5, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_stretches_equal_every_level(spark, seed, rows):
    rng = random.Random(seed)
    counts = [rng.choice([0, 1, 2, 2, 3, 5, 9]) for _ in range(60)]
    if seed == 1:
        counts = list(range(1, 31)) + list(range(30, 0, -1))
    if seed == 2:
        counts = [4] * 60
    df = spark.createDataFrame([(hour(i), c) for i, c in enumerate(counts)], "ts timestamp, n_observed bigint")
    got = grid.stretches(df, HOUR, rows=rows).collect()
    index = {hour(i): i for i in range(60)}
    assert sorted((r.k, r.n, index[r.run_start], index[r.run_end]) for r in got) == all_stretches(counts)
    assert all(r.run_len == index[r.run_end] - index[r.run_start] + 1 for r in got)


@pytest.mark.parametrize("seed", range(5))
def test_best_block_equals_looking_at_all(spark, monkeypatch, seed):
    # One stretch a round: the bounds decide when to stop.
    monkeypatch.setattr(grid, "FIRST_LOOK", 1)
    monkeypatch.setattr(grid, "LOOK", 2)
    rng = random.Random(seed)
    held = {f"s{j}": [rng.random() < 0.8 for _ in range(40)] for j in range(5)}
    if seed == 4:
        held = {"s0": [i % 2 == 0 for i in range(40)], "s1": [i % 2 == 1 for i in range(40)]}
    obs = None
    for name, there in held.items():
        one = series(spark, [1.0 if t else None for t in there], name=name).where("value is not null")
        obs = one if obs is None else obs.unionByName(one)
    first = min(i for t in held.values() for i in range(40) if t[i])
    counts = [sum(t[i] for t in held.values()) for i in range(40)]
    best = None
    for k, _, a, b in all_stretches(counts):
        members = [s for s, t in held.items() if all(t[a : b + 1])]
        score = len(members) ** 0.6 * (b - a + 1) ** 0.4
        key = (round(score, 9), -k, -a)
        if members and (best is None or key > best[0]):
            best = (key, set(members), a, b)
    got = grid.best_block(obs, HOUR).collect()
    if seed == 4:
        # Something is observed all the time, but no series ever is.
        assert best is None and got == []
        return
    assert {r.series for r in got} == best[1] and first <= best[2]
    assert {(r.run_start, r.run_end, r.run_len, r.n_series) for r in got} == {
        (hour(best[2]), hour(best[3]), best[3] - best[2] + 1, len(best[1]))
    }


def test_no_observations_give_no_block(spark):
    empty = series(spark, [1.0]).where("false")
    assert grid.best_block(empty, HOUR).count() == 0
    assert grid.best_block(series(spark, [None, None]).where(F.col("value").isNotNull()), HOUR).count() == 0
