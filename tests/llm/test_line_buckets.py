"""Buckets of lines, their comparison side by side, and what stays on disk."""

import random

import numpy as np

from sensorloom.llm import lines, pigeonhole


def test_pairs_side_by_side_equal_one_by_one():
    draw = random.Random(5)
    a, b = ["", "", "x", "same"], ["", "y", "", "same"]
    for _ in range(400):
        x = [draw.choice("abcd é") for _ in range(draw.choice((1, 7, 40, 150)))]
        y = list(x)
        for _ in range(draw.randrange(len(x) // 2 + 1)):
            i = draw.randrange(len(y) + 1)
            y[i : i + draw.randrange(2)] = draw.choice(("", "e", "ab"))
        a.append("".join(x))
        b.append("".join(y))
    for similarity in (0.6, 0.8, 0.95):
        assert lines.all_alike(a, b, similarity).tolist() == [lines.alike(x, y, similarity) for x, y in zip(a, b, strict=True)]


def test_buckets_hold_adjacent_classes_and_no_repeats():
    draw = np.random.default_rng(2)
    keys, prints = draw.integers(0, 40, 500).astype("<u8"), draw.integers(0, 4, 500) << 8 | draw.integers(0, 9, 500)
    keys, prints = np.append(keys, keys), np.append(prints, prints)
    got = {}
    stars = set()
    for batch in pigeonhole.met(keys, prints, 8):
        for row in batch.to_pylist():
            stars.add((row["fp"], row["least"]))
            if row["bucket"] is not None:
                got.setdefault(row["bucket"], set()).add(row["fp"])
    together = {(x, y) for members in got.values() for x in members for y in members} | stars | {(y, x) for x, y in stars}
    want = {
        (x, y) for k in set(keys.tolist()) for x in set(prints[keys == k].tolist()) for y in set(prints[keys == k].tolist())
        if x != y and abs((x >> 8) - (y >> 8)) <= 1
    }
    assert {(x, y) for x, y in together if x != y} == want


def test_steps_leave_no_names_of_buckets_and_no_shuffles(spark, tmp_path, monkeypatch):
    """The names were saved with the lines, and shuffled again."""
    saved = []
    keep = lines.common.saved
    monkeypatch.setattr(lines.common, "saved", lambda df: (saved.append(df.columns), keep(df))[1])
    rows = [(i, f"a line of words that comes back in each of them\nnumber {chr(97 + i) * 9} has its own other words here") for i in range(6)]
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.n_removed >= 1 for r in got if r.doc_id) and spark.conf.get(setting, "false") == before
    assert not any("names" in columns for columns in saved)
