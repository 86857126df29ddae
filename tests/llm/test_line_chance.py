"""Lines that meet in buckets by chance: told by short sketches, in parts, before any text is read."""

import random

import numpy as np
from pyspark.sql import functions as F

from sensorloom.llm import lines


def drawn(draw, words):
    return " ".join("".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(words))


def test_sketches_agree_from_so_many_bins_on(spark):
    draw = np.random.default_rng(3)
    size = lines.SHORT * lines.BINS
    one = draw.integers(0, 256, (size + 1, size))
    two = (one + draw.integers(1, 256, one.shape)) % 256
    # Row i has i bins in common, the largest and smallest values among them.
    for i in range(size + 1):
        places = draw.permutation(size)[:i]
        one[i, places[:2]] = (0, 255)[: len(places[:2])]
        two[i, places] = one[i, places]
    shifts = 9 * np.arange(lines.BINS)
    numbers = [(x.reshape(-1, lines.SHORT, lines.BINS) << shifts).sum(axis=2).tolist() for x in (one, two)]
    rows = spark.createDataFrame(list(zip(range(size + 1), *numbers, strict=True)), "i int, x array<bigint>, y array<bigint>")
    sides = ([F.col(side)[k] for k in range(lines.SHORT)] for side in "xy")
    got = {r.i: r.alike for r in rows.select("i", lines.agree(*sides).alias("alike")).collect()}
    common = (one == two).sum(axis=1).tolist()
    assert got == {i: common[i] >= lines.AGREEING for i in range(size + 1)} and set(got.values()) == {True, False}


def test_short_sketches_hold_bins_of_every_part():
    draw = random.Random(6)
    texts = [drawn(draw, n) for n in (5, 9, 30, 200)]
    found = lines.Lines("\n".join(texts).encode(), 1)
    wanted = np.array([3, 0, 2])
    full = lines.sketches(found, wanted).reshape(len(wanted), lines.PARTS, lines.BANDS)
    short = lines.short_sketches(found, wanted)
    bins = (short[:, :, None] >> 9 * np.arange(lines.BINS) & 511).reshape(len(wanted), lines.PARTS, -1)
    assert (bins == full[:, :, : bins.shape[2]] & 255).all() and short.min() >= 0


def test_unlike_lines_of_a_bucket_are_not_read(spark, monkeypatch):
    """Texts of all lines that met were fetched, and sent once more for every pair."""
    draw = random.Random(9)
    texts = [drawn(draw, 30) for _ in range(24)]
    # Like lines, one pair across documents, one of a bucket's other members.
    texts += [texts[3].replace("a", "b", 5), texts[11].replace("c", "d", 5)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")

    def one_bucket(docs, count, **options):
        met = lines.occurrences(docs, **options).select("fp").distinct()
        return met.crossJoin(met.agg(F.min("fp").alias("least"))).select(F.lit(7).cast("bigint").alias("bucket"), "fp", "least")

    compared, read = [], []
    verified, texts_of = lines._verified, lines._texts_of
    monkeypatch.setattr(lines, "buckets", one_bucket)
    monkeypatch.setattr(lines, "_verified", lambda pairs, *rest: (compared.append(pairs.count()), verified(pairs, *rest))[1])
    monkeypatch.setattr(lines, "_texts_of", lambda docs, wanted, words: (read.append(wanted.count()), texts_of(docs, wanted, words))[1])
    want = {24: 1, 25: 1}
    for rows in (lines.PART_ROWS, 90):
        monkeypatch.setattr(lines, "PART_ROWS", rows)
        monkeypatch.setattr(lines, "ROWS_A_LINE", 0)
        got = lines.deduplicated(docs).collect()
        assert {r.doc_id: r.n_removed for r in got if r.n_removed} == want
    # 25 pairs with the least, then 275 others.
    assert sum(compared) <= 8 and sum(read) <= 12


def test_parts_of_a_search_give_the_same_rows(spark, monkeypatch):
    draw = random.Random(12)
    base = [drawn(draw, 20) for _ in range(6)]
    rows = []
    for i in range(30):
        line = base[i % 6].split()
        line[draw.randrange(20)] = drawn(draw, 1)
        rows.append((i, " ".join(line) + "\n" + drawn(draw, 12)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(map(tuple, lines.deduplicated(docs).collect()))
    calls, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: (calls.append(df.columns), cut(df))[1])
    monkeypatch.setattr(lines, "PART_ROWS", 8)
    monkeypatch.setattr(lines, "ROWS_A_LINE", 0)
    assert sorted(map(tuple, lines.deduplicated(docs).collect())) == whole
    assert calls.count(["a", "ta", "b", "tb"]) > 2 and sum(r[2] for r in whole) >= 20


def test_groups_merge_in_one_task_and_in_many(spark, monkeypatch):
    draw = random.Random(4)
    names = [bytes([draw.randrange(256) for _ in range(4)]) for _ in range(60)]
    roots = {names[i]: min(names[i - i % 3 : i - i % 3 + 3]) for i in range(45)}
    links = [tuple(roots.get(x, x) for x in draw.sample(names, 2)) for _ in range(25)]
    want = {**{x: x for pair in links for x in pair}, **roots}
    for _ in links:
        for a, b in links:
            low = min(want[a], want[b])
            want = {k: low if r in (want[a], want[b]) else r for k, r in want.items()}
    tables = spark.createDataFrame(list(roots.items()), "key binary, root binary"), spark.createDataFrame(links, "a binary, b binary")
    for most in (lines.LINKS, 3):
        monkeypatch.setattr(lines, "LINKS", most)
        got = [(bytes(r.key), bytes(r.root)) for r in lines._merged(*tables).collect()]
        assert len(got) == len(want) and dict(got) == want
