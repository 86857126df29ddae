"""Work that the line search saves, and that its results stay exact."""

import random

import numpy as np

from sensorloom.llm import lines


def plain_distance(a, b):
    left, right = (np.array([ord(c) for c in x]) for x in (a, b))
    steps = np.arange(len(b) + 1)
    row = steps
    for i, letter in enumerate(left):
        down = np.append(i + 1, np.minimum(row[:-1] + (right != letter), row[1:] + 1))
        row = np.minimum.accumulate(down - steps) + steps
    return int(row[-1])


def test_a_short_rest_needs_no_table(monkeypatch):
    """Tables were filled for pairs whose letters between common beginning and end are fewer than may differ."""
    asked = []
    monkeypatch.setattr(lines, "close", lambda a, b, most: (asked.extend(a), np.zeros(len(a), dtype=bool))[1])
    monkeypatch.setattr(lines, "edit_distance", lambda a, b, most: (asked.append(a), most + 1)[1])
    a = ["x" * 50 + "abcdefgh" * 2 + "y" * 50] * 60
    b = ["x" * 50 + "ijklmnop" + "y" * 50] * 60
    assert lines.all_alike(a, b, 0.8).all() and not asked


def test_pairs_are_compared_in_one_pass(monkeypatch):
    """A small distance was tried for all first."""
    sizes, close = [], lines.close
    monkeypatch.setattr(lines, "close", lambda a, b, most: (sizes.append(len(a)), close(a, b, most))[1])
    draw = random.Random(3)
    a = ["".join(draw.choices("abcdefgh", k=200)) for _ in range(100)]
    b = ["".join(draw.choices("abcdefgh", k=200)) for _ in range(100)]
    assert not lines.all_alike(a, b, 0.8).any() and sum(sizes) <= 100


def test_long_pairs_and_odd_lengths_are_exact():
    draw = random.Random(11)
    a, b = [], []
    for size in (1, 63, 64, 65, 127, 128, 129, 300, 900, 2200):
        for part in (3, 6, 30):
            x = draw.choices("abcd é中", k=size)
            y = list(x)
            for _ in range(draw.randrange(size // part + 1)):
                i = draw.randrange(len(y) + 1)
                y[i : i + draw.randrange(3)] = draw.choice(("", "e", "ab", "abcdbc"))
            a.append("".join(x))
            b.append("".join(y))
            # A passage moved from the end to the beginning.
            a.append("".join(x))
            b.append("".join(y[-size // 8 :] + y[: -size // 8]))
    for similarity in (0.6, 0.8, 0.95):
        most = [int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
        want = [plain_distance(x, y) for x, y in zip(a, b, strict=True)]
        got = [lines.edit_distance(*pair) for pair in zip(a, b, most, strict=True)]
        assert all(g == w if w <= m else g > m for g, w, m in zip(got, want, most, strict=True))
        # Several times, so that they are compared side by side.
        assert lines.all_alike(a * 20, b * 20, similarity).tolist() == [w <= m for w, m in zip(want, most, strict=True)] * 20


def test_bins_agree_with_the_chance_of_the_jaccard_similarity():
    draw = np.random.default_rng(4)
    for shared in (10, 40, 90):
        grams = [draw.integers(0, 1 << 32, 100, dtype="<u4") for _ in range(400)]
        for x, y in zip(grams[::2], grams[1::2], strict=True):
            y[:shared] = x[:shared]
        bins = lines.sketch(np.concatenate(grams), np.full(400, 100))
        assert abs((bins[::2] == bins[1::2]).mean() - shared / (200 - shared)) < 0.03
