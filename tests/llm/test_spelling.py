"""Spelling variants against a plain version that compares all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sensorloom.llm import spelling


def apart(a, b):
    """Whether one letter was replaced, inserted or deleted."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, near = {}, {}
    for w in n:
        others = [v for v in n if apart(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n.get(form[w])))
    return sorted(out)


def found(spark, docs, **options):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("z") for c in ("word", "n", "id", "t", "size", "h")})
    return sorted(tuple(r) for r in spelling.variants(table, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed):
    draw = random.Random(seed)
    docs, words = [], ["aabbaa", "ababab", "éàüßöä"] + ["".join(draw.choice("abé") for _ in range(draw.randint(6, 8))) for _ in range(40)]
    for doc_id in range(60):
        text = []
        for _ in range(120):
            w = words[min(int(draw.expovariate(0.15)), len(words) - 1)]
            if draw.random() < 0.2:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abé") + w[at:], w[:at] + "b" + w[at + 1 :]])
            text.append(w.upper() if draw.random() < 0.1 else w)
        docs.append((doc_id, draw.choice([" ", "-", "\n", "1"]).join(text)))
    return docs


def test_variants_equal_comparing_all_words(spark):
    # A chain of three words beside the random ones.
    docs = [*corpus(3), (100, "chainab " * 6 + "chainac " * 40 + "chaindc " * 300)]
    want = plain(docs)
    assert len(want) > 100 and sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert found(spark, docs) == want


def test_hot_buckets_are_cut_into_slices(spark):
    docs = [(i, " ".join(["prefix" + chr(97 + i // 5) + chr(97 + i % 5)] * 5 * (1 + i))) for i in range(25)]
    want = plain(docs)
    assert max(r[4] for r in want) >= 8
    assert found(spark, docs, shard=4) == want


def test_hard_rows(spark):
    long = "x" * 3000
    docs = [(1, None), (2, ""), (None, "nowhere " * 6), (3, f"{long} {long}y " * 5), (3, "letters " * 5), (3, "letters " * 5), (4, "letterz " * 2), (5, "ÀÉ×÷ÿþ 123 " * 5)]
    got = found(spark, docs)
    assert got == plain(docs) and {r[0] for r in got} >= {"nowhere", "letters", long, "ÀÉ×÷ÿþ"}
    assert found(spark, [(1, None)]) == [] and spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_ties_take_the_least_word(spark):
    docs = [(0, "mnopqr " * 5 + "mnopqs " * 40 + "anopqr " * 40 + "znopqr " * 40)]
    rows = {r[0]: r for r in found(spark, docs)}
    assert rows["mnopqr"][1] == "anopqr" and rows["mnopqr"][5] == 40


def test_bitsets_find_every_edit():
    words = ["abcdef", "abcdeg", "abdef", "abccef", "bcdef", "abcde", "zbcdef", "aabcdef", "abcdfe"]
    size = 6
    short = [w for w in words if len(w) <= size]
    codes = spelling._codes(short, size)
    asks = [i for i, w in enumerate(short) if len(w) == size]
    bucket = np.zeros(len(short), dtype=int)
    i, j = spelling.one_apart(codes[asks], bucket[asks], codes, bucket, np.array([len(w) for w in short]))
    got = {(short[asks[a]], short[b]) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a in short for b in short if len(a) == size and a != b and apart(a, b)}


def test_chains_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(9)], "word string, form string")
    ends = {r.word: r.root for r in spelling.roots(forms, 5**10).collect()}
    assert set(ends.values()) == {"w09"}
