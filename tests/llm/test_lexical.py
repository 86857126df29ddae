"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sensorloom.llm import lexical

LETTERS = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def plain(docs, items, top=50):
    def terms(text):
        return re.findall(LETTERS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    held = [(doc_id, t) for doc_id, text in docs if (t := terms(text))]
    n, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scores = []
        asked = set(terms(text))
        df = {q: sum(q in t for _, t in held) for q in asked}
        for doc_id, t in held:
            m = 100 - 50 + (50 * len(t) * n) // total
            score = 0
            for q in asked:
                if q in t:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[q] + 1))) * ((1000000000 * t.count(q)) // (1000 * t.count(q) + 20 * m))
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("z") for c in ("item", "n", "terms", "score", "rank")})
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit("z") for c in ("key", "t", "score", "doc_id")})
    return sorted((tuple(r) for r in lexical.ranked(table.repartition(3), asked, **options).collect()), key=str)


def corpus(seed, size):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "日本", "a1"]
    weight = [1 / (1 + i) for i in range(len(words))]
    return [(i, draw.choice([" ", ", ", "_"]).join(draw.choices(words, weight, k=draw.randint(1, 40)))) for i in range(size)]


def test_ranks_equal_scoring_all(spark, monkeypatch):
    docs = corpus(1, 400) + [(400, None), (401, ""), (402, "..."), (None, "w1 w2 w3"), (7, "w1 w2"), (7, "w1 w2"), (403, "w40 " * 30_000)]
    items = [(1, "w1 W2 w59 日本"), (2, "w0"), (3, None), (4, ""), (5, "nowhere"), (1, "w3 w40"), (None, "éa a1 w8")]
    assert found(spark, docs, items) == plain(docs, items)
    # Two queries a block.
    monkeypatch.setattr(lexical, "QUERIES", 2)
    assert found(spark, docs, items, top=3) == plain(docs, items, top=3)


def test_no_rows(spark):
    docs, items = corpus(2, 5), [(1, "w1 w2")]
    assert found(spark, [(1, None)], items) == [] and found(spark, docs, [(1, None)]) == []
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([], "item_id bigint, text string")
    assert lexical.ranked(empty, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert lexical.ranked(spark.createDataFrame(docs, "doc_id bigint, text string"), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_skipping_loses_nothing_and_skips(monkeypatch):
    monkeypatch.setattr(lexical, "SPAN", 8)
    monkeypatch.setattr(lexical, "TOGETHER", 4)
    draw, probed = np.random.default_rng(4), 0
    for _ in range(60):
        size, terms = int(draw.integers(1, 700)), 12
        there = draw.random((size, terms)) < draw.random(terms) ** 2
        doc, term = np.nonzero(there)
        impact = (draw.pareto(1.0, len(doc)) * 100).astype(np.int64) + 1
        ids = np.sort(draw.choice(10_000, size, replace=False))
        block = lexical.Block(ids, doc, term, impact)
        query, weight = draw.choice(terms, 6, replace=False), draw.integers(0, 50, 6)
        best = lexical.Best(10)
        seen = []
        add = best.add
        best.add = lambda s, d, add=add, seen=seen: (seen.append(len(d)), add(s, d))
        lexical.search(block, query, weight, best)
        score = np.zeros(size, dtype=np.int64)
        for q, w in zip(query, weight, strict=True):
            score[doc[term == q]] += w * impact[term == q]
        want = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if s > 0)[:10]
        assert [(-int(s), int(i)) for s, i in zip(best.scores, best.docs, strict=True)] == want
        probed += sum(seen) < (score > 0).sum()
    assert probed > 30


def test_counts_of_terms():
    texts = ["b a B, a_a", "", "ÀB àb", "xa ax a"]
    table = lexical.Terms([b"a", b"b", "àb".encode(), "Àb".encode()])
    sizes, text, number, times = lexical.count_terms(pa.array(texts), table)
    assert sizes.tolist() == [5, 0, 2, 3]
    assert list(zip(text, number, times, strict=True)) == [(0, 0, 3), (0, 1, 2), (2, 2, 1), (2, 3, 1), (3, 0, 1)]
