"""The quality fit over all labelled documents against its plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import quality


def drawn(n, share, seed=3):
    draw = np.random.default_rng(seed)
    good = draw.random(n) < share
    rows = draw.normal(0, 1, (n, len(quality.NAMES))) + good[:, None] * np.linspace(-0.5, 0.5, len(quality.NAMES))
    return rows, good


def table(spark, rows, good):
    known = [(int(g), i * 7919, [float(v) for v in x]) for i, (x, g) in enumerate(zip(rows, good, strict=True))]
    return spark.createDataFrame(known, "label int, place bigint, x array<double>")


def test_likelihood_is_that_of_all_pairs():
    rows, good = drawn(60, 0.4)
    weights = np.linspace(-1, 1, len(quality.NAMES))
    off = (rows[good][:, None] - rows[~good][None]).reshape(-1, len(weights))
    p = 1 / (1 + np.exp(-off @ weights))
    found = quality.pair_sums(rows[good], rows[~good], weights)
    want = [[len(off)], off.T @ (1 - p), ((off * (p * (1 - p))[:, None]).T @ off).ravel()]
    assert np.allclose(found, np.concatenate(want), atol=1e-9)


def test_one_block_is_the_plain_fit(spark):
    rows, good = drawn(400, 0.7)
    got, want = quality.fitted(table(spark, rows, good)), quality.fit(rows, good)
    assert np.allclose(got.weights, want.weights, atol=1e-6) and got.accepted == pytest.approx(want.accepted, abs=1e-6)
    assert (want.scores(rows) < quality.ACCEPT).sum() == (~good).sum()


def test_every_labelled_document_is_in_a_block(spark):
    rows, good = drawn(3000, 0.99)
    known = table(spark, rows, good)
    blocks = quality.dealt(known, int(good.sum()), int((~good).sum()), block=200).collect()
    # The rare kind is in every block, the other one is dealt once.
    assert len(blocks) == 15 and all(len(r.bad) >= 14 for r in blocks)
    width = len(quality.NAMES)
    assert {tuple(r.bad[i : i + width]) for r in blocks for i in range(0, len(r.bad), width)} == {tuple(x) for x in rows[~good]}
    dealt = sorted(tuple(r.good[i : i + width]) for r in blocks for i in range(0, len(r.good), width))
    assert dealt == sorted(map(tuple, rows[good]))
    got, want = quality.fitted(known, block=200), quality.fit(rows, good)
    assert np.corrcoef(got.weights, want.weights)[0, 1] > 0.9
    assert (got.scores(rows) < quality.ACCEPT).sum() == (~good).sum()


def test_labels_beyond_any_sample_count(spark):
    # 24,000 labelled documents: 12 bad ones of a kind of their own, all of which must be learned from.
    docs = spark.range(24_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2000 == 1, "### $$$ ### $$$").otherwise(F.concat(F.lit("A calm line of text. Number "), F.col("id"))).alias("text"),
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 2000 != 1).cast("int").alias("quality"))
    # The sample of 20,000 held no more than its own share of them in the border.
    known = quality.labelled.training_labels(labels, "quality", 4, 9)
    assert known.count() == 24_000
    found = quality.scored(docs, labels, held=9).where("predicted = 0")
    assert sorted(r.doc_id for r in found.collect()) == list(range(1, 24_000, 2000))
