"""Language network: gradients, whole texts, held-out accuracy, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import language
from sensorloom.llm.common import read

TONGUES = {"aa": "banana lamana garanda salama ", "ee": "pretekle hetere lenteke mede ", "öö": "gröön mökör töröl sön "}


def test_gradient_through_time_equals_differences():
    draw = np.random.default_rng(0)
    w = language.start(3, units=4, kind=np.float64)
    codes = draw.integers(60, 200, (5, 9))
    codes[0, 6:] = codes[3, 1:] = language.NONE
    said = np.array([0, 1, 2, 1, 0])
    _, g = language.gradient(w, codes, said)
    for name, value in w.items():
        flat, slope = value.reshape(-1), g[name].reshape(-1)
        for at in np.append(draw.choice(len(flat), min(12, len(flat)), replace=False), np.abs(slope).argmax()):
            old = flat[at]
            flat[at] = old + 1e-5
            up, _ = language.gradient(w, codes, said)
            flat[at] = old - 1e-5
            down, _ = language.gradient(w, codes, said)
            flat[at] = old
            assert abs((up - down) / 2e-5 - slope[at]) < 1e-6


def test_chances_equal_the_plain_recurrence():
    draw = np.random.default_rng(1)
    w = language.start(3, units=4, kind=np.float64)
    raw = bytes(draw.integers(60, 200, 7, dtype=np.uint8))
    u = 4

    def states(codes, d):
        h, out = np.zeros(u), []
        for b in codes:
            x, g = w["byte"][d][b], h @ w["state"][d]
            z, r = (1 / (1 + np.exp(-(x[i * u : i * u + u] + g[i * u : i * u + u]))) for i in (0, 1))
            h = z * h + (1 - z) * np.tanh(x[2 * u :] + r * g[2 * u :])
            out.append(h)
        return out

    ahead, back = states(raw, 0), states(raw[::-1], 1)[::-1]
    logits = np.array([a @ w["label"][0] + b @ w["label"][1] + w["bias"] for a, b in zip(ahead, back, strict=True)])
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    codes = np.full((1, 12), language.NONE)
    codes[0, :7] = np.frombuffer(raw, dtype=np.uint8)
    assert np.allclose(language.chances(w, codes)[0, :7], want)
    letters = [i for i, b in enumerate(raw) if language.LETTER[b]]
    assert np.allclose(language.pooled(w, [raw.decode("latin-1")]).sum(), 1)
    assert np.allclose(language.chances(w, codes)[0, letters].mean(axis=0), want[letters].mean(axis=0))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text * (1 + i % 4), lang) for i in range(120) for lang, text in [list(TONGUES.items())[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "ee"), (1002, "12 ... 34", "aa"), (None, TONGUES["ee"], None), (1003, TONGUES["öö"], "aa"), (1003, TONGUES["öö"], "aa")]
    rows += [(1004, TONGUES["aa"] * 30 + TONGUES["ee"] * 3000, None), (1005, "日", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("z") for c in ("id", "t", "place", "piece", "score", "count")})


def test_hard_rows(spark, docs):
    got = language.identified(docs, steps=40).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r for r in got}
    assert [of[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and of[1000].score == 0
    assert all(of[i].lang_pred == list(TONGUES)[i % 3] for i in range(120))
    assert of[None].lang_pred == "ee" and not of[None].held_out and of[1003].lang_pred == "öö"
    # The rest of a long text counts as much as its beginning.
    assert of[1004].lang_pred == "ee" and of[1005].lang_pred in TONGUES


def test_without_languages_or_rows(spark, docs):
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identified(unknown).select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}
    assert language.identified(docs.where("false")).count() == 0
    one = language.identified(docs.withColumn("lang", F.lit("aa")), steps=2).where("lang_pred <> 'und'")
    assert {r.lang_pred for r in one.collect()} == {"aa"}


def test_languages_of_held_out_documents_are_no_input(spark, docs):
    held = language.labelled.in_fold(F.col("doc_id"), 4, 2)
    turned = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    key = lambda r: (str(r.doc_id), r.lang_pred, r.score)
    assert sorted(map(key, language.identified(docs, steps=3).collect())) == sorted(map(key, language.identified(turned, steps=3).collect()))


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = language.identified(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
