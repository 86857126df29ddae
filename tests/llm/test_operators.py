"""Every operator on hard rows: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import ann, bpe, exact, lines, packing, pii, quality, simhash, toxicity, urls
from sensorloom.llm.queries import byte_bpe_files

LONG = "word " * 20_000
LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi"
TEXTS = [
    (1, "a b c d"), (2, "a  b\tc d"), (3, None), (4, ""), (None, "x y"), (5, LONG), (6, LONG), (7, "a b c d"), (7, "a b c d"),
    (8, f"{LINE}\nunlike line of five words\n{LINE}"), (9, f"{LINE} psi"), (None, None), (10, "mail me: ab.c@d.org, +1 (234) 567-8901"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    # Names that operators use themselves.
    return rows.withColumns({c: F.lit("z") for c in ("key", "fp", "root", "page", "score", "label", "gone", "start", "mask", "th")}).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs)
    assert got.count() == len(TEXTS)
    of = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert of[1].component_id == of[2].component_id == of[7].component_id == 1
    assert of[3].component_id == of[4].component_id == 3 and of[3].fingerprint == "0" * 16
    assert of[6].component_id == 5
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {1, 3, 5, 8, 9, 10, None}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_through_hot_buckets(spark):
    from sensorloom.llm import pigeonhole

    prints = [0] + [1 << i for i in range(64)]
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    want = len(prints) * (len(prints) - 1) // 2
    assert pigeonhole.close_pairs(table, 2).count() == want
    assert pigeonhole.close_pairs(table, 2, bound=3).count() == want


def test_exact(docs, none):
    got = exact.copies(docs, capacity=2, depth=4)
    assert got.count() == len(TEXTS)
    want = {}
    for doc_id, text in TEXTS:
        want.setdefault(re.sub("[ \\x09-\\x0D]+", " ", text or ""), []).append(doc_id)
    for r in got.collect():
        ids = next(v for t, v in want.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert exact.copies(none).count() == 0


def test_bpe_and_packing(docs, none):
    path, files = public_tokenizers.path("word_bpe_49k.json"), byte_bpe_files()
    assert bpe.digests(docs, path).count() == len(TEXTS) and bpe.digests(none, path).count() == 0
    ids = bpe.encoded(docs.where("doc_id = 1"), path)
    assert bpe.decoded(ids, path).first().text == "a</w> b</w> c</w> d</w>"
    got = packing.packed(docs, files, capacity=64, group=8).collect()
    assert packing.packed(none, files).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    whole = packing.sequences(docs.where("doc_id in (1, 3, 8)"), files).collect()
    assert sum(len(r.ids) for r in whole) == packing.packed(docs.where("doc_id in (1, 3, 8)"), files).agg(F.sum("length")).first()[0]


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.report(docs).collect() if r.doc_id is not None}
    assert got[10].spans.startswith("email:9:19") and (got[10].n_email, got[10].n_phone) == (1, 1)
    assert got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.report(docs).count() == len(TEXTS) and pii.report(none).count() == 0
    assert pii.redacted(docs).where("doc_id = 10").first().text == "mail me: [EMAIL], [PHONE]"


def test_lines(docs, none):
    got = {(r.doc_id, r.text): r for r in lines.deduplicated(docs).collect()}
    assert len(got) == len({t for t in TEXTS})
    eight = next(r for (i, _), r in got.items() if i == 8)
    assert (eight.n_lines, eight.n_removed) == (3, 1) and eight.text == f"{LINE}\nunlike line of five words"
    assert (3, None) in got and lines.deduplicated(none).count() == 0


def test_classifiers(spark, docs, none):
    good = [(i, f"A plain sentence number {i}. It ends here. All is calm and fine today.") for i in range(100, 160)]
    bad = [(i, f"LOUD!! {i} ### idiot $$$ NOISE!! ### idiot !!") for i in range(200, 260)]
    table = spark.createDataFrame(good + bad + TEXTS, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    for found, label in ((quality.scored(table, labels), "quality"), (toxicity.scored(table, labels), "toxic")):
        both = found.join(labels, "doc_id").where("doc_id >= 100").collect()
        assert len(both) == 120 and all(r.predicted == r[label] for r in both)
        assert found.count() == len(TEXTS) + 120 and found.where("score is null or score < 0 or score > 1").count() == 0
    unlabelled = labels.where("false")
    assert quality.scored(docs, unlabelled).where("predicted = 0").count() == 0
    assert toxicity.scored(docs, unlabelled).count() == len(TEXTS)
    assert quality.scored(none, labels).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.org/x"), (2, "http://example.org/es/1?q"), (3, "x://b.com/fr/"), (4, "http://b.com/de/1#f"), (5, None), (6, "no scheme"), (6, "no scheme"), (None, "http://org")],
        "page_id bigint, url string",
    )
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    assert [got[i].rule for i in (1, 2, 3, 4, 5)] == ["org/", "example.org/es/", "com/fr/", "com/de/", None]
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["allow", "block", "allow", "block"]
    assert (got[5].host, got[5].path, got[None].host, got[None].path) == ("", "", "org", "")
    assert urls.judged(pages).count() == 8 and urls.judged(pages.where("false")).count() == 0


def test_neighbours(spark):
    data = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 0.0]), (63, [float("nan"), 1.0, 1.0]), (0, [0.0, 1.0, 0.0])]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    usable = [d for d in data[:60]]
    for q in (0, 50):
        v = data[q][1]

        def cosine(w, v=v):
            return sum(x * y for x, y in zip(v, w, strict=True)) / (sum(x * x for x in v) ** 0.5 * sum(x * x for x in w) ** 0.5)

        want = sorted(((-round(cosine(w), 12), i) for i, w in usable if i != q))[:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in want]
    assert ann.nearest(table.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(table.where("vec_id in (50, 51)"), F.col("vec_id") == 50).count() == 1
