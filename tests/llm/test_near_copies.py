"""Near copies against brute-force similarity of five-word shingles."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import shingles, simhash
from sensorloom.llm.common import read


def plain(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """Least id of each id's group, over all pairs."""
    sets = {i: plain(t or "") for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def planted():
    words = [f"w{i}" for i in range(200)]
    edited = list(words)
    for place in (30, 80, 130, 180):
        edited[place] = f"other{place}"
    return [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1])), (4, ""), (5, None), (6, "two words")]


def test_stage_takes_documents_with_some_words_changed(spark):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string")
    prints = [simhash.fingerprint(t) % (1 << 64) for _, t in planted()[:2]]
    assert (prints[0] ^ prints[1]).bit_count() > 2
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]


@pytest.mark.parametrize("name", ["sf0.01"])
def test_groups_are_those_of_brute_force(spark, name):
    docs = read(spark, f"/root/testdata/{name}", "documents").select("doc_id", "text")
    want = groups([(r.doc_id, r.text) for r in docs.collect()])
    assert len(set(want.values())) < len(want)
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert got == want
    assert {r.doc_id for r in shingles.keep_one(docs).select(F.col("doc_id")).collect()} == set(want.values())
