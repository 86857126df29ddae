"""Every stage of the pipeline against a plain version, each on its own input."""

import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import lines, packing, quality
from sensorloom.llm.common import read
from sensorloom.llm.queries import byte_bpe_files

SF = "/root/testdata/sf0.001"


def connected(count, linked):
    parent = list(range(count))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(count)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        done.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_rejected_documents_go(spark, stages):
    _, before, after = stages[0]
    verdicts = quality.scored(before, read(spark, SF, "labels")).where("predicted = 1")
    assert set(table(after)) == set(table(verdicts))


def test_repeated_lines_go(stages):
    _, before, after = stages[1]
    texts = sorted((i, r.text) for i, r in table(before).items())
    found = [(i, p, b" ".join(w), w) for i, t in texts for p, w in enumerate(lines.split_lines(t)) if len(w) >= lines.WORDS]
    keys = list(dict.fromkeys(k for _, _, k, _ in found))
    words = {k: w for _, _, k, w in found}
    prints = lines.Hashes().prints([words[k] for k in keys]).view(np.uint64)
    linked = [
        (i, j) for i in range(len(keys)) for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= lines.BITS) + i + 1
        if lines.alike(keys[i].decode(), keys[j].decode(), lines.SIMILARITY)
    ]
    group = dict(zip(keys, connected(len(keys), linked), strict=True))
    seen, gone = set(), {}
    for i, p, k, _ in found:
        if group[k] in seen:
            gone.setdefault(i, set()).add(p)
        seen.add(group[k])
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())) for i, t in texts}
    want = {i: t for i, t in want.items() if i not in gone or t.strip(" ")}
    assert {i: r.text for i, r in table(after).items()} == want


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    rows = table(before)
    ids = sorted(rows)

    def shingles(text):
        words = text.encode().lower().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(rows[i].text or "") for i in ids]
    linked = [
        (i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    ]
    assert set(table(after)) == {ids[i] for i in set(connected(len(ids), linked))}


HARD = [
    (1, "mail me: ab.c@d.org\nand a line of five words\nand a line of five words"), (2, None), (3, ""), (4, "Short."), (4, "Short."),
    (None, "and a line of five words"), (5, "calm and plain text on one line. " * 3000), (6, "and a line of five words"), (None, None),
]
NAMES = ("_gone", "_lines", "_places", "_id", "_key", "_th", "_rk", "_spans", "key", "row", "id", "rk", "th", "places", "text_", "removed", "lines", "gone", "spans")


@pytest.mark.parametrize("number", range(5))
def test_stages_take_hard_rows_and_any_names(spark, number):
    docs = read(spark, SF, "documents")
    columns = [F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars")]
    hard = spark.createDataFrame(HARD, "doc_id bigint, text string").select("doc_id", "text", *columns)
    hard = hard.select(*docs.columns, *[F.lit("mine").alias(c) for c in NAMES])
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, hard, SF)
    got = out.collect()
    assert stage(spark, hard.where("false"), SF).count() == 0
    if name == "packing":
        assert sum(r.doc_id == 4 for r in got) == 2 and {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, None}
        return
    assert out.columns == hard.columns and all(r[c] == "mine" for r in got for c in NAMES)
    texts = sorted(((r.doc_id, r.text) for r in got), key=str)
    if name == "lines":
        # A null doc_id comes first, so its line is the one that stays.
        assert (1, "mail me: ab.c@d.org") in texts and (None, "and a line of five words") in texts
        assert 6 not in {i for i, _ in texts} and texts.count((4, "Short.")) == 2 and (2, None) in texts
    if name == "near_copies":
        assert {i for i, _ in texts} == {None, 1, 2, 4, 5, 6}
    if name == "personal_data":
        assert len(got) == len(HARD) and any(i == 1 and t.startswith("mail me: [EMAIL]") for i, t in texts) and (2, None) in texts


def test_personal_data_goes(stages):
    _, before, after = stages[3]
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    assert set(table(before)) == set(table(after))
    assert any(mail.search(r.text) for r in table(before).values())
    kept = table(before)
    for i, r in table(after).items():
        assert not mail.search(r.text) and r.n_chars == len(r.text)
        if not re.search("[0-9@]", kept[i].text):
            assert r.text == kept[i].text


def test_all_tokens_are_packed(stages):
    _, before, after = stages[4]
    own = packing.tokenizer(*byte_bpe_files())
    want = {i: len(own.encode(r.text)) + 1 for i, r in table(before).items()}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
