"""Addresses without an at sign and national numbers are selected."""

from sensorloom.llm import pii


def test_planted_wider_spans_are_selected(spark):
    rows = [(i, f"please contact name{i}@host.org or call +49 301 555 {1000 + i} today") for i in range(200)]
    rows += [(1000 + i, f"serial {100 + i}-200-3000 of part {i}") for i in range(60)]
    rows += [(2000, "please contact anna [at] host [dot] org about it"), (2001, "please call 301 555 1234 today")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.kind): (r.start, r.end, r.base) for r in pii.spans(docs).where("doc_id >= 1000").collect()}
    assert got == {(2000, "email"): (15, 39, False), (2001, "phone"): (12, 24, False)}
    text = {r.doc_id: r.text for r in pii.redacted(docs).where("doc_id >= 2000").collect()}
    assert text == {2000: "please contact [EMAIL] about it", 2001: "please call [PHONE] today"}
