"""SimHash search of the near-copies stage against all pairs of fingerprints."""

import itertools

from sensorloom.llm import shingles


def test_close_fingerprints_share_a_bucket(spark):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words)] + [" ".join([*words[:-n], *(f"x{n}.{i}" for i in range(n))]) for n in (1, 2, 3, 5, 200, 590)]
    rows = [(i, t) for i, t in enumerate([*texts, ""])]
    found = shingles.described(spark.createDataFrame(rows, "doc_id bigint, text string"))
    prints = {r.doc_id: (r.key, r.fp) for r in found.collect()}
    assert prints.pop(len(texts))[1] is None
    buckets = {}
    for r in shingles.print_buckets(found.select("key", "fp")).collect():
        buckets.setdefault(bytes(r.key), set()).add(r.bucket)
    near = 0
    for (a, x), (b, y) in itertools.combinations(prints.values(), 2):
        close = ((x ^ y) % (1 << 64)).bit_count() <= shingles.BITS
        assert close == bool(buckets[bytes(a)] & buckets[bytes(b)])
        near += close
    assert 0 < near < 21
