"""Near-duplicate documents by the real similarity of their word shingles.

Two documents are linked when the Jaccard similarity of their sets of five-word
shingles reaches ``similarity``.  Pairs to compare come from SimHash, the fingerprints
of the sets that differ in at most ``BITS`` bits, all of them by pigeonhole blocks.  So
few bits reach a similarity of some 0.97; what lies below comes from MinHash beside it: of
20 bands of five minima a pair of similarity 0.8 shares one with probability 0.9996, one
of 0.85 with 0.99999.  Each pair is verified on the sets themselves, so none is linked below.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common, pigeonhole, simhash
from sensorloom.session import cut

WIDTH, SIMILARITY = 5, 0.8
# Bits of SimHash that may differ, and the parts it is cut into for their search.
BITS, PARTS = 3, 6
BANDS, ROWS = 20, 5
# So many hashes meet all factors at once.
CHUNK = 1 << 12

FACTORS = np.random.default_rng(42).integers(0, 1 << 64, size=(BANDS * ROWS, 2), dtype="<u8") | np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes of the text's shingles; words are those of :func:`simhash.fingerprint`.

    Fewer words than ``width`` are one shingle, no words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    count = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = (digest(b" ".join(words[i : i + width]), 42) for i in range(count))
    return np.unique(np.fromiter(hashes, dtype="<u8", count=count))


def key(found: np.ndarray) -> bytes:
    """Name of a set of shingles."""
    return xxhash.xxh3_128_digest(found.tobytes())


def bands(found: np.ndarray) -> np.ndarray:
    """One signed number for each band of a set of shingles that is not empty."""
    least = np.full(len(FACTORS), np.iinfo("<u8").max, dtype="<u8")
    for start in range(0, len(found), CHUNK):
        mixed = found[None, start : start + CHUNK] * FACTORS[:, :1] ^ FACTORS[:, 1:]
        np.minimum(least, mixed.min(axis=1), out=least)
    parts = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], dtype="<u8").view("<i8")


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number."""
    return simhash.majority(found[start : start + simhash.CHUNK] for start in range(0, len(found), simhash.CHUNK))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets of shingles are that similar; empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, key, bands, fp`` of every row of ``docs (doc_id, text)``; an empty set has neither bands nor ``fp``."""

    def run(batches):
        for batch in batches:
            sets = [shingles(text) for text in batch.column("text").to_pylist()]
            named = [bands(s) if len(s) else np.zeros(0, dtype="<i8") for s in sets]
            prints = [fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(map(key, sets), pa.binary()), pa.array(named, pa.list_(pa.int64())),
                    pa.array(prints, pa.int64()),
                ],
                ["doc_id", "key", "bands", "fp"],
            )

    return common.texts(docs).mapInArrow(run, "doc_id bigint, key binary, bands array<bigint>, fp bigint")


def print_buckets(distinct: DataFrame) -> DataFrame:
    """``key, bucket`` of sets ``distinct (key, fp)``: one bucket for a fingerprint and one for each pair of close ones."""
    prints = distinct.where("fp is not null").select("key", "fp")
    close = pigeonhole.close_pairs(prints.select("fp").distinct(), BITS, blocks=PARTS)
    sides = close.select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("fp"))
    own = prints.select("key", F.xxhash64("fp").alias("bucket"))
    return own.unionByName(prints.join(sides, "fp").select("key", "bucket"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, hashes`` of the ``wanted (key, doc_id)`` sets, by a second pass over their documents."""

    def run(batches):
        for batch in batches:
            found = {key(s): s.view("<i8") for s in map(shingles, batch.column("text").to_pylist())}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["key", "hashes"]
            )

    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    rows = common.texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = rows.select("text").mapInArrow(run, "key binary, hashes array<bigint>")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs (a, b)`` that are similar; the least set of a hot bucket meets its pairs in a skewed join."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return cut(both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"))


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id``: one row per row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links.  Documents with one
    set of shingles are compared once; empty texts are alike.  In each bucket first
    all sets meet the least, then those pairs that no link has connected yet.  A null
    text is the empty one.
    """
    rows = common.saved(described(docs))
    distinct = cut(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    keyed = distinct.select("key", F.explode("bands").alias("bucket")).unionByName(print_buckets(distinct))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where("n > 1")
    shared = cut(keyed.join(sizes.drop("n"), "bucket"))
    # A row without a doc_id is found by its null id.
    concerned = distinct.join(shared.select("key").distinct(), "key", "left_semi").select("key", "doc_id")
    sets = common.saved(_sets(docs, concerned))
    stars = shared.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    edges = _verified(stars, sets, similarity)
    roots = common.components(edges).select(F.col("node").alias("key"), "root")
    placed = cut(shared.select("bucket", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    placed = placed.join(mixed.select("bucket"), "bucket")
    other = placed.select("bucket", F.col("key").alias("b"), F.col("root").alias("rb"))
    open_ = placed.withColumnsRenamed({"key": "a", "root": "ra"}).join(other, "bucket").where("ra <> rb and a < b")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_ = open_.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    edges = edges.unionByName(_verified(open_, sets, similarity))
    roots = common.components(edges).select(F.col("node").alias("key"), "root")
    named = distinct.select("key", "doc_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(least, "root").select("key", "component_id")
    return rows.select("doc_id", "key").join(classes, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, of one document of each group: the smallest doc_id.

    Rows that repeat a doc_id stay or go together; rows without a doc_id stay.
    """
    others = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(others, docs["doc_id"].cast("bigint") == others["gone"], "left_anti")
