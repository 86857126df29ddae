"""Near-duplicate documents by SimHash and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common, pigeonhole
from sensorloom.session import cut

# So many shingles are hashed at once, whatever the length of the text.
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, as a signed number.

    Words are runs of other than ASCII white space after lower-casing A-Z; fewer
    words than ``width`` are one shingle, none gives zero.  A bit is set when it
    is set in over half of the shingles' XXH64, repeats included.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return majority(
        np.fromiter(
            (digest(b" ".join(words[i : i + width]), seed) for i in range(start, stop)), dtype="<u8", count=stop - start
        )
        for start, stop in ((start, min(count, start + CHUNK)) for start in range(0, count, CHUNK))
    )


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits set in over half of all hashes, given in parts, as a signed number."""
    ones, count = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row of ``docs (doc_id, text)``."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(text, width) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return common.texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def near_duplicates(docs: DataFrame, *, bits: int = 2, width: int = 3, bound: int = pigeonhole.BOUND) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs (doc_id, text)``.

    Documents whose fingerprints differ in at most ``bits`` bits are linked;
    ``component_id`` is the smallest doc_id reachable over links.  Copies share
    one fingerprint, so blocks, pairs and components hold each fingerprint once,
    however many documents have it.

    A null text is the empty one: fingerprint zero, linked like any other.  Rows
    that repeat a doc_id are each reported.  A null doc_id is reported with its
    component's id, which is null only where the component has no other id.  No
    rows give no rows; other columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs, width=width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = common.components(pigeonhole.close_pairs(distinct.select("fp"), bits, bound=bound))
    roots = roots.select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, of one document of each group: the smallest doc_id.

    Rows that repeat a doc_id stay or go together; rows without a doc_id stay.
    """
    others = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(others, docs["doc_id"].cast("bigint") == others["gone"], "left_anti")
