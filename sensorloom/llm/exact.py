"""Exact copies through an extendible-hash index on shared files.

The index has one chain head per 64-bit key of a normalised text.  Its directory
doubles while buckets hold more heads than their capacity; every bucket is a range
of keys.  Only texts whose key occurs more than once are compared, byte by byte:
they are grouped by bucket, key and whole text, so texts that merely share a key
become separate links of the key's chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import common
from sensorloom.session import cut

# Chain heads per bucket, and the most the directory doubles: 2 ** 16 slots.
CAPACITY = 1 << 14
DEPTH = 16

# Marks of repeated keys: 512 pages of 2 ** 15 bits, 2 MB whatever the input.
MARK_BITS = 24
PAGE_BITS = 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, common.SPACES, " ")


def leaves(counts: dict[int, int], *, depth: int = DEPTH, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(prefix, local depth)`` of the buckets after all splits, in key order.

    ``counts`` has the chain heads of each of the ``2 ** depth`` finest slots.
    """
    sizes = [counts]
    for _ in range(depth):
        coarser: dict[int, int] = {}
        for slot, heads in sizes[-1].items():
            coarser[slot >> 1] = coarser.get(slot >> 1, 0) + heads
        sizes.append(coarser)
    out, waiting = [], [(0, 0)]
    while waiting:
        prefix, at = waiting.pop()
        if at < depth and sizes[depth - at].get(prefix, 0) > capacity:
            waiting += [(2 * prefix + 1, at + 1), (2 * prefix, at + 1)]
        else:
            out.append((prefix, at))
    return out


def directory(heads: DataFrame, *, depth: int = DEPTH, capacity: int = CAPACITY) -> DataFrame:
    """``slot, bucket``: the directory, of at most ``2 ** depth`` slots."""
    slot = F.shiftrightunsigned("key", 64 - depth)
    # At most 2 ** depth counts reach the driver.
    counts = {row.slot: row.n for row in heads.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = leaves(counts, depth=depth, capacity=capacity)
    deepest = max(at for _, at in buckets)
    rows = []
    for bucket, (prefix, at) in enumerate(buckets):
        spread = 1 << (deepest - at)
        rows += [(prefix * spread + i, bucket) for i in range(spread)]
    table = heads.sparkSession.createDataFrame(rows, "slot bigint, bucket int")
    return table.withColumn("depth", F.lit(deepest))


def _page(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MARK_BITS + PAGE_BITS)


def _bit(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MARK_BITS).bitwiseAND(F.lit((1 << PAGE_BITS) - 1))


def copies(docs: DataFrame, *, depth: int = DEPTH, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs (doc_id, text)``.

    Texts are equal when identical after each run of ASCII white space became one
    space; of equal texts the row with the smallest doc_id stays.  A null text is
    the empty one.  Rows that repeat the smallest doc_id are all marked as kept; a
    null doc_id stays only in a group without ids.  No rows give no rows, other
    columns are not read.
    """
    rows = common.texts(docs).select("doc_id", normalised(F.col("text")).alias("t"))
    keyed = rows.select("doc_id", F.xxhash64("t").alias("key"), "t")
    entries = cut(keyed.select("doc_id", "key", F.unhex(F.sha2("t", 256)).alias("sha")))
    heads = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    repeated = heads.where("n > 1").groupBy(_page(F.col("key")).alias("page")).agg(
        F.bitmap_construct_agg(_bit(F.col("key"))).alias("marks")
    )
    # Texts whose key is marked; a key that shares its mark is compared in vain, no copy is missed.
    byte = F.substring(F.col("marks"), (F.shiftright(_bit(F.col("key")), 3) + 1).cast("int"), F.lit(1))
    marked = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), _bit(F.col("key")).bitwiseAND(F.lit(7)).cast("int")) == 1
    compared = keyed.withColumn("page", _page(F.col("key"))).join(F.broadcast(repeated), "page").where(marked)
    slots = directory(heads, depth=depth, capacity=capacity)
    deepest = slots.first().depth
    slot = F.shiftrightunsigned("key", 64 - deepest) if deepest else F.lit(0).cast("bigint")
    # A group's copies become one row per task before they move to the bucket's owner.
    groups = compared.groupBy(slot.alias("slot"), "key", "t").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    chains = groups.select(
        "slot", "key", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size"
    ).join(F.broadcast(slots.select("slot", "bucket")), "slot")
    link = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    index = cut(chains.withColumn("link", link).repartitionByRange("bucket", "key", "link"))
    found = index.select("key", "sha", "keep_id", "group_size")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return entries.join(found, ["key", "sha"], "left").select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay; rows without a doc_id stay."""
    gone = copies(docs, **options).where("not kept").select(F.col("doc_id").alias("gone")).where("gone is not null").distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["gone"], "left_anti")


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
