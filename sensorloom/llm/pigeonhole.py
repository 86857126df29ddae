"""All pairs of 64-bit fingerprints that differ in at most k bits.

Cut the bits into ``blocks`` parts: a pair with at most k differing bits agrees
on at least ``blocks - k`` whole parts, so it meets in the join on one of the
``blocks choose k`` masks.  A bucket with more members than ``bound`` is cut
again over the bits its mask leaves free, which keeps every pair; at the last
level few free bits are left, and with them few different members.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.session import cut

BOUND = 256
# Below so many free bits a bucket holds at most 2 ** LAST fingerprints.
LAST = 11


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def submasks(free: list[int], blocks: int, k: int) -> list[int]:
    """Masks that fix all but k of ``blocks`` even parts of the ``free`` bit places."""
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in free[lo:hi]) for lo, hi in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - k)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(prints: DataFrame, k: int, *, blocks: int = 5, bound: int = BOUND, settled: str | None = None) -> DataFrame:
    """``a, b`` with a < b of distinct ``prints (fp bigint)`` at most k bits apart.

    Pairs with the same value other than null in the column ``settled`` are not wanted.
    """
    spark = prints.sparkSession
    extra = [settled] if settled else []
    rows = prints.select("fp", *extra, F.lit(0).cast("bigint").alias("mask"))
    masks, found = {0: list(range(64))}, None
    while True:
        cuts = {m: submasks(free, blocks, k) for m, free in masks.items()}
        if len(cuts) == 1:
            finer = F.array(*[F.lit(signed(x)) for x in next(iter(cuts.values()))])
            keyed = rows.select("fp", *extra, F.explode(finer).alias("sub"), F.lit(0).cast("bigint").alias("mask"))
        else:
            # One row per mask of the level, whatever the number of fingerprints.
            table = [(signed(m), signed(x)) for m, subs in cuts.items() for x in subs]
            keyed = rows.join(F.broadcast(spark.createDataFrame(table, "mask bigint, sub bigint")), "mask")
        keyed = keyed.select(
            "fp", *extra, F.col("mask").bitwiseOR(F.col("sub")).alias("mask"),
            F.col("fp").bitwiseAND(F.col("mask").bitwiseOR(F.col("sub"))).alias("part"),
        )
        sizes = keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = cut(keyed.join(sizes, ["mask", "part"]))
        masks = {m | x: [b for b in masks[m] if not x >> b & 1] for m, subs in cuts.items() for x in subs}
        last = max(map(len, masks.values())) <= LAST
        near = shared if last else shared.where(F.col("n") <= bound)
        pairs = _joined(near, ["mask", "part"], k, settled)
        found = pairs if found is None else found.unionByName(pairs)
        hot = shared.where(F.col("n") > bound)
        if last or hot.isEmpty():
            return found.distinct()
        # A fingerprint hot under several masks stays one row for each of them.
        rows = hot.select("fp", *extra, "mask")


def _joined(members: DataFrame, bucket: list[str], k: int, settled: str | None) -> DataFrame:
    """Close pairs within the buckets."""
    other = members.select(*bucket, F.col("fp").alias("other"), (F.col(settled) if settled else F.lit(None)).alias("_settled"))
    wanted = (F.col("fp") < F.col("other")) & (distance(F.col("fp"), F.col("other")) <= k)
    if settled:
        wanted = wanted & ~F.coalesce(F.col(settled) == F.col("_settled"), F.lit(False))
    return members.join(other, bucket).where(wanted).select(F.col("fp").alias("a"), F.col("other").alias("b"))


# So many names of buckets are sorted at once.
SORTED = 1 << 21
# Bytes of a name within its range, and of a row's number.
NAME_BYTES, ROW_BYTES = 4, 5


def mates(rows: DataFrame, named, each: int, count: int, bits: int) -> DataFrame:
    """``bucket, fp, least``: members of buckets with several different ones, and the least of them.

    ``named`` makes ``(fp, names)`` of batches of ``rows``: numbers below 2 ** 40 that may repeat,
    whose part above ``bits`` is a class, and ``each`` 64-bit names of buckets a row; ``count`` is
    about the number of rows.  A bucket holds two adjacent classes.  ``bucket`` is null
    where it has two members: pairs with one null bucket count once in a task.

    Names travel packed by ranges of names, nine bytes each with the member.  The ranges grow in number with
    the rows; within one a name keeps 32 bits, and two of one name only have more members.
    """
    tasks = max(8, -(-count * each // (1 << 20)))
    ranges = 8 * tasks

    def packed(prints, names):
        prints, names = np.concatenate(prints), np.concatenate(names)
        keys = ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32) << np.uint64(32) | names & np.uint64(0xFFFFFFFF)).ravel()
        bits = (len(prints) - 1).bit_length()
        if (int(ranges) - 1).bit_length() + 32 + bits <= 64:
            # Numbers sort faster than places: the name, then the row.
            keys = np.sort(keys << np.uint64(bits) | np.repeat(np.arange(len(prints), dtype="<u8"), each))
            keys, prints = keys >> np.uint64(bits), prints[keys & np.uint64((1 << bits) - 1)]
        else:
            order = np.argsort(keys)
            keys, prints = keys[order], prints[order // each]
        part = keys >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        data = np.concatenate([
            keys.view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES], prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ROW_BYTES]
        ], axis=1)
        # Byte by byte, as the upper ones of sorted names repeat.
        found = [data[lo:hi].T.tobytes() for lo, hi in zip(starts, [*starts[1:], len(data)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), pa.array(found, pa.binary())], ["part", "names"])

    def pack(batches):
        prints, names, size = [], [], 0
        for fp, some in named(batches):
            prints.append(fp)
            names.append(some)
            size += some.size
            if size >= SORTED:
                yield packed(prints, names)
                prints, names, size = [], [], 0
        if size:
            yield packed(prints, names)

    def unpack(batches):
        keys, prints = [], []
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("names").to_pylist(), strict=True):
                data = np.frombuffer(data, dtype=np.uint8).reshape(NAME_BYTES + ROW_BYTES, -1).T
                wide = np.zeros((2, len(data), 8), dtype=np.uint8)
                wide[0, :, :NAME_BYTES], wide[1, :, :ROW_BYTES] = data[:, :NAME_BYTES], data[:, NAME_BYTES:]
                keys.append(wide[0].view("<u8")[:, 0] | np.uint64(part << 32))
                prints.append(wide[1].view("<i8")[:, 0])
        if keys:
            yield from met(np.concatenate(keys), np.concatenate(prints), bits)

    packs = rows.mapInArrow(pack, "part bigint, names binary")
    return packs.repartition(tasks, "part").mapInArrow(unpack, "bucket bigint, fp bigint, least bigint")


def met(keys: np.ndarray, prints: np.ndarray, bits: int):
    """Rows of :func:`mates` of one task's names ``keys`` and their members."""
    if not len(keys):
        return
    # Keys that may come again: sorted by some bits of a hash, with the place in the others.
    low = np.uint64((len(keys) - 1).bit_length())
    found = np.sort(keys * np.uint64(0x9E3779B97F4A7C15) >> low << low | np.arange(len(keys), dtype="<u8"))
    same = np.concatenate([[False], found[1:] >> low == found[:-1] >> low, [False]])
    again = found[same[1:] | same[:-1]] & (np.uint64(1) << low) - np.uint64(1)
    keys, prints = keys[again], prints[again]
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
    keys, prints = keys[new], prints[new]
    if not len(keys):
        return
    # Stretches of one name and class, each taken together with the next class if that is there.
    classes = prints >> bits
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])]))
    stops = np.append(starts[1:], len(keys))
    next_to = np.append((keys[starts][1:] == keys[starts][:-1]) & (classes[starts][1:] == classes[starts][:-1] + 1), False)
    stops = np.where(next_to, np.append(stops[1:], 0), stops)
    # The second class alone is within the stretch before.
    taken = (next_to | ~np.concatenate([[False], next_to[:-1]])) & (stops - starts > 1)
    starts, sizes = starts[taken], (stops - starts)[taken]
    two = sizes == 2
    pairs = np.unique(np.stack([prints[starts[two] + 1], prints[starts[two]]], axis=1), axis=0)
    starts, sizes = starts[~two], sizes[~two]
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)
    # The name and the class that a bucket begins with, as one number.
    bucket = keys[starts] * np.uint64(0x9E3779B97F4A7C15) + classes[starts].astype("<u8")
    for fp, least, name in (
        (pairs[:, 0], pairs[:, 1], None), (prints[at], np.repeat(prints[starts], sizes), np.repeat(bucket, sizes).view("<i8")),
    ):
        if len(fp):
            name = pa.nulls(len(fp), pa.int64()) if name is None else pa.array(name)
            yield pa.RecordBatch.from_arrays([name, pa.array(fp), pa.array(least)], ["bucket", "fp", "least"])


# Marks of hashes: 512 pages of 2 ** 15 bits, 2 MB whatever the input.
MARK_BITS, PAGE_BITS = 24, 15


def marks(wanted: DataFrame, place: Column) -> bytes:
    """One bit for each of 2 ** 24 places: whether a row of ``wanted`` has it."""
    pages = wanted.groupBy(F.shiftright(place, PAGE_BITS).alias("page")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))).alias("bits")
    )
    size = 1 << (PAGE_BITS - 3)
    # At most 512 pages of 4096 bytes.
    table = bytearray(size << (MARK_BITS - PAGE_BITS))
    for row in pages.collect():
        table[row.page * size : (row.page + 1) * size] = row.bits
    return bytes(table)


def marked(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose hash in ``column`` may be among those of ``wanted``: none of these is missing."""
    at = F.shiftrightunsigned(F.col(column), 64 - MARK_BITS)
    page, bit = F.shiftright(at, PAGE_BITS), at.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))
    pages = wanted.groupBy(page.alias("_page")).agg(F.bitmap_construct_agg(bit).alias("_marks"))
    byte = F.conv(F.hex(F.substring(F.col("_marks"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.withColumn("_page", page).join(F.broadcast(pages), "_page").where(hit).select(*rows.columns)
