"""Packing of documents into sequences of at most ``capacity`` tokens.

Items are dealt into groups of bounded size and packed there best fit first, the
longest first.  Swaps then push tokens from the emptiest sequence into other
underfull ones - a move, one for one, two for one or one for two - each time with
a larger sum of squared fills, until sequences become empty.  What is left in
underfull sequences of all groups is dealt into fewer groups and packed again.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common
from sensorloom.llm.bpe import settled_class
from sensorloom.session import cut

CAPACITY, END = 1024, 2
# Items of a group, share of the capacity from which on a sequence is closed before the last round.
GROUP, CLOSED = 16_384, 0.98
# Sequences that one group tries to empty after each other without success.
TRIES = 8
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class ByteBpe:
    """Encoder of a byte-level tokenizers file.

    Texts of settled letters go through the same vocabulary as ranks, several
    times as fast; the library itself encodes texts with others or special tokens.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(ranks, "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.settled = re.compile("[" + settled_class(r"(?s:.)") + "]*").fullmatch

    def encode(self, text: str) -> np.ndarray:
        if "<|" not in text and (text.isascii() or self.settled(text)):
            return np.asarray(self.plain.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.cache
def tokenizer(path: str, ranks: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, ranks, pattern)


def pieces(docs: DataFrame, files: tuple[str, str, str], *, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]`` of ``docs (doc_id, text)``.

    A document is its ids and ``end``; a longer one than ``capacity`` is cut into
    pieces of that length, of which the first may be shorter.
    """

    def run(batches):
        bpe = tokenizer(*files)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(bpe.encode(text), np.array([end], dtype="<u4"))
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[lo:hi]
                    rows.append((doc_id, piece, lo, hi - lo, zlib.crc32(part.tobytes()), *([part.astype("i4")] if with_ids else [])))
            fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
            fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields]
            )

    return common.texts(docs).mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


class Bins:
    """Items in bins of one capacity."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.members: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest items first, each into the fullest bin that takes it."""
        by_space: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        spaces = 0
        for item in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            size = self.sizes[item]
            fits = spaces >> size
            if fits:
                space = size + (fits & -fits).bit_length() - 1
                target = by_space[space].pop()
                if not by_space[space]:
                    spaces &= ~(1 << space)
                self.members[target].append(item)
                self.fill[target] += size
            else:
                target, space = len(self.fill), self.capacity
                self.members.append([item])
                self.fill.append(size)
            space -= size
            if space:
                by_space[space].append(target)
                spaces |= 1 << space

    def exchange(self, source: int, target: int) -> bool:
        """The exchange that puts most tokens of ``source`` into ``target``; False if none does.

        With the source not fuller than the target, each makes the sum of squared fills larger.
        """
        space, sizes = self.capacity - self.fill[target], self.sizes
        ours = sorted(self.members[source], key=sizes.__getitem__)
        theirs = sorted(self.members[target], key=sizes.__getitem__)
        a, b = [sizes[i] for i in ours], [sizes[i] for i in theirs]
        best, give, take = 0, (), ()

        def better(gain: int, out: tuple, back: tuple) -> None:
            nonlocal best, give, take
            if best < gain <= space:
                best, give, take = gain, out, back

        at = bisect.bisect_right(a, space)
        if at:
            better(a[at - 1], (at - 1,), ())
        for j, size in enumerate(b):
            at = bisect.bisect_right(a, size + space)
            if at:
                better(a[at - 1] - size, (at - 1,), (j,))
            # Two of ours for one of theirs: the largest sum that fits.
            lo, hi = 0, len(a) - 1
            while lo < hi:
                total = a[lo] + a[hi]
                if total <= size + space:
                    better(total - size, (lo, hi), (j,))
                    lo += 1
                else:
                    hi -= 1
        for i, size in enumerate(a):
            # One of ours for two of theirs: the least sum that makes room.
            lo, hi = 0, len(b) - 1
            while lo < hi:
                total = b[lo] + b[hi]
                if size - total <= space:
                    better(size - total, (i,), (lo, hi))
                    hi -= 1
                else:
                    lo += 1
        if not best:
            return False
        out, back = {ours[i] for i in give}, {theirs[j] for j in take}
        self.members[source] = [i for i in self.members[source] if i not in out] + list(back)
        self.members[target] = [i for i in self.members[target] if i not in back] + list(out)
        self.fill[source] -= best
        self.fill[target] += best
        return True

    def search(self) -> None:
        """Empty bins by exchanges while there are more than the tokens need."""
        least = -(-sum(self.fill) // self.capacity)
        used = sum(1 for f in self.fill if f)
        failed: set[int] = set()
        while used > least and len(failed) < TRIES:
            open_ = [i for i, f in enumerate(self.fill) if 0 < f < self.capacity and i not in failed]
            if not open_:
                break
            source = min(open_, key=lambda i: (self.fill[i], i))
            targets = sorted((i for i, f in enumerate(self.fill) if 0 < f < self.capacity and i != source), key=lambda i: (self.fill[i], i))
            moved = True
            while moved and self.fill[source]:
                moved = False
                for target in targets:
                    if self.fill[target] < self.fill[source]:
                        continue
                    while self.fill[source] and self.fill[target] < self.capacity and self.exchange(source, target):
                        moved = True
                    if not self.fill[source]:
                        break
            if self.fill[source]:
                failed.add(source)
            else:
                used -= 1

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of every item."""
        bins, offsets = np.zeros(len(self.sizes), dtype=np.int64), np.zeros(len(self.sizes), dtype=np.int64)
        for number, members in enumerate(self.members):
            offset = 0
            for item in members:
                bins[item], offsets[item] = number, offset
                offset += self.sizes[item]
        return bins, offsets


def pack(sizes: list[int], capacity: int = CAPACITY) -> Bins:
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.search()
    return bins


def placed(parts: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; ``parts`` has rows of ``PIECE``.

    Full pieces are sequences of their own.  A group is packed in one task; the
    number of groups grows with the items.
    """
    rows = cut(parts.withColumn("item", F.monotonically_increasing_id()))
    done = rows.where(F.col("length") == capacity).select(
        *parts.columns, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    waiting, level = rows.where(F.col("length") < capacity).select("item", "length"), 0
    count, found = waiting.count(), None
    while count:
        groups = -(-count // group)
        dealt = waiting.withColumn("group", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
        filled = cut(dealt.groupBy("group").applyInPandas(
            _packer(level, capacity), "item bigint, length bigint, sequence_id bigint, offset bigint, fill bigint"
        ))
        closed = F.col("fill") >= CLOSED * capacity
        left = filled.where(~closed).count() if groups > 1 else 0
        # Another round where it can change much: the open sequences' items, in fewer groups.
        again = 0 < left <= 0.5 * count
        final = (filled.where(closed) if again else filled).select("item", "sequence_id", "offset")
        found = final if found is None else found.unionByName(final)
        if not again:
            break
        waiting, count, level = filled.where(~closed).select("item", "length"), left, level + 1
    if found is None:
        return done
    return done.unionByName(rows.join(found, "item").select(*parts.columns, "sequence_id", "offset"))


def _packer(level: int, capacity: int):
    """Function that packs one group; groups and rounds have their own range of numbers."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=False)
        bins = pack(pdf["length"].tolist(), capacity)
        number, offset = bins.places()
        fill = np.array(bins.fill, dtype=np.int64)[number]
        first = (level << 56) + (int(key[0]) << 24)
        return pdf[["item", "length"]].assign(sequence_id=first + number, offset=offset, fill=fill)

    return run


def packed(docs: DataFrame, files: tuple[str, str, str], *, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece of ``docs (doc_id, text)``.

    A null text is the empty one: its only id is ``end``.  Repeated rows, and rows
    with a null doc_id, are packed each.  No rows give no rows, other columns are
    not read.
    """
    return placed(pieces(docs, files, capacity=capacity, end=end), capacity=capacity, group=group)


def sequences(docs: DataFrame, files: tuple[str, str, str], *, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """``sequence_id, ids``: the packed sequences; for tables whose doc_ids are unique."""
    where = packed(docs, files, capacity=capacity, end=end, group=group).select("doc_id", "piece", "sequence_id", "offset")
    parts = pieces(docs, files, capacity=capacity, end=end, with_ids=True).select("doc_id", "piece", "ids")
    joined = parts.join(where, ["doc_id", "piece"]).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    return joined.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
