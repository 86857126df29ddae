"""Ranked lexical search: summed short lists inside document-at-a-time skipping.

Documents are read once into counts of the queries' terms, written as a table.  Each
task turns runs of that table into blocks of postings in document order.  For one
query and block the short lists are summed into accumulators first (term at a time);
these then act as one more list with known bounds beside the long lists, and documents
are visited in order: spans whose bounds cannot reach the least of the best results so
far are skipped, and lists that cannot lift a document alone are only probed for the
documents still in the race.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import common

# Documents and postings of a block, documents of a span with its own bound, spans visited together.
DOCS, POSTINGS, SPAN, TOGETHER = 8192, 4_000_000, 128, 16
# Bytes of text that are cut into terms together.
BYTES = 2_000_000
# A block of queries ends beyond this many rows or characters; any number of blocks follows.
QUERIES, QUERY_CHARS = 4096, 4_000_000
# Ways by which an item's candidates are thinned before they meet.
WAYS = 64

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Every byte of a character beyond ASCII belongs to a term.
IN_TERM = np.array([b >= 128 or bytes([b]).isalnum() for b in range(256)])

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COUNTS = "doc_id bigint, n bigint, terms array<int>, times array<int>"
FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(ASCII_LOWER))


class Terms:
    """Byte strings with numbers, looked up many at a time by a checked hash."""

    def __init__(self, terms: list[bytes]):
        self.lengths = np.array([len(t) for t in terms], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(terms), dtype=np.uint8)
        factor = 0x9E3779B97F4A7C15
        while True:
            self.factor = np.uint64(factor)
            hashes = self._hashes(self.bytes, self.starts[:-1], self.starts[1:])
            if len(np.unique(hashes)) == len(terms):
                break
            factor = (factor * 6364136223846793005 + 2) % (1 << 64) | 1
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[hashes >> np.uint64(44)] = True

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One number per token: its bytes times powers counted from its start, mixed."""
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        stretch = np.diff(np.append(starts, len(data)))
        place = np.arange(starts[0], len(data)) - np.repeat(starts, stretch)
        inside = place < np.repeat(ends - starts, stretch)
        powers = np.cumprod(np.full(int((ends - starts).max()), self.factor, dtype=np.uint64))
        value = np.zeros(len(place), dtype=np.uint64)
        value[inside] = (data[starts[0] :][inside] + np.uint64(1)) * powers[place[inside]]
        total = np.add.reduceat(value, starts - starts[0])
        total ^= total >> np.uint64(29)
        return total * np.uint64(0xBF58476D1CE4E5B9)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens ``data[start:end]`` are known, and their numbers."""
        hashes = self._hashes(data, starts, ends)
        if not len(self.hashes) or not len(hashes):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        number = self.order[at]
        same = (self.hashes[at] == hashes[maybe]) & (self.lengths[number] == (ends - starts)[maybe])
        maybe, number = maybe[same], number[same]
        good = np.ones(len(maybe), dtype=bool)
        size = self.lengths[number]
        for length in np.unique(size):
            rows, step = np.flatnonzero(size == length), np.arange(length)
            mine = data[starts[maybe[rows]][:, None] + step]
            good[rows] = (mine == self.bytes[self.starts[number[rows]][:, None] + step]).all(axis=1)
        return maybe[good], number[good]


def count_terms(column: pa.Array, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text its length in terms; then text, term and times of every known term."""
    if not len(column):
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, nothing, nothing
    offsets = _offsets(column)
    raw = column.buffers()[2]
    data = LOWER[np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]] if raw else np.empty(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    sizes = np.bincount(text, minlength=len(column)).astype(np.int64)
    which, number = terms.numbers(data, starts, ends)
    keys, times = np.unique(text[which] * max(1, len(terms.lengths)) + number, return_counts=True)
    return sizes, keys // max(1, len(terms.lengths)), keys % max(1, len(terms.lengths)), times


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` in parts of bounded text; a longer text is a part of its own."""
    offsets = _offsets(batch.column("text"))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BYTES, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, times`` of every document that holds a term of any kind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Terms(terms)
        for batch in batches:
            for part in slices(batch):
                sizes, text, number, times = count_terms(part.column("text"), table)
                offsets = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (number, times)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), *lists], ["doc_id", "n", "terms", "times"])
                yield out.filter(pa.array(sizes > 0))

    return common.texts(docs).mapInArrow(count, COUNTS)


def weights(documents: int, holders: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((2N+2)/(2df+1)))`` per term."""
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * holders.astype(np.float64) + 1))).astype(np.int64)


def impacts(times: np.ndarray, sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's share of a document's score, before its weight."""
    m = 50 + (50 * sizes * documents) // max(1, total)
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


class Block:
    """Postings by term, each list in document order, with the largest impact of every span."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.doc_ids = doc_ids
        self.spans = -(-len(doc_ids) // SPAN)
        order = np.lexsort((doc, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.known, starts = np.unique(term, return_index=True)
        self.edges = np.append(starts, len(term))
        self.cache: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Documents, impacts and largest impact per span of one list; none if it is empty."""
        if term not in self.cache:
            at = int(np.searchsorted(self.known, term))
            if at == len(self.known) or self.known[at] != term:
                return None
            doc, impact = self.doc[self.edges[at] : self.edges[at + 1]], self.impact[self.edges[at] : self.edges[at + 1]]
            most = np.zeros(self.spans, dtype=np.int64)
            np.maximum.at(most, doc // SPAN, impact)
            self.cache[term] = doc, impact, most
        return self.cache[term]


@dataclass
class Best:
    """The best results so far, best first: larger scores, then smaller ids."""

    size: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    docs: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    @property
    def least(self) -> int:
        """A document below this score cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.size else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, -scores))[: self.size]
        self.scores, self.docs = scores[order], docs[order]


def search(block: Block, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Enter the documents of ``block`` that belong to the best for one query."""
    lists = [(block.postings(int(t)), int(w)) for t, w in zip(terms, weight, strict=True) if w > 0]
    lists = sorted(((p, w) for p, w in lists if p is not None), key=lambda x: len(x[0][0]))
    if not lists:
        return
    # Term at a time: the shortest lists together, up to a quarter of the documents.
    held, short = 0, 0
    while short < len(lists) and (short == 0 or held + len(lists[short][0][0]) <= len(block.doc_ids) // 4):
        held, short = held + len(lists[short][0][0]), short + 1
    sums = np.zeros(block.spans * SPAN, dtype=np.int64)
    for (doc, impact, _), w in lists[:short]:
        sums[doc] += w * impact
    listed = np.flatnonzero(sums)
    iterators = [(listed, sums[listed], sums.reshape(-1, SPAN).max(axis=1))]
    iterators += [(doc, w * impact, w * most) for (doc, impact, most), w in lists[short:]]
    bounds = np.sum([most for _, _, most in iterators], axis=0)
    starts = np.arange(0, block.spans * SPAN + 1, SPAN * TOGETHER)
    starts = np.append(starts, block.spans * SPAN) if starts[-1] < block.spans * SPAN else starts
    places = [np.searchsorted(doc, starts) for doc, _, _ in iterators]
    for number, (low, high) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        spans = slice(low // SPAN, high // SPAN)
        least = best.least
        alive = bounds[spans] >= least
        if not alive.any():
            continue
        # Lists whose bounds together stay below the least cannot enter a document alone.
        most = np.array([int(top[spans][alive].max()) for _, _, top in iterators])
        order = np.argsort(most, kind="stable")
        behind = np.cumsum(most[order])
        alone = int(np.searchsorted(behind, least))
        score = np.zeros(high - low, dtype=np.int64)
        for i in order[alone:]:
            doc, share, _ = iterators[i]
            part = slice(places[i][number], places[i][number + 1])
            score[doc[part] - low] += share[part]
        racing = np.flatnonzero(score)
        racing = racing[alive[racing // SPAN]]
        for step in range(alone - 1, -1, -1):
            racing = racing[score[racing] + behind[step] >= least]
            if not len(racing):
                break
            i = order[step]
            doc, share, _ = iterators[i]
            part = slice(places[i][number], places[i][number + 1])
            doc, share = doc[part], share[part]
            if len(doc):
                at = np.minimum(np.searchsorted(doc, racing + low), len(doc) - 1)
                score[racing] += np.where(doc[at] == racing + low, share[at], 0)
        racing = racing[score[racing] >= least]
        if len(racing):
            best.add(score[racing], block.doc_ids[racing + low])


def _blocks(batches: Iterator[pa.RecordBatch], documents: int, total: int) -> Iterator[Block]:
    """Blocks of bounded size from batches of counted documents."""
    held, docs, postings = [], 0, 0

    def made() -> Block:
        ids = np.concatenate([h[0] for h in held])
        sizes, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        term, times = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(np.arange(len(ids)), lengths)
        return Block(ids[order], place[doc], term, impacts(times, sizes[doc], documents, total))

    for batch in batches:
        for start in range(0, batch.num_rows, DOCS):
            part = batch.slice(start, DOCS)
            terms, times = part.column("terms"), part.column("times")
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            # Documents without an id come last and are told apart from all others.
            ids = np.where(np.isnan(ids), NO_ID, ids).astype(np.int64) if ids.dtype.kind == "f" else ids
            lengths = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            flat = terms.flatten().to_numpy().astype(np.int64)
            held.append((ids, part.column("n").to_numpy(), lengths, flat, times.flatten().to_numpy().astype(np.int64)))
            docs, postings = docs + part.num_rows, postings + len(flat)
            if docs >= DOCS or postings >= POSTINGS:
                yield made()
                held, docs, postings = [], 0, 0
    if held:
        yield made()


NO_ID = np.iinfo(np.int64).max


def _query_blocks(items: DataFrame, key: str) -> Iterator[list[tuple[object, list[str]]]]:
    """Items with their different terms, some thousand at a time."""
    block, chars = [], 0
    rows = items.select(F.col(key).alias("key"), F.col("text").alias("t"))
    for row in rows.toLocalIterator():
        block.append((row.key, sorted(set(terms_of(row.t)))))
        chars += len(row.t or "")
        if len(block) >= QUERIES or chars >= QUERY_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _ranked(docs: DataFrame, block: list[tuple[object, list[str]]], top: int) -> DataFrame:
    """``item, doc_id, score, rank`` of one block of queries; ``item`` counts from 0."""
    words = sorted({t for _, ts in block for t in ts})
    numbers = {t: i for i, t in enumerate(words)}
    queries = [np.array([numbers[t] for t in ts], dtype=np.int64) for _, ts in block]
    counts = common.saved(counted(docs, [w.encode("utf-8", "surrogatepass") for w in words]))
    documents, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    holders = np.zeros(len(words), dtype=np.int64)
    # One number per term of this block of queries.
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holders[row["term"]] = row["count"]
    weight, total = weights(documents, holders), total or 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        for postings in _blocks(batches, documents, total):
            for query, found in zip(queries, best, strict=True):
                search(postings, query, weight[query], found)
        for item, found in enumerate(best):
            if len(found.docs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found.docs), item, dtype=np.int32)),
                     pa.array(found.docs, mask=found.docs == NO_ID), pa.array(found.scores)],
                    ["item", "doc_id", "score"],
                )

    found = counts.mapInArrow(find, FOUND)
    # Every task has at most ``top`` rows an item; thinned in ways before one task sees an item whole.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    way = F.pmod(F.xxhash64("doc_id"), F.lit(WAYS))
    first = Window.partitionBy("item", "way").orderBy(*order)
    thin = found.withColumn("way", way).withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).drop("r", "way")
    last = Window.partitionBy("item").orderBy(*order)
    return thin.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, *, key: str = "item_id", top: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each row of ``items (item_id, text)``.

    Scores are those of the contract over whole texts; documents without a shared
    term have none and are left out.  Null and empty texts hold no terms, on either
    side; a null doc_id sorts behind the others; repeated documents are ranked each,
    repeated items are ranked each, other columns are ignored.  Without documents or
    items there are no rows.  Items are taken in blocks of bounded size, and every
    block is searched in all documents.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    kind = dict(items.dtypes)[key]
    out = None
    for block in _query_blocks(items, key):
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"item int, `{key}` {kind}")
        found = _ranked(docs, block, top).join(F.broadcast(names), "item").select(key, "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"`{key}` {kind}, rank int, doc_id bigint, score bigint")
    return out


SQL = """
WITH raw AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM raw GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
held AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM held, whole),
shares AS (
  SELECT tf.doc_id, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * s.n * n_docs) // l))) AS x
  FROM tf JOIN w ON w.term = tf.term JOIN sizes s ON s.doc_id = tf.doc_id, whole),
scored AS (
  SELECT item_id, doc_id, sum(x)::BIGINT AS score FROM shares JOIN asked ON asked.term = shares.term
  GROUP BY ALL HAVING sum(x) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored QUALIFY rank <= 50
"""
