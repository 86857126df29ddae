"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Two words one edit apart share their first or their last half.  Each word goes to
the buckets of both halves, buckets are packed into shards of some thousand rows,
and a shard holds, per position and letter, the bitset of its words with that letter
there.  Reading a word letter by letter, three bitsets over the shard are updated
with whole machine words: words equal so far, words with one replaced letter, and
words that lack one letter (compared one position to the left).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common
from sensorloom.session import cut

# Fixed values of the contract: letters, altered share, least length and count, least ratio of a form.
OTHER = "[^A-Za-zÀ-ÿ]+"
EVERY, LETTERS, TIMES, RATIO = 199, 6, 5, 5
# Rows of a shard, and words read side by side.
SHARD, SIDE = 4096, 2048

FOUND = "word string, n_near bigint, near_n bigint, near string"


def occurrences(docs: DataFrame) -> DataFrame:
    """``word`` of every run of letters of ``docs``, after the contract's deletions."""
    texts = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("id"), F.col("text").alias("t"))
    runs = texts.select("id", F.explode(F.split("t", OTHER)).alias("run")).where(F.length("run") >= LETTERS)
    runs = runs.withColumn("run", common.ascii_lower(F.col("run")))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, *, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """``word, n`` of the words with enough letters and occurrences over all documents."""
    words = occurrences(docs).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def halves(words: DataFrame) -> DataFrame:
    """Each word in the buckets ``(size, side, part)`` where its near words are found.

    ``size`` is the length of the longer word of a pair: a word meets others of its
    own length and shorter ones under its length, longer ones under its length + 1.
    """
    half = F.floor(F.col("size") / 2).cast("int")
    sized = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    sides = F.array(
        F.struct(F.lit("first").alias("side"), F.col("word").substr(F.lit(1), half).alias("part")),
        F.struct(F.lit("last").alias("side"), F.col("word").substr(F.length("word") - half + 1, half).alias("part")),
    )
    return sized.withColumn("at", F.explode(sides)).select("word", "n", "size", "at.side", "at.part")


def shards(rows: DataFrame, count: int, *, shard: int = SHARD) -> DataFrame:
    """Rows with their ``shard``; a bucket larger than a shard is cut into slices.

    Every word of a cut bucket reads along in all its slices but is found (``own``)
    in one of them, so each pair is still seen once.
    """
    bucket = ["size", "side", "part"]
    hot = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > shard)
    hot = hot.select(*bucket, F.ceil(F.col("rows") / shard).cast("int").alias("slices"))
    cutup = rows.join(hot, bucket, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    mine = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    spread = cutup.withColumn("mine", mine).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    number = F.pmod(F.xxhash64(*bucket, "slice"), F.lit(max(1, math.ceil(count / shard))))
    return spread.select("word", "n", *bucket, "slice", (F.col("mine") == F.col("slice")).alias("own"), number.alias("shard"))


def _codes(words: list[str], size: int) -> np.ndarray:
    """Code points, one word a row; positions behind a word's end hold 0."""
    out = np.zeros((len(words), size), dtype=np.uint32)
    for row, word in zip(out, words, strict=True):
        row[: len(word)] = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
    return out


def _bitsets(equal: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, first column in the lowest bit."""
    width = -(-equal.shape[1] // 64) * 8
    packed = np.zeros((equal.shape[0], width), dtype=np.uint8)
    packed[:, : -(-equal.shape[1] // 8)] = np.packbits(equal, axis=1, bitorder="little")
    return packed.view(np.uint64)


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit numbers of all set bits."""
    row, word = np.nonzero(sets)
    bits = np.unpackbits(sets[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return row[which], word[which] * 64 + bit


def one_apart(
    queries: np.ndarray, query_bucket: np.ndarray, found: np.ndarray, found_bucket: np.ndarray, found_length: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of one bucket that are exactly one edit apart.

    ``queries`` and ``found`` hold codes of ``size`` positions; queries have that
    length, found words that one or one less.
    """
    size = queries.shape[1]
    letters, coded = np.unique(queries, return_inverse=True)
    coded = coded.reshape(queries.shape)
    buckets, query_set = np.unique(query_bucket, return_inverse=True)
    same = _bitsets(buckets[:, None] == found_bucket[None, :])[query_set]
    replaced, lacking = np.zeros_like(same), np.zeros_like(same)
    left = np.zeros((len(letters), same.shape[1]), dtype=np.uint64)
    for place in range(size):
        here = _bitsets(letters[:, None] == found[:, place][None, :])
        hit = here[coded[:, place]]
        replaced = (replaced & hit) | (same & ~hit)
        lacking = (lacking & left[coded[:, place]]) | same
        same &= hit
        left = here
    long, short = _bitsets((found_length == size)[None, :]), _bitsets((found_length == size - 1)[None, :])
    return _members((replaced & long) | (lacking & short))


def _near_in_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Partial counts and best near words of one shard's words."""
    # Larger n first, then code-point order (that of UTF-8): a lower rank is the better form.
    keys = [word.encode() for word in shard["word"]]
    shard = shard.iloc[sorted(range(len(keys)), key=lambda i: (-int(shard["n"].iat[i]), keys[i]))].reset_index(drop=True)
    length = shard["word"].map(len).to_numpy()
    bucket = shard.groupby(["size", "side", "part", "slice"], sort=False).ngroup().to_numpy()
    count, best = np.zeros(len(shard), dtype=np.int64), np.full(len(shard), len(shard))
    own, last = shard["own"].to_numpy(), (shard["side"] == "last").to_numpy()
    for size in np.unique(shard["size"].to_numpy()):
        rows = np.flatnonzero((shard["size"] == size).to_numpy())
        codes = _codes([shard["word"].iat[i] for i in rows], int(size))
        asks, answers = np.flatnonzero(length[rows] == size), np.flatnonzero(own[rows])
        for a in range(0, len(answers), SHARD):
            to = answers[a : a + SHARD]
            for q in range(0, len(asks), SIDE):
                ask = asks[q : q + SIDE]
                i, j = one_apart(codes[ask], bucket[rows[ask]], codes[to], bucket[rows[to]], length[rows[to]])
                i, j = ask[i], to[j]
                # Pairs that share the first half were seen there.
                half = int(size) // 2
                fresh = ~last[rows[i]] | (codes[i, :half] != codes[j, :half]).any(axis=1)
                i, j = rows[i[fresh]], rows[j[fresh]]
                shorter = length[j] < length[i]
                i, j = np.concatenate([i, j[shorter]]), np.concatenate([j, i[shorter]])
                np.add.at(count, i, 1)
                np.minimum.at(best, i, j)
    got = np.flatnonzero(count)
    to = best[got]
    return pd.DataFrame(
        {"word": shard["word"].to_numpy()[got], "n_near": count[got],
         "near_n": shard["n"].to_numpy()[to], "near": shard["word"].to_numpy()[to]}
    )


def near_words(words: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """``word, n_near, near, near_n``: words of ``words (word, n)`` with near ones, and their best."""
    rows = halves(words)
    # Four rows a word: two lengths, two halves.
    spread = shards(rows, 4 * words.count(), shard=shard)
    parts = spread.groupBy("shard").applyInPandas(_near_in_shard, FOUND)
    least = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame, most: int, *, ratio: int = RATIO) -> DataFrame:
    """``word, root``: the last form that the forms of ``forms (word, form)`` lead to.

    A form occurs ``ratio`` times as often as its word, so a word occurring
    ``most`` times ends every chain after a known number of steps; each join
    doubles the steps taken.
    """
    steps, n = 1, TIMES * ratio
    while n * ratio <= most:
        steps, n = steps + 1, n * ratio
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("end"))
        now = cut(now.join(onward, now["root"] == onward["via"], "left").select("word", F.coalesce("end", "root").alias("root")))
    return now


def variants(docs: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of the whole texts of ``docs (doc_id, text)``.

    Null and empty texts hold no words, a null doc_id counts as the empty text in
    the deletions, repeated rows count each, other columns are ignored, and no
    documents give no rows.  Of near words with equal ``n`` the least in code-point
    order is the form.  Words of any length take part; no bucket is capped.
    """
    common.prepare(docs.sparkSession)
    words = cut(vocabulary(docs))
    near = near_words(words, shard=shard)
    enough = F.col("near_n") >= RATIO * F.col("n")
    rows = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"),
        )
    )
    most = rows.agg(F.max("n")).first()[0] or 0
    ends = roots(rows.where("form is not null").select("word", "form"), most)
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
low AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM runs WHERE length(raw) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(b) + 1),
      lambda i: ('0x' || substr(hex(b), 2 * i - 1, 2))::BIGINT)),
    lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1]))) AS h
  FROM (SELECT run, c, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM low), crc),
changed AS (
  SELECT CASE WHEN h % 199 = 0
    THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c
  FROM hashed),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (
  SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS z
  FROM words, unnest(range(length(word))) p(i)),
pairs AS (
  SELECT x.word, y.word AS near, y.n FROM cuts x JOIN cuts y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.a || x.z = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.a || x.z = y.word),
best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(l := -n, w := encode(near))) AS b FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -b.l >= 5 * w.n THEN decode(b.w) END AS form, CASE WHEN -b.l >= 5 * w.n THEN -b.l END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
