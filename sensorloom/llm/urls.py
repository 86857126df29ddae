"""URL filter: rules first, then the ratio of two character models.

The models are learned from the urls that the rules decide: how often a character
follows each context of up to ``ORDER`` characters in accepted and in rejected
urls.  Shorter contexts smooth longer ones, so a context counts as much as it was
seen (a variable-order Markov model).  The difference of both log-likelihoods per
character is compared with a threshold calibrated on the same urls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common
from sensorloom.session import cut

# Host, path and verdict of each rule.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# Characters of the models; any other is one symbol more, and so is the edge of the url.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789.-_/?=&#%"
SYMBOLS = len(LETTERS) + 2
ORDER = 3
# Weight of the shorter context against a context's own counts.
SMOOTH = 4.0
# The threshold is one of the edges of so many bins over [-SPAN, SPAN] nats per character.
BINS, SPAN = 2000, 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = common.ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits; null without one."""
    name = verdict = None
    for suffix, start, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(start)
        name = F.when(fits, suffix + start) if name is None else name.when(fits, suffix + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return name, verdict


def contexts(symbols: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """For each order the code of (context, character) at every place of the joined urls.

    Places before a url's start count as its edge symbol.
    """
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes, code = [], symbols.astype(np.int64)
    scale = 1
    codes.append(code)
    for back in range(1, ORDER + 1):
        scale *= SYMBOLS
        before = np.full(len(symbols), SYMBOLS - 1, dtype=np.int64)
        if len(symbols) > back:
            before[back:] = symbols[:-back]
        before[place < back] = SYMBOLS - 1
        code = code + before * scale
        codes.append(code)
    return codes


def encode(urls: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all urls, joined, each with a closing edge; and their lengths."""
    table = np.full(256, SYMBOLS - 2, dtype=np.uint8)
    table[np.frombuffer(LETTERS.encode(), dtype=np.uint8)] = np.arange(len(LETTERS))
    table[0] = SYMBOLS - 1
    # One byte per character: null for the edge, DEL for what is not ASCII.
    raw = [u.lower().replace("\0", "\x7f").encode("ascii", "replace").replace(b"?", b"?") + b"\0" for u in urls]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    return table[np.frombuffer(b"".join(raw), dtype=np.uint8)], lengths


def grams(rows: DataFrame) -> DataFrame:
    """``order, code, allowed, blocked``: counts over all ``rows (url, verdict)``.

    At most ``SYMBOLS ** (ORDER + 1)`` codes; each task adds its own up first.
    """

    def count(batches):
        for pdf in batches:
            symbols, lengths = encode(pdf["url"])
            good = np.repeat((pdf["verdict"] == "allow").to_numpy(), lengths)
            for order, code in enumerate(contexts(symbols, lengths)):
                keys, at = np.unique(code, return_inverse=True)
                allowed = np.bincount(at, weights=good, minlength=len(keys)).astype(np.int64)
                total = np.bincount(at, minlength=len(keys))
                yield pd.DataFrame({"order": np.int32(order), "code": keys, "allowed": allowed, "blocked": total - allowed})

    counted = rows.mapInPandas(count, "order int, code bigint, allowed bigint, blocked bigint")
    return counted.groupBy("order", "code").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))


def model(counts: DataFrame) -> DataFrame:
    """``code, ratio``: log-likelihood difference of every seen longest context.

    ``p(c | context) = (n(context c) + SMOOTH * p(c | shorter context)) / (n(context) + SMOOTH)``, from the uniform
    distribution up.  An unseen code has the difference of its longest seen part.
    """
    levels = None
    for order in range(ORDER + 1):
        # The code is context * SYMBOLS + character with the nearest place lowest after the character.
        here = counts.where(F.col("order") == order)
        context = F.floor(F.col("code") / SYMBOLS)
        sums = here.groupBy(context.alias("context")).agg(F.sum("allowed").alias("na"), F.sum("blocked").alias("nb"))
        here = here.withColumn("context", context).join(sums, "context")
        if levels is None:
            here = here.withColumns({"pa": F.lit(1.0 / SYMBOLS), "pb": F.lit(1.0 / SYMBOLS)})
        else:
            shorter = levels.where(F.col("order") == order - 1).select(
                F.col("code").alias("short"), F.col("p_allow").alias("pa"), F.col("p_block").alias("pb")
            )
            here = here.withColumn("short", F.pmod("code", F.lit(SYMBOLS**order))).join(shorter, "short")
        mixed = here.select(
            "order", "code",
            ((F.col("allowed") + SMOOTH * F.col("pa")) / (F.col("na") + SMOOTH)).alias("p_allow"),
            ((F.col("blocked") + SMOOTH * F.col("pb")) / (F.col("nb") + SMOOTH)).alias("p_block"),
        )
        levels = mixed if levels is None else cut(levels.unionByName(mixed))
    return levels.select("order", "code", F.log(F.col("p_allow") / F.col("p_block")).alias("ratio"))


class Ratio:
    """The seen codes of each order with their log-likelihood differences, on workers."""

    def __init__(self, table: pd.DataFrame):
        self.codes, self.ratios = [], []
        for order in range(ORDER + 1):
            part = table[table["order"] == order].sort_values("code")
            self.codes.append(part["code"].to_numpy(dtype=np.int64))
            self.ratios.append(part["ratio"].to_numpy(dtype=np.float64))

    def score(self, urls: pd.Series) -> np.ndarray:
        """Mean difference per character; the longest seen context of each counts."""
        symbols, lengths = encode(urls)
        value = np.zeros(len(symbols))
        for codes, ratios, code in zip(self.codes, self.ratios, contexts(symbols, lengths), strict=True):
            if len(codes):
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                value = np.where(codes[at] == code, ratios[at], value)
        if not len(lengths):
            return np.zeros(0)
        return np.add.reduceat(value, np.cumsum(lengths) - lengths) / lengths


def calibrated(histogram: list[tuple[int, int, int]]) -> float:
    """Edge that parts the verdicts best: most accepted at or above plus rejected below, as shares.

    ``histogram`` has (bin, allowed, blocked).  Of equal edges the one nearest to
    zero; zero where a verdict is missing.
    """
    allowed, blocked = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for at, good, bad in histogram:
        allowed[at], blocked[at] = good, bad
    if not allowed.sum() or not blocked.sum():
        return 0.0
    edges = (np.arange(BINS + 1) / BINS * 2 - 1) * SPAN
    above = np.cumsum(allowed[::-1])[::-1] / allowed.sum()
    below = (np.cumsum(blocked) - blocked) / blocked.sum()
    gain = above + below
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(edges[best[np.abs(edges[best]).argmin()]])


def judged(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, ratio``: one row per row of ``pages (page_id, url)``.

    ``verdict`` is the longest fitting rule's, else allow where the models' mean
    log-likelihood difference per character reaches the calibrated threshold.  A
    null url has empty host and path and is judged like the empty one.  Without
    urls of both verdicts the threshold is zero; without any ruled url all ratios
    are zero, so every url is allowed.  Repeated rows are each judged and count
    as often as they occur; no rows give no rows; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path")
    )
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    counts = cut(grams(rows.where("verdict is not null").select("url", "verdict")))
    # At most SYMBOLS ** (ORDER + 1) rows of the longest order, 5 million.
    ratio = Ratio(model(counts).toPandas())

    def run(batches):
        for batch in batches:
            ratios = ratio.score(batch.column("url").to_pandas())
            yield batch.drop_columns("url").append_column("ratio", pa.array(ratios, pa.float64()))

    scored = rows.mapInArrow(
        run, "page_id bigint, host string, path string, rule string, verdict string, ratio double"
    )
    place = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("ratio"))) / SPAN + 1) / 2 * BINS).cast("int")
    histogram = scored.where("verdict is not null").groupBy(place.alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")
    )
    threshold = calibrated([tuple(row) for row in histogram.collect()])
    by_model = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), "ratio")
