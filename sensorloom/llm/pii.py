"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

Base spans are fixed patterns with a check of their own.  Wider generators propose
further, overlapping spans: digit runs, dotted quads and numbers that fail the
check, numbers in telephone groups, addresses that avoid the at sign.  Trees learn
from all candidates of the corpus how base spans look - length, separators,
neighbouring letters, nearby words, never the check itself - and a candidate is
added where its score reaches a threshold of the wanted precision.  Telephone groups
and addresses without an at sign are never base spans: there the good ones are base
spans rewritten into the wider form where they stand, and candidates behind a word
that announces them; the others, of the same shape in neutral text, are the bad ones.

Everything runs as DataFrame expressions.  What the trees learn from is a count
per combination of feature values, whose number is bounded by the features.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common
from sensorloom.session import cut

KINDS = ("email", "ip", "card", "phone")

# Generators: kind and pattern.  The first four find the base spans; possessive
# repeats match the same and need neither stack nor retries, and a search begins
# only at the start of a run or where the last match ended.
LOCAL = r"[A-Za-z0-9._%+-]"
GENERATORS = (
    ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("phone", r"\(?(?<![0-9])[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
    ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"),
)
BASE = 4

# Letters of text kept on either side of a candidate as its context.
CONTEXT = 24
HINTS = (
    (1, r"(?i)\b(?:tel|phone|call|mobile|fax|mobil)"),
    (2, r"(?i)\b(?:card|visa|credit|payment|karte|carte|tarjeta)"),
    (3, r"(?i)\b(?:mail|contact|write|kontakt)"),
    (4, r"(?i)\b(?:ip|host|server|address|adresse)\b"),
)

# Features of a candidate and the number of values of each.
FEATURES = {"gen": 6, "digits": 8, "sep": 5, "left": 4, "right": 4, "hint": 5}
ROUNDS, RATE, SHRINK = 24, 0.3, 1.0
PRECISION = 0.95


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(places, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(2 * d.cast("int"), F.lit(10)) + F.when(d >= "5", 1).otherwise(0)),
    )
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10)) == 0


def valid(gen: Column, match: Column) -> Column:
    """Whether a match of a base generator is a base span."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    card = F.length(digits).between(12, 19) & luhn(F.substring(digits, 1, 19))
    return (
        F.when(gen == 0, True).when(gen == 1, match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(gen == 2, card).when(gen == 3, F.length(digits).between(9, 15)).otherwise(False)
    )


def matches(docs: DataFrame) -> DataFrame:
    """``doc_id, rk, gen, start, end, match, before, behind`` of all generators' matches.

    ``rk`` tells documents with one doc_id apart; ``before`` and ``behind`` are
    the letters around the match.  Places count code points from 0, the end excluded.
    """
    rows = common.texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")
    finders = []
    for gen, (_, pattern) in enumerate(GENERATORS):
        pieces = F.transform(
            F.split("text", pattern, -1),
            lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(CONTEXT)).alias("head")),
        )
        finders.append(F.struct(
            F.lit(gen).alias("gen"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), pieces.alias("pieces")
        ))
    # Texts without a digit or an at sign in any form have no candidate.
    rows = rows.where(F.col("text").rlike(r"[0-9@]|[\[(]at[\])]"))
    found = rows.select("doc_id", "rk", F.explode(F.array(*finders)).alias("g")).where(F.size("g.found") > 0)
    each = found.select("doc_id", "rk", "g.gen", "g.pieces", F.posexplode("g.found").alias("i", "match"))
    each = each.select(
        "doc_id", "rk", "gen", "i", "match",
        F.element_at("pieces", F.col("i") + 1).alias("piece"), F.element_at("pieces", F.col("i") + 2).alias("next"),
    )
    # Places are running sums over one document's matches of one generator; a
    # repeated row's matches count once.
    order = "PARTITION BY doc_id, rk, gen ORDER BY i"
    each = each.withColumn("again", F.expr(f"i <=> lag(i) OVER ({order})")).where("not again")
    each = each.withColumn("end", F.expr(f"sum(piece.n + length(match)) OVER ({order})"))
    return each.select(
        "doc_id", "rk", "gen", (F.col("end") - F.length("match")).alias("start"), "end", "match",
        F.col("piece.tail").alias("before"), F.col("next.head").alias("behind"),
    )


def _side(letter: Column) -> Column:
    """0 none, 1 white space, 2 letter or digit, 3 other."""
    return F.when(letter == "", 0).when(letter.rlike(r"\s"), 1).when(letter.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def rewritten(found: DataFrame) -> DataFrame:
    """Base telephone numbers as groups without a country code, base addresses without the at sign."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    sep = F.coalesce(F.nullif(F.regexp_extract("match", r"[0-9]([\x20.-])[0-9]", 1), F.lit("")), F.lit(" "))
    # The last ten digits, with the number's own separator.
    groups = F.concat(F.substring(digits, -10, 3), sep, F.substring(digits, -7, 3), sep, F.substring(digits, -4, 4))
    host = F.regexp_replace(F.substring_index("match", "@", -1), r"\.", " [dot] ")
    address = F.concat(F.substring_index("match", "@", 1), F.lit(" [at] "), host)
    phone = (F.col("gen") == 3) & valid(F.col("gen"), F.col("match")) & (F.length(digits) >= 10)
    changed = found.where((F.col("gen") == 0) | phone)
    return changed.withColumn("match", F.when(F.col("gen") == 0, address).otherwise(groups)).withColumn(
        "gen", F.when(F.col("gen") == 0, 5).otherwise(4)
    )


def described(found: DataFrame) -> DataFrame:
    """``found`` with its feature values, ``base`` and the ``label`` the trees learn.

    Rows that are ``rewritten`` are learned from and no candidates.
    """
    found = found.withColumn("rewritten", F.lit(False))
    found = found.unionByName(rewritten(found).withColumn("rewritten", F.lit(True)))
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    seps = F.regexp_replace("match", r"[0-9A-Za-z@_%]", "")
    hint = F.lit(0)
    for value, pattern in reversed(HINTS):
        hint = F.when(F.col("before").rlike(pattern), value).otherwise(hint)
    base = valid(F.col("gen"), F.col("match"))
    # A telephone group counts as base where it continues a number with a country code.
    inside = (F.col("gen") == 4) & F.col("before").rlike(r"\+[0-9]{1,3}[\x20.-]?$")
    announced = ((F.col("gen") == 4) & (hint == 1)) | ((F.col("gen") == 5) & (hint == 3))
    return found.withColumns({
        "base": base,
        "label": (base | inside | announced | F.col("rewritten")).cast("int"),
        "digits": F.when(digits < 7, 0).when(digits < 10, 1).when(digits < 12, 2).when(digits < 14, 3)
        .when(digits < 16, 4).when(digits == 16, 5).when(digits < 20, 6).otherwise(7),
        "sep": F.when(seps == "", 0).when(seps.rlike(r"^ +$"), 1).when(seps.rlike(r"^-+$"), 2).when(seps.rlike(r"^\.+$"), 3).otherwise(4),
        "left": _side(F.right("before", F.lit(1))),
        "right": _side(F.left("behind", F.lit(1))),
        "hint": hint,
    })


@dataclass
class Tree:
    """Two levels: a first test and one test on each side; four leaves."""

    first: tuple[str, int]
    then: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[tuple[float, float], tuple[float, float]]

    def values(self, table: dict[str, np.ndarray]) -> np.ndarray:
        def split(test, low, high):
            return np.where(table[test[0]] <= test[1], low, high)

        return split(self.first, *(split(self.then[side], *self.leaves[side]) for side in (0, 1)))

    def column(self) -> Column:
        def split(test, low, high):
            return F.when(F.col(test[0]) <= test[1], low).otherwise(high)

        return split(self.first, *(split(self.then[side], F.lit(self.leaves[side][0]), F.lit(self.leaves[side][1])) for side in (0, 1)))


def boost(table: dict[str, np.ndarray], rounds: int = ROUNDS) -> tuple[float, list[Tree]]:
    """Gradient boosting by logistic loss over counted feature values.

    ``table`` has the features, ``good`` and ``all``: candidates and those that are base spans.
    """
    good, every = table["good"].astype(float), table["all"].astype(float)
    start = math.log((good.sum() + 1) / (every.sum() - good.sum() + 1))
    margin, trees = np.full(len(good), start), []
    tests = [(name, cut_at) for name, size in FEATURES.items() for cut_at in range(size - 1)]
    below = np.array([table[name] <= cut_at for name, cut_at in tests])

    def best(g, h, rows):
        """The test with the largest gain on ``rows``, and the value of both sides."""
        low_g, low_h = below @ (g * rows), below @ (h * rows)
        high_g, high_h = (g * rows).sum() - low_g, (h * rows).sum() - low_h
        at = int((low_g**2 / (low_h + SHRINK) + high_g**2 / (high_h + SHRINK)).argmax())
        return at, (RATE * float(low_g[at] / (low_h[at] + SHRINK)), RATE * float(high_g[at] / (high_h[at] + SHRINK)))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = good - every * p, every * p * (1 - p)
        first, _ = best(g, h, np.ones(len(g)))
        sides = [best(g, h, below[first]), best(g, h, ~below[first])]
        tree = Tree(tests[first], (tests[sides[0][0]], tests[sides[1][0]]), (sides[0][1], sides[1][1]))
        trees.append(tree)
        margin = margin + tree.values(table)
    return start, trees


def threshold(margin: np.ndarray, good: np.ndarray, every: np.ndarray, precision: float = PRECISION) -> float:
    """Least margin from which on the wanted share of candidates is good; infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    share = np.cumsum(good[order]) / np.maximum(np.cumsum(every[order]), 1)
    # Candidates of one margin pass or fail together.
    ends = np.append(np.diff(margin[order]) != 0, True)
    fits = np.flatnonzero(ends & (share >= precision) & (np.cumsum(good[order]) >= 20))
    return float(margin[order][fits[-1]]) if len(fits) else math.inf


def spans(docs: DataFrame, *, precision: float = PRECISION, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, rk, kind, start, end, base`` of all spans: base ones and those the trees add.

    Trees are fitted on the candidates of half of the documents, thresholds per
    generator on those of the other half; a generator without 20 good ones in that half
    adds nothing.
    """
    found = cut(described(cut(matches(docs))))
    names = list(FEATURES)
    counted = found.groupBy(*names, F.pmod("rk", F.lit(2)).alias("fold")).agg(
        F.count(F.lit(1)).alias("all"), F.sum("label").alias("good")
    )
    # At most as many rows as there are combinations of feature values, twice.
    rows = counted.orderBy(*names, "fold").collect()
    margin = F.lit(-1.0)
    limits = {gen: math.inf for gen in range(len(GENERATORS))}
    if rows:
        table = {c: np.array([row[c] for row in rows]) for c in [*names, "fold", "all", "good"]}
        fit = {c: v[table["fold"] == 0] for c, v in table.items()}
        start, trees = boost(fit, rounds)
        held = {c: v[table["fold"] == 1] for c, v in table.items()}
        scores = np.round(start + sum((t.values(held) for t in trees), np.zeros(len(held["all"]))), 9)
        for gen in limits:
            mine = held["gen"] == gen
            limits[gen] = threshold(scores[mine], held["good"][mine], held["all"][mine], precision)
        margin = F.round(F.lit(start) + sum((t.column() for t in trees), F.lit(0.0)), 9)
    passes = common.any_of(
        (F.col("gen") == gen) & (margin >= limit - 1e-6) for gen, limit in limits.items() if limit < math.inf
    )
    kinds = F.array(*[F.lit(kind) for kind, _ in GENERATORS])
    taken = found.where(~F.col("rewritten") & (F.col("base") | passes)).select(
        "doc_id", "rk", F.element_at(kinds, F.col("gen") + 1).alias("kind"), "start", "end", "base"
    )
    return taken.groupBy("doc_id", "rk", "kind", "start", "end").agg(F.max("base").alias("base"))


def _listed(items: Column) -> Column:
    texts = F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: one row per row of ``docs (doc_id, text)``.

    The counts and ``base_sha256`` are of the base spans, ``spans`` lists all.  A
    null text is the empty one and has none.  Repeated rows are each reported;
    rows that share a doc_id but not a text have their own spans.  No rows give no
    rows, other columns are not read.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = spans(docs, **options).groupBy("doc_id", "rk").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base"))).alias("items")
    ).withColumnsRenamed({"doc_id": "with_id"})
    rows = common.texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("rk"))
    both = rows.join(listed, (rows["rk"] == listed["rk"]) & rows["doc_id"].eqNullSafe(listed["with_id"]), "left")

    def count(kind: str) -> Column:
        own = F.size(F.filter("items", lambda s: s["base"] & (s["kind"] == kind)))
        return F.when(F.col("items").isNull(), 0).otherwise(own).cast("bigint").alias(f"n_{kind}")

    return both.select(
        rows["doc_id"], *[count(kind) for kind in KINDS],
        F.sha2(F.coalesce(_listed(F.filter("items", lambda s: s["base"])), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("items")), F.lit("")).alias("spans"),
    )


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all columns, each span of ``text`` replaced by its kind in brackets.

    Spans that overlap become one, named after the first.  Null texts stay null.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    # Joined to one: a span that starts before the furthest end so far goes into the one before.
    before = "PARTITION BY doc_id, rk ORDER BY start, rank, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    upto = "PARTITION BY doc_id, rk ORDER BY start, rank, end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    found = spans(docs, **options).withColumn("rank", rank)
    found = found.withColumn("new", F.expr(f"coalesce(start >= max(end) OVER ({before}), true)"))
    found = found.withColumn("part", F.expr(f"sum(int(new)) OVER ({upto})"))
    merged = found.groupBy("doc_id", "rk", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by("kind", F.struct("start", "rank", "end")).alias("kind"),
    )
    listed = merged.groupBy(F.col("doc_id").alias("id"), "rk").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans")
    )
    # The row as one column: whatever its columns are called, they meet no others.
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    both = rows.join(
        listed, (F.col("key") == F.col("rk")) & F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("id")), "left"
    )
    whole = F.col("row.text")
    behind = lambda i: F.when(i == 0, 0).otherwise(F.element_at(F.col("spans"), F.greatest(i, F.lit(1)))["end"])
    # The piece before each span with the span's name, then the rest.
    pieces = F.transform("spans", lambda s, i: F.concat(
        F.substring(whole, behind(i).cast("int") + 1, (s["start"] - behind(i)).cast("int")),
        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
    ))
    rest = F.substring(whole, F.element_at(F.col("spans"), -1)["end"].cast("int") + 1, F.length(whole))
    text = F.when(F.col("spans").isNull(), whole).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return both.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
