"""Supervised detection metrics.

``scored`` rows have the keys of a case (usually ``detector, series``), ``pos``
counted from 0, ``score`` and a 0/1 ``label``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.blocks import SERIES, attach, carry, expand, floor_div, run_table, runs
from sensorloom.functions.stats import beside, quantiles, rank_blocks
from sensorloom.session import cut

CASE = ("detector", "series")
THRESHOLDS = 250
POS_BLOCK = 32_768
METRICS = ("auroc", "aupr", "vus_roc", "vus_pr", "affiliation_f1")


# --- ranking metrics ----------------------------------------------------------


def score_counts(scored: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """Distinct scores with their positives ``p`` and negatives ``q``, the
    running counts up to and including them, and the totals."""
    keys = list(keys)
    counts = scored.groupBy(*keys, "score").agg(
        F.sum("label").cast("bigint").alias("p"), F.sum(1 - F.col("label")).cast("bigint").alias("q")
    )
    return carry(
        rank_blocks(counts, keys, ["score"]),
        {"cp": ("sum", F.col("p")), "cq": ("sum", F.col("q")),
         "tp": ("total", F.col("p")), "tq": ("total", F.col("q"))},
        order="score", keys=keys,
    )


def ranking_metrics(scored: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """AUROC (ties count half) and average precision; null where undefined."""
    keys = list(keys)
    counts = score_counts(scored, keys)
    below = F.col("cq") - F.col("q")
    hits = F.col("tp") - F.col("cp") + F.col("p")
    alarms = F.col("tq") - F.col("cq") + F.col("q")
    return counts.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("p") * (below + F.col("q") / 2)), F.first("tp").cast("double") * F.first("tq")
        ).alias("auroc"),
        F.try_divide(F.sum(F.col("p") * hits / (hits + alarms)), F.first("tp")).alias("aupr"),
    )


# --- labelled runs ------------------------------------------------------------


def label_runs(labels: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``keys, s, e`` (first and last position) of every run of label 1."""
    keys = list(keys)
    blocked = labels.select(*keys, "pos", "label").withColumn("blk", floor_div(F.col("pos"), POS_BLOCK))
    measured = runs(blocked, F.col("label"), order="pos", keys=keys).where("label = 1")
    return run_table(measured, keys=keys).select(
        *keys, F.col("run_start").alias("s"), F.col("run_end").alias("e")
    )


def tolerances(labels: DataFrame, found: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Median length of the labelled runs, whole and at least 1."""
    keys = list(keys)
    middle = quantiles(found, keys, F.col("e") - F.col("s") + 1, {"m": 0.5})
    return labels.select(*keys).distinct().join(middle, keys, "left").select(
        *keys, F.greatest(F.lit(1), F.coalesce(F.floor("m"), F.lit(1))).cast("bigint").alias("tolerance")
    )


def events(marks: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Events ``[start, stop)`` of the rows whose ``mark`` is true."""
    found = label_runs(marks.withColumn("label", F.col("mark").cast("int")), keys)
    return found.select(*keys, F.col("s").alias("start"), (F.col("e") + 1).alias("stop"))


def prediction_events(normed: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """Events where the normalised score is above one half."""
    return events(normed.withColumn("mark", F.col("norm") > 0.5), keys)


# --- volume under the surface -------------------------------------------------


def volumes(
    scored: DataFrame, found: DataFrame, tolerance: DataFrame, *, keys: Sequence[str] = CASE
) -> DataFrame:
    """``vus_roc`` and ``vus_pr``: range-aware areas averaged over tolerances.

    For a tolerance ``w`` each labelled run grows by ``w div 2`` rows on both
    sides with weights ``sqrt(1 - distance / w)``.  A row only matters through
    the first of the 250 thresholds that flags it, so the sums per threshold are
    grouped sums over the rows near labelled runs; the rows are never repeated
    per threshold.

    ``found`` are the labelled runs and ``tolerance`` the tolerances per series.
    """
    keys = list(keys)
    scored = cut(scored.select(*keys, "pos", "score", "label"))
    sizes = cut(
        scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives"))
    )
    counts = score_counts(scored, keys)
    # Rows scored higher than this value; thresholds sit at evenly spaced ranks.
    above = F.col("tp") + F.col("tq") - F.col("cp") - F.col("cq")
    last = F.greatest(F.lit(1), F.col("tp") + F.col("tq") - 1)
    first = F.least(floor_up(above * (THRESHOLDS - 1), last), F.lit(THRESHOLDS - 1))
    levels = cut(
        counts.withColumn("i", first.cast("int")).select(*keys, "score", "i", (F.col("p") + F.col("q")).alias("c"))
    )
    flagged = levels.groupBy(*keys, "i").agg(F.sum("c").alias("flagged"))

    spans = cut(_growing_runs(found, tolerance))
    near = _near_rows(found, tolerance, sizes.groupBy("series").agg(F.max("n").alias("n")))
    reached = cut(scored.join(near, ["series", "pos"]).withColumn("_pb", floor_div(F.col("pos"), POS_BLOCK)))
    # By stretch of positions and score: rows of one frequent score stay spread out.
    rows = (
        attach(reached, levels.select(*keys, "score", "i"), [*keys, "score"], "_pb")
        .withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("d_min") * 2), F.col("tolerance"))))
    )
    soft = F.least(F.lit(1.0), F.col("label") + F.aggregate(
        F.filter("sides", lambda s: s["d"] * 2 <= F.col("w") - F.pmod(F.col("w"), F.lit(2))),
        F.lit(0.0),
        lambda a, s: a + F.when(s["d"] == 0, 0.0).otherwise(F.sqrt(1.0 - s["d"] / F.col("w"))),
    ))
    weighted = rows.withColumn("soft", soft).where("soft > 0")
    weights = weighted.groupBy(*keys, "w", "i").agg(F.sum("soft").alias("soft"))
    touched = (
        weighted.withColumn("s", F.col("near_run"))
        .join(spans, ["series", "w", "s"])
        .groupBy(*keys, "w", "span")
        .agg(F.min("i").alias("i"))
        .groupBy(*keys, "w", "i")
        .agg(F.count(F.lit(1)).alias("touched"))
    )
    totals = spans.groupBy("series", "w").agg(F.countDistinct("span").alias("n_spans"))

    grid = (
        sizes.where("positives > 0").join(totals, "series")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1))))
    )
    filled = (
        grid.join(flagged, [*keys, "i"], "left")
        .join(weights, [*keys, "w", "i"], "left")
        .join(touched, [*keys, "w", "i"], "left")
    )
    upto = Window.partitionBy(*keys, "w").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "w")
    running = lambda name: F.coalesce(F.sum(name).over(upto), F.lit(0.0))
    surface = filled.withColumns(
        {"np": running("flagged"), "hit": running("soft"), "ex": running("touched"),
         "all_soft": F.coalesce(F.sum("soft").over(whole), F.lit(0.0))}
    )
    real = (F.col("positives") + F.col("all_soft")) / 2
    surface = surface.withColumns(
        {"tpr": F.least(F.lit(1.0), F.col("hit") / real) * F.col("ex") / F.col("n_spans"),
         "fpr": F.coalesce(F.try_divide(F.col("np") - F.col("hit"), F.col("n") - real), F.lit(0.0)),
         "prec": F.coalesce(F.try_divide("hit", "np"), F.lit(1.0))}
    )
    line = Window.partitionBy(*keys, "w").orderBy("i")
    tpr0, fpr0 = F.lag("tpr", 1, 0.0).over(line), F.lag("fpr", 1, 0.0).over(line)
    # The curve ends in (1, 1).
    tail = F.when(F.col("i") == THRESHOLDS - 1, (1.0 - F.col("fpr")) * (1.0 + F.col("tpr")) / 2).otherwise(0.0)
    areas = (
        surface.select(
            *keys, "w",
            ((F.col("fpr") - fpr0) * (F.col("tpr") + tpr0) / 2 + tail).alias("roc"),
            ((F.col("tpr") - tpr0) * F.col("prec")).alias("pr"),
        )
        .groupBy(*keys, "w")
        .agg(F.sum("roc").alias("roc"), F.sum("pr").alias("pr"))
    )
    return areas.groupBy(*keys).agg(F.avg("roc").alias("vus_roc"), F.avg("pr").alias("vus_pr"))


def floor_up(number: Column, size: Column) -> Column:
    """Whole-number division rounding up."""
    return floor((number + size - 1), size)


def floor(number: Column, size: Column) -> Column:
    return ((number - F.pmod(number, size)) / size).cast("bigint")


def _near_rows(found: DataFrame, tolerance: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows in or beside labelled runs: ``sides`` lists the distances to the runs
    in reach, ``near_run`` the start of the nearest."""
    runs_ = found.join(tolerance, "series").join(sizes, "series").withColumn(
        "half", floor_div(F.col("tolerance"), 2)
    )
    inside = expand(runs_, F.col("e") - F.col("s") + 1, "_i").select(
        "series", "tolerance", (F.col("s") + F.col("_i")).alias("pos"), F.lit(0).cast("bigint").alias("d"), "s"
    )
    beside = runs_.where("half > 0").withColumn("d", F.explode(F.sequence(F.lit(1).cast("bigint"), "half")))
    beside = beside.withColumn(
        "pos", F.explode(F.array(F.col("s") - F.col("d"), F.col("e") + F.col("d")))
    ).where("pos >= 0 and pos < n").select("series", "tolerance", "pos", "d", "s")
    return inside.unionByName(beside).groupBy("series", "tolerance", "pos").agg(
        F.collect_list(F.struct("d", "s")).alias("sides"),
        F.min("d").alias("d_min"),
        F.min(F.struct("d", "s"))["s"].alias("near_run"),
    )


def _growing_runs(found: DataFrame, tolerance: DataFrame) -> DataFrame:
    """For every tolerance, which grown run (``span``) each labelled run is in;
    grown runs that meet are one."""
    each = found.join(tolerance, "series").withColumn(
        "w", F.explode(F.sequence(F.lit(0).cast("bigint"), "tolerance"))
    )
    blocked = each.withColumn("blk", floor_div(F.col("s"), POS_BLOCK))
    keys = ("series", "w")
    known = carry(blocked, {"_e": ("before", F.col("e"))}, order="s", keys=keys)
    apart = F.col("_e").isNull() | (F.col("s") - F.col("_e") > floor_div(F.col("w"), 2) * 2)
    opened = carry(known, {"span": ("last", F.when(apart, F.col("s")))}, order="s", keys=keys)
    return opened.select("series", "w", "s", "span")


# --- affiliation --------------------------------------------------------------


def affiliation(
    predicted: DataFrame, truth: DataFrame, sizes: DataFrame, keys: Sequence[str] = CASE, cell: int = 4096
) -> DataFrame:
    """Affiliation precision, recall and F1 per case.

    Every true event owns the zone up to the midpoints to its neighbours.
    Precision and recall of a zone are means, over predicted or true points, of
    the chance that a random point of the zone is farther away; both integrals
    have closed forms on the pieces between events.  ``sizes`` is ``keys, n``.
    """
    keys = list(keys)
    zones = cut(_zones(truth, sizes, keys))
    pieces = cut(_pieces(predicted, zones, keys, cell))
    left, right, size = F.col("start") - F.col("z0"), F.col("z1") - F.col("stop"), F.col("z1") - F.col("z0")

    # Precision: the part inside the event counts fully; a part at distances
    # d1..d2 counts the share of the zone beyond them.
    def beyond(d1: Column, d2: Column) -> Column:
        area = lambda room: (F.pow(F.greatest(room - d1, F.lit(0.0)), 2) - F.pow(F.greatest(room - d2, F.lit(0.0)), 2)) / 2
        return F.when(d2 > d1, (area(left) + area(right)) / size).otherwise(0.0)

    zero = F.lit(0.0)
    inside = F.greatest(F.least("b", "stop") - F.greatest("a", "start"), zero)
    before = beyond(F.greatest(F.col("start") - F.least("b", "start"), zero), F.greatest(F.col("start") - F.col("a"), zero))
    after = beyond(F.greatest(F.greatest("a", "stop") - F.col("stop"), zero), F.greatest(F.col("b") - F.col("stop"), zero))
    precise = pieces.groupBy(*keys, "start").agg(
        (F.sum(inside + before + after) / F.sum(F.col("b") - F.col("a"))).alias("precision"),
        F.sum(inside).alias("covered"),
    )

    # Recall: true points under a prediction count fully, those in a hole
    # between predictions by the distance to the nearer end of the hole.
    holes = _holes(pieces, keys)
    gained = holes.withColumn("gain", _hole_gain()).groupBy(*keys, "start").agg(F.sum("gain").alias("gain"))
    per_zone = (
        zones.join(precise, [*keys, "start"], "left")
        .join(gained, [*keys, "start"], "left")
        .withColumn(
            "recall",
            F.when(F.col("precision").isNull(), 0.0).otherwise(
                (F.col("covered") + F.coalesce("gain", F.lit(0.0))) / (F.col("stop") - F.col("start"))
            ),
        )
    )
    means = per_zone.groupBy(*keys).agg(F.avg("precision").alias("_p"), F.avg("recall").alias("_r"))
    p, r = F.coalesce("_p", F.lit(0.0)), F.coalesce("_r", F.lit(0.0))
    return means.select(
        *keys, p.alias("affiliation_precision"), r.alias("affiliation_recall"),
        F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0)).alias("affiliation_f1"),
    )


def _zones(truth: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    blocked = truth.withColumn("blk", floor_div(F.col("start"), POS_BLOCK))
    near = carry(
        blocked, {"_p": ("before", F.col("stop")), "_n": ("after", F.col("start"))}, order="start", keys=keys
    )
    return near.join(sizes, keys).select(
        *keys, "start", "stop",
        F.coalesce((F.col("_p") + F.col("start")) / 2, F.lit(0.0)).alias("z0"),
        F.coalesce((F.col("stop") + F.col("_n")) / 2, F.col("n").cast("double")).alias("z1"),
    )


def _pieces(predicted: DataFrame, zones: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Predicted events cut to the zones (and to cells, which is harmless)."""

    def in_cells(df: DataFrame, low: Column, high: Column) -> DataFrame:
        return expand(
            df.withColumns({"_c0": F.floor(low / cell), "_c1": F.floor(high / cell)}),
            F.col("_c1") - F.col("_c0") + 1, "_i",
        ).withColumn("cell", F.col("_c0") + F.col("_i")).drop("_c0", "_c1", "_i")

    marks = in_cells(predicted.select(*keys, F.col("start").alias("a"), F.col("stop").alias("b")), F.col("a"), F.col("b"))
    areas = in_cells(zones, F.col("z0"), F.col("z1"))
    low, high = F.col("cell") * cell, (F.col("cell") + 1) * cell
    met = marks.join(areas, [*keys, "cell"])
    return met.select(
        *keys, "start", "stop", "z0", "z1",
        F.greatest(F.col("a").cast("double"), F.col("z0"), low.cast("double")).alias("a"),
        F.least(F.col("b").cast("double"), F.col("z1"), high.cast("double")).alias("b"),
    ).where("b > a")


def _holes(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Holes ``(h0, h1)`` between predictions inside each zone, cut to the true
    event; ``c0`` and ``c1`` are the predicted ends beside the hole, if any."""
    blocked = pieces.withColumn("blk", F.floor(F.col("a") / POS_BLOCK))
    near = carry(
        blocked,
        {"_before": ("before", F.struct("start", "b")), "_after": ("after", F.struct("start", "a"))},
        order="a", keys=keys,
    )
    same_before = F.when(F.col("_before.start") == F.col("start"), F.col("_before.b"))
    is_last = F.col("_after").isNull() | (F.col("_after.start") != F.col("start"))
    # The hole before each piece, and the one behind the zone's last piece.
    ahead = near.select(
        *keys, "start", "stop", "z0", "z1", same_before.alias("c0"), F.col("a").alias("c1")
    )
    behind = near.where(is_last).select(
        *keys, "start", "stop", "z0", "z1", F.col("b").alias("c0"), F.lit(None).cast("double").alias("c1")
    )
    cut_ = ahead.unionByName(behind).withColumns(
        {"h0": F.greatest(F.coalesce("c0", "z0"), F.col("start")), "h1": F.least(F.coalesce("c1", "z1"), F.col("stop"))}
    )
    return cut_.where("h1 > h0")


def _hole_gain() -> Column:
    """Integral over the hole of the chance that a zone point is farther from
    ``y`` than the nearer predicted end."""
    size = F.col("z1") - F.col("z0")
    middle = F.when(F.col("c0").isNull(), F.col("z0")).when(F.col("c1").isNull(), F.col("z1")).otherwise(
        (F.col("c0") + F.col("c1")) / 2
    )

    def side(low: Column, high: Column, room: Column) -> Column:
        """Distances ``low..high`` from a predicted end with ``room`` up to the
        far border of the zone: within it both sides count, past it one."""
        turn = F.greatest(low, F.least(high, room / 2))
        both = F.pow(turn, 2) - F.pow(low, 2)
        one = room * (high - turn)
        return (high - low) - (both + one) / size

    a, b = F.greatest("h0", F.least("h1", middle)), F.col("h1")
    # Points nearer to the end on the left, then those nearer to the right one.
    by_left = F.when(F.col("c0").isNotNull(), side(F.col("h0") - F.col("c0"), a - F.col("c0"), F.col("z1") - F.col("c0")))
    by_right = F.when(F.col("c1").isNotNull(), side(F.col("c1") - b, F.col("c1") - a, F.col("c1") - F.col("z0")))
    return F.coalesce(by_left, F.lit(0.0)) + F.coalesce(by_right, F.lit(0.0))


# --- all together -------------------------------------------------------------


def detection_metrics(scored: DataFrame, labels: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """All metrics per case; a case without labelled rows gets zeros.

    ``labels`` is ``series, pos, label``; ``scored`` is ``keys, pos, score``.
    """
    keys = list(keys)
    labels = cut(labels.select("series", "pos", "label"))
    joined = cut(scored.select(*keys, "pos", "score").join(labels, ["series", "pos"]))
    span = joined.groupBy(*keys).agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("_positive"),
    )
    span = cut(span)
    found = cut(label_runs(labels))
    tolerance = cut(tolerances(labels, found))
    half = (F.col("score") - F.col("_lo")) > 0.5 * (F.col("_hi") - F.col("_lo"))
    marked = beside(joined, span, keys, count=span.count()).withColumn("mark", half)
    predicted = cut(events(marked, keys))
    truth = span.where("_positive > 0").select(*keys).join(
        found.select("series", F.col("s").alias("start"), (F.col("e") + 1).alias("stop")), "series"
    )
    sizes = span.select(*keys, "n")
    parts = [
        ranking_metrics(joined, keys),
        volumes(joined, found, tolerance, keys=keys),
        affiliation(predicted, truth, sizes, keys).select(*keys, "affiliation_f1"),
    ]
    out = span.select(*keys, "_positive")
    for part in parts:
        out = out.join(part, keys, "left")
    return zero_without_positives(out, METRICS)


def zero_without_positives(metrics: DataFrame, names: Sequence[str], count: str = "_positive") -> DataFrame:
    """Zeros for cases that have no labelled row; other cases stay as they are."""
    return metrics.select(
        *[c for c in metrics.columns if c not in (*names, count)],
        *[F.when(F.coalesce(F.col(count), F.lit(0)) == 0, 0.0).otherwise(F.col(n)).alias(n) for n in names],
    )
