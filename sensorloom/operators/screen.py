"""Thresholds, detection rates, detector screening and consensus scores.

Tables of scores have ``detector``, the keys of the scored group (``series``,
sometimes ``segment``), ``ts`` and ``score``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import chance
from sensorloom.functions.stats import beside, counted_median_and_mad, finite, median_and_mad
from sensorloom.operators.detect import MAD_TO_SIGMA
from sensorloom.session import cut

THRESHOLD_K = 3.5
MAX_DETECTION_RATE = 0.07
AOM_BUCKETS = 20
AOM_BUCKET_SIZE = 5
METHODS = ("AVG", "MAX", "AOM")


def normalise(scores: DataFrame, keys: Sequence[str], *, ready: bool = False) -> DataFrame:
    """Add ``norm``: min-max scaled per group, 0 where all scores are equal."""
    scores = scores if ready else cut(scores)
    span = scores.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    scaled = F.when(
        F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    ).otherwise(F.lit(0.0))
    return beside(scores, span, keys).withColumn("norm", scaled).drop("_lo", "_hi")


def _limit(k: float) -> Column:
    return F.col("median") + F.lit(k) * F.lit(MAD_TO_SIGMA) * F.col("mad")


def thresholds(
    scores: DataFrame, keys: Sequence[str], k: float = THRESHOLD_K, *, ready: bool = False
) -> DataFrame:
    """``median + k * 1.4826 * MAD`` of the finite scores; infinite without any."""
    found = median_and_mad(scores.where(finite(F.col("score"))), keys, "score", ready=ready).select(
        *keys, _limit(k).alias("threshold")
    )
    return scores.select(*keys).distinct().join(found, list(keys), "left").select(
        *keys, F.coalesce("threshold", F.lit(float("inf"))).alias("threshold")
    )


def flag(scores: DataFrame, keys: Sequence[str], k: float = THRESHOLD_K, *, ready: bool = False) -> DataFrame:
    """Add ``threshold`` and ``flag``: finite and strictly above the threshold."""
    scores = scores if ready else cut(scores)
    found, count = counted_median_and_mad(scores.where(finite(F.col("score"))), keys, "score", ready=True)
    # Groups without a finite score have no median.
    limit = F.coalesce(_limit(k), F.lit(float("inf")))
    joined = beside(scores, found, keys, count=count, how="left").withColumn("threshold", limit).drop("median", "mad")
    return joined.withColumn(
        "flag", F.coalesce(finite(F.col("score")) & (F.col("score") > F.col("threshold")), F.lit(False))
    )


def detection_rates(flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of flagged rows, their number and the number of rows."""
    return flags.groupBy(*keys).agg(
        F.count_if("flag").alias("n_flagged"),
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.avg(F.col("flag").cast("int")), F.lit(0.0)).alias("rate"),
    )


def pooled_rates(flags: DataFrame, keys: Sequence[str] = ("detector", "series")) -> DataFrame:
    """Flagged over all points of every segment a detector scored."""
    return detection_rates(flags, keys)


def macro_rates(rates: DataFrame) -> DataFrame:
    """Mean of the per-series rates of each detector."""
    return rates.groupBy("detector").agg(F.avg("rate").alias("macro_rate"))


def split_by_rate(rates: DataFrame, budget: float = MAX_DETECTION_RATE) -> DataFrame:
    """``kept`` is true up to the budget, the budget itself included."""
    return macro_rates(rates).withColumn("kept", F.col("macro_rate") <= F.lit(budget))


def rank_top_k(metrics: DataFrame, k: int, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Best ``k`` detectors per series; ties go to the smaller name."""
    best = Window.partitionBy(*keys).orderBy(F.col("metric").desc(), "detector")
    return metrics.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def consensus(
    normed: DataFrame,
    keys: Sequence[str],
    method: str = "AVG",
    *,
    weights: DataFrame | None = None,
    seed: int = 13,
) -> DataFrame:
    """Fuse the normalised scores of all detectors of a row into ``score``.

    ``AVG`` is a mean, weighted when ``weights (detector, ..., weight)`` is
    given; ``MAX`` a maximum; ``AOM`` the mean over random buckets of the detectors
    that scored the group of ``keys``, of the bucket's maximum.
    """
    method = method.upper()
    if method not in METHODS:
        raise ValueError(f"unknown ensemble method {method!r}, use one of {METHODS}")
    row = [*keys, "ts"]
    if method == "MAX":
        return normed.groupBy(*row).agg(F.max("norm").alias("score"))
    if method == "AOM":
        return _average_of_maxima(normed, list(keys), seed)
    if weights is None:
        return normed.groupBy(*row).agg(F.avg("norm").alias("score"))
    on = [c for c in weights.columns if c != "weight"]
    return beside(normed, weights, on).groupBy(*row).agg(
        F.try_divide(F.sum(F.col("weight") * F.col("norm")), F.sum("weight")).alias("score")
    )


def buckets_of(names: Column, seed: int = 13) -> Column:
    """Random buckets of the detectors in the array ``names``."""

    def bucket(b: Column) -> Column:
        drawn = F.transform(names, lambda d: F.struct(chance.whole(seed, "bucket", b, d).alias("u"), d.alias("d")))
        return F.slice(F.transform(F.array_sort(drawn), lambda s: s["d"]), 1, AOM_BUCKET_SIZE)

    return F.transform(F.sequence(F.lit(0), F.lit(AOM_BUCKETS - 1)), bucket)


def _average_of_maxima(normed: DataFrame, keys: list[str], seed: int) -> DataFrame:
    by_row = normed.groupBy(*keys, "ts").agg(
        F.map_from_entries(F.collect_list(F.struct("detector", "norm"))).alias("m")
    )
    # One row of at most 20 buckets of 5 names per group.
    names = normed.select(*keys, "detector").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("detector")).alias("names"))
    buckets = names.select(*keys, buckets_of(F.col("names"), seed).alias("buckets"))
    peaks = F.filter(
        F.transform("buckets", lambda b: F.array_max(F.transform(b, lambda d: F.try_element_at(F.col("m"), d)))),
        lambda x: x.isNotNull(),
    )
    mean: Column = F.aggregate(peaks, F.lit(0.0), lambda a, x: a + x) / F.size(peaks)
    return beside(by_row, buckets, keys).select(*keys, "ts", mean.alias("score"))


def remove_flagged(obs: DataFrame, flags: DataFrame) -> DataFrame:
    """Null the values of flagged rows."""
    hits = flags.where("flag").select("series", "ts", F.lit(True).alias("_hit")).distinct()
    return obs.join(hits, ["series", "ts"], "left").withColumn(
        "value", F.when(F.col("_hit").isNull(), F.col("value"))
    ).drop("_hit")


def macro_summary(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric over the series, per detector."""
    return results.groupBy("detector").agg(*[F.avg(m).alias(m) for m in metrics])
