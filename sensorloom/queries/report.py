"""Queries R14 and R15: model order and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY
from sensorloom.operators import report, screen
from sensorloom.plans import cleaning
from sensorloom.queries.detect import daily_segments
from sensorloom.queries.registry import query
from sensorloom.queries.screen import _POOLED, DETECTORS, FLAGS, GROUP
from sensorloom.session import cut


def per_series(spark, sf):
    rows = cut(daily_segments(spark, sf))
    done = cleaning.score_segments(rows, DETECTORS, keys=cleaning.SEGMENT, step=DAY)
    rates = screen.pooled_rates(screen.flag(done.scores, GROUP, ready=True))
    timed = cleaning.with_seconds(rates, done.seconds)
    return cut(
        timed.select(
            F.col("detector").alias("model"), "series", F.col("rate").alias("metric"),
            (F.col("fit_seconds") + F.col("score_seconds")).alias("fit_seconds"),
        )
    )


@query(
    "R14_model_order",
    FLAGS + _POOLED + """, m AS (SELECT detector AS model, avg(rate) AS macro FROM pooled WHERE detector IN ('IQR', 'Hampel_w6') GROUP BY 1)
    SELECT p.detector AS model, round(coalesce(any_value(m.macro), quantile_cont(p.rate, 0.5)), 6) AS order_value
    FROM pooled p LEFT JOIN m ON m.model = p.detector GROUP BY 1""",
)
def r14(spark, sf):
    rates = per_series(spark, sf)
    # Two models come with a macro value, the others fall back to the median.
    macro = rates.where(F.col("model").isin("IQR", "Hampel_w6")).groupBy("model").agg(F.avg("metric").alias("macro_metric"))
    return report.model_order(rates, macro)


@query(
    "R15_metric_distribution",
    FLAGS + _POOLED + """ SELECT p.detector AS model, count(*) AS n, round(min(rate), 6) AS min, round(quantile_cont(rate, 0.25), 6) AS q1,
      round(quantile_cont(rate, 0.5), 6) AS median, round(quantile_cont(rate, 0.75), 6) AS q3, round(max(rate), 6) AS max, true AS timed
    FROM pooled p GROUP BY 1""",
)
def r15(spark, sf):
    rates = per_series(spark, sf)
    # The measured seconds differ from run to run; that there are some does not.
    timed = (F.col("mean_fit_seconds") > 0) & (F.col("median_fit_seconds") > 0)
    times = report.fit_times(rates).select("model", timed.alias("timed"))
    return report.distribution(rates).join(times, "model")
