"""Filling gaps.

Interpolating imputers need, per gap, the nearest observed rows outside the mask.
Those come from one pass over each series, whatever the number of seeds and gap
sizes: gaps look their neighbours up, the series is never copied per set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.blocks import HOUR, MICROS, SERIES, carry, halo, micros, runs
from sensorloom.operators.gaps import SET, gap_rows
from sensorloom.operators.grid import gap_windows
from sensorloom.session import cut

SEASON_HOURS = 24
SHORT_CONTEXT = "not enough clean rows before the gap"


def _line(t0: Column, v0: Column, t1: Column, v1: Column, t: Column) -> Column:
    """Value at ``t`` on the line between two points; flat beyond a lone one."""
    share = (micros(t) - micros(t0)) / (micros(t1) - micros(t0))
    return F.coalesce(v0 + (v1 - v0) * share, v0, v1)


def neighbours(rows: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add ``prev`` and ``next``: the nearest observed ``(ts, value)`` strictly
    before and after each row."""
    seen = F.when(F.col("value").isNotNull(), F.struct("ts", "value"))
    return carry(rows, {"prev": ("before", seen), "next": ("after", seen)}, keys=keys)


def linear_fill(rows: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Fill nulls by straight lines over time, held flat at both ends."""
    near = neighbours(rows, keys)
    filled = _line(F.col("prev.ts"), F.col("prev.value"), F.col("next.ts"), F.col("next.value"), F.col("ts"))
    return near.withColumn("filled", F.coalesce("value", filled)).drop("prev", "next")


def gap_anchors(
    rows: DataFrame, gaps: DataFrame, step: int = HOUR, *, natural: bool = False, near: DataFrame | None = None
) -> DataFrame:
    """Gaps with the observed points ``(t0, v0)`` and ``(t1, v1)`` around them.

    A neighbour inside another gap of the same set is masked too; such gaps are
    linked and share the anchors of the whole chain.  ``natural`` gaps are the
    holes of the rows themselves, which never touch.  ``near`` are the
    :func:`neighbours` of the rows, where a caller has them.
    """
    near = neighbours(rows.select("series", "blk", "ts", "value")) if near is None else near
    ends = gaps.withColumn(
        "_end", F.timestamp_micros(micros("start_ts") + (F.col("len") - 1) * (step * MICROS))
    )
    ends = ends.join(
        near.select("series", F.col("ts").alias("start_ts"), F.col("prev").alias("_p")), ["series", "start_ts"], "left"
    ).join(near.select("series", F.col("ts").alias("_end"), F.col("next").alias("_n")), ["series", "_end"], "left")
    if natural:
        return _anchored(ends, gaps)
    # An artificial set has a handful of gaps, fixed by the options.
    line = Window.partitionBy(*SET).orderBy("start_ts")
    reach = F.max("_end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    linked = F.coalesce(F.col("_p.ts") <= reach, reach.isNotNull() & F.col("_p").isNull())
    chain = ends.withColumn("_opens", F.when(linked, 0).otherwise(1))
    chain = chain.withColumn("_chain", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*SET, "_chain")
    chained = chain.withColumns(
        {"_p": F.min_by("_p", "start_ts").over(whole), "_n": F.max_by("_n", "_end").over(whole)}
    )
    return _anchored(chained, gaps)


def _anchored(ends: DataFrame, gaps: DataFrame) -> DataFrame:
    return ends.select(
        *gaps.columns, F.col("_p.ts").alias("t0"), F.col("_p.value").alias("v0"),
        F.col("_n.ts").alias("t1"), F.col("_n.value").alias("v1"),
    )


def _no_failures(gaps: DataFrame) -> DataFrame:
    return failure_table(gaps.limit(0).withColumns({"available": F.lit(0).cast("bigint")}), "none", 0)


def failure_table(gaps: DataFrame, model: str, required: int) -> DataFrame:
    """Diagnostics of gaps a model could not fill."""
    return gaps.select(
        F.lit(model).alias("model"), *SET, "start_ts", "len",
        F.lit(required).cast("bigint").alias("required"), F.col("available").cast("bigint").alias("available"),
        F.lit(SHORT_CONTEXT).alias("reason"),
    )


def linear_imputer(
    rows: DataFrame, gaps: DataFrame, *, step: int = HOUR, natural: bool = False, anchors: DataFrame | None = None, **_
) -> tuple[DataFrame, DataFrame]:
    """Straight line between the observed rows around each gap.

    ``anchors`` are the gaps' :func:`gap_anchors`, where a caller has them.
    """
    anchored = gap_rows(gap_anchors(rows, gaps, step, natural=natural) if anchors is None else anchors, step)
    value = _line(F.col("t0"), F.col("v0"), F.col("t1"), F.col("v1"), F.col("ts"))
    return anchored.select(*gaps.columns, "ts", value.alias("pred")), _no_failures(gaps)


def season(ts: Column | str, step: int) -> Column:
    """Hour of day; other steps have no season."""
    return F.hour(ts) if step == HOUR else F.lit(0)


def seasonal_imputer(
    rows: DataFrame, gaps: DataFrame, *, step: int = HOUR, natural: bool = False, anchors: DataFrame | None = None, **_
) -> tuple[DataFrame, DataFrame]:
    """Hour-of-day mean plus the interpolated distance from it.

    The hourly means leave the set's masked rows out: their sums are taken off
    the sums of the series.  Where an hour has no data left, and on steps other
    than an hour, the plain line is used.  ``anchors`` as in :func:`linear_imputer`.
    """
    anchored = gap_rows(gap_anchors(rows, gaps, step, natural=natural) if anchors is None else anchors, step)
    plain = _line(F.col("t0"), F.col("v0"), F.col("t1"), F.col("v1"), F.col("ts"))
    if step != HOUR:
        return anchored.select(*gaps.columns, "ts", plain.alias("pred")), _no_failures(gaps)
    sums = (
        rows.where(F.col("value").isNotNull())
        .groupBy("series", F.hour("ts").alias("h"))
        .agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    )
    masked = (
        gap_rows(gaps, step).select(*SET, "ts").distinct()
        .join(rows.select("series", "ts", "value"), ["series", "ts"])
        .where(F.col("value").isNotNull())
        .groupBy(*SET, F.hour("ts").alias("h"))
        .agg(F.sum("value").alias("ms"), F.count(F.lit(1)).alias("mc"))
    )
    # 24 means per set.
    hours = sums.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("h", F.struct("s", "c")))).alias("all"))
    off = masked.groupBy(*SET).agg(
        F.map_from_entries(F.collect_list(F.struct("h", F.struct("ms", "mc")))).alias("off")
    )
    filled = anchored.join(hours, ["series"], "left").join(off, list(SET), "left")

    def mean(ts: str) -> Column:
        every = F.try_element_at("all", F.hour(ts))
        less = F.try_element_at("off", F.hour(ts))
        left = every["c"] - F.coalesce(less["mc"], F.lit(0))
        return F.when(left > 0, (every["s"] - F.coalesce(less["ms"], F.lit(0.0))) / left)

    wave = mean("ts") + _line(
        F.col("t0"), F.col("v0") - mean("t0"), F.col("t1"), F.col("v1") - mean("t1"), F.col("ts")
    )
    return filled.select(*gaps.columns, "ts", F.coalesce(wave, plain).alias("pred")), _no_failures(gaps)


def left_context(rows: DataFrame, gaps: DataFrame, required: int, *, step: int = HOUR) -> DataFrame:
    """Clean rows just before each gap, at most ``required`` and without a hole.

    Each gap asks for the slots it may use; the run of observed rows ending at
    the gap says how many of them count.
    """
    measured = runs(rows.select("series", "blk", "ts", "value"), F.col("value").isNotNull())
    known = measured.where(F.col("value").isNotNull()).select("series", "ts", "value", "run_start")
    asked = gaps.withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(required)))).withColumn(
        "ts", F.timestamp_micros(micros("start_ts") - F.col("_back") * (step * MICROS))
    )
    hit = asked.join(known, ["series", "ts"])
    last_run = F.max(F.when(F.col("_back") == 1, F.col("run_start"))).over(Window.partitionBy(*SET, "gap_id"))
    return hit.withColumn("_run", last_run).where(F.col("run_start") == F.col("_run")).select(
        *gaps.columns, F.col("_back").alias("back"), "ts", "value"
    )


def context_counts(context: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps with ``available``, the number of clean rows before them."""
    counts = context.groupBy(*SET, "gap_id").agg(F.count(F.lit(1)).alias("available"))
    return gaps.join(counts, [*SET, "gap_id"], "left").withColumn(
        "available", F.coalesce("available", F.lit(0)).cast("bigint")
    )


def trend_imputer(
    rows: DataFrame, gaps: DataFrame, *, step: int = HOUR, min_context: int = 3, **_
) -> tuple[DataFrame, DataFrame]:
    """Least-squares line through all clean rows before the gap, plus the mean
    distance from it at the same hour of day.

    Running sums inside each observed run give every gap its sums without
    visiting the history again.
    """
    required = max(3, min_context)
    run = runs(rows.select("series", "blk", "ts", "value"), F.col("value").isNotNull())
    x = ((micros("ts") - micros("run_start")) / F.lit(step * MICROS)).cast("double")
    observed = run.where(F.col("value").isNotNull()).withColumns({"x": x, "h": season("ts", step)})
    one = F.lit(1.0)
    y = F.col("value")
    sums = carry(
        observed.select("series", "run_start", "blk", "ts", "x", "h", "value"),
        {"n": ("sum", one), "sx": ("sum", F.col("x")), "sy": ("sum", y),
         "sxx": ("sum", F.col("x") * F.col("x")), "sxy": ("sum", F.col("x") * y)},
        keys=("series", "run_start"),
    )
    sums = carry(
        sums, {"hn": ("sum", one), "hx": ("sum", F.col("x")), "hy": ("sum", y)}, keys=("series", "run_start", "h")
    )
    sums = cut(sums.select("series", "ts", "run_start", "x", "n", "sx", "sy", "sxx", "sxy", "hn", "hx", "hy"))
    before = gaps.withColumn("_at", F.timestamp_micros(micros("start_ts") - F.lit(step * MICROS)))
    fit = before.join(
        sums.select("series", F.col("ts").alias("_at"), F.col("run_start").alias("_run"),
                    F.col("x").alias("_x"), "n", "sx", "sy", "sxx", "sxy"),
        ["series", "_at"], "left",
    ).withColumn("available", F.coalesce("n", F.lit(0.0)).cast("bigint"))
    slope = F.coalesce(
        F.try_divide(
            F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"),
            F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"),
        ),
        F.lit(0.0),
    )
    usable = fit.where(F.col("available") >= required).withColumn("b", slope).withColumn(
        "a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("n")
    )
    wave = SEASON_HOURS if step == HOUR else 1
    # Last clean row of the same hour before the gap.
    back = F.ceil((F.col("offset") + 1) / F.lit(wave)) * wave - F.col("offset")
    targets = gap_rows(usable.drop("sx", "sy", "sxx", "sxy", "n", "_at"), step).withColumn(
        "_same", F.timestamp_micros(micros("start_ts") - back * (step * MICROS))
    )
    same = sums.select(
        "series", F.col("ts").alias("_same"), F.col("run_start").alias("_run"), "hn", "hx", "hy"
    )
    joined = targets.join(same, ["series", "_same", "_run"], "left")
    usual = F.coalesce((F.col("hy") - F.col("a") * F.col("hn") - F.col("b") * F.col("hx")) / F.col("hn"), F.lit(0.0))
    pred = F.col("a") + F.col("b") * (F.col("_x") + 1 + F.col("offset")) + usual
    short = fit.where(F.col("available") < required)
    return joined.select(*gaps.columns, "ts", pred.alias("pred")), failure_table(short, "TrendFit", required)


def natural_gaps(rows: DataFrame, step: int = HOUR) -> DataFrame:
    """The real holes of gridded series as one gap set per series."""
    return gap_windows(rows).select(
        "series", F.lit(0).cast("bigint").alias("gap_size"), F.lit(0).cast("bigint").alias("seed"),
        F.lit(0).cast("bigint").alias("run"), micros("start_ts").alias("gap_id"), "start_ts", "len",
    )


def impute_series(rows: DataFrame, imputer=seasonal_imputer, *, step: int = HOUR, **options) -> DataFrame:
    """Complete series: observed rows stay, gaps take the imputer's value, and
    what it leaves open falls back to seasonal interpolation."""
    gaps = cut(natural_gaps(rows, step))
    pred, _ = imputer(rows, gaps, step=step, natural=True, **options)
    fill = pred.select("series", "ts", F.col("pred").alias("_fill"))
    out = rows.join(fill, ["series", "ts"], "left")
    value = F.coalesce("value", "_fill")
    if imputer is not seasonal_imputer:
        backstop, _ = seasonal_imputer(rows, gaps, step=step, natural=True)
        out = out.join(
            backstop.select("series", "ts", F.col("pred").alias("_backstop")), ["series", "ts"], "left"
        )
        value = F.coalesce("value", "_fill", "_backstop")
    return out.select("series", "blk", "pos", "ts", value.alias("value"))


def seasonal_naive(rows: DataFrame, mask: DataFrame, m: int, *, step: int = HOUR) -> DataFrame:
    """Value ``m`` rows earlier on the grid, on the masked rows."""
    earlier = rows.select(
        "series", F.timestamp_micros(micros("ts") + F.lit(m * step * MICROS)).alias("ts"), F.col("value").alias("naive")
    )
    return mask.join(earlier, ["series", "ts"], "left")


def context_frame(
    rows: DataFrame, mask: DataFrame, ends: DataFrame, length: int, *, step: int = HOUR
) -> DataFrame:
    """The last ``length`` grid rows up to each series' ``end_ts``: masked rows
    stay null, other holes are interpolated inside the frame."""
    frame = ends.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).select(
        "series", F.timestamp_micros(micros("end_ts") - F.col("_back") * (step * MICROS)).alias("ts"),
        F.lit(0).cast("bigint").alias("blk"),
    )
    values = rows.select("series", "ts", F.col("value").alias("_v"))
    hits = mask.select("series", "ts", F.lit(True).alias("masked")).distinct()
    joined = frame.join(values, ["series", "ts"], "left").join(hits, ["series", "ts"], "left").withColumns(
        {"masked": F.coalesce("masked", F.lit(False)), "value": F.when(F.col("masked").isNull(), F.col("_v"))}
    )
    filled = linear_fill(joined.drop("_v"))
    return filled.select("series", "ts", "masked", F.when(~F.col("masked"), F.col("filled")).alias("value"))


# --- scale of the error -------------------------------------------------------


def naive_scale(rows: DataFrame, m: int, *, step: int = HOUR, near: DataFrame | None = None) -> DataFrame:
    """Running sums for the seasonal-naive error of the history before any row.

    ``full`` sums ``|f(t) - f(t-m)|`` of the interpolated series; ``flat`` is the
    same for rows after the last observation of a history, which hold its value.
    """
    near = neighbours(rows.select("series", "blk", "pos", "ts", "value")) if near is None else near
    line = _line(F.col("prev.ts"), F.col("prev.value"), F.col("next.ts"), F.col("next.value"), F.col("ts"))
    filled = near.withColumn("f", F.coalesce("value", line))
    spread = halo(
        filled.select("series", "pos", "ts", "value", "f", F.col("prev.ts").alias("t0"), F.col("prev.value").alias("v0")),
        m, 0, step=step,
    )
    line_up = Window.partitionBy("series", "blk").orderBy("ts")
    lagged = spread.withColumns(
        {"_f": F.lag("f", m).over(line_up), "_t": F.lag("ts", m).over(line_up)}
    ).where("own")
    held = F.when(F.col("_t") <= F.col("t0"), F.col("_f")).otherwise(F.col("v0"))
    rows_out = lagged.withColumns(
        {"_full": F.coalesce(F.abs(F.col("f") - F.col("_f")), F.lit(0.0)),
         "_flat": F.when(F.col("value").isNull() & F.col("_f").isNotNull(), F.abs(F.col("v0") - held)).otherwise(F.lit(0.0))}
    )
    summed = carry(
        rows_out.select("series", "blk", "pos", "ts", "value", "_full", "_flat"),
        {"full": ("sum", F.col("_full")), "flat": ("sum", F.coalesce("_flat", F.lit(0.0)))},
    )
    at_last = F.when(F.col("value").isNotNull(), F.struct("full", "flat"))
    return carry(summed, {"seen": ("last", at_last)})


def history_scale(
    rows: DataFrame, starts: DataFrame, m: int, *, step: int = HOUR, near: DataFrame | None = None
) -> DataFrame:
    """``starts (series, start_ts)`` with ``scale``: mean seasonal-naive error of
    all rows before the start; null when the history is too short or constant."""
    sums = naive_scale(rows, m, step=step, near=near)
    wanted = starts.select("series", "start_ts").distinct().withColumn(
        "ts", F.timestamp_micros(micros("start_ts") - F.lit(step * MICROS))
    )
    hit = wanted.join(sums, ["series", "ts"])
    total = F.col("seen.full") + F.col("flat") - F.col("seen.flat")
    count = F.col("pos") + 1 - m
    return hit.select(
        "series", "start_ts", F.when((count > 0) & (total > 0), total / count).alias("scale")
    )
