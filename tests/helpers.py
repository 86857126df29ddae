"""Small frames for tests."""

import datetime as dt

import pandas as pd

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, *, step=3600, name="a", start=T0):
    """``(series, ts, value, event_id)`` rows of one regular series; None = null."""
    rows = [
        (name, start + dt.timedelta(seconds=step * i), None if v is None else float(v), i)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double, event_id bigint")


def by_time(df, column="value", **where):
    pdf = df.toPandas()
    for key, value in where.items():
        pdf = pdf[pdf[key] == value]
    return [None if pd.isna(v) else v for v in pdf.sort_values("ts")[column]]
