"""Folder and name of the file a row came from, in time that follows the path's length."""

import re
import time

from sensorloom.sources import files
from pyspark.sql import functions as F

PATHS = [
    "file:///a/station=x%20y/name=x_NO2.csv/part-0.csv", "file:///a/b/station=x/name=x_NO2.csv", "x/y.csv", "/y.csv", "y.csv", "a+b/c+d.csv/p",
    "file:///a/k=v=w/k=n.csv.csv/part.csv", "file:///a/b.csv/c.csv/d", "file:///a/b.txt/c.txt", "", "a//b.csv", "a/b.csv/",
]


def test_parts_are_those_of_the_plain_pattern(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    parent, stem = files.path_parts(F.col("path"), "csv")
    for r in df.select("path", parent.alias("parent"), stem.alias("stem")).collect():
        found = re.search(r"([^/]+)/([^/]+)\.csv(/[^/]*)?$", r.path.replace("%20", " "))
        want = [re.sub("^[^=/]*=", "", x) for x in found.groups()[:2]] if found else ["", ""]
        assert [r.parent, r.stem] == want, r.path


def test_long_names_take_no_square_time(spark):
    # Every place of a name was tried against all the rest of it.
    rows = spark.range(400).select(F.concat(F.repeat(F.lit("x"), 20_000), F.lit("/y.txt")).alias("path"))
    parent, stem = files.path_parts(F.col("path"), "csv")
    begun = time.monotonic()
    assert rows.where((parent != "") | (stem != "")).count() == 0
    assert time.monotonic() - begun < 15
