"""Station files to long tables.

A path may be one file or a folder of part files, so what Spark wrote reads the
same way.  Folders named ``key=value`` count as ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.blocks import HOUR, carry
from sensorloom.operators.grid import regular_grid

SUPPORTED = ("csv", "json")
TWO_COLUMNS = "ts string, value string"
PAYLOAD = "rows array<array<double>>, cols array<string>"


def dataset_glob(base: str, keyword: str, extension: str) -> str:
    """Files one folder below ``base`` whose name contains ``keyword``."""
    return f"{base.rstrip('/')}/*/*{keyword}*.{extension}"


def _plain(part: Column) -> Column:
    return F.regexp_replace(part, "^[^=/]*=", "")


def path_parts(path: Column, extension: str) -> tuple[Column, Column]:
    """Parent folder and stem of the dataset file a row came from."""
    # Tried from the beginning of a folder's name alone, which is taken whole: every row asks this.
    pattern = rf"(?<![^/])([^/]++)/([^/]+)\.{extension}(/[^/]*+)?$"
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return _plain(F.regexp_extract(decoded, pattern, 1)), _plain(F.regexp_extract(decoded, pattern, 2))


def read_csv(spark: SparkSession, glob: str | list[str], *, only: str | None = None) -> DataFrame:
    """``path, ts, value`` of two-column files with a header; what cannot be
    read as a timestamp or number is null."""
    raw = _reader(spark, only).schema(TWO_COLUMNS).option("header", True).csv(glob)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("ts").try_cast("timestamp").alias("ts"),
        F.col("value").try_cast("double").alias("value"),
    )


def read_stations(spark: SparkSession, base: str, pollutant: str) -> DataFrame:
    """5-minute readings ``station, ts, value`` of ``<base>/<station>/*_<pollutant>.csv``.

    Rows without a valid timestamp are dropped, so empty files vanish.
    """
    rows = read_csv(spark, f"{base.rstrip('/')}/*/*_{pollutant}.csv").where(F.col("ts").isNotNull())
    station, _ = path_parts(F.col("path"), "csv")
    return rows.select(station.alias("station"), "ts", "value")


def read_payloads(
    spark: SparkSession, glob: str | list[str], *, multi_line: bool = True, only: str | None = None
) -> DataFrame:
    """``path, ts, value`` of files ``{"rows": [[ms, value], ...], "cols": [...]}``."""
    raw = _reader(spark, only).schema(PAYLOAD).option("multiLine", multi_line).json(glob)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.explode("rows").alias("r")).select(
        "path", F.timestamp_millis(F.get("r", F.lit(0)).cast("bigint")).alias("ts"), F.get("r", F.lit(1)).alias("value")
    )


def read_payload_series(spark: SparkSession, glob: str, *, multi_line: bool = True) -> DataFrame:
    """Payload files as hourly series named by their path's first part."""
    rows = read_payloads(spark, glob, multi_line=multi_line)
    _, stem = path_parts(F.col("path"), "json")
    return regular_grid(rows.select(short_name(stem).alias("series"), "ts", "value"), HOUR)


def read_tolerant(spark: SparkSession, globs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows ``path, ts, value`` of all readable files, and one row ``path, reason``
    per file that was left out.

    ``globs`` may name files, folders of them, or both.  The ending of a file's own
    name decides how it is read; other endings are not supported.  A file is left out,
    too, when it yields no row with a timestamp: one without a byte, one with a header
    alone, broken JSON.  JSON may span lines.
    """
    # The listing of the reader, which also knows files without a byte.
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(globs)).inputFiles()
    listed = spark.createDataFrame([(path,) for path in found], "path string").select(_one_form("path").alias("path"))
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = listed.withColumn("kind", kind)
    known = F.col("kind").isin(*SUPPORTED)
    unsupported = named.where(~known).select("path", F.concat(F.lit("unsupported kind: "), F.col("kind")).alias("reason"))
    rows = spark.createDataFrame([], "path string, ts timestamp, value double")
    for extension, read in (("csv", read_csv), ("json", read_payloads)):
        if any(path.lower().endswith(f".{extension}") for path in found):
            rows = rows.unionByName(read(spark, list(globs), only=extension))
    usable = rows.where(F.col("ts").isNotNull()).withColumn("path", _one_form("path"))
    unreadable = (
        named.where(known)
        .join(usable.select("path").distinct(), "path", "left_anti")
        .select("path", F.lit("no row with a timestamp").alias("reason"))
    )
    return usable, unsupported.unionByName(unreadable)


def _one_form(path: str) -> Column:
    """Local paths come with one or three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _reader(spark: SparkSession, only: str | None) -> DataFrameReader:
    """A reader of all files, or of those with one ending in the folders it is given, too."""
    if only is None:
        return spark.read
    ending = "".join(f"[{c}{c.upper()}]" for c in only)
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ending}")


def short_name(stem: Column) -> Column:
    """Series name: text before the first underscore."""
    return F.get(F.split(stem, "_"), F.lit(0))


def sanitise(text: Column) -> Column:
    """White space to single blanks, other symbols to underscores, blanks too."""
    # (?U): letters and digits of every script are word characters.
    blank = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.replace(F.regexp_replace(blank, r"(?U)[^\w\-\. ]+", "_"), F.lit(" "), F.lit("_"))


def long_name(parent: Column, stem: Column, value: Column) -> Column:
    """``parent__stem``, with ``__value`` unless the stem already names it."""
    base = F.concat_ws("__", sanitise(parent), sanitise(stem))
    named = F.contains(F.lower(sanitise(stem)), F.lower(sanitise(value)))
    return F.when(named, base).otherwise(F.concat_ws("__", base, sanitise(value)))


def unique_names(files: DataFrame, name: str = "name", order: str = "path", block: Column | None = None) -> DataFrame:
    """Give clashing names ``_1``, ``_2``, ... in the given order.

    One row per file or item.  ``block`` numbers stretches along the order when
    one name may be shared by very many rows.
    """
    placed = files.withColumn("blk", F.lit(0).cast("bigint") if block is None else block)
    counted = carry(placed, {"_k": ("sum", F.lit(1).cast("bigint"))}, order=order, keys=(name,))
    clash = F.concat_ws("_", F.col(name), F.col("_k") - 1)
    return counted.withColumn(name, F.when(F.col("_k") == 1, F.col(name)).otherwise(clash)).drop("_k", "blk")


def value_at(df: DataFrame, position: int | None) -> DataFrame | None:
    """``ts`` (first column) and the value column at ``position`` as numbers.

    Without a position a table must have exactly one value column; others are
    skipped (None).  A position out of range is an error.
    """
    columns = [c for c in df.columns if c not in ("series", "path")]
    values = columns[1:]
    if position is None:
        if len(values) != 1:
            return None
        position = 0
    if not 0 <= position < len(values):
        raise ValueError(f"column position {position} is out of range; value columns are {values}")
    kept = [c for c in df.columns if c in ("series", "path")]
    return df.select(
        *kept, F.col(columns[0]).try_cast("timestamp").alias("ts"), F.col(values[position]).try_cast("double").alias("value")
    ).where(F.col("ts").isNotNull())


def load_series(df: DataFrame, position: int | None, step: int, *, tie: str = "event_id") -> DataFrame | None:
    """One value column of a raw table on the regular grid."""
    picked = value_at(df, position)
    return None if picked is None else regular_grid(picked, step, tie=tie)
