"""Result tables: score store, keyed replacement, CSV reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_scores(scores: DataFrame, folder: str) -> None:
    """Store ``run, detector, series, ts, score[, label]`` by run and detector.

    Rows of one detector spread over several files; a run written again replaces
    only its own folders.
    """
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run", "detector"
    ).parquet(folder)


def read_scores(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """Stored scores of one run; only its folders are read."""
    return spark.read.parquet(folder).where(F.col("run") == run).drop("run")


# A stored run: tables by detector below a folder of its own, and a row that names them.
MANIFEST = (
    "run string, version string, mode string, detectors array<string>, series array<string>, "
    "kept array<string>, discarded array<string>, labelled boolean, config string, written_at timestamp"
)


@dataclass(frozen=True)
class Run:
    """What :func:`load_run` finds."""

    mode: str
    detectors: list[str]
    series: list[str]
    kept: list[str]
    discarded: list[str]
    config: dict
    scores: DataFrame
    results: DataFrame
    labels: DataFrame | None


def save_run(
    folder: str, run: str, mode: str, *, scores: DataFrame, results: DataFrame,
    labels: DataFrame | None = None, config: Mapping | None = None,
) -> None:
    """Store scores, results and labels of a run, and last the row that makes it visible.

    ``results`` has a row per ``detector, series``; where it has ``kept`` the names
    of both kinds are noted.  A run saved again is another version; until its row is
    written readers see the one before, and a save that broke off is never seen.
    """
    spark, version = scores.sparkSession, uuid.uuid4().hex
    base = f"{folder}/data/{run}/{version}"
    scores.write.partitionBy("detector").parquet(f"{base}/scores")
    results.write.parquet(f"{base}/results")
    if labels is not None:
        labels.write.parquet(f"{base}/labels")
    stored = spark.read.parquet(f"{base}/results")
    names = lambda which, column: F.array_sort(F.collect_set(F.when(which, F.col(column))))
    judged = F.col("kept") if "kept" in stored.columns else F.lit(None).cast("boolean")
    # As many names as there are detectors and series.
    row = stored.agg(
        names(F.lit(True), "detector").alias("detectors"), names(F.lit(True), "series").alias("series"),
        names(judged, "detector").alias("kept"), names(~judged, "detector").alias("discarded"),
    )
    note = json.dumps(dict(config or {}), sort_keys=True)
    row.select(
        F.lit(run).alias("run"), F.lit(version).alias("version"), F.lit(mode).alias("mode"), "detectors", "series",
        "kept", "discarded", F.lit(labels is not None).alias("labelled"), F.lit(note).alias("config"), F.current_timestamp().alias("written_at"),
    ).coalesce(1).write.mode("append").parquet(f"{folder}/runs")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of every run."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/runs")
    last = rows.groupBy("run").agg(F.max_by("version", F.struct("written_at", "version")).alias("version"))
    return rows.join(last, ["run", "version"])


def load_run(spark: SparkSession, folder: str, run: str) -> Run:
    """A stored run, by its manifest."""
    row = runs(spark, folder).where(F.col("run") == run).first()
    if row is None:
        raise ValueError(f"no run {run!r} in {folder}")
    base = f"{folder}/data/{run}/{row.version}"
    labels = spark.read.parquet(f"{base}/labels") if row.labelled else None
    return Run(
        row["mode"], row.detectors, row.series, row.kept, row.discarded, json.loads(row.config),
        spark.read.parquet(f"{base}/scores"), spark.read.parquet(f"{base}/results"), labels,
    )


def replace_rows(old: DataFrame, new: DataFrame, key: str = "model_name") -> DataFrame:
    """Old rows except those of the keys in ``new``, and the new rows."""
    keys = new.select(F.col(key).cast("string").alias("_key")).distinct()
    aligned = old.select(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in new.columns])
    kept = aligned.join(keys, F.col(key).cast("string") == F.col("_key"), "left_anti")
    return kept.unionByName(new)


def write_curves(rows: DataFrame, folder: str) -> None:
    """Keyed replacement on disk: only the written models' folders change."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name").parquet(folder)


def write_report(df: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """CSV with a header; ``order`` sorts the whole output."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(folder)


def read_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(folder)
