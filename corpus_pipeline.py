"""Corpus pipeline: quality, lines, near copies, personal data, packing.

``STAGES`` lists the stages in order.  Each takes ``(spark, docs, sf_dir)``; all but
the last return the columns of ``documents``.  ``run`` applies them to the table,
each stage's rows written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import lines, packing, pii, quality, shingles
from sensorloom.llm.common import prepare, read
from sensorloom.llm.queries import byte_bpe_files
from sensorloom.session import ensure_checkpoint_dir


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a change of ``text``."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document whose every line went is gone, too."""
    prepare(spark)
    return _measured(lines.without_repeats(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    prepare(spark)
    return shingles.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    prepare(spark)
    return _measured(pii.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    prepare(spark)
    return packing.packed(docs, byte_bpe_files())


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("personal_data", redact),
    ("packing", pack),
]

# Learned scores, fuzzy groups and packing are not expressible in SQL; the tests
# compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
