"""Labelled documents: folds by document id, training labels and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text is ``fold`` modulo ``folds``; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """``doc_id, label`` of all labels outside fold ``held``.

    Labels other than 0 and 1 do not count; of several labels of one document the
    lowest does.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~in_fold(F.col("doc_id"), folds, held))
    return known.groupBy("doc_id").agg(F.min("label").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, size: int) -> DataFrame:
    """``text, label`` of labelled documents outside fold ``held``: all, or about ``size`` of them.

    Beyond ``size`` labels those stay whose hashed id is below the share that
    gives ``size``, so the sample is the same in every run.
    """
    known = training_labels(labels, label, folds, held)
    count = known.count()
    if count > size:
        place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 1).cast("double") / float(1 << 63)
        known = known.where(place < size / count)
    # About ``size`` rows of two numbers.
    return common.texts(docs).join(F.broadcast(known), "doc_id").select("text", "label")
