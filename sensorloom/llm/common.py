"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import cut, ensure_checkpoint_dir

# Rows of long texts travel to Python in batches small enough for a worker.
BATCH_ROWS = 256

# ASCII white space of the contracts (space, tab to carriage return).
SPACES = r"[\x20\x09-\x0D]+"

__all__ = ["BATCH_ROWS", "SPACES", "ascii_lower", "components", "cut", "prepare", "read", "saved", "texts"]


def prepare(spark: SparkSession) -> None:
    """Settings that the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone, a null text as the empty one; other columns stay out of the way."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``node, root`` of undirected ``edges (a, b)`` of any ids but null; root is the component's least node.

    Large-star and small-star steps in turn: every node hands its neighbours to
    the least of them until only stars are left.  Each step is a grouped minimum
    and a join, so a hub is pre-aggregated and its rows are split by the skew
    join; each round is cut to the shared checkpoint folder.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(now), None
    for _ in range(rounds):
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = tuple(row)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        now = cut(small)
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    For wide or long tables of which later steps read some columns; the files stay
    until the folder is cleared.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def any_of(parts: Iterable[Column]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | part
    return out
