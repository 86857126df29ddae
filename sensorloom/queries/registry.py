"""Registry of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.session import configure, ensure_checkpoint_dir

MODULES = ("sources", "grid", "detect", "screen", "inject", "metrics", "impute", "forecast", "report")
DIGITS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; doubles are rounded so that engines can be compared."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            ensure_checkpoint_dir(spark)
            return rounded(build(spark, sf_dir))

        REGISTRY[name] = Query(run, sql)
        return build

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def load_all() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"sensorloom.queries.{module}")
    return REGISTRY
