"""Queries of this package over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import ann, bpe, exact, language, lexical, lines, packing, pii, quality, simhash, spelling, toxicity, urls
from sensorloom.llm.common import read


def byte_bpe_files() -> tuple[str, str, str]:
    """Tokenizers file, the same vocabulary as ranks, and its word pattern."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(read(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), byte_bpe_files())


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(read(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = [
    op1_simhash, op2_toxicity, op3_pii, op4_exact, op5_urls, op6_bpe, op7_quality, op8_lines, op9_packing, op10_ann,
    op11_language, op12_lexical, op13_spelling,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact": exact.SQL, "op12_lexical": lexical.SQL, "op13_spelling": spelling.SQL}
