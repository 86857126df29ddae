"""Grouped sums of outer products, the input of every linear fit here.

Each block of rows gives one small matrix, packed as its upper triangle in an array.
Arrays are added in two levels, so no task holds more than a block of rows or a
bounded number of matrices.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Groups of blocks whose sums are added first: both levels add some thousand arrays at most.
SLOTS = 1024


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def packed(matrix: np.ndarray) -> np.ndarray:
    """The upper triangle of a symmetric matrix, row by row."""
    return matrix[np.triu_indices(len(matrix))]


def unpacked(triangle: Sequence[float]) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    size = int(round((8 * len(triangle) + 1) ** 0.5 - 1)) // 2
    matrix = np.zeros((size, size))
    matrix[np.triu_indices(size)] = triangle
    return matrix + np.triu(matrix, 1).T


def gram(
    rows: DataFrame, keys: Sequence[str], build: Callable[[pd.DataFrame], np.ndarray], block: Sequence[str]
) -> DataFrame:
    """``keys, g``: the packed sum of ``zᵀz`` over all rows of a group.

    ``build`` turns the rows of one block (grouped by ``block``) into a matrix
    with one row per sample.  Groups without samples have no row.
    """
    keys = list(keys)

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        z = build(pdf)
        at = zlib.crc32("|".join(str(v) for v in pdf[list(block)].iloc[0]).encode())
        out = pdf[keys].head(1).assign(_slot=at % SLOTS, _at=at)
        out["g"] = [packed(z.T @ z)]
        return out if len(z) else out.iloc[:0]

    def added(level: list[str], order: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            # In the same order whenever the task runs.
            pdf = pdf.sort_values(order)
            out = pdf[level].head(1).reset_index(drop=True)
            out["g"] = [np.sum(np.stack(pdf["g"].tolist()), axis=0)]
            return out

        return add

    schema = key_schema(rows, keys)
    parts = rows.groupBy(*block).applyInPandas(one_block, f"{schema}, _slot bigint, _at bigint, g array<double>")
    near = parts.groupBy(*keys, "_slot").applyInPandas(added([*keys, "_slot"], "_at"), f"{schema}, _slot bigint, g array<double>")
    return near.groupBy(*keys).applyInPandas(added(keys, "_slot"), f"{schema}, g array<double>")


def fit(
    sums: DataFrame, keys: Sequence[str], solve: Callable[[np.ndarray], dict], schema: str
) -> DataFrame:
    """One model row per group from its matrix of sums."""
    keys = list(keys)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            models = [solve(unpacked(g)) for g in pdf["g"]]
            if models:
                out = pdf[keys].reset_index(drop=True)
                yield out.assign(**{name: [m[name] for m in models] for name in models[0]})

    return sums.mapInPandas(solved, f"{key_schema(sums, keys)}, {schema}")


def sliding(values: np.ndarray, width: int) -> np.ndarray:
    """All windows of ``width`` neighbouring values, one per row."""
    if len(values) < width:
        return np.empty((0, width))
    return np.lib.stride_tricks.sliding_window_view(values, width)
