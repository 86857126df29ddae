"""Exact nearest and furthest neighbours of vectors.

Vectors are put into cells around a few pivots.  The distance of a query to a
pivot and the radius of its cell bound all distances to the cell, so cells that
cannot hold one of the k neighbours are skipped; the rest is compared block by
block, and a block only passes on the k best of each query.  Equal vectors are
searched once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.session import cut

MAX_CELLS = 256
# Vectors of a block at most, queries of a block compared at once, pairs measured exactly at once.
BLOCK, SIDE, EXACT = 16_384, 256, 1 << 16
SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.maximum(squared, 0.0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def cell_count(size: int, block: int) -> int:
    """Cells of about half a block: the smaller they are, the more often every vector is sent."""
    return max(1, min(MAX_CELLS, -(-2 * size // block)))


def neighbours(vectors: DataFrame, k: int, *, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """``id, kind, rank, other, distance`` for ``vectors (id, v)``.

    ``kind`` is near or far, ``distance`` the squared Euclidean distance; equal
    distances are ranked by id.
    """
    # Blocks travel once for every block they meet, so short numbers stay short until they are compared.
    form = "array<float>" if isinstance(vectors.schema["v"].dataType.elementType, T.FloatType) else "array<double>"
    vectors = cut(vectors.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast(form).alias("v")))
    # Of equal vectors only the k + 1 smallest ids can be anyone's neighbour.
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = cut(vectors.withColumn("copy", copy).where(F.col("copy") <= k + 1))
    size = candidates.count()
    wanted = cells or cell_count(size, block)
    # A fixed number of pivots, at most 256 vectors.
    chosen = candidates.where("copy = 1").orderBy(F.xxhash64("id"), "id").limit(wanted)
    pivots = np.array([row.v for row in chosen.select("v").collect()], dtype=float)
    if size == 0:
        return vectors.sparkSession.createDataFrame([], "id bigint, kind string, rank int, other bigint, distance double")

    def place(batches):
        for pdf in batches:
            far = np.sqrt(_distances(_matrix(pdf["v"]), pivots))
            pdf["cell"] = far.argmin(axis=1)
            pdf["off"] = far.min(axis=1)
            yield pdf

    placed = cut(candidates.mapInPandas(place, f"id bigint, v {form}, copy int, cell int, off double"))
    # One row per cell, at most 256.
    table = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("r")).toPandas()
    table = table.sort_values("cell").reset_index(drop=True)
    cell_ids, counts, radii = (table[c].to_numpy() for c in ("cell", "n", "r"))
    parts = np.maximum(1, -(-counts // block))
    part_of = {int(c): int(p) for c, p in zip(cell_ids, parts, strict=True)}
    part = F.create_map(*[F.lit(x) for pair in part_of.items() for x in pair])
    located = placed.withColumn(
        "part", F.pmod(F.xxhash64("id"), F.try_element_at(part, F.col("cell")).cast("bigint")).cast("int")
    )

    def reach(batches):
        """Cells that may hold one of the k + 1 nearest or furthest of a query in a block."""
        for pdf in batches:
            middle = np.sqrt(_distances(_matrix(pdf["v"]), pivots[cell_ids]))
            tol = SLACK * (1.0 + middle.max(axis=1, keepdims=True))
            low, high = np.maximum(middle - radii, 0.0) - tol, middle + radii + tol
            enough = min(k + 1, int(counts.sum()))

            def bound(edge: np.ndarray) -> np.ndarray:
                order = edge.argsort(axis=1)
                seen = counts[order].cumsum(axis=1)
                at = (seen >= enough).argmax(axis=1)
                return np.take_along_axis(edge, order, axis=1)[np.arange(len(edge)), at]

            needed = (low <= bound(high)[:, None]) | (high >= -bound(-low)[:, None])
            blocks = pdf[["cell", "part"]].to_numpy()
            different, own = np.unique(blocks, axis=0, return_inverse=True)
            any_needed = np.zeros((len(different), len(cell_ids)), dtype=bool)
            np.logical_or.at(any_needed, own.ravel(), needed)
            q, c = np.nonzero(any_needed)
            yield pd.DataFrame({
                "q_cell": different[q, 0].astype("int32"), "q_part": different[q, 1].astype("int32"),
                "cell": cell_ids[c].astype("int32"), "parts": parts[c].astype("int32"),
            })

    leading = located.where("copy = 1")
    # Blocks with blocks, without their vectors.
    met = leading.select("v", "cell", "part").mapInPandas(reach, "q_cell int, q_part int, cell int, parts int").distinct()
    pairs = cut(met.select("q_cell", "q_part", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    pair = ["q_cell", "q_part", "cell", "part"]
    queries = leading.select("id", "v", F.col("cell").alias("q_cell"), F.col("part").alias("q_part")).join(pairs, ["q_cell", "q_part"])
    others = located.select(F.col("id").alias("other"), F.col("v").alias("w"), "cell", "part").join(pairs, ["cell", "part"])
    others = others.withColumnsRenamed({c: f"{c}_" for c in pair})

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0][["id"]].assign(kind="", other=0, distance=0.0)
        queried, b, others = _matrix(left["v"]), _matrix(right["w"]), right["other"].to_numpy()
        out = []
        for start in range(0, len(queried), SIDE):
            a, ids = queried[start : start + SIDE], left["id"].to_numpy()[start : start + SIDE]
            rough = _distances(a, b)
            tol = SLACK * (1.0 + rough.max(axis=1, keepdims=True))
            top = min(k, rough.shape[1] - 1)
            for kind, signed in (("near", rough), ("far", -rough)):
                limit = np.partition(signed, top, axis=1)[:, top : top + 1]
                i, j = np.nonzero(signed <= limit + tol)
                exact = np.concatenate([
                    ((a[i[at : at + EXACT]] - b[j[at : at + EXACT]]) ** 2).sum(axis=1) for at in range(0, len(i), EXACT)
                ])
                order = np.lexsort((others[j], exact if kind == "near" else -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, i)
                best = np.arange(len(i)) - first <= k
                i, j, exact = i[best], j[best], exact[best]
                out.append(pd.DataFrame({"id": ids[i], "kind": kind, "other": others[j], "distance": exact}))
        return pd.concat(out)

    best = queries.groupBy(*pair).cogroup(others.groupBy(*[f"{c}_" for c in pair])).applyInPandas(
        compare, "id bigint, kind string, other bigint, distance double"
    )
    key = F.when(F.col("kind") == "near", F.col("distance")).otherwise(-F.col("distance"))
    order = Window.partitionBy("id", "kind").orderBy(key, "other")
    kept = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = kept.groupBy("id", "kind").agg(
        F.array_sort(F.collect_list(F.struct("r", "other", "distance"))).alias("found")
    )
    # Every vector takes the list of the first vector equal to it, less itself.
    leaders = candidates.where("copy = 1").select(F.col("id").alias("leader"), "v")
    joined = vectors.join(leaders, "v").select("id", "leader").join(
        lists.withColumnRenamed("id", "leader"), "leader"
    )
    mine = F.slice(F.filter("found", lambda s: s["other"] != F.col("id")), 1, k)
    return joined.select("id", "kind", F.posexplode(mine).alias("rank", "s")).select(
        "id", "kind", (F.col("rank") + 1).alias("rank"), F.col("s.other").alias("other"),
        F.col("s.distance").alias("distance"),
    )
