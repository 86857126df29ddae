"""Approximate nearest neighbours over balanced posting lists.

Lists come from a balanced tree of two-means over a bounded sample; every vector
of the table is indexed.  A vector near a border is put into several lists.  The
lists' centres are searched by a graph in memory; of the lists it finds, those are
read whose centre is at most a given ratio farther than the nearest one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import cut

# Sample that the lists are fitted on, vectors wanted per list, least of the sample per list.
SAMPLE, LIST, LEAST = 16_384, 256, 8
# A vector joins at most COPIES lists whose centre is at most BORDER times as far as its nearest.
COPIES, BORDER = 2, 1.08
# A query reads all lists found whose centre is at most RATIO times as far as its nearest.
RATIO = 1.25
# Neighbours of a centre in the graph: near ones and drawn ones; entries; vectors searched together.
NEAR, FAR, ENTRIES, TOGETHER = 16, 8, 32, 512
# Rows of a list and of its queries that one task compares.
PART = 4096


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def balanced_centres(sample: np.ndarray, leaf: int, seed: int = 5) -> np.ndarray:
    """Means of the leaves of a tree that halves unit vectors until a leaf has at most ``leaf``."""
    draw, waiting, out = np.random.default_rng(seed), [np.arange(len(sample))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= leaf:
            out.append(sample[rows].mean(axis=0))
            continue
        x = sample[rows]
        ends = x[draw.choice(len(x), 2, replace=False)]
        half = len(rows) // 2
        for _ in range(8):
            order = np.argsort(x @ (ends[0] - ends[1]), kind="stable")
            ends = np.stack([x[order[half:]].mean(axis=0), x[order[:half]].mean(axis=0)])
        waiting += [rows[order[half:]], rows[order[:half]]]
    centres = np.array(out)
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    return np.where(norms > 1e-12, centres / np.maximum(norms, 1e-12), sample[: 1])


class Graph:
    """Neighbourhood graph over list centres and a beam search on it."""

    def __init__(self, centres: np.ndarray, seed: int = 6):
        self.centres, count = centres, len(centres)
        draw, near = np.random.default_rng(seed), min(NEAR, count - 1)
        links = []
        for start in range(0, count, TOGETHER):
            close = centres[start : start + TOGETHER] @ centres.T
            close[np.arange(len(close)), np.arange(start, start + len(close))] = -np.inf
            links.append(np.argpartition(-close, max(0, near - 1), axis=1)[:, :near])
        # Drawn links join parts of the graph that near links alone leave apart.
        self.links = np.concatenate([np.concatenate(links), draw.integers(0, count, (count, FAR))], axis=1)
        self.entries = np.unique(np.linspace(0, count - 1, min(count, ENTRIES)).astype(int))

    def nearest(self, x: np.ndarray, reach: int, ratio: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """``lists, distances`` of up to ``reach`` centres near each unit vector, nearest first; -1 and inf fill up.

        The search goes on from the nearest centre it has not gone on from yet,
        and ends where that is over ``ratio`` times as far as the nearest found.
        """
        found = [self._nearest(x[i : i + TOGETHER], reach, ratio) for i in range(0, len(x), TOGETHER)]
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def _nearest(self, x: np.ndarray, reach: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        count, rows = len(x), np.arange(len(x))
        reach = min(reach, len(self.centres))
        width = max(reach, len(self.entries))
        beam = np.full((count, width), -1)
        far = np.full((count, width), np.inf)
        done = np.zeros((count, width), dtype=bool)
        seen = np.zeros((count, len(self.centres)), dtype=bool)
        beam[:, : len(self.entries)] = self.entries
        far[:, : len(self.entries)] = 2.0 - 2.0 * x @ self.centres[self.entries].T
        seen[:, self.entries] = True
        while len(rows):
            open_ = np.where(done[rows] | (beam[rows] < 0), np.inf, far[rows])
            at = open_.argmin(axis=1)
            next_ = open_[np.arange(len(rows)), at]
            live = (next_ < np.inf) & (next_ <= ratio**2 * far[rows].min(axis=1) + 1e-9)
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            done[rows, at] = True
            links = self.links[beam[rows, at]]
            fresh = ~seen[rows[:, None], links]
            # A link listed twice counts once.
            order = np.sort(links, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():
                first = np.argsort(links, axis=1, kind="stable")
                again = np.zeros_like(fresh)
                np.put_along_axis(again, first[:, 1:], order[:, 1:] == order[:, :-1], axis=1)
                fresh &= ~again
            seen[rows[:, None], links] = True
            d = np.where(fresh, 2.0 - 2.0 * np.einsum("ij,ikj->ik", x[rows], self.centres[links]), np.inf)
            all_far = np.concatenate([far[rows], d], axis=1)
            keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            far[rows] = np.take_along_axis(all_far, keep, axis=1)
            beam[rows] = np.take_along_axis(np.concatenate([beam[rows], np.where(fresh, links, -1)], axis=1), keep, axis=1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros_like(fresh)], axis=1), keep, axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :reach]
        far = np.take_along_axis(far, order, axis=1)
        return np.take_along_axis(beam, order, axis=1), np.sqrt(np.maximum(far, 0.0))

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Whether each of the first lists found takes the vector, with the lists: ``(list, row)`` pairs.

        The nearest list always does.  A further one within ``BORDER`` does unless
        its centre is nearer to a list already taken than to the vector.
        """
        lists, far = self.nearest(x, 4 * COPIES)
        taken = np.zeros(lists.shape, dtype=bool)
        taken[:, 0] = True
        for j in range(1, lists.shape[1]):
            fits = (lists[:, j] >= 0) & (far[:, j] <= BORDER * far[:, 0] + 1e-9) & (taken.sum(axis=1) < COPIES)
            for i in range(j):
                between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", self.centres[lists[:, j]], self.centres[lists[:, i]])))
                fits &= ~(taken[:, i] & (between < far[:, j]))
            taken[:, j] = fits
        row, at = np.nonzero(taken)
        return np.stack([lists[row, at], row], axis=1)

    def reads(self, x: np.ndarray, sizes: np.ndarray, least: int, ratio: float) -> np.ndarray:
        """``(list, row)`` pairs: lists each query reads; further ones while fewer than ``least`` vectors were met."""
        lists, far = self.nearest(x, len(self.centres), ratio)
        held = np.where(lists >= 0, sizes[lists], 0)
        before = np.cumsum(held, axis=1) - held
        row, at = np.nonzero((lists >= 0) & ((far <= ratio * far[:, :1] + 1e-9) | (before < least)))
        return np.stack([lists[row, at], row], axis=1)


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part.

    Out are null ids, null, empty and zero vectors, those with a null or non-finite
    component, and those of another length than most.
    """
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c)
    rows = rows.where(F.size("v") > 0).where(finite).where((square > 0) & (square < F.lit(math.inf)))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size("v") == (sizes.size if sizes else 0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best_of(queries: pd.DataFrame, members: pd.DataFrame, keep: int) -> pd.DataFrame:
    """``q, ids, score``: the ``keep`` members nearest to each query, ties to the smaller id."""
    out = {"q": [], "ids": [], "score": []}
    if len(queries) and len(members):
        members = members.sort_values("rep")
        a, b = _stack(queries["v"]), _stack(members["v"])
        rough = unit(a) @ unit(b).T
        kept = min(keep, len(b))
        edge = np.partition(rough, len(b) - kept, axis=1)[:, len(b) - kept] - 1e-9
        norms, ids = np.sqrt((b * b).sum(axis=1)), members["ids"].to_numpy()
        for i, q in enumerate(queries["rep"].to_numpy()):
            near = np.flatnonzero(rough[i] >= edge[i])
            # Multiplied out pair by pair, so that equal vectors have equal scores in every list.
            score = (a[i] * b[near]).sum(axis=1) / (np.sqrt((a[i] * a[i]).sum()) * norms[near])
            first = np.argsort(-score, kind="stable")[:kept]
            out["q"] += [q] * kept
            out["ids"] += list(ids[near[first]])
            out["score"] += score[first].tolist()
    return pd.DataFrame(out)


def nearest(
    table: DataFrame, wanted: Column, *, k: int = 5, sample: int = SAMPLE, size: int = LIST, ratio: float = RATIO, part: int = PART
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each usable row of ``table`` that is ``wanted``.

    Nearness is the cosine, in double precision, of the vectors of ``table (vec_id,
    embedding)``; candidates are all other usable rows, ties go to the smaller
    vec_id.  Equal vectors are indexed and searched once, with the ``k + 1``
    smallest ids of each, and the answer is handed to every row of a vector.  Rows
    that repeat a vec_id and its vector count once.  Without usable rows there are
    no rows; a query without other rows has none.
    """
    spark, keep = table.sparkSession, k + 1
    rows = usable(table)
    order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    firsts = rows.dropDuplicates(["v", "vec_id"]).withColumn("n", order).where(F.col("n") <= keep)
    distinct = cut(firsts.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"))
    asked = cut(rows.where(wanted).dropDuplicates(["v", "vec_id"]).join(distinct.select("v", "rep"), "v").select("vec_id", "rep"))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], schema)
    place = F.shiftrightunsigned(F.xxhash64("rep"), 1).cast("double") / float(1 << 63)
    # About ``sample`` vectors.
    drawn = distinct.where(place < sample / count) if count > sample else distinct
    drawn = sorted((row.rep, row.v) for row in drawn.select("rep", "v").collect())
    x = unit(np.array([v for _, v in drawn], dtype=np.float64))
    graph = Graph(balanced_centres(x, max(LEAST, round(len(x) * size / count))))
    fields = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    shape = f"list int, rep bigint, ids array<bigint>, v {fields['v']}"

    def homes(batches):
        for pdf in batches:
            pairs = graph.homes(unit(_stack(pdf["v"])))
            yield pdf.iloc[pairs[:, 1]].assign(list=pairs[:, 0].astype("int32"))[["list", "rep", "ids", "v"]]

    index = cut(distinct.mapInPandas(homes, shape))
    # One count per list.
    sizes = np.zeros(len(graph.centres), dtype=np.int64)
    for row in index.groupBy("list").count().collect():
        sizes[row.list] = row["count"]

    def reads(batches):
        for pdf in batches:
            pairs = graph.reads(unit(_stack(pdf["v"])), sizes, 4 * keep, ratio)
            yield pdf.iloc[pairs[:, 1]].assign(list=pairs[:, 0].astype("int32"))[["list", "rep", "v"]]

    searched = distinct.join(asked.select("rep").distinct(), "rep").select("rep", "v")
    searched = cut(searched.mapInPandas(reads, f"list int, rep bigint, v {fields['v']}"))
    # A long list, or one with many queries, is cut into parts that are all compared with each other.
    parts = [(row.list, max(1, -(-int(sizes[row.list]) // part)), -(-row["count"] // part)) for row in searched.groupBy("list").count().collect()]
    parts = F.broadcast(spark.createDataFrame(parts, "list int, rows int, asks int"))
    left = searched.join(parts, "list").withColumn("ask", F.pmod(F.xxhash64("rep"), F.col("asks")))
    left = left.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select("list", "row", F.col("ask").cast("int").alias("ask"), "rep", "v")
    right = index.join(parts, "list").withColumn("row", F.pmod(F.xxhash64("rep"), F.col("rows")).cast("int"))
    right = right.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("list", "row", "ask", "rep", "ids", "v")
    key = ["list", "row", "ask"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        lambda a, b: best_of(a, b, keep), "q bigint, ids array<bigint>, score double"
    )
    found = found.select("q", F.explode("ids").alias("id"), "score").groupBy("q", "id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    lists = found.withColumn("n", best).where(F.col("n") <= keep).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("found")
    )
    answers = asked.join(lists, asked["rep"] == lists["q"])
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("vec_id")), 1, k)
    return answers.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score")
    )
