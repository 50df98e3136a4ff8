"""Approximate nearest neighbours by collision counting: query-centred windows over single projections, widened by virtual rehashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permafield.llm.common import materialise

#: Projections; collisions from which a vector is verified; a window's width for a radius of 1; first radius and its growth.
#: At distance R a projection's window of radius R catches a vector with probability 0.826, so a true neighbour within R is
#: verified with a probability of 0.995 (45 or more of 64), one at 2 R with 0.001.
PROJECTIONS, THRESHOLD, WIDTH, FIRST, GROWTH = 64, 45, 2.719, 0.12, 1.3
#: Rows of a data block and queries of a query block: what one task holds. Small inputs still make LEAST blocks.
BLOCK, QUERIES, LEAST = 65_536, 16_384, 12


class CollisionIndex:
    """Sorted projections of unit vectors; equal vectors are one entry with the ids that can be among the nearest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seed: int = 5):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, inverse = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        # Ties go to the smaller id and a query's own id is left out: of equal vectors the k + 1 smallest ids are all that can be returned.
        by = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[by], np.arange(len(first)))
        ends = np.append(starts[1:], len(by))
        self.members = [np.unique(ids[by[s:e]])[: k + 1] if e - s > 1 else ids[by[s:e]] for s, e in zip(starts, ends)]
        self.k = k
        self.x = vectors[first].astype(np.float64)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        unit = self.x / self.norm[:, None]
        self.axes = np.random.Generator(np.random.Philox(seed)).standard_normal((PROJECTIONS, vectors.shape[1]))
        at = unit @ self.axes.T
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(at, self.order.T, 0).T.copy()
        levels = max(1, math.ceil(math.log(2.2 / FIRST, GROWTH)) + 1)
        self.radii = FIRST * GROWTH ** np.arange(levels)

    def search(self, query_ids: np.ndarray, queries: np.ndarray) -> list[tuple[int, int, float]]:
        """(query id, vector id, cosine) of the k nearest found of each query."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q * q).sum(1))
        at = (q / norm[:, None]) @ self.axes.T
        half = WIDTH * self.radii / 2
        low = np.empty((PROJECTIONS, len(q), len(half)), np.int64)
        high = np.empty_like(low)
        for j in range(PROJECTIONS):
            low[j] = np.searchsorted(self.sorted[j], at[:, j, None] - half, "left")
            high[j] = np.searchsorted(self.sorted[j], at[:, j, None] + half, "right")
        n = len(self.x)
        out = []
        for i, own in enumerate(query_ids.tolist()):
            count = np.zeros(n, np.int64)
            done = np.zeros(n, bool)
            best: list[tuple[float, int]] = []
            for level, radius in enumerate(self.radii):
                parts = []
                for j in range(PROJECTIONS):
                    a, b = low[j, i, level], high[j, i, level]
                    if level:  # the window of the radius before lies within: count what the wider one adds
                        c, d = low[j, i, level - 1], high[j, i, level - 1]
                        parts.append(self.order[j, a:c])
                        parts.append(self.order[j, d:b])
                    else:
                        parts.append(self.order[j, a:b])
                count += np.bincount(np.concatenate(parts), minlength=n)
                new = np.flatnonzero((count >= THRESHOLD) & ~done)
                if len(new):
                    done[new] = True
                    score = (self.x[new] * q[i]).sum(1) / (self.norm[new] * norm[i])
                    if len(new) > 4 * self.k + 16:  # only what can still be among the k nearest is listed
                        floor = np.partition(score, len(score) - self.k - 2)[len(score) - self.k - 2]
                        new, score = new[score >= floor], score[score >= floor]
                    best += [(-s, v) for c, s in zip(new.tolist(), score.tolist()) for v in self.members[c].tolist() if v != own]
                    best.sort()
                    del best[self.k :]
                if len(best) == self.k and math.sqrt(max(0.0, 2 + 2 * best[-1][0])) <= radius:
                    break
            if len(best) < self.k:  # too few vectors met the threshold: verify the others
                rest = np.flatnonzero(~done)
                score = (self.x[rest] * q[i]).sum(1) / (self.norm[rest] * norm[i])
                best += [(-s, v) for c, s in zip(rest.tolist(), score.tolist()) for v in self.members[c].tolist() if v != own]
                best.sort()
                del best[self.k :]
            out += [(own, v, -s) for s, v in best]
        return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest vectors found, by largest cosine, ties to the smaller id: ``query_id, rank, vec_id, score``.

    Every block of vectors is searched by every block of queries, and the blocks' nearest are merged; a task holds one block
    of each. A query's own id is no candidate. Vectors that are null, zero, or hold null or non-finite components, and rows
    without an id, take no part; vectors of different lengths are not compared; a repeated query id is one query, a repeated
    candidate id counts once. Fewer than ``k`` candidates: all. Other columns are not read.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    clean = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    data, asked = clean(vectors), clean(queries).dropDuplicates(["id"])
    n, q = data.count(), asked.count()
    blocks, parts = max(LEAST, -(-n // BLOCK)), max(1, -(-q // QUERIES))
    placed = data.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.size("v").alias("width"), "id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.size("v").alias("width"), "id", "v")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = table["v"].combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False)
        return table["id"].to_numpy(), flat.reshape(len(values), -1)

    names = ["query_id", "vec_id", "score"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list = []
        if left.num_rows and right.num_rows:
            ids, x = matrix(left)
            rows = CollisionIndex(ids, x, k).search(*matrix(right))
        a, b, s = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=names)

    key = ["block", "part", "width"]
    found = placed.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = materialise(found, "found").dropDuplicates(["query_id", "vec_id"])
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["CollisionIndex", "nearest"]
