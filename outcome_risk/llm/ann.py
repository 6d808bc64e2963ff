"""Nearest neighbours by cosine over low-dimensional stable projections.

Vectors are scaled to length one, so the nearest by cosine are the nearest by distance, and
projected on a few Gaussian directions. The squared projected distance of two vectors is
their squared distance times a chi-square variable with as many degrees of freedom as there
are directions. A kd-tree over the projections gives candidates in the order of projected
distance; they are verified on the original vectors, and the search stops when the next
projected distance is so large against the k-th best distance that a nearer vector beyond
it has probability below ``1 - confidence``.

Vectors are dealt into blocks of bounded size, each with an index of its own over all its
rows; queries go in blocks to every block of vectors, and only the best ``k`` of each come
back. Vectors that are null, empty, zero, of another length than the first block's most
common one, or hold null or non-finite components take no part, as queries or candidates.
Equal vectors are indexed once with their ``k + 1`` smallest ids, which is all that a
result can need. Ties go to the smaller id. Rows with a null id take no part; rows that
repeat an id are candidates once per distinct vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIRECTIONS = 8
CONFIDENCE = 0.99
LEAF_ROWS = 32
BLOCK_ROWS = 8192
QUERY_ROWS = 16384
SEED = 20_071


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value that a chi-square variable stays below with probability ``p``."""
    half = degrees / 2

    def below(x: float) -> float:
        term = total = 1 / half
        n = half
        while term > total * 1e-16:
            n += 1
            term *= x / 2 / n
            total += term
        return total * math.exp(-x / 2 + half * math.log(x / 2) - math.lgamma(half))

    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return low


def directions(width: int, count: int, seed: int = SEED) -> np.ndarray:
    """Gaussian directions, the same in every task."""
    return np.random.default_rng(seed).standard_normal((width, count))


def row_norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths of the rows, the same for equal rows wherever they stand."""
    return np.sqrt((vectors * vectors).sum(axis=1))


class Tree:
    """A kd-tree over projected points; boxes and rows of its leaves."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= leaf_rows:
                self.leaves.append(rows)
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = len(rows) // 2
            order = np.argpartition(own[:, axis], middle)
            stack += [rows[order[:middle]], rows[order[middle:]]]
        self.low = np.stack([points[r].min(axis=0) for r in self.leaves])
        self.high = np.stack([points[r].max(axis=0) for r in self.leaves])

    def nearest_first(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the squared distance of their boxes, and these distances."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        distance = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(distance, kind="stable")
        return order, distance[order]


class Block:
    """The index of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, confidence: float, count: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        self.k = k
        by_group = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
        #: Smallest ids of each distinct vector; one more than asked for, as a query may be one.
        self.ids = [np.unique(ids[by_group[a:b]])[: k + 1] for a, b in zip(cuts[:-1], cuts[1:])]
        self.vectors = vectors[first]
        self.norms = row_norms(self.vectors)
        self.unit = self.vectors / self.norms[:, None]
        self.directions = directions(vectors.shape[1], count)
        self.points = self.unit @ self.directions
        self.tree = Tree(self.points)
        self.stop = chi_square_quantile(confidence, count)

    def search(self, own: int, vector: np.ndarray) -> list[tuple[float, int]]:
        """The best ``k`` (score, id) found for one query, nearest first."""
        norm = row_norms(vector[None, :])[0]
        point = (vector / norm) @ self.directions
        order, distances = self.tree.nearest_first(point)
        best: list[tuple[float, int]] = []
        worst = math.inf
        at = 0
        while at < len(order):
            if distances[at] > self.stop * worst:
                break
            rows = np.concatenate([self.tree.leaves[leaf] for leaf in order[at : at + 4]])
            at += 4
            # summed row by row: equal vectors get equal scores in every block
            scores = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)
            keep = rows if len(best) < self.k else rows[scores >= best[-1][0]]
            kept = scores if len(best) < self.k else scores[scores >= best[-1][0]]
            for row, score in zip(keep.tolist(), kept.tolist()):
                best += [(score, i) for i in self.ids[row].tolist() if i != own]
            best = sorted(best, key=lambda found: (-found[0], found[1]))[: self.k]
            if len(best) == self.k:
                worst = max(0.0, 2.0 - 2.0 * best[-1][0])
        return best


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (array of double) of the rows that take part."""
    values = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), values.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 50,
    k: int = 5,
    confidence: float = CONFIDENCE,
    count: int = DIRECTIONS,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``:
    ``query_id, rank, vec_id, score``.
    """
    rows = usable(df, key, vector)
    size = rows.groupBy(F.size("v").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("queries")
    )
    # vectors of one length only can be compared; the most common length counts
    widths = size.orderBy(F.desc("n"), "width").limit(1).collect()
    width, n, queries = widths[0] if widths else (0, 0, 0)
    rows = rows.filter(F.size("v") == width)
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-queries // query_rows))
    spread = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    query_spread = F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(query_blocks)).cast("int")
    base = rows.select("id", "v", spread.alias("block")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    asked = rows.filter(F.col("id") % every == 0).select("id", "v", query_spread.alias("query_block"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(own) and len(queries):
            index = Block(own["id"].to_numpy(), np.stack(own["v"].to_numpy()), k, confidence, count)
            for i, v in zip(queries["id"].tolist(), queries["v"]):
                found += [(i, j, score) for score, j in index.search(i, np.asarray(v))]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    place = ["block", "query_block"]
    found = (
        base.groupBy(*place)
        .cogroup(asked.groupBy(*place))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
