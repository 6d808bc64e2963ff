"""Connected components of an edge table, as rounds of pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcome_risk.llm.storage import write_table


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour, itself included, of each ``u``."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour to the smallest one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tied = both.join(_smallest(both), "u").filter("v > u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie every node and its smaller neighbours to the smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = down.join(_smallest(down), "u")
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    ).first()
    return row["n"], row["sum"]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of its component) of all nodes ``a, b`` of edges.

    Large-star and small-star rounds until nothing changes; then each node has one edge,
    to its root. Self edges and repeated edges are allowed; no edges give no rows.
    """
    nodes = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    current = write_table(nodes.filter("u <> v").distinct(), "component-edges")
    state = _state(current)
    while True:
        following = write_table(_small_star(_large_star(current)), "component-edges")
        now = _state(following)
        current = following
        if now == state:
            break
        state = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.union(roots)
