"""Feature contributions of every row, their ranking, and texts drawn from them.

A row's contributions travel as one array column, so the per-row top lists are array
expressions without any shuffle; only the global importance aggregates.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outcome_risk.functions import bands
from outcome_risk.functions.values import half_even
from outcome_risk.operators.score import Linear
from outcome_risk.roles import quoted
from outcome_risk.storage import new_path, write_table

# Tasks carry this module's functions along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Features listed, drivers per sign.
TOP_FEATURES = 15
DRIVERS = 3
#: Packed trees that are broadcast at once.
BROADCAST_BYTES = 64 << 20

CONTRIBUTION = "array<struct<feature:string,value:double,contribution:double>>"


def with_contributions(
    df: DataFrame, features: list[str], values: list[Column], base: Column, scale: str
) -> DataFrame:
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            quoted(f).cast("double").alias("value"),
            v.alias("contribution"),
        )
        for f, v in zip(features, values)
    ]
    return df.withColumns(
        {"contributions": F.array(*entries), "base": base, "scale": F.lit(scale)}
    )


def linear_contributions(df: DataFrame, model: Linear, background: DataFrame) -> DataFrame:
    """Add ``contributions, base, scale``: weight times distance from the background mean."""
    features = model.features
    # One row, one mean per feature.
    means = background.agg(
        *[F.avg(quoted(f).cast("double")).alias(f"f{i}") for i, f in enumerate(features)]
    ).first()
    centres = [F.lit(m).cast("double") for m in means]
    weights = [F.lit(float(w)) for w in model.weights.values()]
    values = [w * (quoted(f).cast("double") - c) for f, w, c in zip(features, weights, centres)]
    base = F.lit(float(model.intercept))
    for w, c in zip(weights, centres):
        base = base + w * c
    return with_contributions(df, features, values, base, "log-odds")


class Leaf(NamedTuple):
    """A leaf as one interval and one share of training rows per feature on its path."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def tree_table(spark: SparkSession, model) -> DataFrame:
    """Node table of a fitted tree ensemble, read back from its saved form."""
    path = new_path(spark, "model")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data")


PACKED = "tree int, base double, values binary, sizes binary, features binary, bounds binary"


def pack(tree: int, leaves: list[Leaf]) -> dict:
    """Leaves as flat arrays: values, path lengths, and per path step feature, low, high, share."""
    steps = [np.column_stack([l.low, l.high, l.share]) for l in leaves]
    return {
        "tree": tree,
        "base": base_value(leaves),
        "values": np.array([l.value for l in leaves], dtype="<f8").tobytes(),
        "sizes": np.array([len(l.features) for l in leaves], dtype="<i4").tobytes(),
        "features": np.concatenate([l.features for l in leaves] or [[]]).astype("<i4").tobytes(),
        "bounds": np.concatenate(steps or [np.zeros((0, 3))]).astype("<f8").tobytes(),
    }


def unpack(values: bytes, sizes: bytes, features: bytes, bounds: bytes) -> list[Leaf]:
    ends = np.cumsum(np.frombuffer(sizes, dtype="<i4"))
    numbers = np.split(np.frombuffer(features, dtype="<i4"), ends[:-1])
    steps = np.split(np.frombuffer(bounds, dtype="<f8").reshape(-1, 3), ends[:-1])
    return [Leaf(v, f, b[:, 0], b[:, 1], b[:, 2]) for v, f, b in zip(np.frombuffer(values, dtype="<f8"), numbers, steps)]


def ensemble_leaves(spark: SparkSession, model) -> DataFrame:
    """Stored leaves of all trees, a row per tree, scaled so that they add up to the model's output.

    Forests give the positive share, averaged over trees; boosted trees give log-odds. The
    paths are built where the nodes are, tree by tree; the driver sees the tree weights only.
    """
    boosted = isinstance(model, GBTClassificationModel)
    weights = list(model.treeWeights)
    factors = [2.0 * w if boosted else 1.0 / len(weights) for w in weights]
    stats = F.col("impurityStats")
    positive = F.when(F.size(stats) > 1, F.try_divide(F.get(stats, F.lit(1)), F.aggregate(stats, F.lit(0.0), lambda t, s: t + s)))
    nodes = tree_table(spark, model).select("treeID", "nodeData.*").select(
        F.col("treeID").alias("tree"),
        "id",
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.col("rawCount").cast("double").alias("cover"),
        (F.col("prediction") if boosted else F.coalesce(positive, F.lit(0.0))).alias("value"),
    )

    def build(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        leaves = _tree_leaves({n["id"]: n for n in table.to_pylist()}, factors[tree])
        return pa.Table.from_pylist([pack(tree, leaves)]).cast(_PACKED_TYPES)

    return write_table(nodes.groupBy("tree").applyInArrow(build, PACKED), "leaves")


_PACKED_TYPES = pa.schema(
    [("tree", pa.int32()), ("base", pa.float64())]
    + [(name, pa.binary()) for name in ("values", "sizes", "features", "bounds")]
)


def _tree_leaves(nodes: dict[int, dict], factor: float) -> list[Leaf]:
    leaves, stack = [], [(0, {})]
    while stack:
        number, path = stack.pop()
        node = nodes[number]
        if node["left"] < 0:
            leaves.append(_leaf(node["value"] * factor, path))
            continue
        feature, cut = node["feature"], node["cut"]
        for child, left in ((node["left"], True), (node["right"], False)):
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            low, high = (low, min(high, cut)) if left else (max(low, cut), high)
            share = share * nodes[child]["cover"] / node["cover"]
            stack.append((child, {**path, feature: (low, high, share)}))
    return leaves


def _leaf(value: float, path: dict[int, tuple[float, float, float]]) -> Leaf:
    names = sorted(path)
    parts = np.array([path[f] for f in names], dtype=float).reshape(-1, 3)
    return Leaf(value, np.array(names, dtype=int), parts[:, 0], parts[:, 1], parts[:, 2])


def leaf_contributions(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Exact path-dependent Shapley values of a batch of rows.

    For one leaf the game is a product over its features: 1 or 0 by the row's value when
    the feature is known, the training share when it is not. Its Shapley value is the
    integral over t in [0, 1] of the product of t·known + (1-t)·share over the other
    features, times (known - share). That is a polynomial, so a Gauss rule with enough
    nodes integrates it exactly.
    """
    phi = np.zeros(x.shape)
    rules: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for value, features, low, high, share in leaves:
        depth = len(features)
        if not depth:
            continue
        if depth not in rules:
            nodes, weights = np.polynomial.legendre.leggauss(depth // 2 + 1)
            rules[depth] = ((nodes + 1) / 2, weights / 2)
        columns = x[:, features]
        known = ((columns > low) & (columns <= high)).astype(float)
        total = np.zeros(known.shape)
        for t, w in zip(*rules[depth]):
            mixed = known * t + share * (1 - t)
            total += w * mixed.prod(axis=1, keepdims=True) / mixed
        phi[:, features] += value * (known - share) * total
    return phi


def base_value(leaves: list[Leaf]) -> float:
    """The ensemble's output when no feature is known."""
    return float(sum(value * np.prod(share) for value, _, _, _, share in leaves))


def tree_groups(leaves: DataFrame, limit: int) -> list[list[int]]:
    """Trees in order, in groups of at most ``limit`` bytes (or one tree)."""
    size = sum((F.octet_length(c) for c in ("values", "sizes", "features", "bounds")), F.lit(0))
    groups, room = [], 0
    for row in leaves.select("tree", size.alias("size")).orderBy("tree").collect():
        if not groups or row["size"] > room:
            groups.append([])
            room = limit
        groups[-1].append(row["tree"])
        room -= row["size"]
    return groups


def tree_contributions(
    df: DataFrame, leaves: list[Leaf] | DataFrame, features: list[str], scale: str, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Add ``contributions, base, scale`` for a tree ensemble, or for leaves given by hand.

    Only the features cross to Python, in Arrow batches; all other columns stay in the
    JVM, and rows are never moved. Trees are shipped in broadcast variables of at most
    ``limit`` bytes. A larger model takes several, one after the other: the sums so far are
    stored with the rows before the next group of trees is loaded, so neither the driver
    nor a task holds more than one group.
    """
    spark = df.sparkSession
    if isinstance(leaves, list):
        groups, stored = [[pack(0, leaves)]], None
    else:
        groups, stored = tree_groups(leaves, limit), leaves
    own = [f for f in df.columns if f not in ("contributions", "base", "scale")]
    done, base = df.select(*[quoted(c) for c in own], F.lit(None).cast("array<double>").alias("_phi")), 0.0
    for number, group in enumerate(groups):
        if stored is not None:
            group = [row.asDict() for row in stored.filter(F.col("tree").isin(group)).collect()]
        base += sum(tree["base"] for tree in group)
        shared = spark.sparkContext.broadcast([(t["values"], t["sizes"], t["features"], t["bounds"]) for t in group])
        phi = _shapley(shared)(*[quoted(f).cast("double") for f in features])
        if number:
            done = done.withColumn("_new", phi).withColumn("_phi", F.zip_with("_phi", "_new", lambda a, b: a + b)).drop("_new")
        else:
            done = done.withColumn("_phi", phi)
        if number + 1 < len(groups):
            done = write_table(done, "contributions")
            shared.destroy()
    values = [F.get("_phi", F.lit(i)) for i in range(len(features))]
    if not groups:
        values = [F.lit(0.0)] * len(features)
    return with_contributions(done, features, values, F.lit(base), scale).drop("_phi")


def _shapley(shared):
    @F.pandas_udf("array<double>")
    def shapley(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        phi = np.zeros(x.shape)
        for tree in shared.value:
            phi += leaf_contributions(x, unpack(*tree))
        return pd.Series(list(phi))

    return shapley


def explain_model(df: DataFrame, fitted, features: list[str], background: DataFrame) -> DataFrame:
    """Contributions to the uncalibrated output of any fitted model."""
    model = fitted.model
    if hasattr(model, "coefficients"):
        weights = {f: float(w) for f, w in zip(features, model.coefficients.toArray())}
        return linear_contributions(df, Linear(weights, float(model.intercept)), background)
    scale = "log-odds" if isinstance(model, GBTClassificationModel) else "probability"
    return tree_contributions(df, ensemble_leaves(df.sparkSession, model), features, scale)


def top_array(limit: int = TOP_FEATURES) -> Column:
    """A row's contributions by falling size, ties by feature name, cut to the limit."""
    keyed = F.transform(
        "contributions",
        lambda c: F.struct(
            (-F.abs(c["contribution"])).alias("key"),
            c["feature"].alias("feature"),
            c["value"].alias("value"),
            c["contribution"].alias("contribution"),
        ),
    )
    return F.transform(
        F.slice(F.sort_array(keyed), 1, limit),
        lambda c: F.struct(
            c["feature"].alias("feature"),
            c["value"].alias("value"),
            c["contribution"].alias("contribution"),
        ),
    )


def top_contributions(explained: DataFrame, entity: str, limit: int = TOP_FEATURES) -> DataFrame:
    """``entity, rank, feature, value, contribution`` of the largest per row."""
    return explained.select(
        quoted(entity).alias("entity"), F.posexplode(top_array(limit))
    ).select("entity", (F.col("pos") + 1).alias("rank"), "col.*")


def long_contributions(explained: DataFrame, entity: str) -> DataFrame:
    """``entity, feature, value, contribution``, one row per feature."""
    return explained.select(quoted(entity).alias("entity"), F.inline("contributions"))


def with_drivers(explained: DataFrame) -> DataFrame:
    """Add ``risk_factors`` and ``retention_factors`` from the row's top features."""
    def names(test) -> Column:
        kept = F.filter("_top", lambda c: test(c["contribution"]))
        return F.slice(F.transform(kept, lambda c: c["feature"]), 1, DRIVERS)

    return (
        explained.withColumn("_top", top_array())
        .withColumn("risk_factors", names(lambda v: v > 0))
        .withColumn("retention_factors", names(lambda v: v < 0))
        .drop("_top")
    )


def explanation_text(prob: Column) -> Column:
    """Sentence from the risk level and the leading risk factors."""
    reasons = F.when(F.size("risk_factors") > 0, F.array_join("risk_factors", ", "))
    return F.concat(
        bands.explain_band(prob), F.lit(" risk because: "), reasons.otherwise("balanced factors")
    )


def explain_all(explained: DataFrame) -> DataFrame:
    """Add probability, level, drivers and explanation to rows with ``prob``."""
    prob = F.col("prob")
    return with_drivers(explained).withColumns(
        {
            "probability": half_even(prob, 4),
            "risk_level": bands.explain_band(prob),
            "explanation": explanation_text(prob),
        }
    )


def global_importance(explained: DataFrame, limit: int = TOP_FEATURES) -> DataFrame:
    """``rank, feature, importance``: mean absolute contribution, largest first."""
    means = (
        explained.select(F.inline("contributions"))
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
        .limit(limit)
    )
    # At most ``limit`` rows arrive here.
    ranked = means.agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("importance")).alias("key"), "feature", "importance"))
        ).alias("ranked")
    )
    return ranked.select(F.posexplode("ranked")).select(
        (F.col("pos") + 1).alias("rank"), F.col("col.feature"), F.col("col.importance")
    )
