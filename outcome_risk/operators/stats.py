"""Correlation, five-number summaries, heads per class, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcome_risk.functions.values import half_even, lenient_target, number
from outcome_risk.operators.gram import pair_moments
from outcome_risk.operators.ranking import order_statistics
from outcome_risk.roles import Roles, empty, quoted

# Columns of a chosen correlation matrix, rows shown per class.
MATRIX_COLUMNS = 20
HEAD_ROWS = 200


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; null when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """``row_name, col_name, corr`` of all pairs from one scan, whatever their number.

    Null where either is constant over the rows where both are known, NaN where these hold
    an infinity.
    """
    if not names:
        return empty(df, "row_name string, col_name string, corr double")
    pairs = pair_moments(df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(names)]))
    # the squares of the pair's other column stand in the mirrored cell
    mirrored = pairs.select(F.col("row").alias("col"), F.col("col").alias("row"), F.col("squares").alias("others"))
    size = F.sqrt(F.col("squares") * F.col("others"))
    corr = F.try_divide(F.col("products"), size)
    bounded = F.when(corr > 1.0, 1.0).when(corr < -1.0, -1.0).otherwise(corr)
    named = F.array(*[F.lit(c) for c in names])
    return pairs.join(mirrored, ["row", "col"]).select(
        F.get(named, F.col("row")).alias("row_name"),
        F.get(named, F.col("col")).alias("col_name"),
        F.when(F.col("broken") > 0, float("nan")).otherwise(half_even(bounded, 3)).alias("corr"),
    )


def top_corr_columns(
    df: DataFrame, names: list[str], target: str | None, limit: int = MATRIX_COLUMNS
) -> DataFrame:
    """Columns with the largest absolute correlation to the target, with their rank."""
    if not target or len(names) <= limit:
        kept = F.array(
            *[
                F.struct(F.lit(i + 1).alias("rank"), F.lit(c).alias("column"))
                for i, c in enumerate(names[:limit])
            ]
        )
        return df.sparkSession.range(1).select(F.inline(kept))
    outcome = lenient_target(df, target)
    values = df.select(*[number(df, c).alias(c) for c in names], outcome.alias("_outcome"))
    once = values.agg(
        *[pearson(quoted(c), F.col("_outcome")).alias(f"c{i}") for i, c in enumerate(names)]
    )
    # The whole ranking is one row of len(names) numbers.
    ranked = F.sort_array(
        F.filter(
            F.array(
                *[
                    F.struct((-F.abs(F.col(f"c{i}"))).alias("key"), F.lit(c).alias("column"))
                    for i, c in enumerate(names)
                ]
            ),
            lambda x: x["key"].isNotNull(),
        )
    )
    return once.select(F.posexplode(F.slice(ranked, 1, limit))).select(
        (F.col("pos") + 1).alias("rank"), F.col("col")["column"].alias("column")
    )


def matrix_columns(
    df: DataFrame, names: list[str], target: str | None, limit: int | None = None
) -> list[str]:
    """Column names for the matrix: all, or the ``limit`` best by ``top_corr_columns``."""
    if limit is None or len(names) <= limit:
        return names
    best = top_corr_columns(df, names, target, limit)
    return [r["column"] for r in best.orderBy("rank").collect()]


# Positions of the five numbers in the sorted values.
FIVE_NUMBERS = {
    "min": lambda n: F.lit(0),
    "q1": lambda n: F.floor(n / 4),
    "median": lambda n: F.floor(n / 2),
    "q3": lambda n: F.floor(n * 3 / 4),
    "max": lambda n: n - 1,
}
_FIVE_SCHEMA = "class string, n long, " + ", ".join(f"{k} double" for k in FIVE_NUMBERS)


def five_number_by_class(df: DataFrame, roles: Roles) -> DataFrame:
    """Minimum, quartiles, maximum and count of the amount per class, over all rows."""
    if not roles.target or not roles.amount:
        return empty(df, _FIVE_SCHEMA)
    slim = df.select(
        quoted(roles.target).cast("string").alias("class"),
        number(df, roles.amount).alias("amount"),
    )
    return order_statistics(slim, ["class"], "amount", FIVE_NUMBERS)


def head_per_class(df: DataFrame, roles: Roles, limit: int = HEAD_ROWS) -> DataFrame:
    """First known amounts per class in id order; the limit is applied before the shuffle."""
    if not roles.target or not roles.amount or not roles.id:
        return empty(df, "class string, position int, amount double")
    first = W.partitionBy("class").orderBy("id")
    return (
        df.select(
            quoted(roles.target).cast("string").alias("class"),
            quoted(roles.id).alias("id"),
            number(df, roles.amount).alias("amount"),
        )
        .dropna(subset=["class", "amount"])
        .withColumn("position", F.row_number().over(first))
        .filter(F.col("position") <= limit)
        .select("class", "position", "amount")
    )


def five_number_of_head(df: DataFrame, roles: Roles, limit: int = HEAD_ROWS) -> DataFrame:
    """The same summary over the first rows of each class, as the box chart shows it."""
    head = head_per_class(df, roles, limit)
    return order_statistics(head, ["class"], "amount", FIVE_NUMBERS)


def minmax_normalise(
    df: DataFrame,
    name: str,
    low: float | None = None,
    high: float | None = None,
    alias: str = "normalised",
) -> DataFrame:
    """Scale to 0..1 by the column's own bounds or by fixed ones; 0 when they coincide."""
    value = number(df, name)
    if low is None or high is None:
        bounds = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
        least = bounds["low"] if low is None else F.lit(float(low))
        most = bounds["high"] if high is None else F.lit(float(high))
    else:
        least, most = F.lit(float(low)), F.lit(float(high))
    scaled = F.when(most == least, 0.0).otherwise(F.try_divide(value - least, most - least))
    return df.withColumn(alias, scaled)
