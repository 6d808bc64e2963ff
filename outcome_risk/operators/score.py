"""Scoring whole tables, risk reports and what-if scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.functions import bands
from outcome_risk.functions.values import cast_or_default, half_even, nan_to_null
from outcome_risk.operators.encoding import class_text
from outcome_risk.roles import REPORT_EXTRAS, Roles, quoted

# Fixed value: rows of the highest-risk report.
REPORT_ROWS = 100


@dataclass(frozen=True)
class Linear:
    """A linear model with known weights."""

    weights: dict[str, float]
    intercept: float = 0.0

    @property
    def features(self) -> list[str]:
        return list(self.weights)

    def margin(self) -> Column:
        terms = [quoted(f).cast("double") * F.lit(float(w)) for f, w in self.weights.items()]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total + F.lit(float(self.intercept))

    def probability(self, df: DataFrame, features: list[str] | None = None) -> DataFrame:
        """Add ``prob``."""
        return df.withColumn("prob", 1.0 / (1.0 + F.exp(-self.margin())))


def score_population(df: DataFrame, model, features: list[str]) -> DataFrame:
    """Add ``prob, risk_score, risk_category`` to every row; no shuffle.

    ``model`` offers ``probability(df, features)``: a ``Linear`` or a fitted model.
    """
    scored = model.probability(df, features)
    scored = scored.withColumn("risk_score", half_even(F.col("prob") * 100.0, 1))
    return scored.withColumn("risk_category", bands.population_band(F.col("risk_score")))


def report_columns(df: DataFrame, roles: Roles) -> list[str]:
    """Ordered report columns without repeats: id, score, category, group, extras."""
    wanted = [roles.id, "risk_score", "risk_category", roles.group, *REPORT_EXTRAS]
    return [c for c in dict.fromkeys(wanted) if c and c in df.columns]


def top_risk(scored: DataFrame, roles: Roles, limit: int = REPORT_ROWS) -> DataFrame:
    """The highest scores with their report columns; ties go by id."""
    order = [F.desc("risk_score")] + ([quoted(roles.id)] if roles.id else [])
    best = scored.select(*[quoted(c) for c in report_columns(scored, roles)])
    return nan_to_null(best.orderBy(*order).limit(limit))


def sort_by(df: DataFrame, name: str, descending: bool = True) -> DataFrame:
    """Order by any column; a missing number counts as 0, a missing text comes last."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        key = F.coalesce(quoted(name), F.lit(0))
        return df.orderBy(key.desc() if descending else key.asc())
    key = quoted(name)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())


def fill_literals(fills: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Median and mode per feature as constants: one small row per feature."""
    return {
        r["feature"]: (F.lit(r["median"]).cast("double"), F.lit(r["mode"]).cast("double"))
        for r in fills.select("feature", "median", "mode").collect()
    }


def encode_scenarios(
    scenarios: DataFrame,
    features: list[str],
    categorical: list[str],
    encoder: DataFrame,
    fills: DataFrame,
) -> DataFrame:
    """Turn partial what-if rows into complete numeric features.

    A missing value becomes the median of the encoded column, an unseen category the
    mode, a text that is no number 0. Other columns pass through.
    """
    literals = fill_literals(fills)
    unknown = (F.lit(0.0), F.lit(0.0))
    df = scenarios
    for name in features:
        median, mode = literals.get(name, unknown)
        given = quoted(name) if name in scenarios.columns else F.lit(None).cast("string")
        if name in categorical:
            codes = encoder.filter(F.col("column") == name).select(
                F.col("value").alias("_class"), F.col("code").alias("_code")
            )
            df = df.withColumn("_given", given.cast("string"))
            df = df.join(codes, class_text(F.col("_given")) == F.col("_class"), "left")
            value = F.when(F.col("_given").isNull(), median).otherwise(
                F.coalesce(F.col("_code").cast("double"), mode, F.lit(0.0))
            )
            df = df.withColumn(name, value).drop("_given", "_class", "_code")
        else:
            df = df.withColumn(
                name, F.when(given.isNull(), median).otherwise(cast_or_default(given))
            )
    return df


def score_scenarios(encoded: DataFrame, model, features: list[str]) -> DataFrame:
    """Add ``prob, probability, risk_category`` to encoded scenarios."""
    scored = model.probability(encoded, features)
    return scored.withColumn("probability", half_even(F.col("prob"), 4)).withColumn(
        "risk_category", bands.scenario_band(F.col("prob"))
    )
