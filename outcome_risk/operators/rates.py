"""Outcome rates, counts, amounts, crosstabs and KPIs.

Every grouped result is one partially aggregated pass: a key that holds a third of
all rows costs no more than the others, since tasks send one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcome_risk.functions import bands
from outcome_risk.functions.values import (
    filter_in,
    half_even,
    lenient_target,
    number,
    without_nan,
)
from outcome_risk.operators.ranking import medians
from outcome_risk.roles import Roles, empty, quoted
from outcome_risk.storage import write_table

RISK_CATEGORIES = bands.POPULATION[1]


def _positives(df: DataFrame, target: str) -> Column:
    return F.coalesce(F.sum(lenient_target(df, target)), F.lit(0.0))


def _by(df: DataFrame, key: str, label: str):
    """Group by a column under its label, null keys left out."""
    return df.filter(quoted(key).isNotNull()).groupBy(quoted(key).alias(label))


def _rate_columns(df: DataFrame, target: str) -> list[Column]:
    rows, positives = F.count("*"), _positives(df, target)
    return [
        rows.alias("n"),
        positives.alias("positives"),
        half_even(positives / rows * 100.0, 2).alias("rate"),
    ]


def rate(df: DataFrame, key: str | None, target: str | None, label: str) -> DataFrame:
    """Percentage of positive outcomes per key, all rows in the denominator."""
    if not key or not target:
        return empty(df, f"{label} string, n long, positives double, rate double")
    rated = _by(df, key, label).agg(*_rate_columns(df, target))
    return rated.withColumn(label, F.col(label).cast("string")).orderBy(label)


def rate_by_group(df: DataFrame, roles: Roles) -> DataFrame:
    return rate(df, roles.group, roles.target, "grp")


def rate_by_grade(df: DataFrame, roles: Roles) -> DataFrame:
    return rate(df, roles.grade, roles.target, "grade")


def rate_by_flag(df: DataFrame, roles: Roles) -> DataFrame:
    return rate(df, roles.flag, roles.target, "flag")


def counts(df: DataFrame, key: str | None, target: str | None, label: str) -> DataFrame:
    """Known outcomes and positive outcomes per key."""
    if not key or not target:
        return empty(df, f"{label} string, total long, attrited double")
    known = F.count(quoted(target)).alias("total")
    return (
        _by(df, key, label)
        .agg(known, _positives(df, target).alias("attrited"))
        .orderBy(label)
    )


def counts_by_group(df: DataFrame, roles: Roles) -> DataFrame:
    return counts(df, roles.group, roles.target, "grp")


def counts_by_role(df: DataFrame, roles: Roles) -> DataFrame:
    return counts(df, roles.role, roles.target, "role")


def amount_by_group(df: DataFrame, roles: Roles) -> DataFrame:
    """Mean, exact median, minimum and maximum amount per group."""
    if not roles.amount or not roles.group:
        return empty(df, "grp string, mean double, median double, min double, max double")
    slim = df.filter(quoted(roles.group).isNotNull()).select(
        quoted(roles.group).alias("grp"), number(df, roles.amount).alias("amount")
    )
    slim = write_table(slim, "amounts")
    groups = slim.groupBy("grp").agg(F.count("amount").alias("n"))
    found = medians(slim, ["grp"], "amount", stored=True, basics=True)
    # a group without any amount has a row too
    return groups.join(found, "grp", "left").select("grp", "mean", "median", "min", "max").orderBy("grp")


def score_means_by_group(df: DataFrame, roles: Roles) -> DataFrame:
    """Mean of every score column per group, one column per score."""
    if not roles.scores or not roles.group:
        return empty(df, "grp string")
    means = [half_even(F.avg(number(df, s)), 2).alias(s) for s in roles.scores]
    return _by(df, roles.group, "grp").agg(*means).orderBy("grp")


def score_means_long(df: DataFrame, roles: Roles) -> DataFrame:
    """Mean scores as ``grp, feature, mean, band``, one row per heat-map cell."""
    if not roles.scores or not roles.group:
        return empty(df, "grp string, feature string, mean double, band string")
    wide = score_means_by_group(df, roles)
    cells = wide.unpivot("grp", [quoted(s) for s in roles.scores], "feature", "mean")
    return cells.withColumn("band", bands.score_mean_band(F.col("mean")))


def crosstab_group_flag(
    df: DataFrame, roles: Roles, flags: list[str] | None = None
) -> DataFrame:
    """Rows per group and flag, absent cells 0.

    With ``flags`` given the columns are known and no extra job looks for them.
    """
    if not roles.group or not roles.flag:
        return empty(df, "grp string")
    known = df.withColumn("_flag", quoted(roles.flag)).filter(F.col("_flag").isNotNull())
    table = _by(known, roles.group, "grp").pivot("_flag", flags).count()
    return table.na.fill(0).orderBy("grp")


def crosstab_group_risk(scored: DataFrame, roles: Roles) -> DataFrame:
    """Rows per group and risk category, absent cells 0."""
    if not roles.group:
        return empty(scored, "grp string, " + ", ".join(f"{c} long" for c in RISK_CATEGORIES))
    table = _by(scored, roles.group, "grp").pivot("risk_category", RISK_CATEGORIES).count()
    return table.na.fill(0).orderBy("grp")


def _banded(df: DataFrame, tenure: str):
    order = bands.tenure_order(number(df, tenure))
    return df.withColumn("band_order", order).groupBy("band_order")


def rate_by_tenure_band(df: DataFrame, roles: Roles) -> DataFrame:
    """Outcome rate per tenure band; without a target, see ``count_by_tenure_band``."""
    if not roles.tenure or not roles.target:
        return empty(df, "band_order int, tenure_group string, n long, positives double, rate double")
    rated = _banded(df, roles.tenure).agg(*_rate_columns(df, roles.target))
    label = bands.tenure_label(F.col("band_order")).alias("tenure_group")
    return rated.select("band_order", label, "n", "positives", "rate").orderBy("tenure_group")


def count_by_tenure_band(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows per tenure band, most frequent first."""
    if not roles.tenure:
        return empty(df, "band_order int, tenure_group string, count long")
    label = bands.tenure_label(F.col("band_order")).alias("tenure_group")
    counted = _banded(df, roles.tenure).count().select("band_order", label, "count")
    return counted.orderBy(F.desc("count"), "band_order")


def tenure_chart(df: DataFrame, roles: Roles) -> DataFrame:
    return rate_by_tenure_band(df, roles) if roles.target else count_by_tenure_band(df, roles)


def age_histogram(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows per age bin, empty bins kept. One aggregate of nine conditional counts."""
    if not roles.age:
        return empty(df, "bin int, age_range string, count long")
    bins = bands.age_bins()
    aged = df.select(bands.age_bin(number(df, roles.age)).alias("bin"))
    counted = aged.agg(*[F.count_if(F.col("bin") == i).alias(str(i)) for i, _ in bins])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("bin"), F.lit(text).alias("age_range"), quoted(str(i)).alias("count"))
            for i, text in bins
        ]
    )
    return counted.select(F.inline(rows))


def kpi_summary(df: DataFrame, roles: Roles) -> DataFrame:
    """One row of headline figures; a figure whose role is absent is null."""
    missing = F.lit(None).cast("double")
    figures = [F.count("*").alias("total_employees")]
    slim = df.select(
        (lenient_target(df, roles.target) if roles.target else missing).alias("outcome"),
        (number(df, roles.amount) if roles.amount else missing).alias("amount"),
        (number(df, roles.age) if roles.age else missing).alias("age"),
    )
    if roles.amount:
        slim = write_table(slim, "figures")  # read again for the median
    if roles.target:
        outcome = F.col("outcome")
        left = F.coalesce(F.sum(outcome), F.lit(0.0)).cast("long")
        figures += [
            half_even(F.avg(outcome) * 100.0, 2).alias("attrition_rate"),
            left.alias("attritioned"),
            (F.count("*") - left).alias("retained"),
        ]
    else:
        figures += [
            missing.alias("attrition_rate"),
            missing.cast("long").alias("attritioned"),
            missing.cast("long").alias("retained"),
        ]
    figures += [half_even(F.avg("amount"), 2).alias("avg_income"), half_even(F.avg("age"), 2).alias("avg_age")]
    summary = slim.agg(*figures)
    if not roles.amount:
        return summary.withColumn("median_income", missing)
    middle = medians(slim.select("amount"), [], "amount", stored=True)
    return summary.withColumn("median_income", half_even(middle.select("median").scalar(), 2))


def kpi_filtered(df: DataFrame, roles: Roles, groups: str | list[str]) -> DataFrame:
    return kpi_summary(filter_in(df, roles.group, groups), roles)


def overview_rates(df: DataFrame, roles: Roles) -> DataFrame:
    """Positive and negative shares of all rows, one decimal."""
    if not roles.target:
        return empty(
            df,
            "total long, attrited long, retained long, attrition_pct double, retention_pct double",
        )
    outcome = lenient_target(df, roles.target)
    left, stayed, rows = F.count_if(outcome == 1.0), F.count_if(outcome == 0.0), F.count("*")
    return df.agg(
        rows.alias("total"),
        left.alias("attrited"),
        stayed.alias("retained"),
        F.round(F.try_divide(left * 100.0, rows), 1).alias("attrition_pct"),
        F.round(F.try_divide(stayed * 100.0, rows), 1).alias("retention_pct"),
    )


def risk_category_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_category").count().orderBy(F.desc("count"), "risk_category")


def risk_summary(scored: DataFrame) -> DataFrame:
    """Rows, mean score, rows scored 50 or more and their share."""
    rows, high = F.count("*"), F.count_if(F.col("risk_score") >= 50.0)
    return scored.agg(
        rows.alias("total"),
        half_even(F.avg(without_nan(F.col("risk_score"))), 2).alias("avg_risk"),
        high.alias("high_risk_count"),
        F.round(F.try_divide(high * 100.0, rows), 1).alias("high_risk_pct"),
    )


def share_of_total(counted: DataFrame, count: str = "count") -> DataFrame:
    """Each count as an integer percentage of their sum."""
    total = counted.agg(F.sum(count).alias("total")).scalar()
    return counted.withColumn("pct", F.round(F.col(count) * 100.0 / total, 0).cast("int"))
