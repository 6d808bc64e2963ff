import math

import pytest
from pyspark.sql import functions as F

from outcome_risk.functions import bands, values
from outcome_risk.roles import Roles, column_families, match_columns, resolve_roles
from outcome_risk.operators import rates


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_targets_by_type(spark):
    text = spark.createDataFrame([("Yes",), ("No",), ("1",), ("maybe",), (None,)], "t string")
    assert column(text, values.strict_target(text, "t")) == [1, 0, 0, 0, 0]
    assert column(text, values.lenient_target(text, "t")) == [1.0, 0.0, 1.0, None, None]
    number = spark.createDataFrame([(1.0,), (0.0,), (2.0,), (float("nan"),), (None,)], "t double")
    assert column(number, values.strict_target(number, "t")) == [1, 0, 0, 0, 0]
    assert column(number, values.lenient_target(number, "t")) == [1.0, 0.0, 2.0, None, None]
    truth = spark.createDataFrame([(True,), (False,), (None,)], "t boolean")
    assert column(truth, values.strict_target(truth, "t")) == [1, 0, 0]
    assert column(truth, values.lenient_target(truth, "t")) == [1.0, 0.0, None]


def test_tenure_bands(spark):
    years = [-1.0, 0.0, 1.9, 2.0, 5.0, 19.0, 20.0, 99.0, 100.0, None]
    df = spark.createDataFrame([(y,) for y in years], "y double")
    labels = column(df, bands.tenure_label(bands.tenure_order(F.col("y"))))
    assert labels == ["nan", "0-2", "0-2", "2-5", "5-10", "15-20", "20+", "20+", "nan", "nan"]


def test_age_histogram_keeps_empty_bins(spark):
    ages = [18, 19, 23, 24, 63, 64, None]
    df = spark.createDataFrame([(a,) for a in ages], "Age int")
    rows = rates.age_histogram(df, resolve_roles(df.columns)).collect()
    assert [r["count"] for r in rows] == [2, 1, 0, 0, 0, 0, 0, 0, 1]
    assert rows[0]["age_range"] == "(18, 23]" and rows[-1]["age_range"] == "(58, 63]"


def test_ladders_at_their_edges(spark):
    p = spark.createDataFrame([(x,) for x in (0.25, 0.3, 0.5, 0.6, 0.75)], "p double")
    assert column(p, bands.scenario_band(F.col("p"))) == ["Medium", "Medium", "High", "High", "Critical"]
    assert column(p, bands.explain_band(F.col("p"))) == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
    s = spark.createDataFrame([(x,) for x in (25.0, 25.1, 50.0, 75.0, 75.1, None)], "s double")
    expected = ["Low", "Medium", "Medium", "High", "Critical", "Critical"]
    assert column(s, bands.population_band(F.col("s"))) == expected
    m = spark.createDataFrame([(x,) for x in (2.49, 2.5, 3.5, None)], "m double")
    assert column(m, bands.score_mean_band(F.col("m"))) == ["poor", "fair", "good", "poor"]


def test_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "v double")
    assert column(df, values.half_even(F.col("v"), 2)) == [0.12, 0.38, 2.5]


def test_cleaning(spark):
    texts = ["12", " 7.5 ", "ab", None, "5d", "2F", "1.D", "0x1p3", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert column(df, values.cast_or_default(F.col("t"))) == [12.0, 7.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0]
    truth = spark.createDataFrame([(True,), (False,)], "t boolean")
    assert column(truth, values.cast_or_default(F.col("t"))) == [1.0, 0.0]
    gaps = spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "v double, t string")
    assert [r["v"] for r in values.nan_to_null(gaps).collect()] == [1.0, None]
    assert values.drop_nulls(gaps, "v").count() == 1


def test_filters(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "g string")
    assert values.filter_in(df, "g", " A ,, ").count() == 1
    assert values.filter_in(df, "g", " , ").count() == 3
    assert values.filter_in(df, None, "A").count() == 3
    assert values.filter_category(df, "g").count() == 3


def test_roles():
    roles = resolve_roles(["Dept", "SubDepartment", "Monthly Income", "age", "JobSatisfaction"])
    assert roles.group == "SubDepartment" and roles.amount == "Monthly Income"
    assert roles.age == "age" and roles.target is None and roles.scores == ("JobSatisfaction",)
    assert resolve_roles(["x"], {"group": "x"}).group == "x"
    assert match_columns(["SATISFACTIONx", "other"]) == ["SATISFACTIONx"]


def test_families(spark):
    df = spark.createDataFrame([], "a string, b int, c double, d boolean, e date, Attrition string")
    families = column_families(df, "Attrition")
    assert families == {"a": "categorical", "b": "numeric", "c": "numeric"}
    with pytest.raises(ValueError):
        values.number(df, "e")


def test_null_rules(spark):
    rows = [("A", "Yes"), ("A", None), ("B", None), (None, "Yes")]
    df = spark.createDataFrame(rows, "Department string, Attrition string")
    roles = resolve_roles(df.columns)
    rate = {r["grp"]: r["rate"] for r in rates.rate_by_group(df, roles).collect()}
    assert rate == {"A": 50.0, "B": 0.0}
    counts = {r["grp"]: (r["total"], r["attrited"]) for r in rates.counts_by_group(df, roles).collect()}
    assert counts == {"A": (1, 1.0), "B": (0, 0.0)}
    kpi = rates.kpi_summary(df, roles).first()
    assert (kpi["total_employees"], kpi["attrition_rate"], kpi["retained"]) == (4, 100.0, 2)
    assert kpi["avg_income"] is None and kpi["median_income"] is None


def test_missing_roles_give_empty_results(spark):
    df = spark.createDataFrame([(1, 2.0)], "EmpID int, Salary double")
    roles = resolve_roles(df.columns)
    for operator in (
        rates.rate_by_group,
        rates.rate_by_grade,
        rates.rate_by_flag,
        rates.counts_by_group,
        rates.counts_by_role,
        rates.amount_by_group,
        rates.score_means_by_group,
        rates.score_means_long,
        rates.crosstab_group_flag,
        rates.rate_by_tenure_band,
        rates.count_by_tenure_band,
        rates.age_histogram,
        rates.overview_rates,
    ):
        result = operator(df, roles)
        assert result.columns and result.count() == 0, operator.__name__
    kpi = rates.kpi_summary(df, roles).first()
    assert kpi["median_income"] == 2.0 and kpi["attrition_rate"] is None
    assert isinstance(Roles(), Roles) and math.isfinite(kpi["avg_income"])
