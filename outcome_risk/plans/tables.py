"""Entity tables derived from the given star schema and document tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcome_risk.operators.explain import Leaf
from outcome_risk.operators.score import Linear

HR_COLUMNS = {
    "id": "EmployeeNumber",
    "target": "Attrition",
    "grp": "Department",
    "role": "JobRole",
    "grade": "JobLevel",
    "flag": "OverTime",
    "amount": "MonthlyIncome",
    "tenure": "YearsAtCompany",
    "age": "Age",
    "job_satisfaction": "JobSatisfaction",
    "env_satisfaction": "EnvironmentSatisfaction",
}
# A fixed scorer, so that no fitted model stands between a query and its check.
FIXED = Linear(
    {"MonthlyIncome": 1.0 / 150000.0, "Age": 0.05}, -(250000.0 / 150000.0) - 2.1
)


# A fixed tree over (MonthlyIncome, Age): half of the rows earn at most 250000, two
# fifths of the others are at most 40 years old.
_INF = float("inf")
FIXED_TREE = [
    Leaf(0.1, np.array([0]), np.array([-_INF]), np.array([250000.0]), np.array([0.5])),
    Leaf(0.4, np.array([0, 1]), np.array([250000.0, -_INF]), np.array([_INF, 40.0]), np.array([0.5, 0.4])),
    Leaf(0.9, np.array([0, 1]), np.array([250000.0, 40.0]), np.array([_INF, _INF]), np.array([0.5, 0.6])),
]


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with injected nulls; the outcome is random."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.join(customer, cust == F.col("c_custkey")).select(
        key.alias("id"),
        F.when(key % 97 == 0, None)
        .when(F.col("o_orderstatus") == "F", "Yes")
        .otherwise("No")
        .alias("target"),
        F.when(key % 89 == 0, None).otherwise(F.col("c_mktsegment")).alias("grp"),
        F.col("o_orderpriority").alias("role"),
        (F.col("c_nationkey") % 5 + 1).alias("grade"),
        F.when(cust % 3 == 0, "Yes").otherwise("No").alias("flag"),
        F.col("o_totalprice").alias("amount"),
        F.floor(F.col("c_acctbal") / 450.0).cast("int").alias("tenure"),
        (18 + 2 * F.col("c_nationkey")).alias("age"),
        (1 + key % 4).cast("int").alias("job_satisfaction"),
        (1 + cust % 4).cast("int").alias("env_satisfaction"),
    )


def hr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under the column names a personnel table uses."""
    return subjects(spark, sf_dir).withColumnsRenamed(HR_COLUMNS)


def scored_models(spark: SparkSession, sf_dir: str, digits: int = 2) -> DataFrame:
    """``model, id, label, prob`` of three fixed formulas; rounding makes ties."""
    s = subjects(spark, sf_dir)

    def chance(margin):
        return F.round(1.0 / (1.0 + F.exp(-margin)), digits)

    a = (F.col("amount") - 250000.0) / 150000.0 + (F.col("age") - 42) / 20.0
    b = (F.col("tenure") - 9) / 6.0 - (F.col("grade") - 3) / 2.0
    c = (F.col("job_satisfaction") - 2.5) + (F.col("env_satisfaction") - 2.5) / 2.0
    models = [
        F.struct(F.lit(name).alias("model"), chance(margin).alias("prob"))
        for name, margin in (("A", a), ("B", b), ("C", c))
    ]
    label = F.when(F.col("target") == "Yes", 1).otherwise(0)
    rows = s.select("id", label.alias("label"), F.inline(F.array(*models)))
    return rows.select("model", "id", "label", "prob")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with simple text features; ``bad`` marks low quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    words = F.filter(F.split("text", r"[ \n]"), lambda w: w != "")
    n_words = F.greatest(F.size("_words"), F.lit(1))
    chars = F.greatest(F.length("text"), F.lit(1))
    # Counted before the join, so that no text is shuffled.
    counted = docs.withColumn("_words", words).select(
        "doc_id",
        F.length("text").cast("double").alias("n_chars"),
        F.size("_words").cast("double").alias("words"),
        (F.size(F.array_distinct("_words")) / n_words).alias("uniq"),
        (F.length(F.regexp_replace("text", "[^0-9]", "")) / chars).alias("digits"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
        (F.length("text") / n_words).alias("avgw"),
        "lang",
        "source",
    )
    return counted.join(labels, "doc_id").select(
        "doc_id",
        (1 - F.col("quality")).alias("bad"),
        "toxic",
        *TEXT_FEATURES,
        "lang",
        "source",
    )


TEXT_FEATURES = ["n_chars", "words", "uniq", "digits", "lines", "avgw"]


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partial what-if row per order, as text, with gaps, unknown and bad values."""
    key = F.col("id")
    return subjects(spark, sf_dir).select(
        key.alias("scenario"),
        F.when(key % 5 == 0, None)
        .when(key % 7 == 0, "unclear")
        .otherwise(F.col("amount").cast("string"))
        .alias("MonthlyIncome"),
        F.when(key % 3 == 0, None).otherwise(F.col("age").cast("string")).alias("Age"),
        F.when(key % 11 == 0, "ELSEWHERE")
        .when(key % 13 == 0, None)
        .otherwise(F.col("grp"))
        .alias("Department"),
        F.when(key % 4 == 0, None).otherwise(F.col("flag")).alias("OverTime"),
    )


SCENARIO_FEATURES = ["MonthlyIncome", "Age", "Department", "OverTime"]
SCENARIO_MODEL = Linear(
    {"MonthlyIncome": 1.0 / 150000.0, "Age": -0.03125, "Department": 0.25, "OverTime": 0.5}, -1.0
)
