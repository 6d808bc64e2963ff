"""Table shape, value counts, feature profiles and fill values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.functions.values import half_even, number
from outcome_risk.operators.ranking import medians
from outcome_risk.roles import Roles, empty, quoted
from outcome_risk.storage import write_table


def table_shape(df: DataFrame) -> DataFrame:
    """Row count, column count and the column names in order."""
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("cols"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def value_counts(df: DataFrame, name: str | None) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    if not name:
        return empty(df, "value string, count long")
    known = df.filter(quoted(name).isNotNull())
    counted = known.groupBy(quoted(name).cast("string").alias("value")).count()
    return counted.orderBy(F.desc("count"), "value")


def target_split(df: DataFrame, roles: Roles) -> DataFrame:
    return value_counts(df, roles.target)


def group_counts(df: DataFrame, roles: Roles) -> DataFrame:
    return value_counts(df, roles.group)


def distinct_groups(df: DataFrame, roles: Roles) -> DataFrame:
    """Sorted distinct groups, null left out."""
    if not roles.group:
        return empty(df, "grp string")
    groups = df.select(quoted(roles.group).alias("grp")).dropna().distinct()
    return groups.orderBy("grp")


def family_profile(df: DataFrame, families: dict[str, str]) -> DataFrame:
    """Each column with its family and the number of values left after null removal."""
    numeric = [c for c, family in families.items() if family == "numeric"]
    counted = df.agg(
        *[
            F.count(number(df, c) if c in numeric else quoted(c)).alias(c)
            for c in families
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(family).alias("family"), quoted(c).alias("non_null"))
            for c, family in families.items()
        ]
    )
    return counted.select(F.inline(rows))


def long_values(df: DataFrame, names: list[str]) -> DataFrame:
    """``feature, value`` for every non-null number of the named columns."""
    numbers = df.select(*[number(df, c).alias(c) for c in names])
    return numbers.unpivot([], [quoted(c) for c in names], "feature", "value").dropna()


def field_profile_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Minimum, maximum, median, mean and slider step of every numeric feature.

    The step is 1 for whole-number columns without nulls, else 0.1. A Boolean counts as 0 or 1.
    """
    if not names:
        return empty(df, "feature string, min double, max double, mean double, median double, step double")
    whole = [c for c in names if isinstance(df.schema[c].dataType, T.IntegralType)]
    # Stored, as the passes of the search and the count of gaps all read it.
    slim = write_table(df.select(*[number(df, c).alias(c) for c in names]), "features")
    figures = medians(long_values(slim, names), ["feature"], "value", stored=True, basics=True)
    complete = slim.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in whole] or [F.lit(0)])
    gaps = complete.select(
        F.create_map(*[x for c in whole for x in (F.lit(c), quoted(c))])
        if whole
        else F.create_map(F.lit(""), F.lit(0))
    ).scalar()
    step = F.when(F.coalesce(gaps[F.col("feature")], F.lit(1)) == 0, 1.0).otherwise(0.1)
    return figures.select("feature", "min", "max", half_even(F.col("mean"), 2).alias("mean"), "median", step.alias("step"))


def field_profile_categorical(encoder: DataFrame) -> DataFrame:
    """Options of every categorical feature in order; the first is the default."""
    return encoder.select(
        F.col("column").alias("feature"),
        F.col("code").alias("position"),
        F.col("value").alias("option"),
        (F.col("code") == 0).alias("is_default"),
    )


FIELD_SCHEMA = (
    "position int, name string, type string, option_position long, option string, is_default boolean, "
    "min double, max double, median double, mean double, step double"
)


def field_types(df: DataFrame, features: list[str]) -> dict[str, str]:
    """Text is categorical; numbers and Booleans are numeric; nothing else can be a field."""
    types = {}
    for name in features:
        kind = df.schema[name].dataType
        if not isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
            raise ValueError(f"column {name!r} of type {kind.simpleString()} cannot be a form field")
        types[name] = "categorical" if isinstance(kind, T.StringType) else "numeric"
    return types


def field_table(df: DataFrame, features: list[str], encoder: DataFrame) -> DataFrame:
    """All form fields in order: a numeric one's range, mean, median (its default) and step, a
    categorical one's options, a row each, the first of which is the default.

    A numeric field without any value has a row without figures.
    """
    types = field_types(df, features)
    if not types:
        return empty(df, FIELD_SCHEMA)
    spark = df.sparkSession
    names = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(types.items())], "position int, name string, type string")
    figures = field_profile_numeric(df, [f for f, t in types.items() if t == "numeric"])
    options = field_profile_categorical(encoder)
    return (
        names.join(figures.withColumnRenamed("feature", "name"), "name", "left")
        .join(
            options.select(
                F.col("feature").alias("name"), F.col("position").alias("option_position"), "option", "is_default"
            ),
            "name",
            "left",
        )
        .select(*T._parse_datatype_string(FIELD_SCHEMA).names)
        .orderBy("position", "option_position")
    )


def default_scenario(fields: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row with the default of every field: the median, or the first option."""
    values = {"numeric": F.col("median"), "categorical": F.when(F.col("is_default"), F.col("option"))}
    return fields.agg(
        *[F.max(F.when(F.col("name") == f, values[kind])).alias(f) for f, kind in types.items()]
    )


def fill_values(
    encoded: DataFrame, features: list[str], categorical: list[str], stored: bool = False
) -> DataFrame:
    """Median of every encoded feature, and the mode of the categorical ones.

    The mode (smallest code on ties) replaces an unseen category, so numeric
    features have none.
    """
    # Stored, as the median search passes several times over what may be a join.
    encoded = encoded.select(*[number(encoded, f).alias(f) for f in features])
    if not stored:
        encoded = write_table(encoded, "features")
    values = long_values(encoded, features)
    middles = medians(values, ["feature"], "value", stored=True)
    if not categorical:
        return middles.withColumn("mode", F.lit(None).cast("double"))
    frequency = (
        long_values(encoded, categorical)
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("feature")
        .agg((-F.max(F.struct("n", (-F.col("value")).alias("value")))["value"]).alias("mode"))
    )
    return middles.join(F.broadcast(frequency), "feature", "left")
