"""Scalar column expressions used by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.roles import quoted

# The two texts of a yes/no outcome.
POSITIVE_TEXT = "Yes"
NEGATIVE_TEXT = "No"
# Spellings that Java reads as a number and nobody else does: 5d, 2F, 0x1p3.
JAVA_ONLY = r"(?i)[0-9.][df]\s*$|0x"


def half_even(value: Column, digits: int) -> Column:
    """Round the way numpy does: scale, round to the even integer, scale back."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def strict_target(df: DataFrame, name: str) -> Column:
    """1 for a positive outcome, 0 for everything else, null included."""
    if isinstance(df.schema[name].dataType, T.StringType):
        positive = quoted(name) == POSITIVE_TEXT
    else:
        positive = quoted(name).cast("double") == 1.0
    return F.when(positive, 1).otherwise(0)


def lenient_target(df: DataFrame, name: str) -> Column:
    """1/0 for yes/no, other numbers kept, null left null."""
    value = quoted(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return (
            F.when(value == POSITIVE_TEXT, 1.0)
            .when(value == NEGATIVE_TEXT, 0.0)
            .otherwise(parsed_number(value))
        )
    return without_nan(value.cast("double"))


def without_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating column."""
    floating = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            without_nan(quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def number(df: DataFrame, name: str) -> Column:
    """A numeric or boolean column as a double without NaN."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.NumericType, T.BooleanType)):
        raise ValueError(f"column {name!r} of type {kind.simpleString()} is not numeric")
    return without_nan(quoted(name).cast("double"))


def parsed_number(value: Column, kind: str = "double") -> Column:
    """The number a text spells, null where it spells none; type suffixes are no part of one."""
    return F.when(~value.cast("string").rlike(JAVA_ONLY), value.try_cast(kind))


def cast_or_default(value: Column, default: float = 0.0) -> Column:
    """Parse a number, or the default where the text is none."""
    return F.coalesce(parsed_number(value), F.lit(default))


def drop_nulls(df: DataFrame, name: str) -> DataFrame:
    """Rows whose value is neither null nor NaN."""
    return df.dropna(subset=["`" + name.replace("`", "``") + "`"])


def listed(text: str | list[str]) -> list[str]:
    """Items of a comma-separated list, trimmed, empty ones dropped."""
    items = text.split(",") if isinstance(text, str) else text
    return [item.strip() for item in items if item.strip()]


def filter_in(df: DataFrame, name: str | None, values: str | list[str]) -> DataFrame:
    """Rows whose column is in the list; an empty list keeps all rows."""
    wanted = listed(values)
    return df.filter(quoted(name).isin(wanted)) if name and wanted else df


def filter_category(df: DataFrame, name: str, value: str = "All") -> DataFrame:
    """Rows of one category, or all of them."""
    return df if value == "All" else df.filter(quoted(name) == value)
