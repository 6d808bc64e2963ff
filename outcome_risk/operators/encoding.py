"""Label encoding: every distinct text becomes its position in sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcome_risk.functions.values import strict_target
from outcome_risk.roles import CANDIDATES, Roles, column_families, drop_columns, quoted
from outcome_risk.storage import new_path, write_table

# Fixed value: the class that stands for a missing text.
MISSING_CLASS = "nan"
CLASSES_PER_RANGE = 50_000


def class_text(column):
    """The text whose position is the code; null is a class of its own."""
    return F.coalesce(column.cast("string"), F.lit(MISSING_CLASS))


def fit_encoder(df: DataFrame, names: list[str]) -> DataFrame:
    """Encoder table ``column, value, code`` over the named columns.

    Distinct values are numbered by a sample sort: they are cut into ranges of column and
    value, as many as ``CLASSES_PER_RANGE`` asks for, each range is numbered on its own and
    shifted by the ranges of its column below. A column of many classes takes many ranges.
    """
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "column string, value string, code long")
    texts = df.select(*[class_text(quoted(c)).alias(c) for c in names])
    distinct = write_table(
        texts.unpivot([], [quoted(c) for c in names], "column", "value").distinct(), "classes"
    )
    ranged = class_ranges(distinct)
    sizes = ranged.groupBy("column", "range").agg(F.count("*").alias("n"))
    lower = W.partitionBy("column").orderBy("range")
    starts = sizes.select("column", "range", (F.sum("n").over(lower) - F.col("n")).alias("start"))
    inside = W.partitionBy("column", "range").orderBy("value")
    numbered = ranged.withColumn("code", F.row_number().over(inside))
    return numbered.join(starts, ["column", "range"]).select(
        "column", "value", (F.col("code") + F.col("start") - 1).cast("long").alias("code")
    )


def class_ranges(distinct: DataFrame) -> DataFrame:
    """Stored ``column, value`` with the number of their ``range`` in sorted order."""
    ranges = -(-distinct.count() // CLASSES_PER_RANGE)
    if ranges <= 1:
        return distinct.withColumn("range", F.lit(0))
    cut = distinct.repartitionByRange(ranges, "column", "value")
    return write_table(cut.withColumn("range", F.spark_partition_id()), "class-ranges")


def apply_encoder(
    df: DataFrame, encoder: DataFrame, names: list[str], keep: dict[str, str] | None = None
) -> DataFrame:
    """Replace each named column by its code, or add the code under ``keep[name]``.

    A stored encoder is read from one folder per column, so Catalyst broadcasts a column's
    codes when their measured size allows and otherwise joins by shuffle, where adaptive
    execution splits the partition of a hot value. An unseen text gets a null code.
    """
    keep = keep or {}
    for name in names:
        codes = encoder.filter(F.col("column") == name).select(
            F.col("value").alias("_class"), F.col("code").alias("_code")
        )
        df = df.withColumn("_text", class_text(quoted(name)))
        df = df.join(codes, F.col("_text") == F.col("_class"), "left")
        df = df.withColumn(keep.get(name, name), F.col("_code")).drop("_text", "_class", "_code")
    return df


def row_names(roles: Roles, key: str | None = None) -> list[str]:
    """An id or key of the user's own choice: it names rows and is no feature."""
    return [c for c in dict.fromkeys([roles.id, key]) if c and c not in CANDIDATES["id"]]


def categorical_features(
    df: DataFrame, target: str | None, names: list[str] | None = None
) -> list[str]:
    """Text columns left after dropping the fixed ones and ``names``."""
    families = column_families(drop_columns(df).drop(*[quoted(c) for c in names or []]), target)
    return [c for c, family in families.items() if family == "categorical"]


def feature_columns(df: DataFrame, roles: Roles, key: str | None = None) -> list[str]:
    """Every column left after dropping, target and row names excluded, in table order."""
    others = [roles.target, *row_names(roles, key)]
    return [c for c in drop_columns(df).columns if c not in others]


def stored_encoder(df: DataFrame, names: list[str]) -> DataFrame:
    """The encoder, written once with a folder for each column.

    A filter on ``column`` leaves the read of one folder, so the join planner knows the
    size of that column's codes, however many classes another column has.
    """
    spark = df.sparkSession
    encoder = fit_encoder(df, names)
    number = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column"))
    numbered = encoder.withColumn("number", number) if names else encoder.withColumn("number", F.lit(0))
    path = new_path(spark, "encoder")
    numbered.drop("column").write.partitionBy("number").parquet(path)
    written = spark.read.schema("value string, code long, number long").parquet(path)
    # a column without rows has no folder
    found = sorted(r["number"] for r in written.select("number").distinct().collect())
    stored = spark.createDataFrame([], encoder.schema)
    for i, n in enumerate(found):
        part = spark.read.schema("value string, code long").parquet(f"{path}/number={n}")
        part = part.select(F.lit(names[n - 1]).alias("column"), "value", "code")
        stored = stored.union(part) if i else part
    return stored


def prepare(
    df: DataFrame, roles: Roles, encoder: DataFrame, key: str | None = None
) -> DataFrame:
    """Numeric copy: strict target, label codes, dropped columns gone.

    The row as it was stays in the struct column ``raw`` and its key (the id unless
    another column is named) in ``entity``, so that reports need no join to get back to
    it; unused, both are pruned.
    """
    names = row_names(roles, key)
    kept = df.withColumn("raw", F.struct(*[quoted(c) for c in df.columns]))
    if key or roles.id:
        kept = kept.withColumn("entity", quoted(key or roles.id))
    kept = drop_columns(kept).drop(*[quoted(c) for c in names if c != "entity"])
    coded = apply_encoder(kept, encoder, categorical_features(df, roles.target, names))
    if roles.target:
        coded = coded.withColumn(roles.target, strict_target(coded, roles.target))
    return coded
