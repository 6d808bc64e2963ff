"""Reading delimited and Parquet tables, writing CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.functions.values import nan_to_null, parsed_number
from outcome_risk.roles import quoted
from outcome_risk.sources.records import opens, read_spanning

# Texts read as null.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
FLOATING = ("double", "float")
FORMATS = {".csv": "csv", ".parquet": "parquet"}


def format_of(path: str) -> str:
    """Reader for a path by its lower-cased suffix."""
    lowered = path.lower().rstrip("/")
    for suffix, name in FORMATS.items():
        if lowered.endswith(suffix):
            return name
    raise ValueError(f"unsupported file format: {path}; use CSV or Parquet")


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    null_tokens: list[str] | None = None,
) -> DataFrame:
    """Read a table by suffix, or by ``fmt``.

    Delimited text has a header. Without a schema the types are found in one pass over
    the file. Files are read in splits, by many tasks, whether or not quoted fields hold line
    breaks: a scan for lines that leave a quote open tells.
    """
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError(f"unsupported file format: {fmt}; use CSV or Parquet")
    if spark.read.text(path).filter(opens(F.col("value"))).isEmpty():
        texts = spark.read.option("header", True).option("escape", '"').csv(path)
    else:
        texts = read_spanning(spark, path)
    tokens = NULL_TOKENS if null_tokens is None else null_tokens
    cleaned = texts.select(
        *[F.when(~quoted(c).isin(tokens), quoted(c)).alias(c) for c in texts.columns]
    )
    if schema is not None:
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        kinds = {f.name: f.dataType.simpleString() for f in wanted.fields}
    else:
        kinds = _kinds(cleaned)
    return cleaned.select(
        *[
            _typed(quoted(c), kinds[c]).alias(c)
            for c in cleaned.columns
        ]
    )


def _typed(text: Column, kind: str) -> Column:
    if kind == "string":
        return text
    trimmed = F.trim(text)
    return parsed_number(trimmed, kind) if kind in FLOATING else trimmed.try_cast(kind)


def _kinds(texts: DataFrame) -> dict[str, str]:
    """Narrowest type that every known value of a column has; one aggregate."""
    checks: list[Column] = []
    for i, c in enumerate(texts.columns):
        text = quoted(c)
        whole = text.rlike(WHOLE_NUMBER) & F.trim(text).try_cast("bigint").isNotNull()
        number = parsed_number(F.trim(text)).isNotNull()
        truth = F.lower(text).isin("true", "false")
        checks += [
            F.count(text).alias(f"known{i}"),
            F.count_if(whole).alias(f"bigint{i}"),
            F.count_if(number).alias(f"double{i}"),
            F.count_if(truth).alias(f"boolean{i}"),
        ]
    found = texts.agg(*checks).first()
    kinds = {}
    for i, c in enumerate(texts.columns):
        known = found[f"known{i}"]
        fitting = [k for k in ("bigint", "double", "boolean") if found[f"{k}{i}"] == known]
        # A column without any value is numeric, as in pandas.
        kinds[c] = "double" if not known else (fitting[0] if fitting else "string")
    return kinds


def export_csv(df: DataFrame, path: str) -> None:
    """Write as CSV with a header, one file per partition."""
    nan_to_null(df).write.option("header", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """Write as JSON lines; NaN becomes null and null fields stay visible."""
    nan_to_null(df).write.option("ignoreNullFields", False).json(path)
