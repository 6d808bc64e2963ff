"""Exact ranks, quantiles and running totals without a single-task sort.

Ranks are found by radix select. Numbers become whole numbers of 64 bits in the same order
(a double by its sign, exponent and fraction), and each pass looks at sixteen more bits: it
counts rows per cell, pre-aggregated on the map side, and keeps the cells that hold a wanted
rank. A cell of at most ``CELLS`` rows is finished by its distinct values. So no pass gives a
task more than ``CELLS`` cells of a group, four passes end every search whatever the
distribution, and two are enough unless very many rows agree in their first bits.

Running totals cut the distinct values into ranges of about equal numbers of rows, add up
each range, and look at one range at a time. Every step is a pure function of stored
data, so a lost executor changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.storage import write_table

DIGIT_BITS = 16
CELLS = 1 << DIGIT_BITS
# The parts of a double: bits of the fraction, offset of the exponent, largest exponent.
FRACTION, OFFSET, TOP_EXPONENT = 52, 1023, 1024
LEAST_NORMAL, LEAST_POSITIVE = 2.0**-1022, 2.0**-1074


def with_bits(df: DataFrame, value: str, bits: str) -> DataFrame:
    """Add a double as a whole number of the same order; equal doubles are equal, both zeros too.

    Step by step, as each step is used several times by the next one.
    """
    whole = float(1 << FRACTION)
    size, guess, part = F.col("_size"), F.col("_guess"), F.col("_part")
    # the logarithm may be off by one next to a power of two
    up, down = part >= 2.0, part < 1.0
    staged = (
        df.withColumn("_size", F.abs(value))
        .withColumn("_guess", F.least(F.floor(F.log2(size)), F.lit(TOP_EXPONENT - 1)))
        .withColumn("_part", size / F.pow(F.lit(2.0), guess))
        .withColumn("_up", F.when(up, 1).when(down, -1).otherwise(0))
        .withColumn("_part", F.when(up, part / 2.0).when(down, part * 2.0).otherwise(part))
    )
    normal = F.shiftleft(guess.cast("long") + F.col("_up") + OFFSET, FRACTION) + ((part - 1.0) * whole).cast("long")
    staged = staged.withColumn(
        "_bits",
        F.when(size == float("inf"), F.lit((TOP_EXPONENT + OFFSET) << FRACTION))
        .when(size < LEAST_NORMAL, (size / LEAST_POSITIVE).cast("long"))
        .otherwise(normal),
    )
    signed = F.when(F.col(value) < 0, -F.col("_bits")).otherwise(F.col("_bits"))
    return staged.withColumn(bits, signed).drop("_size", "_guess", "_part", "_up", "_bits")


def from_bits(bits: Column) -> Column:
    """The double of a whole number made by ``with_bits``."""
    size = F.abs(bits)
    exponent = F.shiftright(size, FRACTION).cast("int")
    fraction = size.bitwiseAND(F.lit((1 << FRACTION) - 1)).cast("double")
    normal = (fraction / float(1 << FRACTION) + 1.0) * F.pow(F.lit(2.0), exponent - OFFSET)
    value = (
        F.when(exponent == TOP_EXPONENT + OFFSET, F.lit(float("inf")))
        .when(exponent == 0, fraction * LEAST_POSITIVE)
        .otherwise(normal)
    )
    return F.when(bits < 0, -value).otherwise(value)


def _cell(shift: int) -> Column:
    return F.shiftright("bits", shift) if shift else F.col("bits")


def _holding(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of counted cells with the ranks wanted among them, those that hold one.

    ``want`` is an array of (stat, rank); ranks become relative to the cell that holds them.
    """
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("cell"))
    placed = cells.withColumn("before", upto - F.col("n"))
    held = F.filter(
        "want", lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n"))
    )
    moved = F.transform(
        held, lambda w: F.struct(w["stat"].alias("stat"), (w["rank"] - F.col("before")).alias("rank"))
    )
    return placed.withColumn("want", moved).filter(F.size("want") > 0).drop("before")


BASICS = {"mean": lambda c: F.sum(F.col(c).cast("double")), "min": F.min, "max": F.max}


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    stored: bool = False,
    basics: bool = False,
) -> DataFrame:
    """Exact values at given 0-based ranks, per group: ``keys, n, <one column per rank>``.

    ``ranks`` maps an output name to a function of the group size. Null values, NaN and
    rows with a null key are left out. The result has one row per group with a value.
    ``basics`` adds ``mean``, ``min`` and ``max``, which the first pass sees anyway. The keys
    and values are stored for the passes, unless ``df`` is ``stored`` already. What is known
    of the wanted ranks is stored after each pass, so its true size decides how it is joined.
    """
    group = keys or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    source = source.select(*group, F.col(value).alias("v"))
    for name in [*group, "v"]:
        source = source.filter(F.col(name).isNotNull())
    whole = isinstance(source.schema["v"].dataType, T.IntegralType)
    if not whole:
        source = source.withColumn("v", F.col("v").cast("double")).filter(~F.isnan("v"))
    source = source.withColumn("bits", F.col("v").cast("long")) if whole else with_bits(source, "v", "bits")
    if not stored:
        source = write_table(source, "ranked")
    known, largest = _stored_ranks(_first_pass(source, group, ranks, basics))

    shift, extra = 64 - DIGIT_BITS, ["size", *(BASICS if basics else [])]
    while True:
        last = shift == DIGIT_BITS or largest is None or largest <= CELLS
        below = 0 if last else shift - DIGIT_BITS
        wanted = known.withColumnRenamed("cell", "held").drop("n")
        cell = [*group, "held"]
        near = source.withColumn("held", _cell(shift)).join(wanted.select(*cell), cell)
        cells = near.groupBy(*cell, _cell(below).alias("cell")).agg(F.count("*").alias("n"))
        found = _holding(cells.join(wanted, cell), cell).drop("held")
        if last:
            break
        (known, largest), shift = _stored_ranks(found), below
    exact = F.col("cell") if whole else from_bits(F.col("cell"))
    each = found.select(*group, *extra, exact.alias("v"), F.explode("want.stat").alias("stat"))
    result = each.groupBy(*group).agg(
        F.max("size").alias("n"),
        *[F.max(F.when(F.col("stat") == name, F.col("v"))).alias(name) for name in ranks],
        *[F.first(c).alias(c) for c in extra[1:]],
    )
    return result if keys else result.drop("_all")


def _stored_ranks(known: DataFrame) -> tuple[DataFrame, int | None]:
    """The table, stored, and the rows of its largest cell."""
    stored = write_table(known, "ranks")
    return stored, stored.agg(F.max("n")).first()[0]


def _first_pass(source: DataFrame, group: list[str], ranks: dict, basics: bool) -> DataFrame:
    """Cells of the first digit that hold a wanted rank, with the size of their group."""
    figures = [kind("v").alias(name) for name, kind in BASICS.items()] if basics else []
    cells = source.groupBy(*group, _cell(64 - DIGIT_BITS).alias("cell")).agg(F.count("*").alias("n"), *figures)
    whole = W.partitionBy(*group)
    size = F.sum("n").over(whole)
    if basics:
        cells = cells.withColumns(
            {
                "mean": F.sum("mean").over(whole) / size,
                "min": F.min("min").over(whole),
                "max": F.max("max").over(whole),
            }
        )
    n = F.col("size")
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("stat"), F.least(rank(n).cast("long"), n - 1).alias("rank"))
            for name, rank in ranks.items()
        ]
    )
    return _holding(cells.withColumn("size", size).withColumn("want", wanted), group)


# The two middle ranks; their mean is the median.
MIDDLE = {
    "mid_low": lambda n: F.floor((n - 1) / 2),
    "mid_high": lambda n: F.floor(n / 2),
}


def medians(df: DataFrame, keys: list[str], value: str, stored: bool = False, basics: bool = False) -> DataFrame:
    """Exact median per group as ``keys, median``, with ``basics`` also ``mean, min, max``."""
    middle = order_statistics(df, keys, value, MIDDLE, stored, basics)
    median = (F.col("mid_low") + F.col("mid_high")) / 2.0
    return middle.select(*keys, median.alias("median"), *(BASICS if basics else []))


def by_ranges(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """Store ``df`` in ranges of (keys, value from the top), numbered by ``range``.

    ``df`` has one row per distinct (keys, value), so ranges of about as many rows exist
    for every distribution. Their number is that of the session's shuffle partitions.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(ranges, *keys, F.desc(value))
    return write_table(cut.withColumn("range", F.spark_partition_id()), label)


def running_totals(ranged: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Totals over all rows with a value at least as large, per group, as ``cum_<sum>``.

    ``ranged`` comes from ``by_ranges``. A window sees the rows of one range; what lies above
    comes from a table of one row per range and group.
    """
    above = ranged.groupBy(*keys, "range").agg(*[F.sum(s).alias(s) for s in sums])
    ranges_above = W.partitionBy(*keys).orderBy("range")
    above = above.select(
        *keys, "range", *[(F.sum(s).over(ranges_above) - F.col(s)).alias(f"above_{s}") for s in sums]
    )
    inside = W.partitionBy(*keys, "range").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.join(above, [*keys, "range"])
        .withColumns({f"cum_{s}": F.sum(s).over(inside) + F.col(f"above_{s}") for s in sums})
        .drop(*[f"above_{s}" for s in sums])
    )
