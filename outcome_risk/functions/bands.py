"""Threshold ladders and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut points and labels of the ladders.
SCENARIO = ([0.25, 0.50, 0.75], ["Low", "Medium", "High", "Critical"])
POPULATION = ([25.0, 50.0, 75.0], ["Low", "Medium", "High", "Critical"])
EXPLAIN = ([0.3, 0.6], ["LOW", "MEDIUM", "HIGH"])
SCORE_MEAN = ([2.5, 3.5], ["poor", "fair", "good"])
TENURE_EDGES = [0, 2, 5, 10, 15, 20, 100]
TENURE_LABELS = ["0-2", "2-5", "5-10", "10-15", "15-20", "20+"]
AGE_FIRST, AGE_LAST, AGE_WIDTH = 18, 63, 5
OUTSIDE = "nan"


def band(value: Column, cuts: list[float], labels: list[str], closed: str = "left") -> Column:
    """Label by ordered cut points.

    ``closed="left"`` puts a value equal to a cut into the upper band,
    ``closed="right"`` into the lower one. Null falls through to the last label,
    as a comparison with a missing value is never true.
    """
    ladder = None
    for cut, label in zip(cuts, labels):
        below = value < cut if closed == "left" else value <= cut
        ladder = F.when(below, label) if ladder is None else ladder.when(below, label)
    return ladder.otherwise(labels[-1])


def scenario_band(probability: Column) -> Column:
    return band(probability, *SCENARIO)


def population_band(score: Column) -> Column:
    return band(score, *POPULATION, closed="right")


def explain_band(probability: Column) -> Column:
    return band(probability, *EXPLAIN)


def score_mean_band(mean: Column) -> Column:
    """Bands a mean satisfaction score; a missing mean counts as poor."""
    cuts, labels = SCORE_MEAN
    return F.when(mean.isNull(), labels[0]).otherwise(band(mean, cuts, labels))


def tenure_order(years: Column) -> Column:
    """Position of the left-closed tenure band, null outside all of them."""
    order = None
    for i, (low, high) in enumerate(zip(TENURE_EDGES, TENURE_EDGES[1:])):
        inside = (years >= low) & (years < high)
        order = F.when(inside, i) if order is None else order.when(inside, i)
    return order


def tenure_label(order: Column) -> Column:
    labels = F.array(*[F.lit(label) for label in TENURE_LABELS])
    return F.coalesce(F.get(labels, order), F.lit(OUTSIDE))


def age_bins() -> list[tuple[int, str]]:
    """Index and text of every right-closed age bin."""
    lows = range(AGE_FIRST, AGE_LAST, AGE_WIDTH)
    return [(i, f"({low}, {low + AGE_WIDTH}]") for i, low in enumerate(lows)]


def age_bin(age: Column) -> Column:
    """Index of the right-closed bin holding the age, null outside all of them."""
    inside = (age > AGE_FIRST) & (age <= AGE_LAST)
    return F.when(inside, (F.ceil((age - AGE_FIRST) / AGE_WIDTH) - 1).cast("int"))
