"""Rule-based texts: insights on the whole table, advice per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of the insights, with %s for feature names.
STRONGEST = "🔑 **%s** is the strongest predictor of attrition — focus retention efforts here first."
TOP_TWO = "📊 **%s** and **%s** together account for the largest share of attrition risk signals."
PAY_HIGH = "💰 Compensation-related features rank highly — consider salary benchmarking to reduce voluntary turnover."
PAY_LOW = "🕐 Work-life balance and job satisfaction factors appear more influential than compensation in this dataset."
OVERTIME_HIGH = "⏰ Employees working overtime show significantly elevated attrition risk — monitor workload distribution."
OVERTIME_LOW = "🏢 Department and role-specific factors drive attrition — targeted department interventions may be most effective."
TOP_FIVE = "📈 The top 5 features (%s) explain the majority of model predictions — prioritise data collection and HR programmes around these areas."
PAY_WORDS, PAY_RANKS = ["income", "salary"], 5
OVERTIME_WORDS, OVERTIME_RANKS = ["overtime"], 7

# Keywords and advice, first match wins; %s is the feature.
ADVICE = [
    (["overtime"], "Reduce mandatory overtime and implement flexible work arrangements."),
    (["income", "salary"], "Conduct salary benchmarking and consider compensation adjustments."),
    (["distance"], "Offer remote work options or transport allowances to reduce commute burden."),
    (["satisfaction"], "Improve job satisfaction through regular 1:1s and recognition programmes (factor: %s)."),
    (["promotion"], "Create clear promotion pathways and review this employee for advancement opportunities."),
    (["age", "tenure", "years"], "Develop a retention plan for mid-career employees — career development and mentoring."),
    (["travel"], "Limit business travel or provide additional compensation for frequent travel."),
]
OTHER_ADVICE = "Review and improve conditions related to **%s** through targeted HR intervention."
STABLE_ADVICE = "Employee appears stable — continue standard engagement practices."


def _mentions(text: Column, words: list[str]) -> Column:
    lowered = F.lower(text)
    hit = lowered.contains(words[0])
    for word in words[1:]:
        hit = hit | lowered.contains(word)
    return hit


def _filled(text: str, name: Column) -> Column:
    return F.format_string(text, name) if "%s" in text else F.lit(text)


def insights(importance: DataFrame) -> DataFrame:
    """``position, insight`` from the ranked importances (at most fifteen rows)."""
    top = importance.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda r: r["feature"]
        ).alias("top")
    )
    name = lambda i: F.get(F.col("top"), F.lit(i))
    among = lambda words, n: F.exists(F.slice("top", 1, n), lambda f: _mentions(f, words))
    known = F.size("top")
    sentences = F.array(
        F.when(known > 0, F.format_string(STRONGEST, name(0))),
        F.when(known > 1, F.format_string(TOP_TWO, name(1), name(0))),
        F.when(among(PAY_WORDS, PAY_RANKS), PAY_HIGH).otherwise(PAY_LOW),
        F.when(among(OVERTIME_WORDS, OVERTIME_RANKS), OVERTIME_HIGH).otherwise(OVERTIME_LOW),
        F.format_string(TOP_FIVE, F.array_join(F.slice("top", 1, 5), ", ")),
    )
    present = F.filter(sentences, lambda s: s.isNotNull())
    return top.select(F.posexplode(present).alias("position", "insight")).withColumn(
        "position", F.col("position") + 1
    )


def advice(feature: Column) -> Column:
    """Advice for one feature: the first rule whose keyword occurs in its name."""
    chosen = None
    for words, text in ADVICE:
        hit, said = _mentions(feature, words), _filled(text, feature)
        chosen = F.when(hit, said) if chosen is None else chosen.when(hit, said)
    return chosen.otherwise(_filled(OTHER_ADVICE, feature))


def with_recommendations(driven: DataFrame) -> DataFrame:
    """Add ``recommendations``, one text per risk factor, or the stable text alone."""
    given = F.transform("risk_factors", advice)
    return driven.withColumn(
        "recommendations",
        F.when(F.size("risk_factors") > 0, given).otherwise(F.array(F.lit(STABLE_ADVICE))),
    )
