"""The analyses a user asks for, each a set of named DataFrames.

Results are computed when they are used. Training, rank searches, encoders and the choice
of matrix columns or model run jobs while a report is built. The reports of several results
store the columns that these need once, so the given table is read once, and the model runs
once; ``release()`` of such a report deletes what it stored, when its results are no
longer needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from outcome_risk.functions.values import filter_in
from outcome_risk.operators import encoding, evaluate, explain, profile, rates, rules, score, stats
from outcome_risk.operators.training import Training, train
from outcome_risk.roles import Roles, column_families, quoted, resolve_roles
from outcome_risk.storage import Run, write_table


class Report(dict):
    """Named results, and the run that holds their tables."""

    def __init__(self, run: Run, results: dict[str, DataFrame]):
        super().__init__(results)
        self.run = run

    def release(self) -> None:
        self.run.release()


def _projection(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, stored once, in table order."""
    kept = [c for c in df.columns if c in names] or df.columns[:1]  # rows count without any role, too
    return write_table(df.select(*[quoted(c) for c in kept]), "projection")


def _role_columns(roles: Roles) -> list[str]:
    return [*roles.present().values(), *roles.scores]


def _roles(df: DataFrame, roles: Roles | None) -> Roles:
    return roles or resolve_roles(df.columns)


def upload_report(df: DataFrame, roles: Roles | None = None) -> dict[str, DataFrame]:
    """Shape, outcome split, rows per group."""
    roles = _roles(df, roles)
    return {
        "shape": profile.table_shape(df),
        "target_split": profile.target_split(df, roles),
        "group_counts": profile.group_counts(df, roles),
        "overview": rates.overview_rates(df, roles),
    }


def metadata_report(
    df: DataFrame, encoder: DataFrame, roles: Roles | None = None
) -> dict[str, DataFrame]:
    """Form fields of all features in order (Booleans included), and a scenario of their defaults."""
    roles = _roles(df, roles)
    features = encoding.feature_columns(df, roles)
    fields = write_table(profile.field_table(df, features, encoder), "fields")
    return {
        "fields": fields.orderBy("position", "option_position"),
        "categorical": profile.field_profile_categorical(encoder),
        "numeric": fields.filter("type = 'numeric'").select("name", "min", "max", "mean", "median", "step"),
        "default": profile.default_scenario(fields, profile.field_types(df, features)),
    }


def eda_report(
    df: DataFrame, roles: Roles | None = None, matrix_limit: int | None = None
) -> Report:
    """Correlations of all (or the best) numeric columns, rates, amounts per class, scores."""
    roles = _roles(df, roles)
    numeric = [c for c, family in column_families(df).items() if family == "numeric"]
    run = Run(df.sparkSession, "eda")
    with run.open():
        df = _projection(df, [*numeric, *_role_columns(roles)])
        columns = stats.matrix_columns(df, numeric, roles.target, matrix_limit)
        return Report(run, {
            "correlation": stats.correlation_matrix(df, columns),
            "rate_by_group": rates.rate_by_group(df, roles),
            "rate_by_grade": rates.rate_by_grade(df, roles),
            "rate_by_flag": rates.rate_by_flag(df, roles),
            "amounts_by_class": stats.head_per_class(df, roles),
            "five_numbers": stats.five_number_by_class(df, roles),
            "score_means": rates.score_means_long(df, roles),
        })


def dashboard_report(
    df: DataFrame, groups: str | list[str] = "", roles: Roles | None = None
) -> Report:
    """Headline figures and the seven charts, for all or for the chosen groups."""
    roles = _roles(df, roles)
    run = Run(df.sparkSession, "dashboard")
    with run.open():
        df = _projection(df, _role_columns(roles))
        chosen = filter_in(df, roles.group, groups)
        return Report(run, {
            "kpi": rates.kpi_summary(chosen, roles),
            "counts_by_group": rates.counts_by_group(chosen, roles),
            "counts_by_role": rates.counts_by_role(chosen, roles),
            "amount_by_group": rates.amount_by_group(chosen, roles),
            "score_means": rates.score_means_by_group(chosen, roles),
            "flags": rates.crosstab_group_flag(chosen, roles),
            "tenure": rates.tenure_chart(chosen, roles),
            "age": rates.age_histogram(chosen, roles),
            "groups": profile.distinct_groups(df, roles),
        })


def train_report(
    df: DataFrame, roles: Roles | None = None, key: str | None = None, **options
) -> tuple[Training, DataFrame, DataFrame]:
    """Encode and train; returns the training, the encoded table and the encoder.

    Rows are told apart by the id; name a complete and unique ``key`` where it is neither.
    """
    roles = _roles(df, roles)
    if not roles.target or not (key or roles.id):
        raise ValueError("training needs a target and an id column")
    names = encoding.row_names(roles, key)
    encoder = encoding.stored_encoder(df, encoding.categorical_features(df, roles.target, names))
    encoded = encoding.prepare(df, roles, encoder, key)
    features = encoding.feature_columns(df, roles, key)
    training = train(encoded, roles.target, "entity", features, **options)
    return training, encoded, encoder


def model_report(training: Training) -> dict[str, DataFrame]:
    """Metrics, matrix cells, thinned curves and comparison of the trained models."""
    return evaluate.model_report(training.test_scores)


def risk_report(
    encoded: DataFrame, model, features: list[str], roles: Roles | None = None
) -> Report:
    """Score everybody; categories, crosstab, summary and the highest hundred.

    ``encoded`` is the prepared table, which carries the raw rows along.
    """
    run = Run(encoded.sparkSession, "risk")
    with run.open():
        scored = score.score_population(encoded, model, features)
        full = write_table(scored.select("raw.*", "prob", "risk_score", "risk_category"), "scored")
        roles = _roles(full, roles)
        return Report(run, {
            "scored": full,
            "category_counts": rates.share_of_total(rates.risk_category_counts(full)),
            "by_group": rates.crosstab_group_risk(full, roles),
            "top": score.top_risk(full, roles),
            "summary": rates.risk_summary(full),
        })


def explain_report(training: Training, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Contributions of all rows (or of given encoded rows), global and per row."""
    if rows is None:
        rows = training.split.drop("split")
    best = training.best_model
    scored = best.probability(rows, training.features)
    explained = explain.explain_model(scored, best, training.features, training.balanced)
    importance = explain.global_importance(explained)
    return {
        "importance": importance,
        "insights": rules.insights(importance),
        "rows": explain.explain_all(explained),
    }


def scenario_report(
    scenarios: DataFrame, training: Training, encoded: DataFrame, encoder: DataFrame
) -> DataFrame:
    """Probability, category, drivers and advice for a table of what-if rows."""
    categorical = [r["column"] for r in encoder.select("column").distinct().collect()]
    known = [f for f in training.features if f in categorical]
    encoded = write_table(encoded.select(*[quoted(f) for f in training.features]), "features")
    fills = profile.fill_values(encoded, training.features, known, stored=True)
    best = training.best_model
    complete = score.encode_scenarios(scenarios, training.features, known, encoder, fills)
    scored = score.score_scenarios(complete, best, training.features)
    explained = explain.explain_model(scored, best, training.features, training.balanced)
    return rules.with_recommendations(explain.with_drivers(explained))
