"""Registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcome_risk.functions import bands, values
from outcome_risk.operators import (
    balance,
    encoding,
    evaluate,
    explain,
    neighbours,
    profile,
    rates,
    rules,
    score,
    splitting,
    stats,
    training,
)
from outcome_risk.plans import tables
from outcome_risk.roles import (
    column_families,
    drop_columns,
    match_columns,
    quoted,
    resolve_roles,
    select_roles,
)
from outcome_risk.sources.files import export_csv, export_json, load_table
from outcome_risk.storage import new_path, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DEPARTMENTS = "BUILDING, MACHINERY ,,HOUSEHOLD"
FLAGS = ["No", "Yes"]


def query(make: Callable[[SparkSession, str], DataFrame]):
    QUERIES[make.__name__.removesuffix("_query")] = make
    return make


def _hr(spark: SparkSession, sf_dir: str):
    df = tables.hr_table(spark, sf_dir)
    return df, resolve_roles(df.columns)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Sources and sinks


def _round_trip(spark, sf_dir, suffix, write):
    df, _ = _hr(spark, sf_dir)
    path = new_path(spark, "export") + suffix
    write(df, path)
    return path


@query
def scan_csv(spark, sf_dir):
    return load_table(spark, _round_trip(spark, sf_dir, ".CSV", export_csv))


@query
def scan_dispatch(spark, sf_dir):
    text = _round_trip(spark, sf_dir, ".csv", export_csv)
    columnar = _round_trip(spark, sf_dir, ".parquet", lambda df, path: df.write.parquet(path))
    found = [
        load_table(spark, path).agg(
            F.lit(fmt).alias("fmt"),
            F.count("*").alias("n"),
            F.count("Attrition").alias("known"),
            F.sum("Age").cast("long").alias("ages"),
        )
        for fmt, path in (("csv", text), ("parquet", columnar))
    ]
    return found[0].unionByName(found[1])


@query
def sink_csv(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    roles = resolve_roles(scored.columns)
    path = new_path(spark, "export") + ".csv"
    export_csv(scored.select(*[quoted(c) for c in score.report_columns(scored, roles)]), path)
    return load_table(spark, path)


@query
def sink_json(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    gaps = df.withColumn(
        "MonthlyIncome", F.when(F.col("Age") == 18, float("nan")).otherwise(F.col("MonthlyIncome"))
    )
    path = new_path(spark, "export")
    export_json(gaps, path)
    return spark.read.schema(gaps.schema).json(path)


# Schema, projection, predicate, scalar


@query
def resolve_roles_query(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    return select_roles(df, roles)


@query
def match_columns_query(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    return df.select("EmployeeNumber", *match_columns(df.columns, "satisfaction"))


@query
def column_families_query(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    return profile.family_profile(df, column_families(df, roles.target))


@query
def drop_columns_query(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    return drop_columns(df.withColumn("Over18", F.lit("Y")).withColumn("row", F.col("EmployeeNumber")))


@query
def encode_target_strict(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    return df.select("EmployeeNumber", values.strict_target(df, roles.target).alias("label"))


@query
def encode_target_lenient(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    return df.select("EmployeeNumber", values.lenient_target(df, roles.target).alias("outcome"))


@query
def label_encode(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    names = ["Department", "JobRole", "OverTime"]
    encoder = encoding.stored_encoder(df, names)
    return encoding.apply_encoder(df.select("EmployeeNumber", *names), encoder, names)


@query
def label_encoder_table(spark, sf_dir):
    """Codes of a column with as many classes as customers, next to a small one."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return encoding.fit_encoder(customer, ["c_name", "c_mktsegment"])


@query
def filter_in(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    chosen = values.filter_in(df, roles.group, DEPARTMENTS)
    return chosen.select("EmployeeNumber", "Department")


@query
def filter_category(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    chosen = values.filter_category(scored, "risk_category", "Critical")
    return chosen.select("EmployeeNumber", "risk_score", "risk_category")


@query
def nan_to_null(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    gaps = df.select(
        "EmployeeNumber",
        F.when(F.col("YearsAtCompany") < 0, float("nan")).otherwise(F.col("MonthlyIncome")).alias("amount"),
    )
    return values.nan_to_null(gaps)


@query
def drop_nulls(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    return values.drop_nulls(df.select("EmployeeNumber", "Department"), "Department")


@query
def report_columns(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    roles = resolve_roles(scored.columns)
    return scored.select(*[quoted(c) for c in score.report_columns(scored, roles)])


@query
def distinct_groups(spark, sf_dir):
    return profile.distinct_groups(*_hr(spark, sf_dir))


@query
def cast_or_default(spark, sf_dir):
    rows = tables.scenarios(spark, sf_dir)
    return rows.select("scenario", values.cast_or_default(F.col("MonthlyIncome")).alias("amount"))


@query
def band_thresholds(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    amount = F.col(roles.amount)
    cuts, labels = [100000.0, 250000.0, 400000.0], ["small", "middle", "large", "huge"]
    return df.select(
        "EmployeeNumber",
        bands.band(amount, cuts, labels).alias("left_closed"),
        bands.band(F.round(amount, -5), cuts, labels, closed="right").alias("right_closed"),
    )


@query
def minmax_normalise(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    slim = df.select("EmployeeNumber", roles.amount, "JobSatisfaction")
    own = stats.minmax_normalise(slim, roles.amount, alias="own")
    both = stats.minmax_normalise(own, "JobSatisfaction", 1.0, 4.0, "fixed")
    return _rounded(both.select("EmployeeNumber", "own", "fixed"), 9, "own", "fixed")


# Aggregations


def _plain(name: str, operator: Callable, *args):
    QUERIES[name] = lambda spark, sf_dir: operator(*_hr(spark, sf_dir), *args)


_plain("rate_by_group", rates.rate_by_group)
_plain("rate_by_grade", rates.rate_by_grade)
_plain("rate_by_flag", rates.rate_by_flag)
_plain("counts_by_group", rates.counts_by_group)
_plain("counts_by_role", rates.counts_by_role)
_plain("score_means_by_group", rates.score_means_by_group)
_plain("crosstab_group_flag", rates.crosstab_group_flag, FLAGS)
_plain("rate_by_tenure_band", rates.rate_by_tenure_band)
_plain("count_by_tenure_band", rates.count_by_tenure_band)
_plain("age_histogram", rates.age_histogram)
_plain("kpi_summary", rates.kpi_summary)
_plain("kpi_filtered", rates.kpi_filtered, DEPARTMENTS)
_plain("target_split", profile.target_split)
_plain("group_counts", profile.group_counts)
_plain("overview_rates", rates.overview_rates)
_plain("head_per_class", stats.head_per_class)
_plain("five_number_by_class", stats.five_number_by_class)


@query
def amount_by_group(spark, sf_dir):
    return _rounded(rates.amount_by_group(*_hr(spark, sf_dir)), 4, "mean", "median")


@query
def table_shape(spark, sf_dir):
    return profile.table_shape(_hr(spark, sf_dir)[0])


NUMERIC = [
    "JobLevel",
    "MonthlyIncome",
    "YearsAtCompany",
    "Age",
    "JobSatisfaction",
    "EnvironmentSatisfaction",
]


@query
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(_hr(spark, sf_dir)[0], NUMERIC)


@query
def top_corr_columns(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    return stats.top_corr_columns(df, NUMERIC, roles.target, limit=4)


@query
def crosstab_group_risk(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return rates.crosstab_group_risk(scored, resolve_roles(scored.columns))


@query
def risk_category_counts(spark, sf_dir):
    return rates.risk_category_counts(_scored(spark, sf_dir))


@query
def risk_summary(spark, sf_dir):
    return rates.risk_summary(_scored(spark, sf_dir))


@query
def share_of_total(spark, sf_dir):
    return rates.share_of_total(rates.risk_category_counts(_scored(spark, sf_dir)))


@query
def field_profile_numeric(spark, sf_dir):
    return profile.field_profile_numeric(_hr(spark, sf_dir)[0], NUMERIC)


@query
def field_profile_categorical(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    encoder = encoding.fit_encoder(df, ["Department", "JobRole", "OverTime"])
    return profile.field_profile_categorical(encoder)


FORM = ["Department", "OverTime", "MonthlyIncome", "Age", "YearsAtCompany", "Senior"]


def _form(spark, sf_dir):
    """The table with a Boolean feature, its encoder and the types of its form fields."""
    df, _ = _hr(spark, sf_dir)
    df = df.withColumn("Senior", F.col("YearsAtCompany") >= 10)
    encoder = encoding.stored_encoder(df, ["Department", "OverTime"])
    return df, encoder, profile.field_types(df, FORM)


@query
def field_table(spark, sf_dir):
    df, encoder, _ = _form(spark, sf_dir)
    return profile.field_table(df, FORM, encoder)


@query
def default_scenario(spark, sf_dir):
    df, encoder, types = _form(spark, sf_dir)
    return profile.default_scenario(profile.field_table(df, FORM, encoder), types)


def _encoded(spark, sf_dir, names=("Department", "OverTime")):
    df, _ = _hr(spark, sf_dir)
    encoder = encoding.stored_encoder(df, list(names))
    return encoding.apply_encoder(df, encoder, list(names)), encoder


@query
def fill_values(spark, sf_dir):
    encoded, _ = _encoded(spark, sf_dir)
    return profile.fill_values(encoded, tables.SCENARIO_FEATURES, ["Department", "OverTime"])


# Sorts, limits, top-k


@query
def top_risk(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return score.top_risk(scored, resolve_roles(scored.columns))


@query
def sort_by(spark, sf_dir):
    """The rows; a unit test checks their order."""
    df, _ = _hr(spark, sf_dir)
    gaps = df.select(
        "EmployeeNumber",
        F.when(F.col("YearsAtCompany") != 3, F.col("YearsAtCompany")).alias("YearsAtCompany"),
    )
    return score.sort_by(gaps, "YearsAtCompany")


@query
def top_contributions(spark, sf_dir):
    top = explain.top_contributions(_explained(spark, sf_dir), "EmployeeNumber")
    return _rounded(top, 6, "value", "contribution")


@query
def risk_drivers(spark, sf_dir):
    driven = explain.with_drivers(_explained(spark, sf_dir))
    return driven.select(
        "EmployeeNumber",
        F.array_join("risk_factors", ",").alias("risk_factors"),
        F.array_join("retention_factors", ",").alias("retention_factors"),
    )


# Threshold ladders


def _probabilities(spark, sf_dir):
    return tables.scored_models(spark, sf_dir).filter("model = 'A'").select("id", "prob")


@query
def band_scenario(spark, sf_dir):
    return _probabilities(spark, sf_dir).withColumn("band", bands.scenario_band(F.col("prob")))


@query
def band_population(spark, sf_dir):
    p = _probabilities(spark, sf_dir)
    p = p.withColumn("risk_score", values.half_even(F.col("prob") * 100.0, 1))
    return p.withColumn("band", bands.population_band(F.col("risk_score")))


@query
def band_explain(spark, sf_dir):
    return _probabilities(spark, sf_dir).withColumn("band", bands.explain_band(F.col("prob")))


@query
def band_score_mean(spark, sf_dir):
    """Mean scores per group and level, so that all three bands occur."""
    df, roles = _hr(spark, sf_dir)
    fine = df.withColumn(
        "Department", F.concat_ws("/", "Department", "JobLevel", F.col("EmployeeNumber") % 4)
    )
    return rates.score_means_long(fine, roles)


# Split, balance, train, tune, calibrate


def _labelled(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    return df.select("EmployeeNumber", values.strict_target(df, roles.target).alias("label"))


@query
def stratified_split(spark, sf_dir):
    return splitting.stratified_split(_labelled(spark, sf_dir), "label", "EmployeeNumber")


@query
def stratified_folds(spark, sf_dir):
    return splitting.stratified_folds(_labelled(spark, sf_dir), "label", "EmployeeNumber")


@query
def class_weight(spark, sf_dir):
    return splitting.class_weight(_labelled(spark, sf_dir), "label")


@query
def nearest_neighbours(spark, sf_dir):
    """Three nearest other documents of each in the space of three text features."""
    docs = tables.documents(spark, sf_dir)
    points = docs.select("doc_id", F.array("n_chars", "words", "lines").alias("x"))
    distinct = write_table(neighbours.collapse(points, "doc_id", "x"), "points")
    near = neighbours.nearest_neighbours(distinct, 3, block_rows=100)
    return near.select("vid", F.col("rank").cast("int").alias("rank"), "nvid", "ncopies", "d2")


@query
def smote(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    balanced = balance.smote(docs, "bad", "doc_id", ["n_chars", "words", "lines"])
    return _rounded(balanced, 6, "n_chars", "words", "lines")


def _training_rows(spark, sf_dir):
    """Encoded documents with their split, stored once."""
    docs = tables.documents(spark, sf_dir)
    names = ["lang", "source"]
    encoded = encoding.apply_encoder(docs, encoding.stored_encoder(docs, names), names)
    features = [*tables.TEXT_FEATURES, *names]
    ready = training.check_features(encoded, features).select(
        F.col("doc_id").alias("entity"), F.col("bad").alias("label"), *features
    )
    ready = write_table(ready, "encoded")
    return write_table(splitting.stratified_split(ready, "label", "entity"), "split"), features


SETTINGS = {name: {k: v[1] for k, v in space.items()} for name, space in training.SEARCH_SPACES.items()}
SETTINGS[training.LOGISTIC] = {"C": 1.0}
# The second value of every dimension but the number of trees and rounds, which is the first.
SETTINGS[training.FOREST]["numTrees"] = training.SEARCH_SPACES[training.FOREST]["numTrees"][0]
SETTINGS[training.BOOSTED]["maxIter"] = training.SEARCH_SPACES[training.BOOSTED]["maxIter"][0]


def _fit(name, spark, sf_dir):
    split, features = _training_rows(spark, sf_dir)
    rows = split.filter("split = 'train'")
    weight = splitting.class_weight(rows, "label").first()["weight"]
    weighted = name == training.BOOSTED
    ready = training.learnable(rows, features, weight)
    estimator = training.estimator_for(name, weighted)
    training.cut_lineage(spark)
    kept = training.held(ready)  # assembled once, however often the learner reads it
    maps = training.param_maps(estimator, [SETTINGS[name]], training.loss_weight(kept, weighted))
    model = estimator.fit(kept, maps[0])
    kept.unpersist()
    return model, split, features


def _test_scores(model, name, split, features, part="test"):
    one = training.Fitted(name, model, None, [], [])
    scored = one.probability(split.filter(F.col("split") == part), features)
    return scored.select(F.lit(name).alias("model"), "entity", "label", "prob")


def _fitted_rows(name, spark, sf_dir):
    """The test rows; whether each score is a probability, and whether the model has learnt."""
    model, split, features = _fit(name, spark, sf_dir)
    scored = write_table(_test_scores(model, name, split, features), "fitted")
    auc = evaluate.evaluate(scored).first()["auc_roc"]
    return scored.select(
        F.col("entity").alias("doc_id"),
        F.col("label").cast("int").alias("label"),
        F.coalesce(F.col("prob").between(0.0, 1.0), F.lit(False)).alias("in_unit_interval"),
        F.lit(auc is not None and auc > 0.5).alias("better_than_chance"),
    )


@query
def fit_random_forest(spark, sf_dir):
    return _fitted_rows(training.FOREST, spark, sf_dir)


@query
def fit_boosted_trees(spark, sf_dir):
    return _fitted_rows(training.BOOSTED, spark, sf_dir)


@query
def fit_logistic(spark, sf_dir):
    return _fitted_rows(training.LOGISTIC, spark, sf_dir)


def _refitted(model, setting, total):
    """Whether the model carries the setting, ``C`` as its penalty."""
    values = dict(setting)
    if "C" in values:
        values["regParam"] = 1.0 / (values.pop("C") * total)
    got = {k: model.getOrDefault(k) for k in values}
    return all(v == got[k] or (k == "regParam" and abs(got[k] / v - 1.0) < 1e-9) for k, v in values.items())


def _searched(name, spark, sf_dir):
    """Rows per fold and class, and whether the refitted setting is the best of all drawn."""
    split, features = _training_rows(spark, sf_dir)
    train = split.filter("split = 'train'")
    rows = splitting.stratified_folds(train, "label", "entity")
    folded = write_table(rows, "folds")
    weighted = name == training.BOOSTED
    weight = splitting.class_weight(train, "label").first()["weight"] if weighted else None
    ready = training.learnable(folded, features, weight)
    settings = training.drawn_settings(training.SEARCH_SPACES[name], training.DRAWS[name])
    model, scores = training.random_search_cv(name, training.fold_pairs(ready), ready, settings, weighted, in_task=True)
    best = settings[max(range(len(settings)), key=scores.__getitem__)]
    refitted = _refitted(model, best, training.loss_weight(ready, weighted))
    return folded.groupBy("fold", F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("n"),
        F.lit(len(settings)).cast("int").alias("drawn"),
        F.lit(refitted).alias("best_refitted"),
    )


@query
def random_search_cv(spark, sf_dir):
    """The logistic model's search; its space has as many settings as are drawn."""
    return _searched(training.LOGISTIC, spark, sf_dir)


@query
def random_search_forest(spark, sf_dir):
    return _searched(training.FOREST, spark, sf_dir)


@query
def random_search_boosted(spark, sf_dir):
    return _searched(training.BOOSTED, spark, sf_dir)


@query
def platt_calibrate(spark, sf_dir):
    """The test rows, and whether the slopes of the smoothed likelihood vanish at the fit."""
    model, split, features = _fit(training.LOGISTIC, spark, sf_dir)
    raw = training.raw_score(model).alias("score")
    cal = model.transform(training.assemble(split.filter("split = 'cal'"), features))
    cal = write_table(cal.select("label", raw), "margins")
    sigmoid = training.platt_calibrate(cal)
    positive = F.col("label") == 1
    sizes = cal.agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")).first()
    target = F.when(positive, (sizes["pos"] + 1.0) / (sizes["pos"] + 2.0)).otherwise(1.0 / (sizes["neg"] + 2.0))
    miss = sigmoid.apply(F.col("score")) - target
    spread = F.greatest(F.stddev_pop("score"), F.lit(1.0))
    slopes = cal.agg(F.avg(miss).alias("a"), (F.avg(miss * F.col("score")) / spread).alias("b")).first()
    test = model.transform(training.assemble(split.filter("split = 'test'"), features))
    return test.select("entity", "label", raw).select(
        F.col("entity").alias("doc_id"),
        F.col("label").cast("int").alias("label"),
        sigmoid.apply(F.col("score")).between(0.0, 1.0).alias("in_unit_interval"),
        F.lit(max(abs(slopes["a"]), abs(slopes["b"])) < 1e-4).alias("slopes_vanish"),
    )


@query
def empty_if_missing(spark, sf_dir):
    """Rows of operators over the table with, and without, the columns they look for."""
    df, _ = _hr(spark, sf_dir)
    cases = []
    for make, column in ((rates.rate_by_group, "Department"), (rates.counts_by_role, "JobRole"),
                         (rates.rate_by_flag, "OverTime")):
        for present, given in ((True, df), (False, df.drop(column))):
            made = make(given, resolve_roles(given.columns))
            cases.append(made.agg(
                F.lit(make.__name__).alias("operator"), F.lit(present).alias("present"), F.count("*").alias("n")
            ))
    return functools.reduce(DataFrame.unionByName, cases)


@query
def apply_sigmoid(spark, sf_dir):
    """A known calibration applied to the margins of the fixed scorer."""
    df, _ = _hr(spark, sf_dir)
    sigmoid = training.Sigmoid(0.75, -0.5)
    prob = sigmoid.apply(tables.FIXED.margin())
    return df.select("EmployeeNumber", F.round(prob, 9).alias("prob"))


@query
def train_models(spark, sf_dir):
    """The whole run on the whole search spaces: split, balance, search, calibrate, evaluate."""
    docs = tables.documents(spark, sf_dir)
    names = ["lang", "source"]
    encoded = encoding.apply_encoder(docs, encoding.stored_encoder(docs, names), names)
    done = training.train(encoded, "toxic", "doc_id", [*tables.TEXT_FEATURES, *names])
    return done.metrics.withColumn("best", F.col("model") == done.best)


@query
def select_best(spark, sf_dir):
    metrics = evaluate.evaluate(tables.scored_models(spark, sf_dir))
    return evaluate.select_best(metrics, {"A": 0, "B": 1, "C": 2}).select("model", "auc_roc")


# Evaluate


@query
def classification_metrics(spark, sf_dir):
    return evaluate.classification_metrics(tables.scored_models(spark, sf_dir))


@query
def auc_roc(spark, sf_dir):
    return evaluate.auc_roc(tables.scored_models(spark, sf_dir, digits=4), digits=6)


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(tables.scored_models(spark, sf_dir))


@query
def roc_curve(spark, sf_dir):
    curve = evaluate.roc_curve(tables.scored_models(spark, sf_dir, digits=4))
    return _rounded(curve, 9, "fpr", "tpr")


@query
def roc_thin(spark, sf_dir):
    curve = evaluate.roc_curve(tables.scored_models(spark, sf_dir, digits=4))
    return _rounded(evaluate.roc_thin(curve), 9, "fpr", "tpr")


@query
def compare_models(spark, sf_dir):
    return evaluate.compare_models(evaluate.evaluate(tables.scored_models(spark, sf_dir)))


@query
def model_report(spark, sf_dir):
    """Metrics with the best flagged, matrix cells and thinned curve of three fixed models."""
    found = evaluate.model_report(tables.scored_models(spark, sf_dir))
    none = F.lit(None)
    parts = [
        found["comparison"].select(
            F.lit("metric").alias("section"), "model", F.col("metric").alias("name"), none.cast("int").alias("position"),
            none.cast("double").alias("x"), F.col("value").alias("y"), F.col("is_best").alias("flag"),
        ),
        found["confusion"].select(
            F.lit("cell"), "model", "cell", (F.col("actual") * 2 + F.col("predicted")).cast("int"),
            none.cast("double"), F.col("count").cast("double"), none.cast("boolean"),
        ),
        found["curve"].select(
            F.lit("curve"), "model", none.cast("string"), F.col("step").cast("int"), F.round("fpr", 9), F.round("tpr", 9),
            none.cast("boolean"),
        ),
    ]
    return functools.reduce(DataFrame.union, parts)


# Score and explain


def _scored(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    return score.score_population(df, tables.FIXED, tables.FIXED.features)


def _explained(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return explain.linear_contributions(scored, tables.FIXED, scored)


@query
def score_population(spark, sf_dir):
    scored = _scored(spark, sf_dir).select(
        "EmployeeNumber", "Department", "prob", "risk_score", "risk_category"
    )
    return _rounded(scored, 9, "prob")


def _scenarios(spark, sf_dir):
    features, categorical = tables.SCENARIO_FEATURES, ["Department", "OverTime"]
    narrow = write_table(_hr(spark, sf_dir)[0].select(*features), "scenario-features")
    encoder = encoding.stored_encoder(narrow, categorical)
    encoded = write_table(encoding.apply_encoder(narrow, encoder, categorical), "scenario-encoded")
    fills = profile.fill_values(encoded, features, categorical, stored=True)
    rows = tables.scenarios(spark, sf_dir)
    complete = score.encode_scenarios(rows, features, categorical, encoder, fills)
    scored = score.score_scenarios(complete, tables.SCENARIO_MODEL, features)
    explained = explain.linear_contributions(scored, tables.SCENARIO_MODEL, encoded)
    return rules.with_recommendations(explain.with_drivers(explained))


@query
def score_scenarios(spark, sf_dir):
    done = _scenarios(spark, sf_dir)
    return done.select(
        "scenario",
        *tables.SCENARIO_FEATURES,
        "probability",
        "risk_category",
        F.array_join("risk_factors", ",").alias("risk_factors"),
        F.array_join("retention_factors", ",").alias("retention_factors"),
    )


@query
def recommendations(spark, sf_dir):
    done = _scenarios(spark, sf_dir)
    return done.select("scenario", F.array_join("recommendations", " | ").alias("recommendations"))


@query
def linear_contributions(spark, sf_dir):
    long = explain.long_contributions(_explained(spark, sf_dir), "EmployeeNumber")
    return _rounded(long, 6, "value", "contribution")


@query
def fixed_tree_contributions(spark, sf_dir):
    df, _ = _hr(spark, sf_dir)
    features = tables.FIXED.features
    explained = explain.tree_contributions(df, tables.FIXED_TREE, features, "probability")
    return _rounded(explain.long_contributions(explained, "EmployeeNumber"), 6, "contribution")


def _model_contributions(name, spark, sf_dir):
    """Every feature of every row, and whether its contributions add up to the output."""
    model, split, features = _fit(name, spark, sf_dir)
    leaves = explain.ensemble_leaves(spark, model)
    boosted = name == training.BOOSTED
    scored = model.transform(training.assemble(split.select("entity", *features), features))
    raw = vector_to_array("rawPrediction" if boosted else "probability")[1]
    rows = scored.select("entity", *features, (raw * (2.0 if boosted else 1.0)).alias("output"))
    explained = explain.tree_contributions(rows, leaves, features, "any")
    total = F.aggregate("contributions", F.col("base"), lambda t, c: t + c["contribution"])
    exact = explained.withColumn("local_accuracy_ok", F.abs(total - F.col("output")) < 1e-6)
    long = exact.select(F.col("entity").alias("doc_id"), "local_accuracy_ok", F.inline("contributions"))
    return _rounded(long.drop("contribution"), 6, "value")


@query
def tree_contributions(spark, sf_dir):
    return _model_contributions(training.FOREST, spark, sf_dir)


@query
def boosted_contributions(spark, sf_dir):
    return _model_contributions(training.BOOSTED, spark, sf_dir)


@query
def explain_all(spark, sf_dir):
    df, roles = _hr(spark, sf_dir)
    done = explain.explain_all(_explained(spark, sf_dir))
    return done.select(
        "EmployeeNumber",
        "probability",
        "risk_level",
        "explanation",
        F.array_join("risk_factors", ",").alias("risk_factors"),
        F.array_join("retention_factors", ",").alias("retention_factors"),
        values.strict_target(df, roles.target).alias("actual"),
    )


@query
def global_importance(spark, sf_dir):
    return _rounded(explain.global_importance(_explained(spark, sf_dir)), 6, "importance")


@query
def insights(spark, sf_dir):
    return rules.insights(explain.global_importance(_explained(spark, sf_dir)))
