"""Tuning, calibration and choice of three Spark ML classifiers."""

from __future__ import annotations

import itertools
import json
import logging
import random
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outcome_risk.functions.values import number
from outcome_risk.operators.balance import smote
from outcome_risk.operators.boosting import f1_in_task, fit_in_task, one_task_width, task_setting
from outcome_risk.operators.evaluate import evaluate, select_best
from outcome_risk.operators.profile import fill_values
from outcome_risk.operators.splitting import (
    FOLDS,
    SEED,
    class_weight,
    stratified_folds,
    stratified_split,
)
from outcome_risk.roles import quoted
from outcome_risk.storage import shared_root, write_table

log = logging.getLogger(__name__)

FOREST, BOOSTED, LOGISTIC = "Random Forest", "Boosted Trees", "Logistic Regression"

# Search spaces, settings drawn per model, iterations and tolerance.
# A forest without depth limit becomes one of depth 30, Spark's largest; a minimum size for splitting a
# node has no counterpart in Spark and is left out.
SEARCH_SPACES = {
    FOREST: {
        "numTrees": [100, 200, 300],
        "maxDepth": [30, 5, 10, 15],
        "minInstancesPerNode": [1, 2, 4],
    },
    BOOSTED: {
        "maxIter": [100, 200, 300],
        "maxDepth": [3, 5, 7],
        "stepSize": [0.01, 0.05, 0.1, 0.2],
        "subsamplingRate": [0.6, 0.8, 1.0],
        "featureSubsetStrategy": ["0.6", "0.8", "1.0"],
    },
    LOGISTIC: {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]},
}
DRAWS = {FOREST: 10, BOOSTED: 10, LOGISTIC: 6}
LOGISTIC_ITERATIONS = 1000
LOGISTIC_TOLERANCE = 1e-4
#: Rows that one task of a fit takes at least, and fits that run side by side.
ROWS_PER_TASK = 50_000
PARALLELISM = 8


def drawn_settings(space: dict[str, list], draws: int, seed: int = SEED) -> list[dict]:
    """Distinct random settings; all of them when the space is no larger."""
    names = list(space)
    every = [dict(zip(names, values)) for values in itertools.product(*space.values())]
    return every if draws >= len(every) else random.Random(seed).sample(every, draws)


def estimator_for(name: str, weighted: bool = False, seed: int = SEED):
    weight = {"weightCol": "weight"} if weighted else {}
    if name == FOREST:
        # Each row's node is kept per tree, so no level walks down from the root again; the trees are the same.
        return RandomForestClassifier(labelCol="label", seed=seed, cacheNodeIds=True, **weight)
    if name == BOOSTED:
        return GBTClassifier(labelCol="label", seed=seed, **weight)
    return LogisticRegression(
        labelCol="label",
        maxIter=LOGISTIC_ITERATIONS,
        tol=LOGISTIC_TOLERANCE,
        elasticNetParam=0.0,
        standardization=False,
        **weight,
    )


def loss_weight(df: DataFrame, weighted: bool) -> float:
    """What Spark divides the loss by: the sum of weights, or the number of rows."""
    return df.agg(F.sum("weight").alias("w")).first()["w"] or 0.0 if weighted else float(df.count())


def effort(setting: dict) -> int:
    """Levels that a fit of the setting grows at most; 1 without trees."""
    return setting.get("numTrees", setting.get("maxIter", 1)) * setting.get("maxDepth", 1)


def param_maps(estimator, settings: list[dict], total: float) -> list[dict]:
    """Translate settings to Spark parameters; C becomes 1 / (C · total weight)."""
    maps = []
    for setting in settings:
        params = dict(setting)
        if "C" in params:
            params["regParam"] = 1.0 / (params.pop("C") * max(total, 1e-9))
        maps.append({estimator.getParam(k): v for k, v in params.items()})
    return maps


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    values = F.array(*[quoted(f).cast("double") for f in features])
    return df.withColumn("features", array_to_vector(values))


def f1_score(predicted: DataFrame) -> float:
    """F1 of the positive class from ``label, prediction``; 0 when undefined."""
    actual, said = F.col("label") == 1, F.col("prediction") == 1.0
    hits, misses = F.count_if(actual & said), F.count_if(actual != said)
    score = F.coalesce(F.try_divide(hits * 2.0, hits * 2.0 + misses), F.lit(0.0))
    return predicted.agg(score.alias("f1")).first()["f1"]


class Ledger:
    """Scores of a search in a folder: a stopped search goes on with the fits that are missing.

    A row is one fit: a fingerprint of the rows searched over, model, setting, fold, F1.
    Scores of other rows are never taken for these.
    """

    SCHEMA = "run string, model string, setting string, fold int, score double"

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def scores(self, run: str, model: str) -> dict[tuple[str, int], float]:
        if self.path is None:
            return {}
        self._write([])  # so that there is a folder to read
        known = self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", True).parquet(self.path)
        mine = known.filter((F.col("run") == run) & (F.col("model") == model))
        return {(r["setting"], r["fold"]): r["score"] for r in mine.collect()}

    def add(self, run: str, model: str, setting: str, fold: int, score: float) -> None:
        if self.path is not None:
            self._write([(run, model, setting, fold, score)])

    def _write(self, rows: list[tuple]) -> None:
        """A folder of its own per fit, as fits end side by side."""
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.parquet(f"{self.path}/{uuid.uuid4().hex}")


def fingerprint(folds: list[tuple[DataFrame, DataFrame]]) -> str:
    """Rows and hash of what is searched over, in any order."""
    parts = []
    for _, outer in folds:
        weight = [F.col("weight")] if "weight" in outer.columns else []
        row = F.xxhash64(vector_to_array("features"), F.col("label"), *weight)
        parts.append(outer.agg(F.count("*"), F.coalesce(F.bit_xor(row), F.lit(0))).first())
    return "|".join(f"{n}:{h}" for n, h in parts)


def held(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Assembled rows kept for many fits, in no more tasks than they are worth."""
    names = [c for c in ("features", "label", "weight") if c in df.columns]
    kept = df.select(*names)
    tasks = tasks or max(1, -(-kept.count() // ROWS_PER_TASK))
    return kept.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)


def _side_by_side(spark: SparkSession, fit, tasks: list, parallelism: int) -> None:
    """Run all fits, or none any more once one has failed.

    The threads carry the caller's job group, so cancelling it reaches every fit; the others'
    jobs, found by a tag, are then cancelled, too.
    """
    tag = f"search-{uuid.uuid4().hex}"
    context = spark.sparkContext

    def tagged(task) -> None:
        context.addJobTag(tag)
        fit(task)

    pool = ThreadPoolExecutor(parallelism)
    running = [pool.submit(inheritable_thread_target(spark)(tagged), task) for task in tasks]
    try:
        for one in as_completed(running):
            one.result()
    except BaseException:
        pool.shutdown(wait=False, cancel_futures=True)
        while not all(one.done() for one in running):
            context.cancelJobsWithTag(tag)
            time.sleep(0.1)
        raise
    pool.shutdown()


def cut_lineage(spark: SparkSession) -> None:
    """Let learners that iterate cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/learners")


def random_search_cv(
    name: str,
    folds: list[tuple[DataFrame, DataFrame]],
    whole: DataFrame,
    settings: list[dict],
    weighted: bool = False,
    parallelism: int = PARALLELISM,
    seed: int = SEED,
    ledger: str | None = None,
    in_task: bool = False,
):
    """Fit every setting on each fold, take the best mean F1, refit it on all rows.

    ``folds`` holds (training, validation) pairs with ``features, label`` (and
    ``weight``), which are kept while they are fitted on. With ``ledger``, a folder, each
    score is written down as it is known, and a repeated call fits only what is missing.
    With ``in_task``, boosted trees of rows that fit in one task are grown by one, the same
    trees without a job for every level; other models and larger tables are fitted as without.
    Returns the model and the mean scores in the order of the settings.
    """
    spark = whole.sparkSession
    cut_lineage(spark)
    estimator = estimator_for(name, weighted, seed)
    book = Ledger(spark, ledger)
    run = fingerprint(folds) if ledger else ""
    known = book.scores(run, name)
    keys = [json.dumps(s, sort_keys=True) for s in settings]
    missing = [(i, f) for f in range(len(folds)) for i in range(len(settings)) if (keys[i], f) not in known]
    missing.sort(key=lambda task: -effort(settings[task[0]]))  # the longest first, so that none is left running alone
    in_task = in_task and name == BOOSTED
    widths = {f: one_task_width(*folds[f]) if in_task else None for f in sorted({f for _, f in missing})}
    pairs = {f: tuple(held(df, 1 if width else None) for df in folds[f]) for f, width in widths.items()}
    try:
        maps = {f: param_maps(estimator, settings, loss_weight(inner, weighted)) for f, (inner, _) in pairs.items()}

        def fit(task: tuple[int, int]) -> None:
            i, f = task
            inner, outer = pairs[f]
            setting = in_task and task_setting(estimator.copy(maps[f][i]), widths[f])
            if setting:
                score = f1_in_task(estimator, inner, outer, setting)
            else:
                score = f1_score(estimator.fit(inner, maps[f][i]).transform(outer))
            book.add(run, name, keys[i], f, score)
            known[keys[i], f] = score

        _side_by_side(spark, fit, missing, parallelism)
    finally:
        for pair in pairs.values():
            for df in pair:
                df.unpersist()
    totals = [sum(known[k, f] for f in range(len(folds))) / len(folds) for k in keys]
    best = max(range(len(settings)), key=lambda i: totals[i])
    width = one_task_width(whole) if in_task else None
    rows = held(whole, 1 if width else None)
    try:
        tuned = estimator.copy(param_maps(estimator, [settings[best]], loss_weight(rows, weighted))[0])
        setting = in_task and task_setting(tuned, width)
        return fit_in_task(tuned, rows, setting) if setting else tuned.fit(rows), totals
    finally:
        rows.unpersist()


def fold_pairs(folded: DataFrame, folds: int = FOLDS) -> list[tuple[DataFrame, DataFrame]]:
    """Training and validation rows of every fold."""
    return [
        (folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)) for i in range(folds)
    ]


def balanced_pairs(
    folded: DataFrame, features: list[str], weight: float | None, seed: int = SEED
) -> list[tuple[DataFrame, DataFrame]]:
    """The same, with oversampling inside each training part, so nothing leaks."""
    pairs = []
    for inner, outer in fold_pairs(folded):
        enlarged = smote(inner, "label", "entity", features, seed, checked=True)
        pairs.append(
            (
                write_table(learnable(enlarged, features, weight), "fold"),
                learnable(outer, features, weight),
            )
        )
    return pairs


def learnable(df: DataFrame, features: list[str], weight: float | None) -> DataFrame:
    """Assembled rows, positive ones weighted when a weight is given."""
    ready = assemble(df, features)
    if weight is None:
        return ready
    return ready.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))


def raw_score(model) -> Column:
    """What calibration is fitted on: the margin of a linear model, else the probability."""
    linear = hasattr(model, "coefficients")
    return vector_to_array("rawPrediction" if linear else "probability")[1]


@dataclass(frozen=True)
class Sigmoid:
    """Calibrated probability 1 / (1 + exp(-(slope · score + intercept)))."""

    slope: float
    intercept: float

    def apply(self, score: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(F.lit(self.slope) * score + F.lit(self.intercept))))


def platt_calibrate(scores: DataFrame) -> Sigmoid | None:
    """Fit the sigmoid on ``label, score`` with smoothed targets; None when it cannot.

    Each row enters twice, as a positive with its target as weight and as a negative
    with the rest, which is the same as fitting the smoothed target itself.
    """
    sizes = {r["label"]: r["count"] for r in scores.groupBy("label").count().collect()}
    negatives, positives = sizes.get(0, 0), sizes.get(1, 0)
    if not negatives or not positives:
        log.warning("not calibrated: one class only")
        return None
    target = F.when(F.col("label") == 1, (positives + 1.0) / (positives + 2.0)).otherwise(
        1.0 / (negatives + 2.0)
    )
    both = scores.withColumn("target", target).select(
        "score",
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("label"), F.col("target").alias("weight")),
                F.struct(F.lit(0.0).alias("label"), (1.0 - F.col("target")).alias("weight")),
            )
        ),
    )
    fit = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=100, tol=1e-8).fit(
        assemble(both, ["score"])
    )
    return Sigmoid(float(fit.coefficients[0]), float(fit.intercept))


@dataclass
class Fitted:
    """One tuned model with its calibration and its search record."""

    name: str
    model: object
    sigmoid: Sigmoid | None
    settings: list[dict]
    scores: list[float]

    def probability(self, df: DataFrame, features: list[str]) -> DataFrame:
        """Add ``prob``; a model that could not be calibrated gives its own probability."""
        scored = self.model.transform(assemble(df, features))
        if self.sigmoid is None:
            prob = vector_to_array("probability")[1]
        else:
            prob = self.sigmoid.apply(raw_score(self.model))
        extra = ["features", "rawPrediction", "probability", "prediction"]
        return scored.withColumn("prob", prob).drop(*extra)


@dataclass
class Training:
    """Everything a training run leaves behind."""

    features: list[str]
    split: DataFrame
    balanced: DataFrame
    models: dict[str, Fitted]
    test_scores: DataFrame
    metrics: DataFrame
    best: str
    status: dict[str, str] = field(default_factory=dict)

    @property
    def best_model(self) -> Fitted:
        return self.models[self.best]


def check_features(df: DataFrame, features: list[str], on_null: str = "error") -> DataFrame:
    """Cast features to double; missing values raise, or become the column's median."""
    ready = df.withColumns({f: number(df, f) for f in features})
    if on_null == "median":
        return fill_gaps(ready, features, ready)
    gaps = ready.agg(*[F.count_if(quoted(f).isNull()) for f in features]).first()
    missing = [f for f, rows in zip(features, gaps) if rows]
    if missing:
        raise ValueError(f"features with missing values: {missing}; use on_null='median'")
    return ready


def fill_gaps(df: DataFrame, features: list[str], known: DataFrame) -> DataFrame:
    """Replace missing features by the medians of ``known``; raise where it has no value."""
    found = fill_values(known, features, []).collect()
    medians = {r["feature"]: r["median"] for r in found}
    unknown = [f for f in features if medians.get(f) is None]
    if unknown:
        raise ValueError(f"features without any value: {unknown}")
    return df.withColumns({f: F.coalesce(quoted(f), F.lit(medians[f])) for f in features})


def train(
    encoded: DataFrame,
    label: str,
    entity: str,
    features: list[str],
    models: list[str] | None = None,
    spaces: dict[str, dict] | None = None,
    draws: dict[str, int] | None = None,
    balance: str = "both",
    cv_balance: str = "before",
    on_null: str = "error",
    parallelism: int = PARALLELISM,
    seed: int = SEED,
    ledger: str | None = None,
) -> Training:
    """Split, balance, tune, calibrate, evaluate, choose.

    ``balance`` is "smote", "weight" or "both" (oversampled rows and, for the boosted
    trees, the weight of the original classes). ``cv_balance`` cuts the folds after
    oversampling ("before") or oversamples inside each fold ("inside"). ``entity`` must be
    complete and unique. ``on_null="median"`` takes the medians of the training part.
    ``ledger`` names a folder that keeps the search's scores, so a stopped run can go on.
    """
    names = models or [FOREST, BOOSTED, LOGISTIC]
    spaces = spaces or SEARCH_SPACES
    draws = draws or DRAWS
    status: dict[str, str] = {}

    # Stored, as the checks and the split look several times at it.
    ready = encoded.select(
        quoted(entity).alias("entity"),
        quoted(label).cast("int").alias("label"),
        *[number(encoded, f).alias(f) for f in features],
    )
    ready = write_table(ready, "encoded")
    if on_null != "median":
        check_features(ready, features)
    split = write_table(stratified_split(ready, "label", "entity", seed), "split")
    if on_null == "median":
        split = write_table(fill_gaps(split, features, split.filter("split = 'train'")), "filled")
    part = {s: split.filter(F.col("split") == s).drop("split") for s in ("train", "cal", "test")}

    oversampled = balance in ("smote", "both")
    if oversampled:
        balanced = smote(part["train"], "label", "entity", features, seed, checked=True)
    else:
        balanced = part["train"].withColumn("synthetic", F.lit(False))
    weight = class_weight(part["train"], "label").first()["weight"]
    keyed = balanced.withColumn(
        "key",
        F.when(
            F.col("synthetic"),
            F.concat_ws("|", F.col("entity").cast("string"), *[quoted(f).cast("string") for f in features]),
        ).otherwise(F.col("entity").cast("string")),
    )
    keyed = write_table(keyed, "balanced")
    if oversampled and not keyed.filter("synthetic").head(1):
        status["balance"] = "not balanced"
    if cv_balance == "inside" and oversampled:
        folded = stratified_folds(part["train"], "label", "entity", seed=seed)
    else:
        folded = stratified_folds(keyed, "label", "key", seed=seed)
    folded = write_table(folded, "folds")

    fitted: dict[str, Fitted] = {}
    for name in names:
        settings = drawn_settings(spaces[name], draws[name], seed)
        weighted = balance == "weight" or (balance == "both" and name == BOOSTED)
        factor = weight if weighted else None
        if cv_balance == "inside" and oversampled:
            pairs = balanced_pairs(folded, features, factor, seed)
        else:
            pairs = fold_pairs(learnable(folded, features, factor))
        whole = learnable(keyed, features, factor)
        model, scores = random_search_cv(
            name, pairs, whole, settings, weighted, parallelism, seed, ledger, in_task=True
        )
        cal = model.transform(assemble(part["cal"], features))
        sigmoid = platt_calibrate(cal.select("label", raw_score(model).alias("score")))
        status[name] = "calibrated" if sigmoid else "raw"
        fitted[name] = Fitted(name, model, sigmoid, settings, scores)

    scored = None
    for name, one in fitted.items():
        rows = one.probability(part["test"], features).select(
            F.lit(name).alias("model"), "entity", "label", "prob"
        )
        scored = rows if scored is None else scored.unionByName(rows)
    scored = write_table(scored, "test-scores")
    exact = evaluate(scored, None)
    ordinals = {name: i for i, name in enumerate(names)}
    best = select_best(exact, ordinals).first()["model"]
    return Training(features, split, keyed, fitted, scored, evaluate(scored), best, status)
