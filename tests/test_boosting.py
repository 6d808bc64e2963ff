"""Boosted trees grown in one task are Spark's."""

import json
import threading
import time

import numpy as np
import pytest

from outcome_risk.operators import boosting, training

ROWS = [
    "id % 3 AS fold",
    "CAST(hash(id) % 5 + id % 3 = 0 AS INT) AS label",
    "rand(1) AS a",
    "CAST(id % 7 AS DOUBLE) AS b",
    "floor(rand(5) * 100) - 20D AS c",
    "1D AS d",
]
SETTINGS = [
    {"maxIter": 3, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0"},
    {"maxIter": 6, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6"},
    {"maxIter": 4, "maxDepth": 7, "stepSize": 0.05, "subsamplingRate": 0.6, "featureSubsetStrategy": "0.8"},
]


def table(spark, n, weight=3.5):
    return training.learnable(spark.range(0, n, 1, 1).selectExpr(*ROWS), list("abcd"), weight)


def tuned(setting, weighted=True):
    estimator = training.estimator_for(training.BOOSTED, weighted)
    return estimator.copy(training.param_maps(estimator, [setting], 1.0)[0])


def nodes(spark, model, tmp_path):
    model.write().save(str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/data").select("treeID", "nodeData.*").sort("treeID", "id").collect()
    kinds = [(r["treeID"], r["id"], r["leftChild"], r["rightChild"], r["rawCount"], r["split"]) for r in rows]
    return kinds, np.array([[r["prediction"], r["impurity"], r["gain"], *r["impurityStats"]] for r in rows])


@pytest.mark.parametrize("n", [60, 1500, 12_000, 30_000])
@pytest.mark.parametrize("setting", SETTINGS, ids=lambda s: f"depth-{s['maxDepth']}")
def test_trees_are_those_of_spark(spark, tmp_path, setting, n):
    """Splits of all rows, of a share and of a share drawn by gaps; feature subsets, samples, a constant feature."""
    rows = table(spark, n).cache()
    width = boosting.one_task_width(rows)
    plan = boosting.task_setting(tuned(setting), width)
    mine = boosting.fit_in_task(tuned(setting), rows, plan)
    theirs = tuned(setting).fit(rows)
    (kinds, numbers), (known, figures) = (nodes(spark, m, tmp_path / str(i)) for i, m in enumerate((mine, theirs)))
    trees = 1 if n > 12_000 else 3  # later ones may break a tie by the last digit of an exponential
    mine_first, theirs_first = ([k for k in ks if k[0] < trees] for ks in (kinds, known))
    assert mine_first == theirs_first
    assert numbers[: len(mine_first)] == pytest.approx(figures[: len(mine_first)], rel=1e-9, abs=1e-9)
    assert mine.treeWeights == theirs.treeWeights and mine.numFeatures == theirs.numFeatures == 4
    assert {k: mine.getOrDefault(k) for k in setting} == setting and mine.getOrDefault("seed") == theirs.getOrDefault("seed")
    rows.unpersist()


@pytest.mark.parametrize("weighted", [False, True])
def test_score_in_a_task_is_that_of_the_model(spark, weighted):
    (inner, outer), *_ = training.fold_pairs(table(spark, 900))
    for setting in SETTINGS:
        estimator = tuned(setting, weighted)
        plan = boosting.task_setting(estimator, boosting.one_task_width(inner, outer))
        kept = training.held(inner, 1)
        score = boosting.f1_in_task(estimator, kept, outer, plan)
        assert score == pytest.approx(training.f1_score(estimator.fit(kept).transform(outer)), abs=1e-12)
        assert score == pytest.approx(training.f1_score(boosting.fit_in_task(estimator, kept, plan).transform(outer)), abs=1e-12)
        kept.unpersist()


def test_a_search_has_no_job_for_every_level(spark):
    """Four settings of twenty trees; the scores and the model are Spark's."""
    ready = table(spark, 600)
    settings = [{**SETTINGS[1], "maxIter": 20, "stepSize": s} for s in (0.01, 0.05, 0.1, 0.2)]
    context, found = spark.sparkContext, {}
    for in_task in (True, False):
        context.setJobGroup(f"search-{in_task}", "a search")
        model, scores = training.random_search_cv(
            training.BOOSTED, training.fold_pairs(ready), ready, settings, True, in_task=in_task
        )
        found[in_task] = scores, len(context.statusTracker().getJobIdsForGroup(f"search-{in_task}"))
        assert json.dumps(model.getOrDefault("stepSize")) in [json.dumps(s["stepSize"]) for s in settings]
        assert len(model.treeWeights) == 20
    context._jsc.clearJobGroup()
    assert found[True][0] == pytest.approx(found[False][0], abs=0.02)
    assert found[True][1] < 100 < found[False][1]


def test_larger_tables_are_left_to_spark(spark, monkeypatch):
    (inner, outer), *_ = training.fold_pairs(table(spark, 300))
    assert boosting.one_task_width(inner, outer) == 4
    monkeypatch.setattr(boosting, "MOST_CELLS", 300 * 4 - 1)
    assert boosting.one_task_width(inner, outer) is None
    assert boosting.one_task_width(inner) == 4  # the training rows alone
    assert boosting.one_task_width(inner.limit(0), outer) is None
    assert boosting.task_setting(tuned(SETTINGS[0]), None) is None
    assert boosting.task_setting(tuned({**SETTINGS[0], "featureSubsetStrategy": "sqrt"}), 4) is None


def test_the_queries_grow_trees_in_tasks(spark, monkeypatch):
    from outcome_risk.plans.queries import QUERIES
    from tests.conftest import SF_DIR
    from tests.test_search import SMALL

    def fit(*args, **kwargs):
        raise AssertionError("a job for every level")

    monkeypatch.setattr(training, "SEARCH_SPACES", {**training.SEARCH_SPACES, **SMALL})
    monkeypatch.setattr(training, "DRAWS", {**training.DRAWS, training.BOOSTED: 2})
    monkeypatch.setattr(training.GBTClassifier, "fit", fit)
    rows = QUERIES["random_search_boosted"](spark, SF_DIR).collect()
    assert {(r["drawn"], r["best_refitted"]) for r in rows} == {(2, True)}


def test_a_whole_training_grows_trees_in_tasks(spark, monkeypatch):
    def fit(*args, **kwargs):
        raise AssertionError("a job for every level")

    monkeypatch.setattr(training.GBTClassifier, "fit", fit)
    df = spark.range(0, 400, 1, 2).selectExpr("id AS entity", "CAST(hash(id) % 4 = 0 AS INT) AS y", "rand(1) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    spaces = {training.BOOSTED: {"maxIter": [2], "maxDepth": [2], "subsamplingRate": [0.8]}}
    done = training.train(df, "y", "entity", ["a", "b"], [training.BOOSTED], spaces, {training.BOOSTED: 1})
    assert done.best == training.BOOSTED and done.status[training.BOOSTED] == "calibrated"
    assert len(done.best_model.model.treeWeights) == 2


def test_cancelling_ends_fits_in_tasks(spark):
    ready = table(spark, 3000)
    settings = [{**SETTINGS[1], "maxIter": 20_000, "stepSize": s} for s in (0.1, 0.2)]
    context = spark.sparkContext
    context.setJobGroup("long", "a search", interruptOnCancel=True)
    timer = threading.Timer(6, lambda: context.cancelJobGroup("long"))
    timer.start()
    began = time.time()
    try:
        with pytest.raises(Exception):
            training.random_search_cv(training.BOOSTED, training.fold_pairs(ready), ready, settings, True, in_task=True)
    finally:
        timer.cancel()
        context._jsc.clearJobGroup()
    assert time.time() - began < 60


@pytest.mark.parametrize("count", [5, 64, 65, 1000])
def test_random_numbers_are_those_of_the_jvm(spark, count):
    jvm = spark._jvm.org.apache.spark.util.random.XORShiftRandom(43)
    assert boosting.shift_doubles(43, count).tolist() == [jvm.nextDouble() for _ in range(count)]
    java, mine = spark._jvm.java.util.Random(-7), boosting.JavaRandom(-7)
    assert [mine.next_long() for _ in range(20)] == [java.nextLong() for _ in range(20)]


def test_no_text_is_shuffled(spark, tmp_path):
    """Texts are counted before they meet their labels, also where the join shuffles."""
    from outcome_risk.plans import tables

    docs = spark.createDataFrame([(i, f"a {i}  b\n{i}", "en", "web") for i in range(9)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = tables.documents(spark, str(tmp_path))
        join = joined._jdf.queryExecution().optimizedPlan().children().head()
        assert join.nodeName() == "Join"
        met = join.children().head().output()
        names = {met.apply(i).name() for i in range(met.size())}
        found = {r["doc_id"]: r for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert names == {"doc_id", *tables.TEXT_FEATURES, "lang", "source"}
    assert sorted(found) == list(range(8))
    assert [found[3][c] for c in ("bad", "n_chars", "words", "uniq", "digits", "lines", "avgw")] == [0, 8.0, 4.0, 0.75, 0.25, 2.0, 2.0]
