"""The queries search the whole spaces of all three models."""

import threading
import time

import pytest

from outcome_risk.operators import training
from outcome_risk.plans.queries import QUERIES
from tests.conftest import SF_DIR

SMALL = {
    training.FOREST: {"numTrees": [2, 3], "maxDepth": [2, 3], "minInstancesPerNode": [1, 2]},
    training.BOOSTED: {"maxIter": [1, 2], "maxDepth": [2, 3], "stepSize": [0.1, 0.2], "subsamplingRate": [0.8, 1.0]},
}


class Called(Exception):
    pass


def stopped(seen):
    def stop(*args, **kwargs):
        seen.append((args, kwargs))
        raise Called

    return stop


SEARCHES = {
    "random_search_cv": (training.LOGISTIC, 6),
    "random_search_forest": (training.FOREST, 10),
    "random_search_boosted": (training.BOOSTED, 10),
}


@pytest.mark.parametrize("query", SEARCHES)
def test_draws_from_the_whole_space(spark, monkeypatch, query):
    seen = []
    monkeypatch.setattr(training, "random_search_cv", stopped(seen))
    with pytest.raises(Called):
        QUERIES[query](spark, SF_DIR)
    name, draws = SEARCHES[query]
    assert seen[0][0][0] == name
    assert seen[0][0][3] == training.drawn_settings(training.SEARCH_SPACES[name], draws)
    assert len(seen[0][0][3]) == draws


def test_training_runs_on_the_whole_spaces(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(training, "random_search_cv", stopped(seen))
    with pytest.raises(Called):
        QUERIES["train_models"](spark, SF_DIR)
    forest = training.SEARCH_SPACES[training.FOREST]
    assert seen[0][0][3] == training.drawn_settings(forest, training.DRAWS[training.FOREST])


def test_a_stopped_search_goes_on(spark, monkeypatch, tmp_path):
    """Fits that the ledger has are not made again; another table's are."""
    df = spark.range(240).selectExpr("id % 3 AS fold", "CAST(id % 4 = 0 AS INT) AS label", "CAST(id % 8 AS DOUBLE) AS a")
    ready = training.learnable(df, ["a"], None)
    settings = training.drawn_settings(training.SEARCH_SPACES[training.LOGISTIC], 6)
    fits, score, ledger = [], training.f1_score, str(tmp_path / "ledger")

    def stopped(predicted):
        fits.append(1)
        if len(fits) > 7:
            raise Called
        return score(predicted)

    monkeypatch.setattr(training, "f1_score", stopped)
    args = (training.LOGISTIC, training.fold_pairs(ready), ready, settings, False, 1)
    with pytest.raises(Called):
        training.random_search_cv(*args, ledger=ledger)
    fits.clear()
    monkeypatch.setattr(training, "f1_score", lambda predicted: fits.append(1) or score(predicted))
    _, scores = training.random_search_cv(*args, ledger=ledger)
    assert len(fits) == 18 - 7
    fits.clear()
    assert training.random_search_cv(*args, ledger=ledger)[1] == scores and not fits
    other = ready.filter("a < 7")
    training.random_search_cv(training.LOGISTIC, training.fold_pairs(other), other, settings[:1], ledger=ledger)
    assert len(fits) == 3


def test_cancelling_the_job_group_ends_every_fit(spark):
    df = spark.range(2000).selectExpr("id % 3 AS fold", "CAST(id % 4 = 0 AS INT) AS label", "rand(1) AS a")
    ready = training.learnable(df, ["a"], None)
    settings = training.drawn_settings(training.SEARCH_SPACES[training.BOOSTED], 4)
    context = spark.sparkContext
    context.setJobGroup("search", "a search", interruptOnCancel=True)
    timer = threading.Timer(8, lambda: context.cancelJobGroup("search"))
    timer.start()
    began = time.time()
    try:
        with pytest.raises(Exception):
            training.random_search_cv(training.BOOSTED, training.fold_pairs(ready), ready, settings)
    finally:
        timer.cancel()
        context._jsc.clearJobGroup()
    assert time.time() - began < 60


@pytest.mark.parametrize("query, name", [("random_search_forest", training.FOREST), ("random_search_boosted", training.BOOSTED)])
def test_trees_are_refitted_with_the_best_draw(spark, monkeypatch, query, name):
    monkeypatch.setattr(training, "SEARCH_SPACES", {**training.SEARCH_SPACES, **SMALL})
    monkeypatch.setattr(training, "DRAWS", {**training.DRAWS, name: 2})
    rows = QUERIES[query](spark, SF_DIR).collect()
    assert {r["fold"] for r in rows} == {0, 1, 2}
    assert {(r["drawn"], r["best_refitted"]) for r in rows} == {(2, True)}


def test_a_forest_keeps_the_node_of_each_row(spark):
    """The trees are those that are grown without it."""
    df = spark.range(0, 600, 1, 3).selectExpr("CAST(hash(id) % 5 = 0 AS INT) AS label", "rand(1) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    rows = training.learnable(df, ["a", "b"], None).cache()
    estimator = training.estimator_for(training.FOREST).setNumTrees(4).setMaxDepth(12)
    assert estimator.getCacheNodeIds()
    kept, walked = (estimator.fit(rows, {estimator.cacheNodeIds: keep}).toDebugString for keep in (True, False))
    rows.unpersist()
    assert kept.splitlines()[1:] == walked.splitlines()[1:]


@pytest.mark.parametrize("name", [training.FOREST, training.BOOSTED])
def test_the_longest_fits_begin_first(spark, monkeypatch, name):
    df = spark.range(60).selectExpr("id % 3 AS fold", "CAST(id % 4 = 0 AS INT) AS label", "CAST(id % 8 AS DOUBLE) AS a")
    ready = training.learnable(df, ["a"], None)
    settings = training.drawn_settings(training.SEARCH_SPACES[name], training.DRAWS[name])
    seen = []
    monkeypatch.setattr(training, "_side_by_side", stopped(seen))
    with pytest.raises(Called):
        training.random_search_cv(name, training.fold_pairs(ready), ready, settings)
    tasks = seen[0][0][2]
    efforts = [training.effort(settings[i]) for i, _ in tasks]
    assert efforts == sorted(efforts, reverse=True)
    assert sorted(tasks) == [(i, f) for i in range(len(settings)) for f in range(3)]
