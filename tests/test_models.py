import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from outcome_risk.operators import balance, explain, neighbours, splitting, training
from outcome_risk.storage import write_table


def brute_force(frame, k):
    x = np.stack(frame["x"].to_numpy())
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    ids = frame["vid"].to_numpy()
    return {
        ids[i]: sorted((round(float(d2[i, j]), 6), ids[j]) for j in range(len(x)) if j != i)[:k]
        for i in range(len(x))
    }


@pytest.mark.parametrize("block_rows", [20, 1000])
def test_neighbours_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(40, 0.01, (100, 3)), rng.normal(0, 300, (50, 3))])
    frame = pd.DataFrame({"vid": range(len(x)), "x": (x * 1000).round().tolist(), "copies": 1})
    points = write_table(spark.createDataFrame(frame), "points")
    found = neighbours.nearest_neighbours(points, 4, block_rows=block_rows).collect()
    expected = brute_force(frame, 4)
    got = {}
    for r in sorted(found, key=lambda r: (r["vid"], r["rank"])):
        got.setdefault(r["vid"], []).append((round(r["d2"], 6), r["nvid"]))
    assert got == expected


def test_visited_cells_stay_few_as_rows_grow(spark):
    """Ten times the rows: a deeper tree, but about as many candidates per vector."""
    rng = np.random.default_rng(12)
    per_vector, depths = [], []
    for n in (400, 4000):
        frame = pd.DataFrame({"vid": range(n), "x": rng.random((n, 2)).tolist(), "copies": 1})
        points = write_table(spark.createDataFrame(frame), "points")
        celled, levels = neighbours.pivot_tree(points, 20, 8)
        assert celled.groupBy("cell").count().agg(F.max("count")).first()[0] <= 20
        assert levels[-1].groupBy("parent").count().agg(F.max("count")).first()[0] <= 8
        bound = 5.0 / n  # a disc with some fifteen vectors
        asking = celled.select("vid", "x", F.col("cell").alias("home"), F.lit(bound).alias("bound"))
        sizes = celled.groupBy("cell").count()
        candidates = neighbours.visited_cells(asking, levels).join(sizes, "cell").agg(F.sum("count")).first()[0]
        per_vector.append(candidates / n)
        depths.append(len(levels))
    assert depths[0] < depths[1]
    assert per_vector[1] < 1.5 * per_vector[0]


def test_salted_copies_give_the_same_rows(spark, monkeypatch):
    df, _ = imbalanced(spark, 23, 90, copies=8)
    key = ["entity", "synthetic", "a", "b"]
    plain = sorted(map(tuple, balance.smote(df, "y", "id", ["a", "b"]).select(key).collect()))
    monkeypatch.setattr(balance, "HOT_COPIES", 2)
    salted = sorted(map(tuple, balance.smote(df, "y", "id", ["a", "b"]).select(key).collect()))
    assert plain == salted


def imbalanced(spark, positives, negatives, copies=0):
    rng = np.random.default_rng(2)
    n = positives + negatives
    frame = pd.DataFrame(rng.normal(0, 1, (n, 2)), columns=["a", "b"])
    frame["y"] = [1] * positives + [0] * negatives
    frame.loc[: copies - 1, ["a", "b"]] = 0.5
    frame["id"] = range(n)
    return spark.createDataFrame(frame), frame


def test_smote_reaches_parity_between_parents(spark):
    df, frame = imbalanced(spark, 23, 90, copies=8)
    rows = balance.smote(df, "y", "id", ["a", "b"]).toPandas()
    assert (rows["y"] == 1).sum() == (rows["y"] == 0).sum() == 90
    minority = frame[frame["y"] == 1][["a", "b"]].to_numpy()
    for _, made in rows[rows["synthetic"]].iterrows():
        base = frame.loc[made["entity"], ["a", "b"]].to_numpy(dtype=float)
        point = np.array([made["a"], made["b"]])
        gaps = [
            abs(np.linalg.norm(base - point) + np.linalg.norm(point - other) - np.linalg.norm(base - other))
            for other in minority
        ]
        assert min(gaps) < 1e-9
    again = balance.smote(df.repartition(5), "y", "id", ["a", "b"]).toPandas()
    key = ["entity", "synthetic", "a", "b"]
    assert rows.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()


@pytest.mark.parametrize("positives, negatives", [(0, 9), (1, 9), (5, 5), (9, 4)])
def test_smote_falls_back_to_its_input(spark, positives, negatives):
    df, _ = imbalanced(spark, positives, negatives)
    rows = balance.smote(df, "y", "id", ["a", "b"])
    assert rows.count() == positives + negatives and not rows.filter("synthetic").count()


def shapley(x, leaves, features):
    """Brute force over all orders of the path-dependent game."""
    def worth(known):
        total = 0.0
        for value, columns, low, high, share in leaves:
            product = value
            for f, lo, hi, z in zip(columns, low, high, share):
                product *= float(lo < x[f] <= hi) if f in known else z
            total += product
        return total

    phi = np.zeros(features)
    for order in itertools.permutations(range(features)):
        seen = set()
        for f in order:
            before = worth(seen)
            seen.add(f)
            phi[f] += worth(seen) - before
    return phi / math.factorial(features)


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(0, 1, (300, 4)), columns=list("abcd"))
    frame["label"] = (frame["a"] + frame["b"] * frame["c"] + rng.normal(0, 0.5, 300) > 0).astype(int)
    frame["entity"] = range(300)
    return spark.createDataFrame(frame).cache()


@pytest.mark.parametrize("name", [training.FOREST, training.BOOSTED])
def test_tree_contributions_are_exact(spark, learnable, name):
    features = list("abcd")
    settings = {training.FOREST: {"numTrees": 5, "maxDepth": 4}, training.BOOSTED: {"maxIter": 4, "maxDepth": 3}}
    estimator = training.estimator_for(name)
    ready = training.assemble(learnable, features)
    model = estimator.fit(ready, training.param_maps(estimator, [settings[name]], 300)[0])
    leaves = explain.ensemble_leaves(spark, model)
    rows = explain.tree_contributions(learnable, leaves, features, "any").collect()
    output = vector_to_array("probability" if name == training.FOREST else "rawPrediction")[1]
    raw = {r["entity"]: r["raw"] for r in model.transform(ready).select("entity", output.alias("raw")).collect()}
    scale = 1.0 if name == training.FOREST else 2.0
    for r in rows:
        total = r["base"] + sum(c["contribution"] for c in r["contributions"])
        assert total == pytest.approx(scale * raw[r["entity"]], abs=1e-6)
    packed = leaves.collect()
    assert len(packed) == len(model.treeWeights)
    flat = [x for t in packed for x in explain.unpack(t["values"], t["sizes"], t["features"], t["bounds"])]
    for r in rows[:5]:
        x = [r[f] for f in features]
        phi = shapley(x, flat, 4)
        assert [c["contribution"] for c in r["contributions"]] == pytest.approx(phi, abs=1e-9)


def test_large_models_go_tree_by_tree(spark, learnable):
    """A limit below a tree's size loads one tree at a time; the sums are the same."""
    features = list("abcd")
    model = training.estimator_for(training.FOREST).fit(training.assemble(learnable, features))
    leaves = explain.ensemble_leaves(spark, model)
    assert [len(g) for g in explain.tree_groups(leaves, 1)] == [1] * 20
    assert len(explain.tree_groups(leaves, 1 << 30)) == 1
    half = sum(len(r["bounds"]) + len(r["values"]) + len(r["sizes"]) + len(r["features"]) for r in leaves.collect()) // 2
    whole, split = (
        {r["entity"]: r for r in explain.tree_contributions(learnable, leaves, features, "any", limit).collect()}
        for limit in (1 << 30, half)
    )
    assert len(explain.tree_groups(leaves, half)) in (2, 3)
    for entity, r in whole.items():
        assert split[entity]["base"] == pytest.approx(r["base"])
        got = [c["contribution"] for c in split[entity]["contributions"]]
        assert got == pytest.approx([c["contribution"] for c in r["contributions"]], abs=1e-12)


def test_trees_are_evaluated_once_and_only_on_features(learnable):
    leaves = [explain.Leaf(0.5, np.array([1]), np.array([-np.inf]), np.array([0.0]), np.array([0.5]))]
    explained = explain.tree_contributions(learnable, leaves, ["a", "b"], "any")
    plan = explain.with_drivers(explained)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stump_by_hand():
    """One split on feature 0 at 1.0, a quarter of the rows left of it."""
    inf = np.inf
    leaves = [
        (0.8, np.array([0]), np.array([-inf]), np.array([1.0]), np.array([0.25])),
        (0.2, np.array([0]), np.array([1.0]), np.array([inf]), np.array([0.75])),
    ]
    phi = explain.leaf_contributions(np.array([[0.0, 9.0], [5.0, 9.0]]), leaves)
    assert explain.base_value(leaves) == pytest.approx(0.35)
    assert phi.tolist() == [[pytest.approx(0.45), 0.0], [pytest.approx(-0.15), 0.0]]


def test_drivers_stay_within_the_top(spark):
    entries = [("f%02d" % i, float(i), (-1.0) ** i * (20 - i)) for i in range(18)]
    df = spark.createDataFrame([(1, entries)], f"id int, contributions {explain.CONTRIBUTION}")
    top = explain.top_contributions(df, "id").collect()
    assert [r["feature"] for r in top] == [e[0] for e in entries[:15]]
    row = explain.with_drivers(df).first()
    assert row["risk_factors"] == ["f00", "f02", "f04"]
    assert row["retention_factors"] == ["f01", "f03", "f05"]


def test_settings():
    space = training.SEARCH_SPACES[training.BOOSTED]
    drawn = training.drawn_settings(space, 10)
    assert len(drawn) == 10 == len({str(s) for s in drawn})
    assert drawn == training.drawn_settings(space, 10)
    assert len(training.drawn_settings(training.SEARCH_SPACES[training.LOGISTIC], 6)) == 6


def test_calibration_is_monotone(spark):
    rng = np.random.default_rng(9)
    score = rng.normal(0, 1, 500)
    label = (rng.random(500) < 1 / (1 + np.exp(-2 * score - 0.5))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": score, "label": label}))
    sigmoid = training.platt_calibrate(df)
    assert 1.3 < sigmoid.slope < 2.8 and 0.0 < sigmoid.intercept < 1.0
    assert training.platt_calibrate(df.withColumn("label", F.lit(0))) is None


def test_missing_features_raise_or_fill(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 10.0)], "id int, a double")
    with pytest.raises(ValueError, match="missing"):
        training.check_features(df, ["a"])
    filled = training.check_features(df, ["a"], on_null="median").orderBy("id").collect()
    assert [r["a"] for r in filled] == [1.0, 3.0, 3.0, 10.0]


def test_columns_without_values_raise(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, a double")
    with pytest.raises(ValueError, match="without any value"):
        training.check_features(df, ["a"], on_null="median")


@pytest.mark.parametrize("ids", [[1, 2, 2, 3], [1, 2, 3, None]])
def test_ids_that_are_no_key_raise(spark, ids):
    rows = [(i, n % 2, float(n)) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id int, y int, a double")
    with pytest.raises(ValueError, match="no key"):
        splitting.stratified_split(df, "y", "id")
    many = df.unionByName(spark.range(10, 30).selectExpr("int(id) as id", "0 as y", "1.0D as a"))
    with pytest.raises(ValueError, match="no key"):
        balance.smote(many, "y", "id", ["a"])


def test_penalty_follows_the_weights(learnable):
    ready = training.learnable(learnable, list("abcd"), 3.0)
    positives = learnable.filter("label = 1").count()
    assert training.loss_weight(ready, True) == 300 + 2 * positives
    assert training.loss_weight(ready, False) == 300


@pytest.mark.parametrize("cv_balance", ["before", "inside"])
def test_training_end_to_end(spark, learnable, cv_balance):
    names = [training.LOGISTIC] if cv_balance == "inside" else [training.FOREST, training.LOGISTIC]
    done = training.train(
        learnable,
        "label",
        "entity",
        list("abcd"),
        models=names,
        spaces={training.FOREST: {"numTrees": [5], "maxDepth": [4]}, training.LOGISTIC: {"C": [1.0]}},
        cv_balance=cv_balance,
    )
    metrics = {r["model"]: r for r in done.metrics.collect()}
    assert set(metrics) == set(names) and done.best in names
    assert max(m["auc_roc"] for m in metrics.values()) > 0.7
    assert all(status == "calibrated" for status in done.status.values())
    scored = done.best_model.probability(done.split, done.features)
    assert scored.filter("prob <= 0 or prob >= 1").count() == 0
    explained = explain.explain_model(scored, done.best_model, done.features, done.balanced)
    assert explain.global_importance(explained).count() == 4
