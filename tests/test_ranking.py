import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcome_risk.operators import evaluate, ranking, stats
from outcome_risk.operators.encoding import apply_encoder, fit_encoder, stored_encoder
from outcome_risk.operators.ranking import MIDDLE, by_ranges, medians, order_statistics, running_totals
from outcome_risk.operators.splitting import stratified_folds, stratified_split
from outcome_risk.roles import resolve_roles


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group, a heavy tie, a far outlier, negatives, one constant group, gaps."""
    rng = np.random.default_rng(7)
    hot = np.concatenate([rng.normal(1.7e9, 5.0, 3000), np.full(1500, 1.7e9), [-1e300, 1e300]])
    frame = pd.concat(
        [
            pd.DataFrame({"g": "hot", "v": hot}),
            pd.DataFrame({"g": "small", "v": rng.lognormal(0, 8, 400) * rng.choice([-1, 1], 400)}),
            pd.DataFrame({"g": "flat", "v": np.full(10, 3.0)}),
            pd.DataFrame({"g": "one", "v": [0.1]}),
            pd.DataFrame({"g": "gaps", "v": [np.nan, 1.0, np.inf]}),
            pd.DataFrame({"g": [None], "v": [1.0]}),
        ]
    )
    return spark.createDataFrame(frame).repartition(7), frame


@pytest.mark.parametrize("cells", [1 << 16, 16])
def test_order_statistics(skewed, monkeypatch, cells):
    monkeypatch.setattr(ranking, "CELLS", cells)  # sixteen rows make all passes necessary
    df, frame = skewed
    ranks = {"first": lambda n: F.lit(0), "q3": lambda n: F.floor(n * 3 / 4), "last": lambda n: n - 1}
    found = {r["g"]: r for r in order_statistics(df, ["g"], "v", ranks).collect()}
    expected = frame.dropna().groupby("g")["v"].apply(lambda v: sorted(v))
    assert set(found) == set(expected.index)
    for group, values in expected.items():
        row, n = found[group], len(values)
        assert (row["n"], row["first"], row["q3"], row["last"]) == (
            n,
            values[0],
            values[n * 3 // 4],
            values[-1],
        )


def test_median_of_everything_and_of_nothing(spark, skewed):
    df, frame = skewed
    finite = frame[np.isfinite(frame["v"])]["v"]
    found = medians(df.filter(F.abs("v") < float("inf")), [], "v").first()
    assert found["median"] == finite.median()
    assert medians(df.filter("v > 1e305 and v < 1e306"), [], "v").count() == 0
    assert set(MIDDLE) == {"mid_low", "mid_high"}


@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=40))
@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
def test_bits_keep_order_and_value(spark, values):
    edges = [0.0, -0.0, 5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, float("inf"), 0.1, 1.0]
    edges += [2.0**e for e in range(-1074, 1024, 67)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1000, 1000, 97)]
    df = spark.createDataFrame([(v,) for v in [*values, *edges, *(-v for v in edges)]], "v double")
    rows = ranking.with_bits(df, "v", "b").withColumn("back", ranking.from_bits(F.col("b"))).collect()
    assert all(r["back"] == r["v"] for r in rows)
    rows.sort(key=lambda r: r["b"])
    assert all(x["v"] < y["v"] if x["b"] < y["b"] else x["v"] == y["v"] for x, y in zip(rows, rows[1:]))


def cells_of_each_pass(monkeypatch):
    """Cells per group that the tasks of every pass of a search hold."""
    largest, holding = [], ranking._holding

    def watched(cells, keys):
        largest.append(cells.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return holding(cells, keys)

    monkeypatch.setattr(ranking, "_holding", watched)
    return largest


def test_crowded_values_never_share_a_window(spark, monkeypatch):
    """200 000 values below 1e-5 and two large ones: no pass has more cells than a digit."""
    largest = cells_of_each_pass(monkeypatch)
    df = spark.range(200_000).select((F.col("id") * 5e-11).alias("v")).union(spark.createDataFrame([(1e9,), (2e9,)], "v double"))
    found = order_statistics(df, [], "v", {"q1": lambda n: F.floor(n / 4), "last": lambda n: n - 1}).first()
    assert (found["n"], found["q1"], found["last"]) == (200_002, 50_000 * 5e-11, 2e9)
    assert max(largest) <= ranking.CELLS and len(largest) == 2
    largest.clear()
    near = spark.range(300_000).select((F.lit(1e9) + F.col("id") / 4096.0).alias("v"))
    found = order_statistics(near, [], "v", {"mid": lambda n: F.floor(n / 2)}).first()
    assert found["mid"] == 1e9 + 150_000 / 4096.0
    assert max(largest) <= ranking.CELLS and len(largest) == 4


def test_whole_numbers_of_sixty_bits(spark):
    df = spark.range(5000).select((F.lit(1 << 59) + F.col("id")).alias("v"))
    found = order_statistics(df, [], "v", {"at": lambda n: F.lit(4321)}, basics=True).first()
    assert (found["at"], found["min"], found["max"]) == ((1 << 59) + 4321, 1 << 59, (1 << 59) + 4999)


def test_basics_come_with_the_ranks(skewed):
    df, frame = skewed
    finite = frame[np.isfinite(frame["v"]) & frame["g"].notna()]
    found = {r["g"]: r for r in medians(df.filter(F.abs("v") < float("inf")), ["g"], "v", basics=True).collect()}
    for group, values in finite.groupby("g")["v"]:
        row = found[group]
        assert (row["median"], row["min"], row["max"]) == (values.median(), values.min(), values.max())
        assert row["mean"] == pytest.approx(values.mean(), rel=1e-9, abs=1e284)


def crowded_scores(spark):
    """Scores far below 1e-5 next to ordinary ones, two models of different size."""
    low = spark.range(60_000).select(F.lit("a").alias("m"), (F.col("id") * 1e-12).alias("p"))
    rest = spark.range(1, 500).select(F.lit("b").alias("m"), (F.col("id") / 500.0).alias("p"))
    return low.union(rest).withColumn("n", (F.hash("p") % 5 + 5).cast("long"))


def test_running_totals(spark):
    ranged = by_ranges(crowded_scores(spark), ["m"], "p", "test")
    totals = running_totals(ranged, ["m"], "p", ["n"])
    whole = W.partitionBy("m").orderBy(F.desc("p"))
    check = totals.withColumn("expected", F.sum("n").over(whole))
    assert check.count() == 60_499
    assert check.filter("expected <> cum_n").count() == 0


def test_crowded_scores_are_dealt_evenly(spark):
    ranged = by_ranges(crowded_scores(spark), ["m"], "p", "test")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranged.groupBy("range", "m").count().agg(F.max("count")).first()[0] < 2 * 60_499 / ranges


def test_no_rank_needs_a_whole_class_in_one_task(skewed):
    df, _ = skewed
    plan = order_statistics(df, ["g"], "v", MIDDLE)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SortAggregate" not in plan


def test_split_is_exact_and_stable(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, label int")
    one = stratified_split(df.coalesce(1), "label", "id")
    many = stratified_split(df.repartition(8), "label", "id")
    assert sorted(one.collect()) == sorted(many.collect())
    sizes = {(r["label"], r["split"]): r["count"] for r in one.groupBy("label", "split").count().collect()}
    for label, n in ((0, 859), (1, 144)):
        assert sum(sizes[label, s] for s in ("train", "cal", "test")) == n
        assert abs(sizes[label, "test"] - 0.2 * n) <= 1 and abs(sizes[label, "cal"] - 0.2 * n) <= 1
    folds = stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        per_fold = [r["count"] for r in folds if r["label"] == label]
        assert len(per_fold) == 3 and max(per_fold) - min(per_fold) <= 1


def test_encoder_orders_by_text(spark):
    values = [f"user{i:05d}" for i in range(1500)] + ["é", "Z", "a", ""]
    frame = pd.DataFrame({"many": values + [None], "few": "x"})
    encoder = fit_encoder(spark.createDataFrame(frame), ["many", "few"]).collect()
    codes = {r["value"]: r["code"] for r in encoder if r["column"] == "many"}
    assert codes == {v: i for i, v in enumerate(sorted([*values, "nan"]))}
    assert [r["code"] for r in encoder if r["column"] == "few"] == [0]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 1.0)], "a double, b double, c double")
    cells = {(r["row_name"], r["col_name"]): r["corr"] for r in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert cells["a", "a"] == 1.0 and cells["a", "b"] is None and cells["b", "b"] is None
    assert cells["a", "c"] == cells["c", "a"] == -1.0


def test_wide_tables_keep_twenty_columns(spark):
    wide = spark.range(50).select(
        *[(F.pow(F.col("id"), 1 + i / 10) * (-1) ** i).alias(f"c{i:02d}") for i in range(24)],
        F.when(F.col("id") > 25, "Yes").otherwise("No").alias("Attrition"),
    )
    names = [f"c{i:02d}" for i in range(24)]
    frame = wide.toPandas()
    size = frame[names].corrwith((frame["Attrition"] == "Yes").astype(float)).abs()
    kept = stats.matrix_columns(wide, names, "Attrition", 20)
    assert kept == list(size.nlargest(20).index)
    assert stats.matrix_columns(wide, names, None, 20) == names[:20]
    assert stats.matrix_columns(wide, names, None) == names


def test_auc_matches_the_exact_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(5)
    p = np.round(rng.random(3000), 2)
    frame = pd.DataFrame({"model": "m", "prob": p, "label": (rng.random(3000) < p).astype(int)})
    df = spark.createDataFrame(frame)
    exact = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0)
    assert evaluate.auc_roc(df, None).first()["auc_roc"] == pytest.approx(exact.evaluate(df), abs=1e-12)
    alone = df.withColumn("label", F.lit(0))
    assert evaluate.auc_roc(alone).first()["auc_roc"] is None


def test_head_is_limited_before_the_shuffle(hr):
    plan = stats.head_per_class(hr, resolve_roles(hr.columns))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_wide_column_does_not_shuffle_a_narrow_one(spark):
    flag = F.when(F.col("id") % 2 == 0, "yes").otherwise("no")
    df = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("many one"), flag.alias("flag"))
    encoder = stored_encoder(df, ["many one", "flag"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        joins = {}
        for name in ("many one", "flag"):
            coded = apply_encoder(df, encoder, [name])
            joins[name] = coded._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in joins["flag"] and "SortMergeJoin" not in joins["flag"]
        assert "SortMergeJoin" in joins["many one"]
        codes = apply_encoder(df, encoder, ["flag"]).groupBy("flag").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {tuple(r) for r in codes} == {(0, 30_000), (1, 30_000)}
    assert encoder.filter(F.col("column") == "many one").count() == 60_000


def test_stored_encoder_of_nothing(spark):
    empty = spark.createDataFrame([], "flag string")
    for names in ([], ["flag"]):
        encoder = stored_encoder(empty, names)
        assert encoder.columns == ["column", "value", "code"] and encoder.count() == 0
    assert apply_encoder(empty, encoder, ["flag"]).columns == ["flag"]
