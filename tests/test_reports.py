import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from outcome_risk.operators import encoding, score
from outcome_risk.plans import reports
from outcome_risk.plans.tables import FIXED, hr_table
from outcome_risk.roles import resolve_roles
from outcome_risk.sources.files import export_csv, export_json, format_of, load_table
from tests.conftest import SF_DIR


def test_format_by_suffix():
    assert format_of("/x/A.CSV") == "csv" and format_of("t.parquet/") == "parquet"
    for bad in ("a.xlsx", "a.txt"):
        with pytest.raises(ValueError):
            format_of(bad)


def test_csv_types_and_nulls(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'id,big,part,word,flag,none\n1,9007199254740993,0.5,"a, ""b""",True,\n2, 7 ,NA,n/a,false,NaN\n'
    )
    df = load_table(spark, str(path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {
        "id": "bigint",
        "big": "bigint",
        "part": "double",
        "word": "string",
        "flag": "boolean",
        "none": "double",
    }
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [
        (1, 9007199254740993, 0.5, 'a, "b"', True, None),
        (2, 7, None, None, False, None),
    ]
    given = load_table(
        spark, str(path), schema="id int, big string, part double, word string, flag string, none string"
    )
    assert given.schema["id"].dataType.simpleString() == "int"
    assert load_table(spark, str(path), null_tokens=["a"]).schema["part"].dataType.simpleString() == "string"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 'x, "y"'), (2, 1.5, None)], "id int, v double, t string")
    export_json(df, str(tmp_path / "j"))
    lines = [json.loads(l) for p in Path(tmp_path / "j").glob("part*") for l in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["id"]) == [
        {"id": 1, "v": None, "t": 'x, "y"'},
        {"id": 2, "v": 1.5, "t": None},
    ]
    export_csv(df, str(tmp_path / "c.csv"))
    back = load_table(spark, str(tmp_path / "c.csv")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, None, 'x, "y"'), (2, 1.5, None)]


def test_quoted_line_breaks_and_suffixed_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a\nb "c"', "1D"), (2, "x", "2F"), (3, "y", "1F")], "id int, t string, v string")
    path = str(tmp_path / "breaks.csv")
    export_csv(df.coalesce(1), path)
    back = load_table(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'a\nb "c"', "1D"), (2, "x", "2F"), (3, "y", "1F")]
    export_csv(df.filter("id > 1"), str(tmp_path / "plain.csv"))
    given = load_table(spark, str(tmp_path / "plain.csv"), schema="id int, t string, v double").collect()
    assert {(r["id"], r["v"]) for r in given} == {(2, None), (3, None)}


def test_reports_without_a_model(hr):
    upload = reports.upload_report(hr)
    assert upload["shape"].first()["rows"] == 1500
    eda = reports.eda_report(hr)
    assert eda["correlation"].count() == 49
    assert eda["five_numbers"].count() == 2
    board = reports.dashboard_report(hr, "BUILDING")
    assert board["counts_by_group"].count() == 1 and board["groups"].count() == 5
    encoder = encoding.stored_encoder(hr, encoding.categorical_features(hr, "Attrition"))
    fields = reports.metadata_report(hr, encoder)
    assert fields["categorical"].filter("is_default").count() == 3
    assert fields["numeric"].count() == 6
    assert fields["fields"].select("name").distinct().count() == 9
    default = fields["default"].first()
    assert default["OverTime"] == "No" and default["MonthlyIncome"] == hr.selectExpr("median(MonthlyIncome)").first()[0]


def test_reports_read_their_table_once_and_can_be_released(spark, hr, tmp_path):
    hr.write.parquet(str(tmp_path / "people"))
    people = spark.read.parquet(str(tmp_path / "people"))
    for make in (reports.dashboard_report, reports.eda_report):
        report = make(people)
        folder = report.run.path
        for name, df in report.items():
            files = df.inputFiles()
            assert all(folder in f for f in files), (make.__name__, name)
        kept = Path(folder.removeprefix("file://"))
        assert any(kept.iterdir())
        report.release()
        assert not kept.exists()


def test_train_score_explain_scenario(spark, hr):
    from outcome_risk.operators import training

    small = hr.filter("EmployeeNumber < 300")
    done, encoded, encoder = reports.train_report(
        small,
        models=[training.BOOSTED],
        spaces={training.BOOSTED: {"maxIter": [2], "maxDepth": [2]}},
    )
    assert "Department" in done.features and "EmployeeNumber" not in done.features
    risk = reports.risk_report(encoded, done.best_model, done.features)
    assert risk["summary"].first()["total"] == small.count()
    top = risk["top"].collect()
    assert len(top) == 100
    assert [r["risk_score"] for r in top] == sorted((r["risk_score"] for r in top), reverse=True)
    told = reports.explain_report(done)
    assert told["insights"].count() == 5
    assert told["rows"].filter("explanation not like '% risk because: %'").count() == 0
    cases = spark.createDataFrame(
        [(1, "nobody", "12"), (2, None, "x")], "case int, Department string, Age string"
    )
    answer = reports.scenario_report(cases, done, encoded, encoder).collect()
    assert len(answer) == 2 and all(r["recommendations"] for r in answer)


def test_own_keys_are_no_features(spark, hr):
    from outcome_risk.operators import training

    named = hr.filter("EmployeeNumber < 200").withColumn("person", F.concat(F.lit("p"), "EmployeeNumber"))
    named = named.drop("EmployeeNumber").withColumn("EmployeeName", F.lit("the same"))
    small = {"models": [training.FOREST], "spaces": {training.FOREST: {"numTrees": [2], "maxDepth": [2]}}}
    with pytest.raises(ValueError, match="no key"):
        reports.train_report(named, **small)
    done, encoded, encoder = reports.train_report(named, key="person", **small)
    assert "person" not in done.features and not encoder.filter("column = 'person'").count()
    assert encoded.select("entity").distinct().count() == named.count()
    done, _, _ = reports.train_report(named, resolve_roles(named.columns, {"id": "person"}), **small)
    assert "person" not in done.features


def test_sorting_treats_missing_numbers_as_zero(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, -1.0, None), (3, 2.0, "a")], "id int, v double, t string")
    assert [r["id"] for r in score.sort_by(df, "v").collect()] == [3, 1, 2]
    assert [r["id"] for r in score.sort_by(df, "v", False).collect()] == [2, 1, 3]
    assert [r["id"] for r in score.sort_by(df, "t").collect()] == [1, 3, 2]


def test_scoring_runs_on_a_stream(spark, tmp_path):
    whole = hr_table(spark, SF_DIR).select("EmployeeNumber", "MonthlyIncome", "Age", "Department")
    whole.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
    scored = score.score_population(stream, FIXED, FIXED.features)
    query = (
        scored.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == whole.count()
    assert out.filter(F.col("risk_category").isNull()).count() == 0


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    from outcome_risk.operators import rates

    hr_table(spark, SF_DIR).write.parquet(str(tmp_path / "hr"))
    df = load_table(spark, str(tmp_path / "hr"), fmt="parquet")
    counts = rates.counts_by_group(
        reports.filter_in(df, "Department", "BUILDING,MACHINERY"), resolve_roles(df.columns)
    )
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "In(Department, [BUILDING,MACHINERY])" in plan
    assert "ReadSchema: struct<Attrition:string,Department:string>" in plan


def test_report_columns_have_no_repeats(hr):
    scored = score.score_population(hr, FIXED, FIXED.features)
    columns = score.report_columns(scored, resolve_roles(scored.columns))
    assert columns == [
        "EmployeeNumber", "risk_score", "risk_category", "Department", "JobRole", "JobLevel",
    ]


def test_names_with_spaces_and_dots(hr):
    from outcome_risk.operators import training

    odd = hr.filter("EmployeeNumber < 250").withColumnsRenamed(
        {"MonthlyIncome": "Monthly Income", "JobRole": "Job Role", "YearsAtCompany": "Years.Here"}
    )
    roles = resolve_roles(odd.columns, {"tenure": "Years.Here"})
    assert (roles.amount, roles.role) == ("Monthly Income", "Job Role")
    board = reports.dashboard_report(odd, "", roles)
    assert board["amount_by_group"].count() == 5 and board["counts_by_role"].count() == 5
    assert board["tenure"].count() >= 5
    assert reports.eda_report(odd, roles)["correlation"].count() == 49
    done, encoded, encoder = reports.train_report(
        odd,
        roles,
        models=[training.FOREST],
        spaces={training.FOREST: {"numTrees": [2], "maxDepth": [2]}},
        on_null="median",
    )
    assert {"Monthly Income", "Job Role", "Years.Here"} <= set(done.features)
    assert reports.explain_report(done)["importance"].count() > 1
    cases = odd.limit(3).select("Job Role")
    assert reports.scenario_report(cases, done, encoded, encoder).count() == 3
