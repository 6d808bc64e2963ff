"""Every query with a SQL counterpart gives the same rows in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF_DIR

ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is not None, v if v is not None else 0) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = ordered(tuple(row[c] for c in columns) for row in df.collect())
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    theirs = ordered(tuple(row[i] for i in places) for row in relation.fetchall())
    assert len(ours) == len(theirs)
    assert [r for r in zip(ours, theirs) if r[0] != r[1]][:3] == []


def test_entry_points(spark):
    assert set(ORACLES) <= set(QUERIES)
    flagship = entry_points.entry(spark)
    assert flagship.columns == ["grp", "n", "positives", "rate"]
    assert flagship.count() == 5


def test_every_query_reads_given_tables(spark):
    for name in ("rate_by_group", "kpi_summary", "roc_curve"):
        assert QUERIES[name](spark, SF_DIR).inputFiles(), name
