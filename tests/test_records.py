"""Records that span lines: several splits give what one task reads."""

import csv
import io
import random

import pytest

from outcome_risk.sources import records
from outcome_risk.sources.files import load_table


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def state_of(line, inside):
    """The quoting rule, one character at a time."""
    begin, i = not inside, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif c == '"' and begin:
            inside, begin = True, False
            i += 1
            continue
        begin = not inside and c == ","
        i += 1
    return inside


def test_quoting_rule(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choices('",a\t5', k=rng.randint(0, 9))) for _ in range(3000)]
    for line in lines:
        for inside in (False, True):
            assert records.inside_after(line, inside) == state_of(line, inside), (line, inside)
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    found = df.select("x", records.opens(df["x"]).alias("o")).collect()
    assert all(r["o"] == state_of(r["x"], False) for r in found)


def written(path, rows, header=("id", "a b", "note")):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows(rows)
    path.write_text(out.getvalue(), encoding="utf-8")


def test_several_splits_equal_one_task(small_splits, tmp_path):
    rng = random.Random(1)
    words = ["x", "a,b", 'say "hi"', "two\nlines", '"', "\n\nfour\n", "é", "", '5" pipe', "id,a b,note"]
    rows = [(i, rng.choice(words), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(900)]
    rows.insert(400, (9000, "long", "line\n" * 2000))  # one record over several splits
    (tmp_path / "t.csv").mkdir()
    written(tmp_path / "t.csv" / "one.csv", rows)
    written(tmp_path / "t.csv" / "two.csv", [(i + 10_000, b, c) for i, b, c in rows])
    df = load_table(small_splits, str(tmp_path / "t.csv"))
    assert df.rdd.getNumPartitions() > 8
    whole = small_splits.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "t.csv"))
    cleaned = {(int(r["id"]), r["a b"] or None, r["note"] or None) for r in whole.collect()}
    assert len(cleaned) == 2 * len(rows)
    assert {(r["id"], r["a b"], r["note"]) for r in df.collect()} == cleaned


def test_inch_marks_need_no_quotes(spark, tmp_path):
    path = tmp_path / "inch.csv"
    path.write_text('id,size\n1,5" pipe\n2,"6"" pipe"\n3,7\n')
    assert {tuple(r) for r in load_table(spark, str(path)).collect()} == {(1, '5" pipe'), (2, '6" pipe'), (3, "7")}
    path.write_text('id,size,note\n1,5" pipe,"two\nlines"\n2,x,\n')
    assert {tuple(r) for r in load_table(spark, str(path)).collect()} == {(1, '5" pipe', "two\nlines"), (2, "x", None)}


def test_header_names():
    assert records.header_names('a,,A,"b ""c"""') == ["a0", "_c1", "A2", 'b "c"']


def test_changed_splits_are_an_error(spark, tmp_path):
    written(tmp_path / "t.csv", [(1, "a\nb", "c")])
    lines = records._lines(spark, str(tmp_path / "t.csv"))
    pieces = lines.mapInArrow(
        records._records({}), "file string, block long, owner long, whole boolean, header boolean, record string"
    )
    with pytest.raises(Exception, match="splits of the files changed"):
        pieces.collect()
