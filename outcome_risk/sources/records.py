"""CSV records that span lines, read by many tasks.

A file is read line by line, in its splits. Whether a line begins inside a quoted field
depends on all lines before it; but what a split does to that question is one of two answers
for each of two beginnings, whatever its length. So a first pass finds both answers per
split, the splits of a file are chained in order, and a second pass cuts every split into
records, knowing how it begins. Only records that cross a border of splits are put together
by a shuffle.

A quote opens a field only where the field begins; any other quote is a character, so the
value ``5" pipe`` needs no quotes. Inside quotes a doubled quote stands for one.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks carry this module's functions along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
#: A line, read from a record's begin, whose last field is quoted and does not end.
LEAVES_OPEN = rf'^(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+"{_QUOTED}$'
_OPEN = re.compile(LEAVES_OPEN.replace("$", r"\Z"))
_CLOSES = re.compile(rf'{_QUOTED}"[^,]*+(,|\Z)')
ROWS = 10_000


def opens(line: Column) -> Column:
    """Whether a line that begins a record leaves a quote open."""
    return line.rlike(LEAVES_OPEN)


def inside_after(line: str, inside: bool) -> bool:
    """Whether the next line begins inside a quoted field."""
    if '"' not in line:
        return inside
    if inside:
        closed = _CLOSES.match(line)
        if closed is None:
            return True
        if not closed[1]:
            return False
        line = line[closed.end() :]
    return _OPEN.match(line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """The lines of each split in turn, as runs of one batch."""
    for batch in batches:
        values, files, blocks = (c.to_pylist() for c in batch.columns)
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield files[start], blocks[start], values[start:i]
                start = i


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: where it ends if begun outside, and if begun inside; whether the latter ever left."""
    found: dict[tuple[str, int], list[bool]] = {}
    for file, block, lines in _by_split(batches):
        state = found.setdefault((file, block), [False, True, False])
        for line in lines:
            if '"' in line:
                state[0], state[1] = inside_after(line, state[0]), inside_after(line, state[1])
                state[2] |= not state[1]
    rows = [(f, b, *state) for (f, b), state in found.items()]
    if rows:
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        names = ["file", "block", "outside", "inside", "left"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def split_starts(lines: DataFrame) -> dict[tuple[str, int], int | None]:
    """Every split, with the block in which the record began that it starts inside of.

    One entry per split of the files, which the driver lists anyway.
    """
    found = lines.mapInArrow(_answers, "file string, block long, outside boolean, inside boolean, left boolean")
    starts: dict[tuple[str, int], int | None] = {}
    owner, last = None, None
    for row in found.orderBy("file", "block").toLocalIterator():
        if row["file"] != last:
            owner, last = None, row["file"]
        starts[row["file"], row["block"]] = owner
        ends_inside = row["outside"] if owner is None else row["inside"]
        fresh = owner is None or row["left"]  # the record that is open at the end began here
        owner = (row["block"] if fresh else owner) if ends_inside else None
    return starts


def _records(starts: dict[tuple[str, int], int | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, open_lines, owner, header = [], None, [], None, False

        def cut(whole: bool) -> None:
            nonlocal header
            text = "\n".join(open_lines)
            open_lines.clear()
            if not whole or text.strip():
                out.append((place[0], place[1], owner, whole, header, text))
                header = False

        for file, block, lines in _by_split(batches):
            if (file, block) != place:
                if open_lines:
                    cut(False)
                place = file, block
                if place not in starts:
                    raise ValueError("the splits of the files changed between two reads; set spark.sql.files.minPartitionNum")
                owner, header = starts[place], block == 0
                inside, head = owner is not None, owner is not None
            for line in lines:
                open_lines.append(line)
                inside = inside_after(line, inside)
                if not inside:
                    # what ends a record of an earlier split is no record of its own
                    cut(not head)
                    owner, head = None, False
                elif owner is None:
                    owner = block
            if len(out) >= ROWS:
                yield _batch(out)
                out = []
        if open_lines:
            cut(False)
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    names = ["file", "block", "owner", "whole", "header", "record"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def spanning_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, header, record`` of every record, its line breaks kept; blank ones are left out."""
    lines = _lines(spark, path)
    pieces = lines.mapInArrow(
        _records(split_starts(lines)),
        "file string, block long, owner long, whole boolean, header boolean, record string",
    )
    parts = pieces.filter(~F.col("whole")).groupBy("file", "owner").agg(
        F.bool_or("header").alias("header"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return pieces.filter("whole").select("file", "header", "record").unionByName(
        parts.select("file", "header", joined.alias("record"))
    )


def header_names(record: str) -> list[str]:
    """Column names of a header: empty ones by their place, repeated ones with it."""
    names = next(csv.reader([record]))
    lowered = [n.lower() for n in names]
    return [
        f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)
    ]


def read_spanning(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, of files whose quoted fields hold line breaks; each has a header."""
    records = spanning_records(spark, path)
    names = header_names(records.filter("header").orderBy("file").first()["record"])
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("record", F.lit(ddl), {"escape": '"'})
    return records.filter("not header").select(parsed.alias("row")).select("row.*")
