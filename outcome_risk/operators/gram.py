"""Pairwise moments of all numeric columns in one scan, as one mergeable state.

A task turns its batches into four square arrays: rows where both columns are known, the
first one's mean over these, its squared deviations, and the products of both deviations.
Batches are matrix products; states merge by adding deviations about the joint mean, so
nothing cancels whatever the size of the values. The rows of a task's arrays then meet by
row number and are merged as a stream: a task holds one state per row that it owns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks carry this module's functions along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "row int, n array<double>, mean array<double>, other array<double>, squares array<double>, products array<double>, broken array<double>"
PARTS = ["n", "mean", "other", "squares", "products", "broken"]
#: A column whose deviation is below this part of its mean is constant.
CONSTANT = 1e-12


def moments(x: np.ndarray) -> list[np.ndarray]:
    """State of a batch of rows; NaN is unknown. ``broken`` counts pairs that hold an infinity."""
    endless = np.isinf(x)
    known = ~np.isnan(x)
    mask = known.astype(float)
    usable = known & ~endless
    count = np.maximum(usable.sum(axis=0), 1)
    centre = np.where(usable, x, 0.0).sum(axis=0) / count
    shifted = np.where(usable, x - centre, 0.0)
    n = mask.T @ mask
    rows = np.maximum(n, 1.0)
    total = shifted.T @ mask  # of the column's deviations, where the other is known too
    mean = total / rows
    squares = np.maximum((shifted**2).T @ mask - total * mean, 0.0)
    products = shifted.T @ shifted - total * mean.T
    broken = endless.astype(float).T @ mask if endless.any() else np.zeros_like(n)
    mean = np.where(n > 0, centre[:, None] + mean, 0.0)
    return [n, mean, mean.T, squares, products, broken + broken.T]


def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """One state of two; works on whole arrays as on single rows."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1.0)
    gap, other_gap = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    return [
        n,
        np.where(a[0] > 0, a[1] + gap * share, b[1]),
        np.where(a[0] > 0, a[2] + other_gap * share, b[2]),
        a[3] + b[3] + np.where(weight > 0, gap * gap * weight, 0.0),
        a[4] + b[4] + np.where(weight > 0, gap * other_gap * weight, 0.0),
        a[5] + b[5],
    ]


def _batch(rows: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array(list(rows), pa.int32())]
    for i in range(len(PARTS)):
        columns.append(pa.array([state[i] for state in rows.values()], pa.list_(pa.float64())))
    return pa.RecordBatch.from_arrays(columns, names=["row", *PARTS])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        if len(x):
            state = moments(x) if state is None else merge(state, moments(x))
    if state is not None:
        for row in range(len(state[0])):
            yield _batch({row: [part[row] for part in state]})


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        parts = [batch.column(i + 1) for i in range(len(PARTS))]
        for i, row in enumerate(batch.column(0).to_pylist()):
            own = [part[i].values.to_numpy() for part in parts]
            states[row] = merge(states[row], own) if row in states else own
    for row, state in states.items():
        yield _batch({row: state})


def pair_moments(values: DataFrame) -> DataFrame:
    """``row, col, n, squares, other_squares, products, broken`` of every pair of columns.

    ``values`` has double columns only and is read once, whatever their number. ``squares``
    are those of ``row``'s column over the rows where ``col``'s is known too, zero if it is
    constant there.
    """
    states = values.mapInArrow(_gather, STATE).repartition("row").mapInArrow(_merge_rows, STATE)
    long = states.select("row", F.posexplode(F.arrays_zip(*PARTS)).alias("col", "s")).select("row", "col", "s.*")
    flat = F.col("squares") <= F.col("n") * F.pow(F.col("mean") * CONSTANT, 2)
    return long.withColumn("squares", F.when(flat, 0.0).otherwise(F.col("squares")))
