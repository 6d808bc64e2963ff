"""Quality scores by a generalised additive model with pairwise interactions.

Cyclic boosting learns one lookup table per feature: in every round each feature in turn
gets a shallow tree over its bins, fitted to what the others leave unexplained. Then the
pairs of features with the largest gain get tables of their own, boosted the same way.
Scoring is a vectorised sum of table entries.

Features come from the text alone. Null and empty texts have the features of an empty
text and are scored. The fit uses a bounded sample (``max_rows`` labelled rows, by hash
of the id); rows with a null label are not used, repeated labels count as they are.
Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.llm.bpe import schema_with
from outcome_risk.llm.textscan import SPACED, text_slices, words_of

MAX_ROWS = 20_000
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
BINS = 32
RATE = 0.15
RIDGE = 2.0
THRESHOLD = 0.7

FEATURES = [
    "log_bytes", "log_words", "distinct_words", "top_word", "word_bytes", "digits", "capitals",
    "symbols", "symbol_runs", "spaces", "line_feeds", "not_ascii",
]

_BYTE = np.arange(256)
_CLASSES = {
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "capitals": (_BYTE >= 65) & (_BYTE <= 90),
    "symbols": ((_BYTE >= 33) & (_BYTE <= 47)) | ((_BYTE >= 58) & (_BYTE <= 64)) | ((_BYTE >= 91) & (_BYTE <= 96)) | ((_BYTE >= 123) & (_BYTE <= 126)),
    "spaces": ~SPACED,
    "line_feeds": _BYTE == 10,
    "not_ascii": _BYTE >= 128,
}


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text of a slice."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = {name: np.zeros(len(sizes)) for name in FEATURES}
    if len(full):
        places = offsets[:-1][full]
        for name, held in _CLASSES.items():
            out[name][full] = np.add.reduceat(held[data], places, dtype=np.int64) / sizes[full]
        symbol = _CLASSES["symbols"][data]
        runs = np.zeros(len(data), dtype=bool)
        runs[1:] = symbol[1:] & symbol[:-1]
        out["symbol_runs"][full] = np.add.reduceat(runs, places, dtype=np.int64) / sizes[full]
    words = words_of(data, offsets, SPACED)
    counts = np.diff(words.first)
    for i in np.flatnonzero(counts):
        _, own = np.unique(words.hashes[words.first[i] : words.first[i + 1]], return_counts=True)
        out["distinct_words"][i] = len(own) / counts[i]
        out["top_word"][i] = own.max() / counts[i]
    out["word_bytes"] = sizes * (1 - out["spaces"]) / np.maximum(counts, 1)
    out["log_bytes"], out["log_words"] = np.log1p(sizes), np.log1p(counts)
    return np.stack([out[name] for name in FEATURES], axis=1)


def add_features(df: DataFrame, text: str = "text", name: str = "features", keep_text: bool = False) -> DataFrame:
    """Add the column ``features`` (array of double, in the order of ``FEATURES``)."""
    schema = schema_with(df, name, T.ArrayType(T.DoubleType()), () if keep_text else (text,))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features_of(d, o) for _, d, o in text_slices(batch.column(batch.schema.get_field_index(text)))]
            values = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            offsets = np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*kept, name])

    return df.mapInArrow(run, schema)


@dataclass
class Model:
    """Bin edges and lookup tables; ``pairs`` maps two features to a table over their bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for i, table in enumerate(self.tables):
            total += table[bins[:, i]]
        for (i, j), table in self.pairs.items():
            total += table[bins[:, i], bins[:, j]]
        return total

    def score(self, values: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(values), 0.5)
        return 1.0 / (1.0 + np.exp(-self.logits(self.bins(values))))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to three leaves."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-12, None, None)
        for start, stop in parts:
            gs, hs = np.cumsum(g[start:stop]), np.cumsum(h[start:stop])
            if stop - start < 2:
                continue
            left = gs[:-1] ** 2 / (hs[:-1] + RIDGE)
            right = (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE)
            gain = left + right - gs[-1] ** 2 / (hs[-1] + RIDGE)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (start, stop), start + at + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
        for start, stop in parts:
            out[start:stop] = _leaf(g[start:stop].sum(), h[start:stop].sum())
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each of two features."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    cuts = []
    for s in (gs, hs):
        inner, side, top, total = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        cuts.append((inner, side - inner, top - inner, total - side - top + inner))
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(*cuts)) - gs[-1, -1] ** 2 / (hs[-1, -1] + RIDGE)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = np.zeros_like(g)
    leaves = [_leaf(a[i, j], b[i, j]) for a, b in zip(*cuts)]
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = leaves[0], leaves[1]
    values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaves[2], leaves[3]
    return float(gain[i, j]), values


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """Fit on the rows given; their number is bounded by the caller."""
    if not len(labels):
        return Model()
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    for i in range(values.shape[1]):
        cuts = np.quantile(values[:, i], np.linspace(0, 1, BINS + 1)[1:-1])
        model.edges.append(np.unique(cuts))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(values)
    logit = np.full(len(labels), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-logit))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            g, h = slopes()
            n = len(table)
            step = RATE * _tree(np.bincount(bins[:, i], g, n), np.bincount(bins[:, i], h, n))
            table += step
            logit += step[bins[:, i]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = len(model.tables[i]), len(model.tables[j])
        flat = bins[:, i] * shape[1] + bins[:, j]
        size = shape[0] * shape[1]
        return np.bincount(flat, g, size).reshape(shape), np.bincount(flat, h, size).reshape(shape)

    gains = sorted(((_quarters(*grid(i, j))[0], i, j) for i, j in combinations(range(len(model.tables)), 2)), reverse=True)
    model.pairs = {(i, j): np.zeros((len(model.tables[i]), len(model.tables[j]))) for _, i, j in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = RATE * _quarters(*grid(i, j))[1]
            table += step
            logit += step[bins[:, i], bins[:, j]]
    return model


def fit_quality(labelled: DataFrame, key: str, label: str, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` rows with ``features`` and a label of 0 or 1."""
    rows = labelled.filter(F.col(f"`{label}`").isNotNull()).select(
        F.xxhash64(F.col(f"`{key}`")).alias("h"), F.col(f"`{label}`").cast("double").alias("y"), "features"
    )
    sample = rows.orderBy("h", "y", "features").limit(max_rows).toPandas()
    if sample.empty:
        return Model()
    return fit(np.stack(sample["features"].to_numpy()), sample["y"].to_numpy())


def score_quality(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Replace ``features`` by ``score`` and ``predicted``."""
    base = df.drop("score", "predicted")
    schema = schema_with(base, "score", T.DoubleType(), ("features",))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("features"))
            values = np.asarray(lists.flatten()).reshape(len(lists), len(FEATURES))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(values))], names=[*kept, "score"])

    scored = base.mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
