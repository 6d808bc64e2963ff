"""Benchmark passages in documents, by winnowing and a join.

Words are lower-cased runs of letters and digits. A window is ten consecutive words of a
benchmark item, or a whole shorter item. Documents and items are cut into five-word grams;
of the six neighbouring grams in a window the smallest hash is the window's fingerprint, on
both sides alike, so equal windows have equal fingerprints. The fingerprints of both sides
are joined, and a hit is extended at once: the rows that meet carry the hash of the whole
window, and its words are hit if these agree, too. A shorter item is its own fingerprint and
window; documents are searched for it at every place.

Both sides are read in tasks. Of the items only a filter of fixed size goes to the driver, two
megabytes at most, so that documents send no fingerprint that is surely none of the
benchmark's. What passes it is joined in full; Catalyst picks the join by stored sizes, and
a hot fingerprint can be split.

Null and empty texts have no words and no hits, on both sides. Repeated documents are
scored alike. Items that repeat count once per ``item_id``; a null ``item_id`` hits words
but is not listed. Other columns of the documents stay as they are, those named like a result
are replaced. An empty benchmark hits nothing; no documents give no rows. Texts are read in
slices of words, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.llm.storage import write_table
from outcome_risk.llm.textscan import ALPHANUMERIC, gram_hashes, text_slices, words_of
from outcome_risk.llm.worker import trim

WINDOW = 10
GRAM = 5
FILTER_BITS = 24  # of a hash that the filter looks at

WINDOWS = "size int, print long, window long"
_FOUND = T.ArrayType(
    T.StructType().add("start", T.IntegerType()).add("size", T.IntegerType()).add("print", T.LongType()).add("window", T.LongType())
)


def fingerprints(grams: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin that do not cross a text's end, and the smallest gram hash of each."""
    span = window - gram + 1
    count = len(grams) - span + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    low = grams[:count].copy()
    for j in range(1, span):
        np.minimum(low, grams[j : j + count], out=low)
    inside = np.ones(count, dtype=bool)
    # windows start in one text and end, ``window`` words later, in the same one
    for step in range(1, window):
        ends = first[1:] - step
        inside[ends[(ends >= 0) & (ends < count)]] = False
    starts = np.flatnonzero(inside)
    return starts, low[starts]


def _item_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for at, data, offsets in text_slices(batch.column(1)):
                words = words_of(data, offsets, ALPHANUMERIC)
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    hashes, size = words.hashes[a:b], min(window, b - a)
                    if not size:
                        continue
                    whole = gram_hashes(hashes, size)
                    prints = whole
                    if size == window:
                        starts, prints = fingerprints(gram_hashes(hashes, gram), np.array([0, b - a]), window, gram)
                        whole = whole[starts]
                    pairs = np.unique(np.stack([prints, whole]), axis=1).view(np.int64)
                    count = pairs.shape[1]
                    columns = [
                        pa.array([names[at + i].as_py()] * count, pa.string()),
                        pa.array(np.full(count, size, dtype=np.int32)),
                        pa.array(pairs[0]),
                        pa.array(pairs[1]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "size", "print", "window"])

    return run


def item_windows(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Stored distinct ``item, size, print, window`` of all benchmark items, hashes as signed numbers."""
    narrow = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    found = narrow.mapInArrow(_item_windows(window, gram), f"item string, {WINDOWS}")
    return write_table(found.distinct(), "benchmark-windows")


def print_filter(items: DataFrame, bits: int) -> np.ndarray:
    """For each value of a fingerprint's first ``bits`` bits, whether an item has it.

    Gathered as at most ``2 ** bits / 64`` whole numbers.
    """
    bucket = F.shiftrightunsigned("print", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (bucket % 64).cast("int"))
    rows = items.groupBy(F.shiftrightunsigned(bucket, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    words = np.zeros(max(1, (1 << bits) // 64), dtype=np.int64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return words


def _scan(shared, sizes: list[int], text: str, names: list[str], window: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value.view(np.uint8), bitorder="little").astype(bool)
        shift = np.uint64(64 - bits)
        for batch in batches:
            column = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            counts, ends, found = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64), []
            for at, data, offsets in text_slices(column[text]):
                words = words_of(data, offsets, ALPHANUMERIC)
                own = slice(at, at + len(offsets) - 1)
                counts[own] = np.diff(words.first)
                parts = []
                for size in sizes:
                    whole = gram_hashes(words.hashes, size)
                    if size == window:
                        starts, prints = fingerprints(gram_hashes(words.hashes, gram), words.first, window, gram)
                    else:
                        starts, prints = np.arange(len(whole)), whole
                    kept = held[prints >> shift]
                    starts, prints = starts[kept], prints[kept]
                    row = np.searchsorted(words.first, starts, side="right") - 1
                    within = starts + size <= words.first[row + 1]
                    row, starts, prints = row[within], starts[within], prints[within]
                    parts.append((row, starts - words.first[row], np.full(len(row), size), prints, whole[starts]))
                if parts:
                    row, start, size, prints, whole = (np.concatenate(p) for p in zip(*parts))
                    order = np.argsort(row, kind="stable")
                    ends[own] = np.bincount(row, minlength=len(offsets) - 1)
                    found.append([x[order] for x in (start, size, prints.view(np.int64), whole.view(np.int64))])
            start, size, prints, whole = (np.concatenate(p) for p in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
            places = pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32))
            values = pa.StructArray.from_arrays(
                [pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(prints), pa.array(whole)],
                names=["start", "size", "print", "window"],
            )
            column["n_words"] = pa.array(counts)
            column["_found"] = pa.ListArray.from_arrays(places, values)
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names=names)
        del held
        trim()

    return run


def find_passages(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    gram: int = GRAM,
    keep_text: bool = True,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Add ``n_words``, ``spans`` (array of [first word, words]) and ``items`` (sorted ids)."""
    spark = df.sparkSession
    items = item_windows(benchmark, item, text, window, gram)
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # of 1 to ``window``
    shared = spark.sparkContext.broadcast(print_filter(items, filter_bits))
    base = df.drop("n_words", "spans", "items", "_found").withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType([f for f in base.schema.fields if keep_text or f.name != text])
    schema = schema.add("n_words", T.LongType()).add("_found", _FOUND)
    scan = _scan(shared, sizes, text, schema.names, window, gram, filter_bits)
    packed = write_table(base.mapInArrow(scan, schema), "benchmark-documents")
    hits = packed.select("_row", F.inline("_found")).join(items, ["size", "print", "window"])
    marks = hits.groupBy("_row").agg(
        F.collect_set(F.array("start", "size")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    # written, so that the join goes by the true size of these few rows
    marks = write_table(marks, "benchmark-hits")
    return packed.drop("_found").join(marks, "_row", "left").drop("_row")


def hit_words(spans: F.Column) -> F.Column:
    """Number of words in the union of spans."""
    ordered = F.array_sort(spans)
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state, s):
        stop = F.get(s, F.lit(0)) + F.get(s, F.lit(1))
        fresh = F.greatest(stop - F.greatest(F.get(s, F.lit(0)), state["end"]), F.lit(0))
        return F.struct(F.greatest(state["end"], stop).alias("end"), (state["n"] + fresh).alias("n"))

    return F.coalesce(F.aggregate(ordered, zero, add, lambda state: state["n"]), F.lit(0)).cast("long")


def decontamination(df: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``find_passages`` plus ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    found = find_passages(df, benchmark, **settings)
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return (
        found.withColumn("n_hit", hit_words(F.col("spans")))
        .withColumn("n_items", F.size(listed).cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(listed, ",").cast("binary"), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
