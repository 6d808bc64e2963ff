"""Removing later copies of repeated line runs, with DataFrame operations only.

Lines become ids; only lines that occur twice or more can be part of a repeated run, all
others end it. Prefix doubling sorts the suffixes of the line sequences: the rank of a
position at depth 1, 2, 4, ... is its place in the suffix array cut at that depth, made
from the pair of ranks of its two halves. Suffixes whose first ``n`` lines are equal form
one interval of the suffix array with a longest common prefix of at least ``n``; the pair
of ranks at depth 2^k <= n of the run's first and last 2^k lines names that interval.

A run counts when its lines, with a line feed each, have ``min_chars`` characters or more.
Whether a run is a later copy is decided for the shortest counting run that starts at a
line and the shortest that ends at it. Copies of a run agree in these, and every longer
repeated run is covered by them, so the removed lines are exactly those of the maximal
repeated runs. Such lines need no more depths than the longest shortest run has.

The first copy, by document key, then by line, stays. Rows with equal or null keys are
separate documents (nulls first); a null text stays null, an empty text or line is a line
without characters. All columns of the input remain, ``n_lines`` and ``n_removed`` are
added (or replaced). Line ids are 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcome_risk.llm.storage import write_table

MIN_CHARS = 20


def _lines(keyed: DataFrame, text: str) -> DataFrame:
    """One row per line: ``row, key, i, a, b, chars``."""
    parts = keyed.select("row", "key", F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("i", "line"))
    return parts.select(
        "row",
        "key",
        "i",
        F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit("line"), "line").alias("b"),
        (F.length("line") + 1).alias("chars"),
    )


def _repeated(lines: DataFrame) -> DataFrame:
    """Positions of lines that occur twice or more, with the rank ``r`` of the line."""
    counts = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranks = counts.orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("r"))
    ranks = write_table(ranks, "line-ranks")
    return write_table(
        lines.join(ranks, ["a", "b"]).select("row", "key", "i", "chars", "r"), "line-positions"
    )


def _runs(positions: DataFrame, min_chars: int) -> DataFrame:
    """Shortest counting runs inside unbroken stretches: ``row, key, start, n`` (lines)."""
    by_line = W.partitionBy("row").orderBy("i")
    stretch = positions.withColumn("stretch", F.col("i") - F.row_number().over(by_line))
    inside = W.partitionBy("row", "stretch").orderBy("i")
    summed = stretch.withColumn("upto", F.sum("chars").over(inside)).withColumn(
        "before", F.col("upto") - F.col("chars")
    )
    # lines that begin less than min_chars after the first, or end so before the last, are
    # the shortest run, as sums only grow along a stretch
    forward = F.count(F.lit(1)).over(
        W.partitionBy("row", "stretch").orderBy("before").rangeBetween(0, min_chars - 1)
    )
    backward = F.count(F.lit(1)).over(
        W.partitionBy("row", "stretch").orderBy("upto").rangeBetween(-(min_chars - 1), 0)
    )
    last = F.max("upto").over(W.partitionBy("row", "stretch"))
    sized = summed.withColumn("ahead", forward).withColumn("behind", backward).withColumn("last", last)
    starts = sized.filter(F.col("last") - F.col("before") >= min_chars).select(
        "row", "key", F.col("i").alias("start"), F.col("ahead").alias("n")
    )
    first = F.col("i") - F.col("behind") + 1
    ends = sized.filter(F.col("upto") >= min_chars).select(
        "row", "key", first.alias("start"), F.col("behind").alias("n")
    )
    return starts.union(ends).distinct()


def _at_depth(runs: DataFrame, ranks: DataFrame, low: int) -> DataFrame:
    """Name runs of ``low`` to ``2 * low - 1`` lines by the ranks of their first and last ``low``."""
    some = runs.filter(F.col("n").between(low, 2 * low - 1))
    head = ranks.select("row", F.col("i").alias("start"), F.col("r").alias("head"))
    tail = ranks.select("row", F.col("i").alias("tail_at"), F.col("r").alias("tail"))
    return (
        some.withColumn("tail_at", F.col("start") + F.col("n") - low)
        .join(head, ["row", "start"])
        .join(tail, ["row", "tail_at"])
        .select("row", "key", "start", "n", "head", "tail")
    )


def _later_copies(named: DataFrame) -> DataFrame:
    """Runs with an equal run before them; the earliest is found by pre-aggregated minima."""
    names = ["n", "head", "tail"]
    place = F.struct("key", "row", "start")
    first = named.groupBy(*names).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    # written, so that both sides of the join are dealt anew and a hot name can be split
    first = write_table(first.filter("copies > 1"), "line-firsts")
    later = named.join(first, names).filter(place > F.col("first"))
    return later.select("row", "start", "n")


def _double(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks at twice the depth, of positions whose run of that length occurs twice or more."""
    shifted = ranks.select("row", (F.col("i") - depth).alias("i"), F.col("r").alias("r2"))
    pairs = write_table(ranks.join(shifted, ["row", "i"]).select("row", "i", "r", "r2"), "line-pairs")
    shared = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # ids that grow along the sorted pairs keep the order of the suffix array
    sorted_pairs = shared.orderBy("r", "r2").select("r", "r2", F.monotonically_increasing_id().alias("next"))
    sorted_pairs = write_table(sorted_pairs, "line-ranks")
    joined = pairs.join(sorted_pairs, ["r", "r2"]).select("row", "i", F.col("next").alias("r"))
    return write_table(joined, "line-depth")


def removed_lines(keyed: DataFrame, text: str, min_chars: int) -> DataFrame:
    """``row`` and the sorted numbers of its ``gone`` lines, for rows that lose any."""
    positions = _repeated(_lines(keyed, text))
    runs = write_table(_runs(positions, min_chars), "line-runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    ranks, depth, copies = positions.select("row", "i", "r"), 1, []
    while depth <= longest:
        copies.append(_later_copies(write_table(_at_depth(runs, ranks, depth), "line-named")))
        if 2 * depth <= longest:
            ranks = _double(ranks, depth)
        depth *= 2
    if not copies:
        return runs.select("row", F.array(F.lit(0)).alias("gone")).limit(0)
    found = copies[0]
    for other in copies[1:]:
        found = found.union(other)
    gone = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("i"))
    return gone.groupBy("row").agg(F.collect_set(F.col("i").cast("int")).alias("gone"))


def dedup_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Delete every line of a repeated run but those of its first copy."""
    body = F.col(f"`{text}`")
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("n_lines", "n_removed")]
    own = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    # row numbers are fixed by writing them; a second read must see the same ones
    packed = df.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    packed = write_table(packed, "line-documents")
    keyed = packed.select("row", F.col(f"doc.`{key}`").alias("key"), F.col(f"doc.`{text}`").alias("text"))
    gone = write_table(removed_lines(keyed, "text", min_chars), "line-removed")
    # always dealt by row, never broadcast: the plan is the same at every size
    joined = packed.join(gone.hint("shuffle_hash"), "row", "left")
    lines = F.split(F.col(f"doc.`{text}`"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    result = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    result = result.withColumn(
        "rest", F.when(F.col("gone").isNull(), F.col(f"doc.`{text}`")).otherwise(rest)
    )
    outputs = [(F.col("rest") if c == text else F.col(f"doc.`{c}`")).alias(c) for c in own]
    n_lines = F.coalesce(F.size(F.split(F.col(f"doc.`{text}`"), "\n")), F.lit(0))
    n_lines = F.when(F.col(f"doc.`{text}`").isNull(), 0).otherwise(n_lines)
    return result.select(
        *outputs,
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
