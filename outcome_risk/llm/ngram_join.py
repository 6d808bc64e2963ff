"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

Every n-gram has a 56-bit hash. The hash range is cut into fragments, and every document's
set falls into segments, one per fragment.

1. A task turns its documents into sorted segments, packed per fragment; equal sets of a
   task are one. A fragment counts in how many sets each n-gram is. An n-gram that several
   sets of one task share is sent once for all of them, so a fragment gets each n-gram at
   most once per task, however common it is.
2. The counts go back to the task's documents. Only sets that share at least the
   threshold's part of their n-grams with other sets can link. Most documents end here.
3. The global order of n-grams is by count, then by hash; n-grams in one set only come
   first. Linked sets share one of their first ``n - ceil(threshold * n) + 1`` n-grams.
   Sets under one such n-gram are compared with one set that speaks for it, in the first
   turn the one that shares most of its n-grams, then others. Sets that are connected
   already need no comparison, so a group of near copies is soon one; all that are still
   apart are compared. Pairs that cannot reach the threshold by their sizes and by how
   many n-grams they share with any set at all are never made.
4. A comparison counts partial overlaps fragment by fragment and sums them per pair.
   A pair links when ``100 * overlap >= percent * union``.

Equal sets are one class from the start, and only links between classes are computed.
Null ids are allowed: such rows link, but a component is named by its smallest id, null if
it has none. Texts that are null or have no words have no n-grams and stay alone. Rows
that repeat are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcome_risk.llm.components import components
from outcome_risk.llm.storage import read_parts, write_parts, write_table
from outcome_risk.llm.textscan import SPACED, gram_hashes, mix, text_slices, words_of
from outcome_risk.llm.worker import release, trim

SIZE = 5
PERCENT = 75
GROUP_GRAMS = 600_000
GROUP_ROWS = 60_000
FRAGMENT_GRAMS = 1_000_000
VERIFY_FRAGMENTS = 4
TURNS = 2
#: Numbers of sets: how much of a set is shared by nobody, then a running number.
LOW_BITS = (1 << 55) - 1
FLIP = 0x2545F4914F6CDD
#: Set numbers from here on say how many sets of one task share the n-gram.
SEVERAL = GROUP_ROWS
KEPT_BITS = ~np.uint64(0xFF)

PACKED = "route long, fragment int, group_id long, high binary, low binary, sets binary, codes binary"
PARTS = "kind string, doc_id long, n long, sig binary, grams binary, codes binary"
SETS = "sig binary, n long, m long, segments array<binary>, prefix array<long>"


def text_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for _, data, offsets in text_slices(texts):
        words = words_of(data, offsets, SPACED)
        grams = gram_hashes(words.hashes, size) & KEPT_BITS
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield gram_hashes(words.hashes[a:b], b - a) & KEPT_BITS
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(grams: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    first = mix(grams)
    return np.array([first.sum(dtype=np.uint64), mix(first + np.uint64(len(grams))).sum(dtype=np.uint64)]).tobytes()


def _pack(grams: np.ndarray, sets: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted hashes as steps of their first 24 bits, in few bytes, and their next 32."""
    steps = np.diff((grams >> np.uint64(40)).astype(np.int64), prepend=0)
    largest = int(steps.max(initial=0))
    width = 1 if largest < 1 << 8 else 2 if largest < 1 << 16 else 4
    low = ((grams >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    return bytes([width]) + steps.astype(f"<u{width}").tobytes(), low.tobytes(), sets.astype("<u2").tobytes()


def _unpack(high: bytes, low: bytes, sets: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(high, f"<u{high[0]}", offset=1)
    tops = np.cumsum(steps.astype(np.uint64))
    grams = (tops << np.uint64(40)) + (np.frombuffer(low, "<u4").astype(np.uint64) << np.uint64(8))
    return grams, np.frombuffer(sets, "<u2").astype(np.int64)


def _code(sets: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Counts of sets in one byte that keeps their order within each half.

    Below 128 it is the exact number of tasks that have the n-gram, each in one set. From
    128 on some task has it in several sets, or very many have it: it is shared for sure.
    """
    steps = np.minimum(8 * np.log2(np.maximum(sets, 1)), 127).astype(np.int64)
    return np.where(several | (sets >= 128), 128 + steps, sets).astype(np.uint8)


class _Group:
    """Documents of one task, gathered up to a bound."""

    def __init__(self):
        self.ids: list = []
        self.counts: list[int] = []
        self.signatures: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.grams: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_id, grams: np.ndarray) -> None:
        sig = signature(grams)
        self.ids.append(doc_id)
        self.counts.append(len(grams))
        self.signatures.append(sig)
        if len(grams) and sig not in self.number:
            self.number[sig] = len(self.grams)
            self.grams.append(grams)
            self.total += len(grams)

    def full(self) -> bool:
        return self.total >= GROUP_GRAMS or len(self.ids) >= GROUP_ROWS

    def rows(self, group_id: int, fragments: int) -> Iterator[tuple]:
        """Rows of ``PACKED``: the documents, the n-grams shared here, and the segments."""
        nulls = np.array([i is None for i in self.ids], dtype=np.uint8)
        ids = np.array([0 if i is None else i for i in self.ids], dtype="<i8")
        meta = ids.tobytes() + nulls.tobytes() + np.array(self.counts, dtype="<i8").tobytes()
        yield -1 - group_id, -1, group_id, meta, b"".join(self.signatures), b"", b""
        if not self.grams:
            return
        grams = np.concatenate(self.grams)
        sets = np.repeat(np.arange(len(self.grams)), [len(g) for g in self.grams])
        order = np.argsort(grams)
        grams, sets = grams[order], sets[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        counts = np.diff(first, append=len(grams))
        shared = np.repeat(counts > 1, counts)
        yield -1 - group_id, -2, group_id, *_pack(grams[shared], sets[shared]), b""
        sent = grams[first]
        owners = np.where(counts > 1, SEVERAL + np.minimum(counts, 0xFFFF - SEVERAL), sets[first])
        cuts = np.searchsorted(sent, _bounds(fragments))
        for fragment, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(sent)])):
            if b > a:
                yield fragment, fragment, group_id, *_pack(sent[a:b], owners[a:b]), b""


def _bounds(fragments: int) -> np.ndarray:
    """Lowest hash of every fragment of the global order."""
    return np.array([(i << 64) // fragments for i in range(fragments)], dtype=np.uint64)


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = ["route", "fragment", "group_id", "high", "low", "sets", "codes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _segments(df: DataFrame, size: int, fragments: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        group_id = TaskContext.get().partitionId() << 32
        group = _Group()
        for batch in batches:
            for doc_id, grams in zip(batch.column(0).to_pylist(), text_sets(batch.column(1), size)):
                group.add(doc_id, grams)
                if group.full():
                    yield _packed_batch(list(group.rows(group_id, fragments)))
                    group, group_id = _Group(), group_id + 1
        if group.ids:
            yield _packed_batch(list(group.rows(group_id, fragments)))
        del group
        trim()

    return df.mapInArrow(run, PACKED)


def _shared_in_fragment(frame: pd.DataFrame) -> pd.DataFrame:
    """Per group, the n-grams of one fragment that other sets have too, with their codes."""
    if frame["fragment"].iloc[0] < 0:
        return frame
    parts = [_unpack(*row) for row in zip(frame["high"], frame["low"], frame["sets"])]
    grams = np.concatenate([g for g, _ in parts])
    owners = np.concatenate([s for _, s in parts])
    from_row = np.repeat(np.arange(len(parts)), [len(g) for g, _ in parts])
    several = owners > SEVERAL
    order = np.argsort(grams)
    ordered = grams[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.add.reduceat(np.where(several, owners - SEVERAL, 1)[order], first)
    codes = _code(counts, np.add.reduceat(several[order], first, dtype=np.int64) > 0)
    runs = np.diff(first, append=len(ordered))
    code = np.empty(len(grams), dtype=np.uint8)
    code[order] = np.repeat(np.where(counts > 1, codes, 0), runs)
    kept = np.flatnonzero(code)
    out = []
    cuts = np.searchsorted(from_row[kept], np.arange(len(parts) + 1))
    for i, group_id in enumerate(frame["group_id"].tolist()):
        own = kept[cuts[i] : cuts[i + 1]]
        if len(own):
            out.append((-1 - group_id, -2, group_id, *_pack(grams[own], owners[own]), code[own].tobytes()))
    return pd.DataFrame(out, columns=list(frame.columns))


def _coded(rest: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, n-gram, code) of the shared n-grams of one group."""
    grams, sets, codes, direct = [], [], [], []
    for high, low, owners, own_codes in zip(rest["high"], rest["low"], rest["sets"], rest["codes"]):
        g, s = _unpack(high, low, owners)
        if len(own_codes):
            grams.append(g), sets.append(s), codes.append(np.frombuffer(own_codes, np.uint8))
        else:
            direct.append((g, s))
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    grams, sets, codes = np.concatenate(grams), np.concatenate(sets), np.concatenate(codes)
    several = sets > SEVERAL
    known = np.argsort(grams[several])
    known_grams, known_codes = grams[several][known], codes[several][known]
    all_grams, all_sets, all_codes = [grams[~several]], [sets[~several]], [codes[~several]]
    for g, s in direct:
        all_grams.append(g), all_sets.append(s)
        all_codes.append(known_codes[np.searchsorted(known_grams, g)])
    return np.concatenate(all_sets), np.concatenate(all_grams), np.concatenate(all_codes)


def _candidates(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Documents of one group, and its sets that share enough n-grams to link."""
        trim()
        meta = frame[frame["fragment"] == -1].iloc[0]
        count = len(meta["low"]) // 16
        ids = np.frombuffer(meta["high"], "<i8", count)
        nulls = np.frombuffer(meta["high"], np.uint8, count, 8 * count).astype(bool)
        sizes = np.frombuffer(meta["high"], "<i8", count, 9 * count)
        signatures = [meta["low"][16 * i : 16 * i + 16] for i in range(count)]
        docs = pd.DataFrame(
            {
                "kind": "doc",
                "doc_id": pd.array(np.where(nulls, 0, ids), dtype="Int64"),
                "n": sizes,
                "sig": signatures,
                "grams": None,
                "codes": None,
            }
        )
        docs.loc[nulls, "doc_id"] = pd.NA
        number: dict[bytes, int] = {}
        for sig, size in zip(signatures, sizes.tolist()):
            if size and sig not in number:
                number[sig] = size
        sets, grams, codes = _coded(frame[frame["fragment"] == -2])
        order = np.argsort(sets, kind="stable")
        grams, codes = grams[order], codes[order]
        cuts = np.searchsorted(sets[order], np.arange(len(number) + 1))
        kept = []
        for i, (sig, size) in enumerate(number.items()):
            own = slice(cuts[i], cuts[i + 1])
            if 100 * (cuts[i + 1] - cuts[i]) >= percent * size:
                kept.append(("set", None, size, sig, grams[own].astype("<u8").tobytes(), codes[own].tobytes()))
        if not kept:
            return docs
        found = pd.DataFrame(kept, columns=list(docs.columns))
        found["doc_id"] = found["doc_id"].astype("Int64")
        return pd.concat([docs, found], ignore_index=True)

    return run


def _distinct_sets(sets: DataFrame, percent: int, fragments: int) -> DataFrame:
    """One row per set with what it shares with different sets: its segments, and the
    first n-grams of the global order, of which linked sets have one in common.
    """
    once = sets.groupBy("sig").agg(
        F.count(F.lit(1)).alias("copies"),
        F.first("n").alias("n"),
        F.first(F.struct("grams", "codes")).alias("own"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(fragments)
        for batch in batches:
            out: list[tuple] = []
            for sig, copies, n, raw, raw_codes in zip(*(column.to_pylist() for column in batch.columns)):
                grams, codes = np.frombuffer(raw, "<u8"), np.frombuffer(raw_codes, np.uint8)
                # an n-gram in no more tasks than the set itself is in no other set
                other = (codes >= 128) | (codes > copies)
                grams, codes = grams[other], codes[other]
                if 100 * len(grams) < percent * n:
                    continue
                first = len(grams) - -(-percent * n // 100) + 1
                prefix = grams[np.lexsort((grams, codes))[:first]].astype(np.int64)
                grams = np.sort(grams)
                cuts = [*np.searchsorted(grams, bounds).tolist(), len(grams)]
                segments = [grams[a:b].astype("<u8").tobytes() for a, b in zip(cuts, cuts[1:])]
                out.append((sig, n, len(grams), segments, prefix))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["sig", "n", "m", "segments", "prefix"]
                )

    return once.select("sig", "copies", "n", "own.grams", "own.codes").mapInArrow(run, SETS)


def _overlaps(both: DataFrame) -> DataFrame:
    """``a, b, part``: n-grams that two segments have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            counts = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), assume_unique=True))
                for x, y in zip(one, two)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["a", "b", "part"]
            )

    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long, part long")


def _links(pairs: DataFrame, sizes: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link, by partial overlaps summed over the fragments."""
    n = lambda side: sizes.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"))
    one = segments.select(F.col("sid").alias("a"), "fragment", F.col("segment").alias("one"))
    two = segments.select(F.col("sid").alias("b"), "fragment", F.col("segment").alias("two"))
    both = pairs.join(one, "a").join(two, ["b", "fragment"])
    total = _overlaps(both).groupBy("a", "b").agg(F.sum("part").alias("common"))
    summed = total.join(n("a"), "a").join(n("b"), "b")
    linked = summed.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return write_table(linked.select("a", "b"), "ngram-links")


def _apart(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings, with the ``root`` of each set, of n-grams whose sets are not all connected."""
    named = postings.drop("root").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("root", F.coalesce("root", "sid"))
    named = write_table(named, "ngram-postings")
    spans = named.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return named.join(spans.filter("low <> high").select("gram"), "gram", "left_semi")


def _meeting(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` of sets under one n-gram that are apart and may link.

    With ``least`` n-grams to have in common, their first common one is among the first
    ``n - least + 1`` of either set.
    """
    one = left.select("gram", *(F.col(c).alias(f"{c}_1") for c in ("sid", "n", "m", "place", "root")))
    two = right.select("gram", *(F.col(c).alias(f"{c}_2") for c in ("sid", "n", "m", "place", "root")))
    least = F.ceil(percent * (F.col("n_1") + F.col("n_2")) / (100 + percent))
    early = (F.col("place_1") <= F.col("n_1") - least) & (F.col("place_2") <= F.col("n_2") - least)
    on = (F.col("root_1") != F.col("root_2")) & (F.least("m_1", "m_2") >= least) & early
    met = one.join(two.withColumnRenamed("gram", "other"), (F.col("gram") == F.col("other")) & on)
    return met.select(F.least("sid_1", "sid_2").alias("a"), F.greatest("sid_1", "sid_2").alias("b")).distinct()


def join_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, root`` of the sets (``sid, n, m, segments, prefix``) that link with another one.

    ``m`` is how many of its ``n`` n-grams a set shares with any other one.
    """
    # places count from 0, after the n-grams that no other set has
    place = F.col("at") + F.col("n") - F.col("m")
    postings = sets.select(F.posexplode("prefix").alias("at", "gram"), "sid", "n", "m")
    postings = postings.select("gram", "sid", "n", "m", place.alias("place"), F.col("sid").alias("root"))
    postings = write_table(postings, "ngram-postings")
    sizes = sets.select("sid", "n")
    segments = sets.select("sid", F.posexplode("segments").alias("fragment", "segment"))
    segments = segments.filter(F.octet_length("segment") > 0)
    links: DataFrame | None = None
    tested: DataFrame | None = None
    apart = postings
    for turn in range(TURNS):
        # one set of each n-gram speaks for it: the least number, after a flip of bits
        flip = F.lit((turn << 55) | (turn * FLIP & LOW_BITS))
        spoken = apart.groupBy("gram").agg(F.min(F.col("sid").bitwiseXOR(flip)).bitwiseXOR(flip).alias("sid"))
        pairs = _meeting(apart, apart.join(spoken, ["gram", "sid"]), percent)
        links, tested, roots = _settle(pairs, links, tested, sizes, segments, percent)
        apart = _apart(postings, roots)
    return _settle(_meeting(apart, apart, percent), links, tested, sizes, segments, percent)[2]


def _settle(pairs, links, tested, sizes, segments, percent) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links, all compared pairs and the components after comparing ``pairs``."""
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = write_table(pairs, "ngram-compared")
    found = _links(pairs, sizes, segments, percent)
    links = found if links is None else links.union(found)
    tested = pairs if tested is None else tested.union(pairs)
    return links, tested, write_table(components(links), "ngram-components")


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    percent: int = PERCENT,
    fragment_grams: int = FRAGMENT_GRAMS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``df``."""
    spark = df.sparkSession
    narrow = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(16, total // (6 * fragment_grams))
    shared = _segments(narrow, size, fragments).groupBy("route").applyInPandas(_shared_in_fragment, PACKED)
    parts = shared.groupBy("group_id").applyInPandas(_candidates(percent), PARTS)
    path = write_parts(parts, "ngram-parts", "kind")
    docs = read_parts(spark, parts, path, "kind", "doc").select("doc_id", "n", "sig")
    sets = read_parts(spark, parts, path, "kind", "set").select("n", "sig", "grams", "codes")
    sets = _distinct_sets(sets, percent, VERIFY_FRAGMENTS)
    own = F.floor((F.col("n") - F.col("m")) * 255 / F.col("n")).cast("long")
    number = F.shiftleft(own, 55) + F.monotonically_increasing_id()
    sets = write_table(sets.withColumn("sid", number), "ngram-sets")
    roots = join_sets(sets, percent)
    named = sets.select("sid", "sig").join(roots.withColumnRenamed("node", "sid"), "sid")
    names = sets.select(F.col("sid").alias("root"), F.col("sig").alias("class"))
    classes = named.join(names, "root").select("sig", "class")
    full = docs.filter("n > 0").join(classes, "sig", "left")
    full = write_table(
        full.select("doc_id", "n", F.coalesce("class", "sig").alias("class")), "ngram-classes"
    )
    # written, so that a class of very many rows can be split in the join
    least = write_table(full.groupBy("class").agg(F.min("doc_id").alias("component_id")), "ngram-least")
    linked = full.join(least, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = docs.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)
