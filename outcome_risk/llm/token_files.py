"""Token ids in binary shards with constant-time keyed access.

Documents are ordered by key over the whole table and written as shards of one folder,
one Parquet row each, so that every store Spark writes to is supported and a lost task
leaves nothing behind. A shard holds

* ``payload``: the raw ids of its documents, one after the other, little-endian, 16 bits
  each if every id of the vocabulary fits, else 32;
* ``levels``: a minimal perfect hash of its keys, bit arrays of a few levels: a key is
  placed on the first level where no other key shares its bit, and its slot is the number
  of set bits before it;
* per slot: ``prints`` (32-bit fingerprints, stored so that absent keys are told apart),
  ``places`` (first document with that key) and ``repeats`` (how many have it);
* per document: ``ends``, where its ids end in the payload; ``keys``, for reading all.

Keys are integers. A null key comes first in the order and is a key of its own; rows with
equal keys follow each other in the order of their texts and are all found by their key.
A null or empty text has the end id only. An empty table gives no shards.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcome_risk.llm.bpe import Encoder, Vocabulary, broadcast_vocabulary
from outcome_risk.llm.pretokens import lookup, special_splitter, unit_memory
from outcome_risk.llm.worker import keep
from outcome_risk.llm.storage import write_table
from outcome_risk.llm.textscan import mix

END_ID = 0
UNITS_KEPT = 250_000  # some 160 bytes each, in two generations
SHARD_IDS = 1 << 20
GAMMA = 2
NULL_KEY = np.uint64(0x6A09E667F3BCC909)

SHARD = (
    "shard int, part int, first_key long, last_key long, width int, n_ids long, payload binary, "
    "levels array<binary>, prints binary, places binary, repeats binary, ends binary, "
    "keys binary, nulls int"
)


class RankedEncoder:
    """Ids of texts by a rank-based library encoder, remembered per unit."""

    def __init__(self, vocabulary: Vocabulary):
        self.special = vocabulary.special
        self.kind = vocabulary.id_kind
        self.cut = special_splitter(vocabulary.special)
        self.ranked = vocabulary.ranked().encode_ordinary
        self.memory = unit_memory(self.unit, UNITS_KEPT)

    def unit(self, unit: str) -> bytes:
        parts = self.cut(unit)
        if len(parts) == 1 and unit not in self.special:
            return array(self.kind, self.ranked(unit)).tobytes()
        ids: list[int] = []
        for part in parts:
            ids.extend([self.special[part]] if part in self.special else self.ranked(part))
        return array(self.kind, ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, in the vocabulary's width."""
        return b"".join(lookup(text, self.memory)) if text else b""


def _encoder(vocabulary: Vocabulary) -> RankedEncoder | Encoder:
    kind = RankedEncoder if vocabulary.ids_are_ranks else Encoder
    return keep("file encoder", vocabulary, lambda: kind(vocabulary))


def key_hashes(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """64-bit hashes of integer keys; different keys differ, a null is a value of its own."""
    hashes = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(1))
    hashes[nulls] = NULL_KEY
    return hashes


def _bit(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(hashes + salt) % np.uint64(size)).astype(np.int64)


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xBB67AE8584CAA73B)) >> np.uint64(32)).astype("<u4")


def build_levels(hashes: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct hashes."""
    levels, rest = [], hashes
    while len(rest):
        size = 8 * ((GAMMA * len(rest) + 7) // 8)
        bits = _bit(rest, len(levels), size)
        alone = np.bincount(bits, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[bits]]
    return levels


def find_slots(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Slot of every hash, -1 where no level holds it."""
    slots = np.full(len(hashes), -1, dtype=np.int64)
    before, rest = 0, np.arange(len(hashes))
    for level, held in enumerate(levels):
        ranks = np.cumsum(held) - held
        bits = _bit(hashes[rest], level, len(held))
        hit = held[bits]
        slots[rest[hit]] = before + ranks[bits[hit]]
        rest = rest[~hit]
        before += int(held.sum())
    return slots


def _shard_row(number: int, part: int, keys: list, payload: list[bytes], width: int) -> dict:
    nulls = np.array([k is None for k in keys], dtype=bool)
    numbers = np.array([0 if k is None else k for k in keys], dtype=np.int64)
    ends = np.cumsum([len(p) // width for p in payload]).astype("<i8")
    hashes = key_hashes(numbers, nulls)
    distinct, places, repeats = np.unique(hashes, return_index=True, return_counts=True)
    levels = build_levels(distinct)
    slots = find_slots(levels, distinct)
    order = np.argsort(slots)
    first, last = (keys[0], keys[-1]) if keys else (None, None)
    return {
        "shard": number,
        "part": part,
        "first_key": first,
        "last_key": last,
        "width": width,
        "n_ids": int(ends[-1]),
        "payload": b"".join(payload),
        "levels": [np.packbits(level).tobytes() for level in levels],
        "prints": _fingerprints(distinct[order]).tobytes(),
        "places": places[order].astype("<i8").tobytes(),
        "repeats": repeats[order].astype("<i8").tobytes(),
        "ends": ends.tobytes(),
        "keys": numbers.astype("<i8").tobytes(),
        "nulls": int(nulls.sum()),
    }


def write_tokens(
    df: DataFrame,
    folder: str,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Write the ids of ``text`` with ``end_id`` appended, in ascending order of ``key``.

    The text is what moves, before it is encoded: it is smaller than its ids. Ranges are
    cut over key and text together, so a key with very many rows spreads too.
    """
    shared = broadcast_vocabulary(df.sparkSession, path)
    kind = shared.value.id_kind
    end = array(kind, [end_id]).tobytes()
    width = array(kind).itemsize
    schema = pa.schema(
        [
            (f.name, {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.list_(pa.binary())))
            for f in _shard_schema(df.sparkSession)
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        number, part = TaskContext.get().partitionId(), 0
        keys: list = []
        payload: list[bytes] = []
        count = 0
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                payload.append(encoder.encode(value.as_py()) + end)
                count += len(payload[-1]) // width
                if count >= shard_ids:
                    yield pa.RecordBatch.from_pylist([_shard_row(number, part, keys, payload, width)], schema=schema)
                    keys, payload, count, part = [], [], 0, part + 1
        if keys:
            yield pa.RecordBatch.from_pylist([_shard_row(number, part, keys, payload, width)], schema=schema)

    narrow = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    salted = narrow.withColumn("tie", F.xxhash64("text"))
    ordered = salted.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text")
    ordered.select("key", "text").mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(folder)


def _shard_schema(spark: SparkSession):
    return spark.createDataFrame([], SHARD).schema


class Shard:
    """One shard row, opened."""

    def __init__(self, row: dict):
        self.levels = [np.unpackbits(np.frombuffer(b, dtype=np.uint8)).astype(bool) for b in row["levels"]]
        self.prints = np.frombuffer(row["prints"], dtype="<u4")
        self.places = np.frombuffer(row["places"], dtype="<i8")
        self.repeats = np.frombuffer(row["repeats"], dtype="<i8")
        self.ends = np.frombuffer(row["ends"], dtype="<i8")
        kind = "<u2" if row["width"] == 2 else "<u4"
        self.ids = np.frombuffer(row["payload"], dtype=kind)

    def rows(self, keys: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key, -1 and 0 for absent ones."""
        hashes = key_hashes(keys, nulls)
        slots = find_slots(self.levels, hashes)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == _fingerprints(hashes[found])
        first, count = np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        first[found], count[found] = self.places[slots[found]], self.repeats[slots[found]]
        return first, count

    def span(self, row: int) -> tuple[int, int]:
        return (int(self.ends[row - 1]) if row else 0), int(self.ends[row])


def shard_starts(shards: DataFrame) -> DataFrame:
    """Number of ids before every shard; one narrow row per shard."""
    before = W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)
    return shards.select(
        "shard", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before")
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: ``key, start, ids`` (unsigned 32-bit, little-endian).

    Keys are looked up through each shard's own index; the rows of a shard stay in place.
    """
    shards = spark.read.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _documents(batch.slice(i, 1).to_pylist()[0])

    # written first, so that the join goes by the true size of this one row per shard
    placed = shards.join(write_table(shard_starts(shards), "shard-starts"), ["shard", "part"])
    return placed.mapInArrow(run, "key long, start long, ids binary")


def _documents(row: dict) -> pa.RecordBatch:
    shard = Shard(row)
    keys = np.frombuffer(row["keys"], dtype="<i8")
    nulls = np.arange(len(keys)) < row["nulls"]
    change = np.ones(len(keys), dtype=bool)
    change[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
    at = np.flatnonzero(change)
    first, count = shard.rows(keys[at], nulls[at])
    if (first < 0).any():
        raise ValueError("a key of the shard is missing from its index")
    documents = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
    starts = np.concatenate([[0], shard.ends[:-1]])
    if (documents != np.arange(len(keys))).any():
        raise ValueError("the shard's index does not list its documents in order")
    offsets = pa.array(np.concatenate([[0], shard.ends]) * 4, pa.int64())
    ids = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(keys), [None, offsets.buffers()[1], pa.py_buffer(shard.ids.astype("<u4"))]
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, mask=nulls), pa.array(starts + row["before"]), ids.cast(pa.binary())], names=["key", "start", "ids"]
    )


def lookup_tokens(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of the wanted keys: ``key, ids``; absent keys give no row.

    A wanted key goes to the shards whose key range holds it, found by range in a sorted
    list of one entry per shard; the index in the shard answers in constant time.
    """
    shards = spark.read.parquet(folder)
    bounds = shards.select("shard", "part", "first_key", "last_key").orderBy("shard", "part").toPandas()
    # a null key is stored first, so it stands for the least number here
    low = bounds["first_key"].fillna(-(1 << 63)).astype("int64").to_numpy()
    high = bounds["last_key"].fillna(-(1 << 63)).astype("int64").to_numpy()
    numbers = np.array(list(zip(bounds["shard"].tolist(), bounds["part"].tolist())), dtype=np.int64).reshape(-1, 2)
    keys = wanted.select(F.col(f"`{key}`").cast("long").alias("key")).distinct()

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["key"].astype("Int64").fillna(-(1 << 63)).astype("int64").to_numpy()
            begin = np.searchsorted(high, values, side="left")
            stop = np.searchsorted(low, values, side="right")
            reps = np.maximum(stop - begin, 0)
            rows = np.repeat(np.arange(len(values)), reps)
            offset = np.arange(len(rows)) - np.repeat(np.cumsum(reps) - reps, reps)
            shard = begin[rows] + offset
            yield pd.DataFrame(
                {
                    "key": frame["key"].astype("Int64").iloc[rows].reset_index(drop=True),
                    "shard": numbers[shard, 0] if len(shard) else [],
                    "part": numbers[shard, 1] if len(shard) else [],
                }
            )

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys_out, ids_out = [], []
            for row in frame.to_dict("records"):
                shard = Shard(row)
                nulls = np.array([k is None or k != k for k in row["wanted"]], dtype=bool)
                values = np.array([0 if n else int(k) for k, n in zip(row["wanted"], nulls)], dtype=np.int64)
                for k, n, f, c in zip(values.tolist(), nulls.tolist(), *(x.tolist() for x in shard.rows(values, nulls))):
                    for document in range(f, f + c):
                        begin, end = shard.span(document)
                        keys_out.append(None if n else k)
                        ids_out.append(shard.ids[begin:end].astype("<u4").tobytes())
            yield pd.DataFrame({"key": pd.array(keys_out, dtype="Int64"), "ids": ids_out})

    routed = keys.mapInPandas(route, "key long, shard int, part int")
    # distinct keys, so a shard is asked for no more keys than it holds plus absent ones of its range
    asked = routed.groupBy("shard", "part").agg(F.transform(F.collect_list(F.struct("key")), lambda s: s["key"]).alias("wanted"))
    return shards.join(asked, ["shard", "part"]).mapInPandas(fetch, "key long, ids binary")


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    read = read_tokens(spark, folder)
    return read.select(
        F.col("key").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def crc_of(ids: list[int]) -> int:
    """The checksum of one document's ids, for tests."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
