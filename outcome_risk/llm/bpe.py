"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

An automaton over the vocabulary reports, for every prefix of a pre-token, all vocabulary
strings that are a suffix of it. BPE gives each prefix one last token: the suffix match
whose left neighbour, the last token of the remaining prefix, stays apart from it when
both are merged side by side. That last token is stored per prefix, and following the
stored tokens back from the end emits the ids. Time is linear in the length of the text.

Null texts encode as empty ones; empty texts give no ids. Rows that repeat are encoded
alike, columns of the input stay as they are, and a column named like the result is
replaced. Decoding skips null and unknown ids, and invalid UTF-8 becomes U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from outcome_risk.llm.pretokens import PRETOKEN, Remembered, lookup, special_splitter, unit_memory
from outcome_risk.llm.worker import keep, trim

BATCH_BYTES = 1 << 19  # of ids that are put out together
IDS_AT_ONCE = 1 << 19  # that are shown together; a longer text is shown in parts
PAIRS_KEPT = 200_000
PIECES_KEPT = 50_000
SHORT = 32


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and special strings of one byte-level BPE file."""

    def __init__(self, definition: dict):
        model, before = definition["model"], definition["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without prefix space is supported")
        if definition["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("normalizers, ignore_merges and dropout are not supported")
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in definition["added_tokens"]}
        self.text: dict[int, bytes] = {}
        for token, number in model["vocab"].items():
            if token not in self.special:
                self.text[number] = bytes(alphabet[c] for c in token)
        names = {number: token for token, number in model["vocab"].items()}
        numbers = {token: number for number, token in names.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = numbers[left + right]
            key = numbers[left], numbers[right]
            self.merges.setdefault(key, (rank, made))
            self.parts.setdefault(made, (rank, *key))
        self.bytes = [0] * 256
        for number, text in self.text.items():
            if len(text) == 1 and number not in self.parts:
                self.bytes[text[0]] = number
        self.table: dict[int, bytes] = {}
        largest = max([*self.text, *self.special.values()], default=0)
        #: Array type of the narrowest width that holds every id.
        self.id_kind = "H" if largest < 1 << 16 else "I"
        #: By id: rank of its merge (-1: none) and its two parts; by pair of ids: rank of their merge.
        self.width = largest + 1
        self.rank, self.left, self.right = ([-1] * self.width for _ in range(3))
        for made, (rank, left, right) in self.parts.items():
            self.rank[made], self.left[made], self.right[made] = rank, left, right
        self.pair_rank = {left * self.width + right: rank for (left, right), (rank, _) in self.merges.items()}
        #: Strings that alone encode as one token, proven by merging each of them.
        self.whole = {text: number for number, text in self.text.items() if self.merge(text) == [number]}

    @property
    def ids_are_ranks(self) -> bool:
        """Whether merging by id is merging by rank, as rank-based encoders assume."""
        made = [(rank, number) for number, (rank, _, _) in self.parts.items()]
        numbers = [number for _, number in sorted(made)]
        return numbers == sorted(numbers) and (not numbers or numbers[0] > max(self.bytes))

    def ranked(self) -> tiktoken.Encoding:
        """A rank-based library encoder of this vocabulary, without its special strings."""
        if not self.ids_are_ranks:
            raise ValueError("ids of merged tokens do not follow their ranks")
        ranks = {text: number for number, text in self.text.items()}
        return tiktoken.Encoding("ranked", pat_str=PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merging neighbours, lowest rank and leftmost first."""
        ids = [self.bytes[b] for b in piece]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        merges = self.merges
        while len(ids) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                found = merges.get(pair)
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, count = self.merges, len(ids)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heap = [(rank, i, made, p) for rank, made, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= count or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = made, None
            after[i] = after[j]
            if after[i] < count:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < count and (pair := (ids[a], ids[b])) in merges:
                    rank, made = merges[pair]
                    heapq.heappush(heap, (rank, a, made, pair))
        return [i for i in ids if i is not None]

    def decode(self, ids: list) -> str:
        """The text of token ids; null and unknown ones are skipped."""
        if not self.table:
            self.table = {number: s.encode("utf-8") for s, number in self.special.items()} | self.text
        found = map(self.table.get, ids)
        try:
            raw = b"".join(found)
        except TypeError:
            raw = b"".join(text for text in map(self.table.get, ids) if text)
        return raw.decode("utf-8", "replace")

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are not merged across their border.

        Undoing the later of the two outer merges step by step gives every pair of
        pieces that ever met at the border; none may merge before its own outer merge.
        On equal ranks the left place goes first.
        """
        rank, width, found = self.rank, self.width, self.pair_rank.get
        limit, right_side = len(self.merges), False
        while True:
            met = found(left * width + right, limit + 1)
            if met < limit or (met == limit and right_side):
                return False
            rank_left, rank_right = rank[left], rank[right]
            if rank_left > rank_right:
                limit, right_side, left = rank_left, False, self.right[left]
            elif rank_right >= 0:
                limit, right_side, right = rank_right, True, self.left[right]
            else:
                return True


class Ragged:
    """Byte strings by number, put together for whole arrays of numbers."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of the numbers on end, and where each of them ends."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.flat[places], ends


class Shown:
    """Digests of ids as decimal text, and of the text that they stand for."""

    def __init__(self, vocabulary: Vocabulary):
        table = {number: s.encode("utf-8") for s, number in vocabulary.special.items()} | vocabulary.text
        self.decimal = Ragged([b"%d," % i for i in range(vocabulary.width)])
        self.text = Ragged([table.get(i, b"") for i in range(vocabulary.width)])

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, str]]:
        """Of documents whose ids end at ``ends``, together few enough to be shown at once."""
        (decimal, at), (raw, to) = self.decimal.take(ids), self.text.take(ids)
        decimal, raw = decimal.tobytes(), raw.tobytes()
        at, to = (np.concatenate([[0], x])[np.concatenate([[0], ends])].tolist() for x in (at, to))
        for i in range(len(ends)):
            told = decimal[at[i] : max(at[i], at[i + 1] - 1)]
            text = raw[to[i] : to[i + 1]].decode("utf-8", "replace")
            yield hashlib.sha256(told).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()

    def long_digests(self, ids: np.ndarray) -> tuple[str, str]:
        """Of one document, a bounded number of ids at once."""
        told, text, decoder = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for start in range(0, len(ids), IDS_AT_ONCE):
            some = ids[start : start + IDS_AT_ONCE]
            last = start + len(some) == len(ids)
            told.update(self.decimal.take(some)[0].tobytes()[: -1 if last else None])
            text.update(decoder.decode(self.text.take(some)[0].tobytes(), last).encode("utf-8"))
        return told.hexdigest(), text.hexdigest()


class Encoder:
    """Per-worker encoder of one vocabulary, with bounded memories."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cut = special_splitter(vocabulary.special)
        self.matches = ahocorasick.Automaton()
        for text, number in vocabulary.whole.items():
            self.matches.add_word(text.decode("latin-1"), (len(text), number))
        self.matches.make_automaton()
        self.length = {number: len(text) for text, number in vocabulary.whole.items()}
        self.width, self.kind = vocabulary.width, vocabulary.id_kind
        #: Whether two tokens stay apart, for pairs met since it was last emptied.
        self.apart: dict[int, bool] = {}
        self.pieces = Remembered(lambda token: self.piece(token.encode("utf-8")), PIECES_KEPT)
        self.memory = unit_memory(self.unit)
        self.shown = Shown(vocabulary)

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (alone := self.vocabulary.whole.get(piece)) is not None:
            return [alone]
        last = [-1] * (len(piece) + 1)
        known, width, stay_apart = self.apart, self.width, self.vocabulary.stay_apart
        answer = known.get
        for end, (length, token) in self.matches.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if length < end:
                left = last[end - length]
                pair = left * width + token
                apart = answer(pair)
                if apart is None:
                    apart = known[pair] = stay_apart(left, token)
                if not apart:
                    continue
            last[end] = token
        if len(known) > PAIRS_KEPT:
            known.clear()
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= self.length[last[at]]
        return ids[::-1]

    def unit(self, unit: str) -> bytes:
        """Ids of an independent piece of text, in the vocabulary's width."""
        ids: list[int] = []
        special = self.vocabulary.special
        for part in self.cut(unit):
            if part in special:
                ids.append(special[part])
            else:
                for token in PRETOKEN.findall(part):
                    ids.extend(self.pieces[token])
        return array(self.kind, ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, in the vocabulary's width."""
        return b"".join(lookup(text, self.memory)) if text else b""

    def ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of encoded texts on end, and where each text's end."""
        ids = np.frombuffer(b"".join(parts), dtype=self.kind)
        return ids, np.cumsum([len(p) for p in parts]) // ids.itemsize


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process and broadcast vocabulary."""
    return keep("bpe encoder", vocabulary, lambda: Encoder(vocabulary))


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The vocabulary at ``path``, read by the driver; its size is bounded by the file's."""
    return spark.sparkContext.broadcast(Vocabulary.load(path))


def schema_with(df: DataFrame, name: str, kind: T.DataType, without: tuple[str, ...] = ()) -> T.StructType:
    """The schema of ``df`` with a last column ``name``."""
    return T.StructType(
        [f for f in df.schema.fields if f.name != name and f.name not in without] + [T.StructField(name, kind)]
    )


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """Add the column ``ids`` (array of int) with the token ids of ``text``."""
    shared = broadcast_vocabulary(df.sparkSession, path)
    schema = schema_with(df, ids, T.ArrayType(T.IntegerType()), () if keep_text else (text,))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            start, parts, count = 0, [], 0
            for i, value in enumerate(texts):
                parts.append(encoder.encode(value.as_py()))
                count += len(parts[-1])
                if count >= BATCH_BYTES or i + 1 == len(texts):
                    yield _with_lists(batch.slice(start, i + 1 - start), kept, ids, *encoder.ids(parts))
                    start, parts, count = i + 1, [], 0

    return df.mapInArrow(run, schema)


def _with_lists(batch: pa.RecordBatch, kept: list[str], name: str, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
    columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
    return pa.RecordBatch.from_arrays([*columns, lists], names=[*kept, name])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column ``text`` with the text that the token ids stand for."""
    shared = broadcast_vocabulary(df.sparkSession, path)
    schema = schema_with(df, text, T.StringType())
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [vocabulary.decode(value.as_py() or []) for value in lists]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*kept, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode every text and decode its ids again, in one pass that ships neither.

    Replaces ``text`` by ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas)
    and ``decoded_sha256`` (of the decoded text in UTF-8).
    """
    shared = broadcast_vocabulary(df.sparkSession, path)
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    schema = T.StructType([f for f in df.schema.fields if f.name not in (*added, text)])
    kept = list(schema.names)
    schema = schema.add("n_tokens", T.LongType()).add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            parts, size, start = [], 0, 0
            texts = batch.column(batch.schema.get_field_index(text))
            for i, value in enumerate(texts):
                parts.append(encoder.encode(value.as_py()))
                size += len(parts[-1])
                if size >= BATCH_BYTES or i + 1 == len(texts):
                    yield _digested(encoder, batch.slice(start, i + 1 - start), kept, added, parts)
                    parts, size, start = [], 0, i + 1
        trim()

    return df.mapInArrow(run, schema)


def _digested(encoder: Encoder, batch: pa.RecordBatch, kept: list[str], added: tuple, parts: list[bytes]) -> pa.RecordBatch:
    ids, ends = encoder.ids(parts)
    if len(ids) > IDS_AT_ONCE:
        starts = np.concatenate([[0], ends[:-1]])
        digests = [encoder.shown.long_digests(ids[a:b]) for a, b in zip(starts, ends)]
    else:
        digests = list(encoder.shown.digests(ids, ends))
    told, text = zip(*digests)
    columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
    columns += [pa.array(np.diff(ends, prepend=0)), pa.array(told, pa.string()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*kept, *added])
