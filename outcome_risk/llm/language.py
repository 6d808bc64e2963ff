"""Language identification by compression.

For each language two zstandard raw-content dictionaries are filled with sampled text. A text,
lower-cased, cut to its words and without immediate repeats of a word, is compressed with
both dictionaries of every language, in blocks of equal size so that a dictionary counts as
much at the end of a long text as at its start. The smallest sum of sizes names the language.
The margin is what the next language takes more. A margin under ``min_margin`` bytes, or
under ``min_ratio`` of the smallest sum, is narrow and the prediction is rejected: in a text
of no learnt language the margin stays a small part of the size, however long the text is.
The score is 0.5 for equal sums, 0.75 at ``MIN_RATIO``, and nears 1 as the ratio grows.

The sample is bounded: of the distinct texts of a language the ``sample_rows`` of smallest
hash, of each at most ``sample_bytes`` characters picked by hash, and ``dictionary_bytes`` per
dictionary. Copies count once, so every language has a dictionary. A task holds the
compressors of ``MAX_LANGUAGES`` languages at a time, however many there are.
Labelled rows with a null language or text are not learnt from. Texts that are null or
without a letter get ``und``, score 0, and are rejected. Ties between languages go to the
first name. Without any labelled row every text is ``und``. Repeated rows are treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcome_risk.llm.storage import write_table
from outcome_risk.llm.worker import keep, trim

UND = "und"
LEVEL = 6
BLOCK_BYTES = 4096
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 500
SAMPLE_BYTES = 600
MAX_LANGUAGES = 200
MIN_MARGIN = 1
#: Between the ratios of random Latin letters (200 of 200 at 200 characters and as many at 1000 are
#: below) and of texts of the learning folds of sf0.1 (the least but ties is 0.046).
MIN_RATIO = 0.04
LETTER = regex.compile(r"\p{L}")
_BETWEEN = re.compile(r"[\W\d_]+")


def plain_words(text: str) -> bytes:
    """Lower-cased words in order, a word that follows itself once."""
    return " ".join(word for word, _ in groupby(_BETWEEN.split(text.lower()))).encode("utf-8")


def fit_dictionaries(
    labelled: DataFrame,
    text: str = "text",
    language: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, list[bytes]]:
    """Contents of two dictionaries by language, from a bounded sample picked by text hash."""
    rows = labelled.select(F.col(f"`{language}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter("lang is not null and text is not null and length(text) > 0")
    # distinct texts by their hashes alone; of a large language only the lower end is ranked
    hashed = write_table(rows.select("lang", F.xxhash64("text").alias("h")).distinct(), "language-texts")
    sizes = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.col("h") / F.lit(2.0**64) + 0.5
    low = hashed.join(F.broadcast(sizes), "lang").filter(place <= F.lit(4.0 * sample_rows + 1000) / F.col("n"))
    ranked = low.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    cuts = ranked.filter(F.col("rank") <= sample_rows).groupBy("lang").agg(F.max("h").alias("cut"))
    cuts = write_table(cuts, "language-cuts")
    length = F.length("text")
    start = F.pmod(F.xxhash64(F.lit("start"), "text"), F.greatest(length - sample_bytes, F.lit(0)) + 1) + 1
    piece = F.substr("text", start.cast("int"), F.lit(sample_bytes)).alias("piece")
    # one row per language, so the cuts are small at any size of the table
    picked = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(cuts), "lang").filter("h <= cut")
    picked = picked.select("lang", "h", piece).dropDuplicates(["lang", "h"]).orderBy("lang", "h")
    dictionaries = {}
    for lang, found in groupby(picked.toLocalIterator(), key=lambda row: row["lang"]):
        own = [row["piece"] for row in found]
        dictionaries[lang] = [_fill(own[0::2], dictionary_bytes), _fill(own[1::2] or own, dictionary_bytes)]
    return dictionaries


def _fill(pieces: list[str], size: int) -> bytes:
    content, total = [], 0
    for piece in pieces:
        raw = plain_words(piece)
        if total + len(raw) + 1 > size:
            raw = raw[: max(0, size - total - 1)]
        content.append(raw)
        total += len(raw) + 1
        if total >= size:
            break
    return b"\n".join(content) + b"\n"


def _compressor(content: bytes):
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=BLOCK_BYTES,
        dict_size=len(content),
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


class Classifier:
    """Compressors of all languages, of ``MAX_LANGUAGES`` at a time."""

    def __init__(self, dictionaries: dict[str, list[bytes]]):
        self.languages = sorted(dictionaries)
        self.dictionaries = dictionaries
        self.blocks = [self.languages[i : i + MAX_LANGUAGES] for i in range(0, len(self.languages), MAX_LANGUAGES)]
        self.held = self._pairs(self.blocks[0]) if len(self.blocks) == 1 else None

    def _pairs(self, block: list[str]) -> list[tuple]:
        return [tuple(_compressor(content) for content in self.dictionaries[lang]) for lang in block]

    def predict_all(
        self, texts: list[str | None], min_margin: int, min_ratio: float = MIN_RATIO
    ) -> list[tuple[str, float, int, bool]]:
        """Language, score, margin in bytes, rejected, of every text."""
        known = [bool(t) and bool(self.languages) and LETTER.search(t) is not None for t in texts]
        sizes: list[list[int]] = [[] for _ in texts]
        if len(self.languages) > 1:
            for block in self.blocks:
                pairs = self.held or self._pairs(block)
                for text, use, own in zip(texts, known, sizes):
                    if use:
                        own += _sizes(plain_words(text), pairs)
        return [
            self._decide(text, own, min_margin, min_ratio) if use else (UND, 0.0, 0, True)
            for text, use, own in zip(texts, known, sizes)
        ]

    def predict(self, text: str | None, min_margin: int, min_ratio: float = MIN_RATIO) -> tuple[str, float, int, bool]:
        return self.predict_all([text], min_margin, min_ratio)[0]

    def _decide(self, text: str, sizes: list[int], min_margin: int, min_ratio: float) -> tuple[str, float, int, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, len(plain_words(text)), False
        best, margin = _best(sizes)
        ratio = margin / max(1, sizes[best])
        rejected = margin < min_margin or ratio < min_ratio
        return self.languages[best], 1.0 - 0.5 ** (1 + ratio / MIN_RATIO), margin, rejected


def _sizes(raw: bytes, pairs: list[tuple]) -> list[int]:
    """Compressed bytes by language, summed over its dictionaries."""
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    return [sum(len(compress(block)) for compress in pair for block in blocks) for pair in pairs]


def _best(sizes: list[int]) -> tuple[int, int]:
    """The smallest size's place, the first of equals, and its distance to the next."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    return order[0], sizes[order[1]] - sizes[order[0]]


def identify(
    df: DataFrame,
    dictionaries: dict[str, list[bytes]],
    text: str = "text",
    min_margin: int = MIN_MARGIN,
    keep_text: bool = True,
    min_ratio: float = MIN_RATIO,
) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``margin`` (bytes) and ``rejected``."""
    added = ("lang_pred", "score", "margin", "rejected")
    base = df.drop(*added)
    kept = [f for f in base.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]
    schema = base.select(*(F.col(f"`{n}`") for n in names)).schema
    for name, kind in zip(added, ("string", "double", "long", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = keep("classifier", dictionaries, lambda: Classifier(dictionaries))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            # few texts as Python strings at a time, unless compressors are made anew for each turn
            step = 64 if classifier.held else max(1, len(texts))
            found = []
            for i in range(0, len(texts), step):
                found += classifier.predict_all(texts.slice(i, step).to_pylist(), min_margin, min_ratio)
            lang, score, margin, rejected = zip(*found) if found else ((), (), (), ())
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [
                pa.array(lang, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(margin, pa.int64()),
                pa.array(rejected, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])
        trim()

    return base.mapInArrow(run, schema)


def held_out(key: str, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id as text falls on the fold; a null id never does."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == fold, F.lit(False))
