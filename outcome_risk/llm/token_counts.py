"""Token counts without emitting ids, by the whole-token shortcut.

Which vocabulary strings encode alone as exactly one token is proven when the vocabulary
is loaded, by merging every one of them. A pre-token among them counts 1 directly; only
the others are merged. Counts of repeated units are remembered in bounded memory.

Null texts count as empty: no bytes, no tokens. A null limit is not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.llm.bpe import Vocabulary, broadcast_vocabulary, schema_with
from outcome_risk.llm.pretokens import PRETOKEN, lookup, special_splitter, unit_memory
from outcome_risk.llm.worker import keep

LIMIT = 1024
UNITS_KEPT = 250_000  # some 130 bytes each, in two generations


class Counter:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cut = special_splitter(vocabulary.special)
        self.memory = unit_memory(self.unit, UNITS_KEPT)
        self.merges = vocabulary.ranked().encode_ordinary

    def unit(self, unit: str) -> int:
        total = 0
        whole, special = self.vocabulary.whole, self.vocabulary.special
        for part in self.cut(unit):
            if part in special:
                total += 1
                continue
            for token in PRETOKEN.findall(part):
                total += 1 if token.encode("utf-8") in whole else len(self.merges(token))
        return total

    def count(self, text: str | None) -> int:
        return sum(lookup(text, self.memory)) if text else 0


def counter_of(vocabulary: Vocabulary) -> Counter:
    """One counter per worker process and broadcast vocabulary."""
    return keep("token counter", vocabulary, lambda: Counter(vocabulary))


def count_tokens(
    df: DataFrame, path: str, text: str = "text", limit: int = LIMIT, keep_text: bool = True
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    shared = broadcast_vocabulary(df.sparkSession, path)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    sized = df.drop("n_tokens", "over_limit").withColumn("n_bytes", size)
    schema = schema_with(sized, "n_tokens", T.LongType(), () if keep_text else (text,))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            counts = pa.array((counter.count(value.as_py()) for value in texts), pa.int64())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, counts], names=[*kept, "n_tokens"])

    return sized.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
