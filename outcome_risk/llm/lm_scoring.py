"""Language-model scores of whole texts: context-tree weighting, and a word unigram beside it.

Text is never joined with the model place by place. A block of documents asks for the
distinct contexts (and words) that it has, shards of contexts answer, and the block adds the
answers up. What a block asks for also carries how often its training documents have it, so
the model is gathered by the same exchange and grows with the corpus:

1. ``gather``: per block, the distinct contexts of its texts with training counts, by shard.
2. Shards merge the counts and weight their subtrees (contexts of three bytes and more, all
   with the same three nearest bytes in one shard, so a subtree never exceeds 2^24 numbers).
3. The depths above are aggregated by Spark; those of one byte and none, at most 257 x 255
   nodes, are finished on the driver and broadcast.
4. Shards answer every block with the log probability of each of its contexts.
5. Blocks add up their documents.

A null text is an empty one, which consists of its end. Rows that repeat are scored alike
and all count in training; a null ``held_out`` counts as training. An empty table gives an
empty result. Columns that bear the name of a result are replaced; the others stay, but the
text. A very long text is read in windows of bounded size, within the block that it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcome_risk.llm.ctw import Forest, context_keys, kt_one, log_kt, merged, stream, weighted
from outcome_risk.llm.storage import read_parts, write_parts, write_table
from outcome_risk.llm.textscan import SPACED, mix, text_slices, words_of
from outcome_risk.llm.worker import trim

DEPTH = 5
TOP = 3  # depth from which a shard holds whole subtrees
BLOCK_BYTES = 32 << 20
WINDOW_BYTES = 1 << 19  # of texts that are read at once, and places of a longer one
PENDING = 1_500_000  # numbers of windows that wait to be merged
SMOOTHING = 0.1
END = np.uint64(0xFFFFFFFFFFFFFFFF)  # stands for the end of a text among word hashes

RESULTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("bits_per_byte", T.DoubleType()),
    ]
)
_ASKED = "kind string, block long, shard int, a binary, b binary"
_ANSWERED = "block long, kind string, a binary, b binary, n long, v long"


def pack(values: np.ndarray, differences: bool) -> bytes:
    """Compressed numbers, byte planes apart; sorted ones as differences."""
    values = values.astype("<u8")
    if differences and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = values.view(np.uint8).reshape(-1, 8).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, differences: bool) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    values = np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(values, dtype=np.uint64) if differences else values


class Counted:
    """Distinct numbers with their training counts; what waits to be merged is bounded."""

    def __init__(self):
        self.parts, self.waiting = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0

    def add(self, numbers: np.ndarray, training: bool) -> None:
        found = pc.value_counts(pa.array(numbers.view(np.int64)))
        keys = found.field("values").to_numpy(zero_copy_only=False).view(np.uint64)
        counts = found.field("counts").to_numpy(zero_copy_only=False)
        self.parts.append((keys, counts if training else np.zeros_like(counts)))
        self.waiting += len(keys)
        if self.waiting > PENDING:
            self.parts, self.waiting = [self.whole()], 0

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(*(np.concatenate(p) for p in zip(*self.parts)))


def windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Context numbers of all places of some texts, text by text, a bounded number at once."""
    padded, counts = stream(data, offsets, DEPTH)
    for start in range(DEPTH, len(padded), WINDOW_BYTES):
        stop = min(start + WINDOW_BYTES, len(padded))
        yield context_keys(padded[start - DEPTH : stop], DEPTH)[counts[start:stop]]


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, each with its end, and where each text begins among them."""
    words = words_of(data, offsets, SPACED)
    return np.insert(words.hashes, words.first[1:], END), words.first + np.arange(len(words.first))


def _gather(text: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        grams, words = Counted(), Counted()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            training = batch.column(batch.schema.get_field_index("_training"))
            for first, data, offsets in text_slices(batch.column(at)):
                own = batch.slice(first, len(offsets) - 1)
                for flag in (True, False):
                    chosen = own.filter(pc.equal(training.slice(first, own.num_rows), flag))
                    for _, d, o in text_slices(chosen.column(at), WINDOW_BYTES):
                        for keys in windows(d, o):
                            grams.add(keys, flag)
                        words.add(token_hashes(d, o)[0], flag)
                yield _asked([("texts", block, 0, _written(own), b"")])
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield _requests(block, grams, words, shards)
                    trim()
                    block, size, grams, words = block + 1, 0, Counted(), Counted()
        if size or len(grams.parts) > 1:
            yield _requests(block, grams, words, shards)

    return run


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "block", "shard", "a", "b"])


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _requests(block: int, grams: Counted, words: Counted, shards: int) -> pa.RecordBatch:
    rows = []
    for kind, counted in (("grams", grams), ("words", words)):
        keys, counts = counted.whole()
        name = keys >> np.uint64(8 * (DEPTH + 1 - TOP)) if kind == "grams" else keys
        shard = (mix(name.copy()) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for own in np.split(order, cuts) if len(order) else ():
            rows.append((kind, block, int(shard[own[0]]), pack(keys[own], True), pack(counts[own], False)))
    return _asked(rows)


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All keys of a shard with their counts, and the keys of each asking block."""
    asked = [unpack(a, True) for a in table.column("a").to_pylist()]
    counts = np.concatenate([unpack(b, False) for b in table.column("b").to_pylist()]).astype(np.int64)
    keys, total = merged(np.concatenate(asked), counts)
    return keys, total, asked


def _subtrees(table: pa.Table) -> pa.Table:
    keys, counts, _ = _merge(table)
    context, node, zeros, ones, log_w = Forest(keys, counts, DEPTH, TOP).roots()
    shard = np.full(len(node), table.column("shard")[0].as_py(), dtype=np.int32)
    return pa.table({"shard": shard, "context": context, "node": node, "zeros": zeros, "ones": ones, "log_w": log_w})


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner nodes: the sum over their children becomes their own log weight, plus their estimate."""
    for batch in batches:
        zeros, ones, below = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("zeros", "ones", "log_w"))
        log_w, weight = weighted(log_kt(zeros, ones), below)
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        columns |= {"log_w": pa.array(log_w), "weight": pa.array(weight), "one": pa.array(kt_one(zeros, ones))}
        yield pa.RecordBatch.from_pydict(columns)


def _answers(table: pa.Table, above: pa.Table) -> pa.Table:
    keys, counts, asked = _merge(table)
    name = (above.column("context").to_numpy().astype(np.uint64) << np.uint64(8)) | above.column("node").to_numpy().astype(np.uint64)
    order = np.argsort(name)
    mass = np.stack([above.column(c).to_numpy()[order] for c in ("mass_0", "mass_1")])
    found = Forest(keys, counts, DEPTH, TOP).log10_probabilities(name[order], mass, above.column("rest").to_numpy()[order])
    sent = [pack(found[np.searchsorted(keys, k)].view(np.uint64), False) for k in asked]
    return _answered("gram", table, sent, 0, 0)


def _word_answers(table: pa.Table) -> pa.Table:
    keys, counts, asked = _merge(table)
    sent = [pack(counts[np.searchsorted(keys, k)], False) for k in asked]
    return _answered("word", table, sent, int(counts.sum()), int(np.count_nonzero(counts)))


def _answered(kind: str, table: pa.Table, sent: list[bytes], n: int, v: int) -> pa.Table:
    """An answer per asking block; the shard's sums stand in the first."""
    rows = len(sent)
    return pa.table(
        {
            "block": table.column("block"),
            "kind": pa.array([kind] * rows),
            "a": table.column("a"),
            "b": pa.array(sent, pa.binary()),
            "n": pa.array([n] + [0] * (rows - 1), pa.int64()),
            "v": pa.array([v] + [0] * (rows - 1), pa.int64()),
        }
    )


def _looked_up(answers: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All of a block's numbers of a kind, sorted, with what was answered."""
    own = answers.filter(pc.equal(answers.column("kind"), kind))
    keys = np.concatenate([unpack(a, True) for a in own.column("a").to_pylist()])
    values = np.concatenate([unpack(b, False) for b in own.column("b").to_pylist()])
    order = np.argsort(keys)
    return keys[order], values[order]


def _values(numbers: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    found = pa.array(numbers.view(np.int64)).dictionary_encode()
    own = values[np.searchsorted(keys, found.dictionary.to_numpy().view(np.uint64))]
    return own[found.indices.to_numpy()]


def _add_up(text: str, n: int, v: int, schema: T.StructType):
    names = schema.names

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        gram_keys, gram_values = _looked_up(answers, "gram")
        word_keys, word_values = _looked_up(answers, "word")
        gram_values, word_counts = gram_values.view(np.float64), word_values.astype(np.int64)
        word_scores = np.log10((word_counts + SMOOTHING) / (n + SMOOTHING * (v + 1)))
        out = []
        for blob in texts.column("a").to_pylist():
            batch = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()
            for own in batch:
                out.append(_scored(own, gram_keys, gram_values, word_keys, word_counts, word_scores))
            trim()
        return pa.concat_tables(out)

    def _scored(batch, gram_keys, gram_values, word_keys, word_counts, word_scores) -> pa.Table:
        rows = batch.num_rows
        score, base = np.zeros(rows), np.zeros(rows)
        n_bytes, n_tokens, n_known = (np.zeros(rows, dtype=np.int64) for _ in range(3))
        for first, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text)), WINDOW_BYTES):
            own = slice(first, first + len(offsets) - 1)
            n_bytes[own] = np.diff(offsets)
            ends, seen = np.cumsum(n_bytes[own] + 1), 0
            for numbers in windows(data, offsets):
                if not len(numbers):
                    continue
                found = _values(numbers, gram_keys, gram_values)
                low, high = np.searchsorted(ends, [seen, seen + len(numbers) - 1], side="right")
                starts = np.maximum(np.concatenate([[0], ends])[low : high + 1] - seen, 0)
                score[first + low : first + high + 1] += np.add.reduceat(found, starts)
                seen += len(numbers)
            tokens, begin = token_hashes(data, offsets)
            at = np.searchsorted(word_keys, tokens)
            n_tokens[own] = np.diff(begin)
            base[own] = np.add.reduceat(word_scores[at], begin[:-1])
            n_known[own] = np.add.reduceat((word_counts[at] > 0).astype(np.int64), begin[:-1])
        bits = np.where(n_bytes > 0, -score / np.log10(2.0) / np.maximum(n_bytes, 1), np.nan)
        made = {
            "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(rows, n, dtype=np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(score),
            "n_bytes": pa.array(n_bytes),
            "bits_per_byte": pa.array(bits, from_pandas=True),
        }
        kept = {f: batch.column(batch.schema.get_field_index(f)) for f in names if f not in made}
        return pa.table({f: made[f] if f in made else kept[f] for f in names})

    return run


def score_texts(df: DataFrame, held_out: str = "held_out", text: str = "text") -> DataFrame:
    """Learn from the rows that are not ``held_out`` and score all: the columns but the text, and ``RESULTS``.

    ``score`` is the log10 probability of the text's bytes and its end under the context
    trees, ``bits_per_byte`` the same as a code length (null for an empty text).
    ``base_score`` is that of its lower-cased words and its end under the smoothed unigram;
    ``n_known`` of its ``n_tokens`` are among the ``train_tokens`` of training.
    """
    spark = df.sparkSession
    df = df.drop(*RESULTS.names, "_training")
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + RESULTS.fields)
    ready = df.withColumn("_training", F.coalesce(~F.col(f"`{held_out}`").cast("boolean"), F.lit(True)))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = ready.mapInArrow(_gather(text, shards), _ASKED)
    path = write_parts(asked, "lm-asked", "kind")
    texts, grams, words = (read_parts(spark, asked, path, "kind", k) for k in ("texts", "grams", "words"))

    roots = write_table(
        grams.groupBy("shard").applyInArrow(
            _subtrees, "shard int, context long, node long, zeros long, ones long, log_w double"
        ),
        "lm-roots",
    )
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")]
    second = roots.groupBy("context", "node").agg(*sums).mapInArrow(
        _weigh, "context long, node long, zeros long, ones long, log_w double, weight double, one double"
    )
    second = write_table(second, "lm-second")
    first = second.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(*sums)
    outer = spark.createDataFrame(
        _outer(first.collect()), "outer long, node long, outer_0 double, outer_1 double, outer_rest double"
    )
    left = F.col("outer_rest")
    path_to = second.withColumn("outer", F.shiftright("context", 8)).join(F.broadcast(outer), ["outer", "node"]).select(
        "context",
        "node",
        (F.col("outer_0") + left * F.col("weight") * (1.0 - F.col("one"))).alias("mass_0"),
        (F.col("outer_1") + left * F.col("weight") * F.col("one")).alias("mass_1"),
        (left * (1.0 - F.col("weight"))).alias("rest"),
    )
    above = roots.select("shard", "context", "node").join(path_to, ["context", "node"])
    gram_answers = grams.groupBy("shard").cogroup(above.groupBy("shard")).applyInArrow(_answers, _ANSWERED)
    word_answers = words.groupBy("shard").applyInArrow(_word_answers, _ANSWERED)
    answers = write_table(gram_answers.unionByName(word_answers), "lm-answers")
    total = answers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    scored = _add_up(text, total["n"], total["v"], schema)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def _outer(rows: list) -> list[tuple]:
    """Mixture of the depths 0 and 1, for every byte before (at most 256) and decision (at most 255)."""
    if not rows:
        return []
    context, node, zeros, ones = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("context", "node", "zeros", "ones"))
    log_w, weight = weighted(log_kt(zeros, ones), np.array([r["log_w"] for r in rows]))
    root = {}
    for sums, values in (("zeros", zeros), ("ones", ones), ("log_w", log_w)):
        root[sums] = np.bincount(node, weights=values, minlength=256)
    _, root_weight = weighted(log_kt(root["zeros"].astype(np.int64), root["ones"].astype(np.int64)), root["log_w"])
    said = kt_one(root["zeros"], root["ones"])[node]
    w0, one = root_weight[node], kt_one(zeros, ones)
    mass_0 = w0 * (1 - said) + (1 - w0) * weight * (1 - one)
    mass_1 = w0 * said + (1 - w0) * weight * one
    rest = (1 - w0) * (1 - weight)
    return list(zip(context.tolist(), node.tolist(), mass_0.tolist(), mass_1.tolist(), rest.tolist()))
