"""How the sources of a language differ: exact triangular divergence of their term shares.

``CountVectorizer`` learns the vocabulary over terms marked by their language, so a term
must be in ``MIN_DOCS`` documents of its language and no vocabulary is capped. Its sparse
document vectors, made by the same vocabulary in the tasks that read the texts (from Spark's own
vectors they would have to cross from the JVM once more), are summed per source within each task, then across tasks. Pairs of
sources are evaluated sparsely: with ``f`` the divergence of two shares and a zero for the
share of a term that a source lacks,

    sum f(a, b) = sum over a's terms f(a, 0) + sum over b's terms f(0, b) + rest f(0, 0)
                  + sum over terms of both [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)]

so that absent terms are counted, not visited. The first two sums run over the distinct
counts of a source; tasks add the last one up per pair. All numbers are whole.

A null text, language or source is an empty string, and so a group of its own. Repeated rows
count as documents of their own. A language without kept terms has pairs of value 0 and no
terms. A language with one source has no pairs. Ties go to the smaller item, by its bytes.
No rows give no rows. Other columns are ignored, and a text's length is not limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcome_risk.llm.ctw import merged
from outcome_risk.llm.storage import write_table
from outcome_risk.llm.textscan import LOWER, text_slices
from outcome_risk.llm.worker import keep, trim

# Documents that a kept term is in, scale of a share, terms listed per source.
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
UNLIMITED = 2**31 - 1

#: Bytes of a term of a lower-cased text: a-z and all beyond ASCII.
TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
MARKS = 60  # languages that one vocabulary tells apart, by a byte before each term that no term holds
PENDING = 3_000_000  # vector entries, or cells of pairs, that a task holds before it sends them
CELLS = 2_000_000  # shares that are compared at once


def marked_terms(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> pa.ListArray:
    """The terms of texts, A-Z lower-cased, each behind the byte that marks its text's language."""
    texts = len(offsets) - 1
    begins = offsets + np.arange(texts + 1)  # with a byte before each text, so that every term has one
    own = np.ones(begins[-1], dtype=bool)
    own[begins[:-1]] = False
    padded = np.zeros(len(own), dtype=np.uint8)
    padded[own] = LOWER[data]
    inside = np.zeros(len(own) + 1, dtype=bool)
    inside[:-1] = TERM[padded]
    before = np.zeros(len(own) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    first = np.searchsorted(starts, begins)
    padded[starts - 1] = np.repeat(marks, np.diff(first))
    taken = inside[:-1]
    taken[starts - 1] = True
    places = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(padded[taken]))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), words)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Slices of ``mark, name, text`` rows with their marked terms."""
    for batch in batches:
        marks = batch.column(0).to_numpy().astype(np.uint8)
        for first, data, offsets in text_slices(batch.column(2)):
            own = batch.slice(first, len(offsets) - 1)
            yield own, marked_terms(data, offsets, marks[first : first + own.num_rows])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own, terms in _batches(batches):
        yield pa.RecordBatch.from_arrays([own.column(1), terms], names=["name", "terms"])
    trim()


def fit_vocabulary(marked: DataFrame) -> CountVectorizerModel:
    """The vocabulary of all terms in ``MIN_DOCS`` documents of their language, of ``mark, name, text`` rows."""
    found = marked.mapInArrow(_terms, "name long, terms array<string>").select("terms")
    # a term of no language in enough documents, as a vocabulary must not be empty
    never_empty = marked.sparkSession.range(MIN_DOCS).select(F.array(F.lit("")).alias("terms"))
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(MIN_DOCS), vocabSize=UNLIMITED)
    return counter.fit(found.unionByName(never_empty))


class Vectors:
    """Sparse exact count vectors of documents under a vocabulary, as CountVectorizer's model gives them."""

    def __init__(self, vocabulary: list[str]):
        self.place = {term: i for i, term in enumerate(vocabulary) if term}

    def entries(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(document, index of the term) of every kept occurrence."""
        coded = terms.values.dictionary_encode()
        place = np.array([self.place.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        index = place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        document = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
        return document[index >= 0], index[index >= 0]


def _sum_vectors(shared, base: int):
    """Sums of the document vectors per group; at most ``PENDING`` entries of a task wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = keep("term vectors", shared.value, lambda: Vectors(shared.value))
        size = len(shared.value)
        groups: dict[int, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def sent() -> pa.RecordBatch:
            keys, sums = merged(*(np.concatenate(p) for p in zip(*parts)))
            names = np.array(list(groups), dtype=np.int64)
            columns = [pa.array(names[keys // size]), pa.array((keys % size + base).astype(np.int32)), pa.array(sums)]
            return pa.RecordBatch.from_arrays(columns, names=["name", "index", "n"])

        for own, terms in _batches(batches):
            local = np.array([groups.setdefault(n, len(groups)) for n in own.column(1).to_pylist()], dtype=np.int64)
            document, index = vectors.entries(terms)
            found = pc.value_counts(pa.array(local[document] * size + index))
            parts.append(tuple(found.field(f).to_numpy(zero_copy_only=False) for f in ("values", "counts")))
            waiting += len(parts[-1][0])
            if waiting > PENDING:
                yield sent()
                parts, waiting = [], 0
                groups.clear()
        if parts:
            yield sent()
        trim()

    return run


def _share(count: Column, total: Column, size: Column) -> Column:
    """``1 + floor(SCALE (count + 2) / (total + 2 size))``, whatever the counts."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", wide, (total + size * 2).cast("decimal(20,0)"))
    return (whole + 1).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of a language's sources: the bracket's sum over the terms that both have."""
    totals: dict[str, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            a, b = np.nonzero(total)
            columns = [pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "both"])

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang_of = langs.indices.to_numpy()
        lists = batch.column(1)
        offsets, fields = lists.offsets.to_numpy(), lists.values
        g, p, p0 = (fields.field(c).to_numpy() for c in ("g", "p", "p0"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        base = offsets[0]
        g, p, p0 = (x[base : offsets[-1]] for x in (g, p, p0))
        for number, lang in enumerate(langs.dictionary.to_pylist()):
            mine = lang_of[row] == number
            sources = np.unique(g[mine])
            size = max(1, CELLS // len(sources))
            at = np.unique(row[mine], return_inverse=True)[1]
            column = np.searchsorted(sources, g[mine])
            zero = np.zeros(len(sources), dtype=np.int64)
            zero[column] = p0[mine]
            found = np.zeros((len(sources), len(sources)), dtype=np.int64)
            for start in range(0, at.max() + 1, size):
                here = (at >= start) & (at < start + size)
                shares = np.zeros((min(size, at.max() + 1 - start), len(sources)), dtype=np.int64)
                shares[at[here] - start, column[here]] = p[mine][here]
                for a in range(len(sources) - 1):
                    rows = shares[shares[:, a] > 0]
                    of_a, of_b, za, zb = rows[:, a, None], rows[:, a + 1 :], zero[a], zero[a + 1 :]
                    bracket = _divergences(of_a, of_b) - _divergences(of_a, zb) - _divergences(za, of_b) + _divergences(za, zb)
                    found[a, a + 1 :] += np.where(of_b > 0, bracket, 0).sum(axis=0)
            width = int(sources[-1]) + 1
            total = totals.setdefault(lang, np.zeros((width, width), dtype=np.int64))
            if len(total) < width:
                total = totals[lang] = np.pad(total, (0, width - len(total)))
            total[np.ix_(sources, sources)] += found
        if sum(t.size for t in totals.values()) > PENDING:
            yield from sent()
            totals.clear()
    yield from sent()


def _ranked(values: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order))


def source_divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources (``pair``) and typical terms (``term``)."""
    spark = df.sparkSession
    docs = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    # groups go by a hash of their names, found to be unique below
    named = docs.withColumn("name", F.xxhash64("lang", "source"))
    groups = write_table(named.select("lang", "source", "name").distinct(), "divergence-names")
    if groups.groupBy("name").count().filter("count > 1").head(1):
        raise ValueError("two groups have one hash")
    langs = [r["lang"] for r in groups.select("lang").distinct().orderBy("lang").collect()]
    counts, words, base = None, None, 0
    for start in range(0, len(langs) or 1, MARKS):
        some = langs[start : start + MARKS]
        mark = F.array_position(F.array(*[F.lit(x) for x in some]), F.col("lang")).cast("int")
        marked = named.select(mark.alias("mark"), "name", "text").filter("mark > 0")
        vocabulary = fit_vocabulary(marked).vocabulary
        shared = spark.sparkContext.broadcast(vocabulary)
        partial = marked.mapInArrow(_sum_vectors(shared, base), "name long, index int, n long")
        found = write_table(partial.groupBy("name", "index").agg(F.sum("n").alias("n")), "divergence-counts")
        shared.destroy()
        known = [(base + i, some[ord(x[0]) - 1], x[1:]) for i, x in enumerate(vocabulary) if x]
        terms = pd.DataFrame(known, columns=["index", "lang", "term"])
        terms = write_table(spark.createDataFrame(terms, "index int, lang string, term string"), "divergence-terms")
        base += len(vocabulary)
        counts = found if counts is None else counts.unionByName(found)
        words = terms if words is None else words.unionByName(terms)
    return _parts(groups, counts, words)


def _parts(names: DataFrame, counts: DataFrame, words: DataFrame) -> DataFrame:
    sizes = words.groupBy("lang").agg(F.count("*").alias("size"))
    totals = counts.groupBy("name").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = (
        names.join(totals, "name", "left").join(sizes, "lang", "left").na.fill(0)
        .withColumn("g", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("int"))
        .withColumn("p0", F.when(F.col("size") > 0, _share(F.lit(0), F.col("total"), F.col("size"))))
    )
    groups = write_table(groups, "divergence-groups")
    shares = counts.join(groups, "name").withColumn("p", _share(F.col("n"), F.col("total"), F.col("size")))
    shares = write_table(shares.select("lang", "source", "g", "index", "n", "p", "p0", "total", "size"), "divergence-shares")

    whole = shares.groupBy("index").agg(F.sum("n").alias("all_n"))
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    p, q = F.col("p"), F.col("q")
    typical = (
        shares.join(whole, "index").join(lang_totals, "lang")
        .withColumn("q", _share(F.col("all_n"), F.col("all_total"), F.col("size")))
        .filter(p > q)
        .join(words.select("index", "term"), "index")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(p, q).alias("value"))
    )
    typical = _ranked(typical).filter(F.col("rank") <= TOP_TERMS)

    entries = shares.groupBy("lang", "index").agg(F.collect_list(F.struct("g", "p", "p0")).alias("held")).filter("size(held) > 1")
    both = entries.select("lang", "held").mapInArrow(_add_pairs, "lang string, a int, b int, both long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))
    other = groups.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("source", "g", "p0", "held")])
    alike = shares.groupBy("lang", "g", "p").agg(F.count("*").alias("times"))
    lone = (
        alike.join(other, "lang").filter(F.col("g") != F.col("b_g"))
        .groupBy("lang", "g", "b_g").agg(F.sum(F.col("times") * _divergence(p, F.col("b_p0"))).alias("lone"))
    )
    lone, both = write_table(lone, "divergence-lone"), write_table(both, "divergence-both")
    mirrored = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    pairs = (
        groups.join(other, "lang").filter(F.col("g") != F.col("b_g"))
        .join(lone, ["lang", "g", "b_g"], "left")
        .join(lone.select("lang", F.col("g").alias("b_g"), F.col("b_g").alias("g"), F.col("lone").alias("b_lone")), ["lang", "g", "b_g"], "left")
        .join(mirrored.select("lang", F.col("a").alias("g"), F.col("b").alias("b_g"), "both"), ["lang", "g", "b_g"], "left")
    )
    rest = (F.col("size") - F.col("held") - F.col("b_held")) * _divergence(F.col("p0"), F.col("b_p0"))
    zero = F.lit(0)
    value = F.coalesce("lone", zero) + F.coalesce("b_lone", zero) + F.coalesce("both", zero) + F.coalesce(rest, zero)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("b_source").alias("item"), value.cast("long").alias("value"))
    return _ranked(pairs).unionByName(typical)
