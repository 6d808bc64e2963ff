"""A training-corpus pipeline over ``documents``: each stage works on all that the one before kept.

Stages but the last return the columns of ``documents``. A document that loses lines gets
its new ``n_chars``; one whose lines are all later copies of other documents' lines goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcome_risk.llm import bpe, decontaminate, language, line_dedup, ngram_join
from outcome_risk.llm.queries import documents, table, vocabulary_path
from outcome_risk.llm.storage import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without doubt."""
    learnt = docs.filter(~language.held_out("doc_id", 3, 1))
    found = language.identify(docs.select(*COLUMNS), language.fit_dictionaries(learnt))
    return found.filter("not rejected").select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    shorter = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    kept = found.filter("n_removed < n_lines or n_removed = 0")
    return kept.withColumn("n_chars", shorter.cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, nulls last, then the text by hash.

    Rows are told apart by a hash of id and text, which needs no second copy of the texts.
    Rows without words are alone, equal ones once, but all of those without an id.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keyed = docs.select(*COLUMNS, key.alias("key"))
    groups = ngram_join.near_duplicates(keyed, key="key").withColumnRenamed("doc_id", "key")
    groups = write_table(groups.distinct(), "pipeline-groups")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", (F.col("n_shingles") == 0).alias("bare"))
    placed = keyed.select("doc_id", "key").distinct().join(groups, "key").select("component_id", place.alias("place"))
    first = placed.groupBy("component_id").agg(F.min("place").alias("place"))
    chosen = write_table(first.select("place.key", "place.bare"), "pipeline-chosen")
    kept = keyed.join(chosen, "key")
    copy = F.row_number().over(W.partitionBy("key").orderBy("text"))
    return kept.withColumn("copy", copy).filter("copy = 1 or bare and doc_id is null").select(*COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.decontamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs.select("doc_id", "text"), vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", remove_contaminated),
    ("bpe_encoding", encode),
]

#: Compression sizes and token ids are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = write_table(docs, f"pipeline-{name}")
    return docs
