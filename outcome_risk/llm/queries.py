"""The registered queries of these operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcome_risk.llm import ann, bpe, chat, decontaminate, divergence, language, line_dedup, lm_scoring, ngram_join
from outcome_risk.llm import quality, repair, token_counts, token_files
from outcome_risk.llm.storage import new_path, write_table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    """Where the installed tokenizer files keep the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), vocabulary_path())


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary_path(), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), folder, vocabulary_path())
    return token_files.token_table(spark, folder)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", "lang", language.held_out("doc_id", 3, 1).alias("held_out")
    )
    dictionaries = language.fit_dictionaries(docs.filter("not held_out"))
    found = language.identify(docs.drop("lang"), dictionaries, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    features = write_table(quality.add_features(docs), "quality-features")
    features = features.withColumn("held_out", language.held_out("doc_id", 4, 2))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit_quality(features.filter("not held_out").join(labels, "doc_id"), "doc_id", "quality")
    return quality.score_quality(features, model).select("doc_id", "held_out", "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.decontamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language.held_out("doc_id", 10, 0).alias("held_out")
    return lm_scoring.score_texts(documents(spark, sf_dir).select("doc_id", "text", held_out))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    query.__name__: query
    for query in (
        op1_bpe_codec,
        op2_ngram_jaccard_join,
        op3_token_counts,
        op4_token_files,
        op5_nearest_neighbours,
        op6_chat_format,
        op7_language_id,
        op8_quality_classifier,
        op9_line_dedup,
        op10_decontamination,
        op11_lm_scoring,
        op12_source_divergence,
        op13_conversation_repair,
    )
}
