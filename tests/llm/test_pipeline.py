"""The pipeline against plain versions of its stages."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from outcome_risk.llm import queries
from outcome_risk.llm.storage import write_table
from tests.conftest import SF_DIR
from tests.llm.test_operators import brute_components, brute_lines, brute_passages


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = queries.documents(spark, SF_DIR)
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_table(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    first, lines, groups, clean = kept
    source = {r["doc_id"]: r["text"] for r in queries.documents(spark, SF_DIR).collect()}
    assert set(first) <= set(source) and len(first) >= 0.97 * len(source)
    least = brute_lines_of(first)
    assert lines == least
    roots = brute_components(lines)
    assert groups == {i: t for i, t in lines.items() if roots[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    hits = brute_passages(groups, items)
    assert clean == {i: t for i, t in groups.items() if not hits[i][-1]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in encoded} == set(clean)
    for r in encoded:
        own = library.encode(clean[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()


def brute_lines_of(docs):
    found = brute_lines(docs, 20)
    return {i: t for i, t in found.items() if t != "" or docs[i] == ""}


def test_run_keeps_columns_and_rows(spark):
    result = corpus_pipeline.run(spark, SF_DIR)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < result.count() <= queries.documents(spark, SF_DIR).count()
    assert result.filter(F.col("n_tokens").isNull()).count() == 0
