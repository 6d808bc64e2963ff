"""The pipeline's choice within groups of near copies when ids are null or repeated."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import DOCS


def test_one_row_of_each_group_whatever_its_id(spark):
    base = [" ".join(f"w{g}x{i}" for i in range(60)) for g in range(5)]
    rows = [
        (None, base[0]),  # alone, so its group is all null
        (None, base[1]), (1, base[1] + " more"),  # a near copy of a document with an id
        (2, base[2]), (9, base[2] + " more"), (9, base[3]),  # a repeated id, one text a near copy of 2
        (None, base[4]), (None, base[4] + " more"), (None, base[4]),
        (5, None), (5, None), (None, None), (None, None), (6, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    last = [k for k in kept if k[0] is None and k[1] and k[1].startswith(base[4])]
    assert len(last) == 1 and kept.pop(last[0]) == 1
    assert kept == Counter(
        {(None, base[0]): 1, (1, base[1] + " more"): 1, (2, base[2]): 1, (9, base[3]): 1, (5, None): 1, (None, None): 2, (6, ""): 1}
    )
