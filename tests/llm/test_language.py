"""Rejection and sampling of language identification."""

import random
import string

import pytest
from pyspark.sql import functions as F

from outcome_risk.llm import language, queries
from tests.llm.test_operators import frame


@pytest.fixture(scope="module")
def learnt(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    return language.fit_dictionaries(docs.filter(~language.held_out("doc_id", 3, 1)))


@pytest.mark.parametrize("length, least", [(200, 95), (1000, 99), (5000, 99)])
def test_random_letters_of_any_length_are_rejected(learnt, length, least):
    rng = random.Random(length)
    classifier = language.Classifier(learnt)
    texts = ["".join(rng.choices(string.ascii_lowercase + "    ", k=length)) for _ in range(100)]
    found = [classifier.predict(t, language.MIN_MARGIN) for t in texts]
    assert sum(rejected for *_, rejected in found) >= least
    assert all(score < 0.75 for _, score, _, rejected in found if rejected)


def test_texts_of_learnt_languages_stay(spark, learnt):
    docs = queries.documents(spark, "/root/testdata/sf0.01").filter(language.held_out("doc_id", 3, 1))
    found = language.identify(docs.filter("length(text) > 100"), learnt).collect()
    assert len(found) > 200
    assert sum(r["rejected"] for r in found) <= 0.01 * len(found)


@pytest.mark.parametrize("copies", [3000])
def test_copies_count_once_in_the_sample(spark, copies):
    hot = "der hund und die katze sind im haus " * 3
    own = [f"das buch {i} liegt am meer " * 3 for i in range(20)]
    rows = [(hot, "de")] * copies + [(t, "de") for t in own] + [("solo texto de una lengua", "es")] * copies
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    found = language.fit_dictionaries(labelled)
    assert set(found) == {"de", "es"}
    learnt = b"".join(found["de"]).decode()
    assert "der hund und die katze" in learnt
    assert all("das buch liegt am meer" in part.decode() for part in found["de"])
    assert learnt.count("das buch liegt") == 60
    few = language.fit_dictionaries(labelled, sample_rows=4)
    assert b"".join(few["de"]).decode().count("\n") == 4 and "solo texto" in few["es"][0].decode()


def test_more_languages_than_compressors_at_a_time(spark, monkeypatch):
    words = [[f"{a}{b}{c}" for b in "aeiou" for c in "rstlnm"] for a in ("b", "d", "f", "g", "k")]
    rows = [(" ".join(random.Random(i).choices(w, k=60)), f"l{n}") for n, w in enumerate(words) for i in range(9)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    dictionaries = language.fit_dictionaries(labelled)
    texts = [r[0] for r in rows]
    whole = language.Classifier(dictionaries).predict_all(texts, 1)
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    assert set(language.fit_dictionaries(labelled)) == {f"l{n}" for n in range(5)}
    assert language.Classifier(dictionaries).predict_all(texts, 1) == whole
    assert [w[0] for w in whole] == [r[1] for r in rows]
