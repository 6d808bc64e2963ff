"""Source divergence against counting by hand, and its vectors against the texts."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from outcome_risk.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank array<int>"


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows):
    docs = [(terms(t), lang or "", source or "") for _, t, lang, source in rows]
    frequency, groups = defaultdict(Counter), defaultdict(Counter)
    for found, lang, source in docs:
        frequency[lang].update(set(found))
        groups[lang, source].update(found)
    kept = {lang: [t for t, n in own.items() if n >= 10] for lang, own in frequency.items()}

    def shares(counts, lang):
        own = kept.get(lang, [])
        n = sum(counts[t] for t in own)
        return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(own)) for t in own}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    p = {g: shares(counts, g[0]) for g, counts in groups.items()}
    out = set()
    for (lang, source), counts in groups.items():
        whole = sum((c for (other, _), c in groups.items() if other == lang), Counter())
        q, own = shares(whole, lang), p[lang, source]
        pairs = [(b, sum(f(own[t], p[lang, b][t]) for t in own)) for other, b in groups if other == lang and b != source]
        typical = [(t, f(own[t], q[t])) for t in own if counts[t] > 0 and own[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", typical, 10)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])}
    return out


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x", [0]) for r in rows], SCHEMA).repartition(partitions)
    found = [tuple(r) for r in divergence.source_divergence(df).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    return found


def table(n=240):
    words = ["Alpha", "beta", "Gamma", "délta", "日本", "eta's", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi"]
    rows = []
    for i in range(n):
        text = " ".join(words[(i * i + j * (i % 5 + 1)) % len(words)] for j in range(i % 17))
        rows.append((i, text, ("en", "de", None)[i % 3], ("a", "b", "c", "d", None, "Ä")[i % 7 % 6]))
    return rows


def test_against_counting(spark):
    found = check(spark, table())
    assert {r[2] for r in found} == {"pair", "term"}


def test_small_tasks_send_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 8)
    rows = table(90)
    vectors = [(r[2] or "", r[3] or "") for r in rows]
    assert len(vectors) == 90
    check(spark, rows, 7)


def test_no_kept_terms_one_source_nulls(spark):
    rows = [(i, "same words here", "xx", "only") for i in range(12)]
    rows += [(50, "rare", "yy", "a"), (51, None, "yy", "b"), (52, "", None, None)]
    found = check(spark, rows)
    assert ("yy", "a", "pair", "b", 0, 1) in found
    assert not [r for r in found if r[0] == "xx" and r[2] == "pair"]


def test_nothing_kept_at_all(spark):
    assert check(spark, [(1, "a", "x", "p"), (2, "b", "x", "q"), (2, "b", "x", "q")])


def test_language_that_looks_like_a_term(spark):
    check(spark, [(i, "a b", lang, "st"[i % 2]) for i in range(30) for lang in ("a\x00b", "a", "")])


def test_hot_source_and_very_long_text(spark):
    rows = [(i, "one two three four", "en", "hot") for i in range(400)] + [(500 + i, "one five", "en", f"s{i % 3}") for i in range(30)]
    check(spark, rows + [(999, "five six " * 100_000, "en", "s0")])


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_vectors_are_those_of_the_fitted_model(spark):
    texts = ["x y y", "é x", "z", ""] * 12 + ["x rare"]
    rows = [(i % 2 + 1, i, t) for i, t in enumerate(texts)]
    marked = spark.createDataFrame(rows, "mark int, name long, text string")
    model = divergence.fit_vocabulary(marked)
    found = marked.mapInArrow(divergence._terms, "name long, terms array<string>")
    expected = {r["name"]: (r["vector"].indices.tolist(), r["vector"].values.tolist()) for r in model.transform(found).collect()}
    vectors = divergence.Vectors(model.vocabulary)
    for mark, name, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        own = divergence.marked_terms(data, np.array([0, len(data)]), np.array([mark], dtype=np.uint8))
        counted = Counter(vectors.entries(own)[1].tolist())
        assert (sorted(counted), [float(counted[i]) for i in sorted(counted)]) == expected[name]


def test_more_languages_than_marks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MARKS", 2)
    check(spark, [(i, "a b c", f"l{i % 5}", "st"[i // 5 % 2]) for i in range(120)])


@given(st.lists(st.text(alphabet="aZ é日\x00\x7f@[`{9", max_size=12), min_size=1, max_size=4))
@settings(max_examples=80, deadline=None)
def test_terms_are_those_of_the_pattern(texts):
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = divergence.marked_terms(data, offsets, np.arange(1, len(texts) + 1, dtype=np.uint8)).to_pylist()
    assert found == [[chr(i + 1) + t for t in terms(text)] for i, text in enumerate(texts)]
