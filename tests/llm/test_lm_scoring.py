"""Context-tree weighting against a plain recursive version, and the unigram against counting."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from outcome_risk.llm import ctw, lm_scoring
from outcome_risk.llm.queries import QUERIES
from tests.conftest import SF_DIR

DEPTH = lm_scoring.DEPTH


def brute_model(texts):
    """Counts and weighted probabilities of every (context, decision), by recursion."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for text in texts:
        symbols = [255] * DEPTH + list(text) + [255]
        for t in range(DEPTH, len(symbols)):
            context, node = tuple(reversed(symbols[t - DEPTH : t])), 1
            for shift in range(7, -1, -1):
                bit = symbols[t] >> shift & 1
                for d in range(DEPTH + 1):
                    counts[context[:d], node][bit] += 1
                    if d:
                        children[context[: d - 1], node].add(context[:d])
                node = node << 1 | bit
    known = {}

    def log_w(context, node):
        """(log of the weighted probability, weight of the node's own estimate)."""
        if (context, node) not in known:
            a, b = counts.get((context, node), (0, 0))
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            if len(context) == DEPTH:
                known[context, node] = own, 1.0
            else:
                below = sum(log_w(c, node)[0] for c in children.get((context, node), ()))
                both = np.logaddexp(own, below) - math.log(2)
                known[context, node] = both, math.exp(own - math.log(2) - both)
        return known[context, node]

    def score(text):
        symbols, total = [255] * DEPTH + list(text) + [255], 0.0
        for t in range(DEPTH, len(symbols)):
            context, node = tuple(reversed(symbols[t - DEPTH : t])), 1
            for shift in range(7, -1, -1):
                bit, p = symbols[t] >> shift & 1, 0.0
                for d in range(DEPTH, -1, -1):
                    pair = counts.get((context[:d], node), (0, 0))
                    own = (pair[bit] + 0.5) / (sum(pair) + 1.0)
                    weight = log_w(context[:d], node)[1]
                    p = weight * own + (1 - weight) * p
                total += math.log10(p)
                node = node << 1 | bit
        return total

    return score


def brute_tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def brute(rows):
    """n_tokens, n_known, train_tokens, base score and score of ``(text, held_out)`` rows."""
    train = [t or "" for t, held in rows if not held]
    score, words = brute_model([t.encode() for t in train]), Counter(w for t in train for w in brute_tokens(t))
    n, v = sum(words.values()), len(words)
    for text, _ in rows:
        own = brute_tokens(text)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        yield len(own), sum(words[w] > 0 for w in own), n, base, score((text or "").encode())


def check(spark, rows, partitions=2):
    schema = "doc_id long, text string, held_out boolean, score string, extra array<int>"
    made = [(i, t, held, "x", [i]) for i, (t, held) in enumerate(rows)]
    df = spark.createDataFrame(made, schema).repartition(partitions)
    scored = lm_scoring.score_texts(df)
    assert scored.columns == ["doc_id", "held_out", "extra", *lm_scoring.RESULTS.names]
    found = {r["doc_id"]: r for r in scored.collect()}
    assert sorted(found) == list(range(len(rows)))
    for i, (n_tokens, n_known, train, base, score) in enumerate(brute(rows)):
        r, size = found[i], len((rows[i][0] or "").encode())
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["n_bytes"]) == (n_tokens, n_known, train, size)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)
        assert r["extra"] == [i]
        if size:
            assert r["bits_per_byte"] == pytest.approx(-score / math.log10(2) / size)
        else:
            assert r["bits_per_byte"] is None


MIXED = [
    ("Die Katze sitzt. Die Katze schläft.", False),
    ("die katze sitzt auf der Matte.\n\n日本語", False),
    ("die katze sitzt auf der Matte.\n\n日本語", False),
    (None, False),
    ("", True),
    ("   ", False),
    ("Die Katze jagt, die Maus rennt\t!", True),
    ("zzz qqq", True),
]


def test_equals_the_recursive_version(spark):
    check(spark, MIXED, 3)


def test_no_training_rows(spark):
    check(spark, [("abc abc", True), (None, True)])


def test_null_flag_is_training(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "a", True)], "doc_id long, text string, held_out boolean")
    found = {r["doc_id"]: r for r in lm_scoring.score_texts(df).collect()}
    assert found[2]["train_tokens"] == 3 and found[2]["n_known"] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert lm_scoring.score_texts(df).collect() == []


def test_windows_do_not_change_the_numbers(monkeypatch):
    text = "".join(f"word{i % 97} " for i in range(300))
    data, offsets = np.frombuffer((text + "ab").encode(), np.uint8), np.array([0, len(text), len(text), len(text) + 2])
    whole = np.concatenate(list(lm_scoring.windows(data, offsets)))
    monkeypatch.setattr(lm_scoring, "WINDOW_BYTES", 64)
    assert (np.concatenate(list(lm_scoring.windows(data, offsets))) == whole).all()
    assert len(whole) == len(data) + 3


def test_very_long_text(spark):
    rows = [("lorem ipsum dolor sit amet " * 200_000, False), ("lorem ipsum", True), ("xyz", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, held_out boolean")
    found = {r["doc_id"]: r for r in lm_scoring.score_texts(df).collect()}
    assert found[0]["n_tokens"] == 1_000_001 and found[0]["n_bytes"] == 5_400_000
    assert found[0]["bits_per_byte"] < 0.001 < found[2]["bits_per_byte"]


@given(st.lists(st.binary(max_size=12), min_size=1, max_size=4))
@settings(max_examples=50, deadline=None)
def test_context_numbers(texts):
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    padded, counts = ctw.stream(data, offsets, DEPTH)
    keys = ctw.context_keys(padded, DEPTH)[counts[DEPTH:]].tolist()
    expected = []
    for text in texts:
        symbols = [255] * DEPTH + list(text) + [255]
        for t in range(DEPTH, len(symbols)):
            expected.append(int.from_bytes(bytes([*reversed(symbols[t - DEPTH : t]), symbols[t]]), "big"))
    assert keys == expected


def test_large_counts():
    a, b = np.array([0, 5, 4095, 4096, 5000, 10**6]), np.array([0, 7, 4096, 4097, 10, 10**7])
    expected = [
        math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(a, b)
    ]
    assert ctw.log_kt(a, b) == pytest.approx(expected, rel=1e-10, abs=1e-9)


def test_query_over_the_whole_table(spark):
    rows = QUERIES["op11_lm_scoring"](spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 for d in docs}
    words = Counter(w for d in docs if not held[d["doc_id"]] for w in brute_tokens(d["text"]))
    n, v = sum(words.values()), len(words)
    texts = {d["doc_id"]: d["text"] for d in docs}
    assert sorted(texts) == sorted(r["doc_id"] for r in rows)
    for r in rows:
        own = brute_tokens(texts[r["doc_id"]])
        assert r["held_out"] == held[r["doc_id"]] and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(words[w] > 0 for w in own))
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    for held in (False, True):
        own = [r for r in rows if r["held_out"] == held]
        assert -sum(r["score"] for r in own) / math.log10(2) / sum(r["n_bytes"] for r in own) < 2.6
