"""Each operator against the library it imitates or a brute-force version, and on edge cases."""

import hashlib
import random
import re
import weakref
import zlib
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from outcome_risk.llm import ann, bpe, chat, components, decontaminate, language, line_dedup, ngram_join, quality
from outcome_risk.llm import queries, token_counts, token_files, worker
from tests.conftest import SF_DIR

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [
    None, "", " ", "  a  b", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "a\n b \n\n c", " lead", "trail ",
    "don't we'll I'm", "a" * 400, "é" * 100, "日本語 テスト x²", "a\x1c b \x85 c", "\t\t a\r\n b", "12345 ٣٤ Ⅷ",
    "==" * 77 + " " * 90 + "z", "😀 😀😀 👨‍👩‍👧", "word " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def noise(count):
    rng = random.Random(3)
    pool = [chr(c) for c in (32, 32, 10, 9, 13, 160, 0x3000, 97, 98, 39, 115, 116, 0x1C, 0x85, 65, 48, 233, 0x4E2D, 46, 0x200B)]
    return ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(count)]


def test_bpe_equals_library(spark, library, vocabulary):
    texts = HARD + noise(400)
    df = frame(spark, texts).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["ids"] == ids_of(library, text)
        assert rows[i]["decoded"] == library.decode(rows[i]["ids"], skip_special_tokens=False)
        assert rows[i]["text"] == text
    for piece in ("hello", " everything", "antidisestablishment", "zzzzzzzz"):
        assert bpe.Encoder(vocabulary).piece(piece.encode()) == vocabulary.merge(piece.encode())
    assert vocabulary.merge(b"ab" * 100) == bpe.Encoder(vocabulary).piece(b"ab" * 100)


def test_worker_keeps_one_operator_and_frees_the_last(vocabulary):
    first = bpe.encoder_of(vocabulary)
    assert bpe.encoder_of(vocabulary) is first
    gone = weakref.ref(first)
    del first
    counter = token_counts.counter_of(vocabulary)
    assert gone() is None  # although an encoder refers to itself
    assert token_counts.counter_of(vocabulary) is counter
    gone = weakref.ref(counter)
    del counter
    worker.release()
    assert gone() is None


def test_decode_skips_unknown_ids(spark):
    df = spark.createDataFrame([(1, [50256, None, 99_999, 0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()}
    assert got == {1: "<|endoftext|>!", 2: "", 3: ""}


def test_counts_equal_library(spark, library):
    texts = HARD + noise(200)
    df = frame(spark, texts).withColumn("n_tokens", F.lit("clash"))
    for row in token_counts.count_tokens(df, PATH).collect():
        text = texts[row["doc_id"]]
        assert row["n_tokens"] == len(ids_of(library, text))
        assert row["n_bytes"] == len((text or "").encode())
        assert row["over_limit"] == (row["n_tokens"] > 1024)


def test_token_files(spark, library, tmp_path):
    texts = HARD + ["same", "same"]
    df = frame(spark, texts).withColumn("key", F.col("doc_id") * 7 - 20).drop("doc_id")
    df = df.union(df.filter("key = 1")).union(df.limit(1).withColumn("key", F.lit(None).cast("long")))
    folder = f"file://{tmp_path}/tokens"
    token_files.write_tokens(df, folder, PATH, key="key", shard_ids=2000)
    expected = sorted(
        ((r["key"] is not None, r["key"] or 0, ids_of(library, r["text"]) + [0]) for r in df.collect()),
        key=lambda r: r[:2],
    )
    start = 0
    rows = token_files.token_table(spark, folder).orderBy("start").collect()
    assert len(rows) == len(expected)
    for row, (known, key, ids) in zip(rows, expected):
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (key if known else None, start, len(ids))
        assert row["ids_crc32"] == token_files.crc_of(ids)
        start += len(ids)
    wanted = spark.createDataFrame([(1,), (1,), (-20,), (999_999,), (3,), (None,)], "doc_id long")
    found = defaultdict(list)
    for row in token_files.lookup_tokens(spark, folder, wanted).collect():
        found[row["key"]].append(np.frombuffer(row["ids"], "<u4").tolist())
    assert sorted(found, key=str) == [-20, 1, None]
    assert found[1] == [ids_of(library, texts[3]) + [0]] * 2
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(df.limit(0), empty, PATH, key="key")
    assert token_files.token_table(spark, empty).count() == 0


def test_perfect_hash_tells_absent_keys():
    keys = np.arange(0, 50_000, 5)
    none = np.zeros(len(keys), dtype=bool)
    hashes = token_files.key_hashes(keys, none)
    levels = token_files.build_levels(hashes)
    slots = token_files.find_slots(levels, hashes)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(docs), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def near_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [None, "", "one two", "one two", "One  TWO\n", "a b c d e", "\x0b"]
    common = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy + (common if rng.random() < 0.4 else [])))
    return dict(enumerate(texts * 1 + texts[3:20]))


@pytest.mark.parametrize("fragment_grams", [1_000_000, 10])
def test_ngram_join_equals_brute_force(spark, fragment_grams):
    docs = near_copies()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, component_id string")
    got = ngram_join.near_duplicates(df.repartition(5), fragment_grams=fragment_grams).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)
    assert len(got) == len(docs)


def test_ngram_join_null_ids_and_no_rows(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(None, text), (7, text), (3, text + " more"), (None, None), (7, text)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 36, 3), (7, 36, 3), (7, 36, 3), (3, 37, 3), (None, 0, None)], key=str)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 61), (61, 60), (70, 70)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 60: 60, 61: 60}
    assert components.components(edges.limit(0)).count() == 0


def test_nearest_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((600, 16))
    vectors[100:130] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(601, None), (602, []), (603, [0.0] * 16), (604, [float("nan")] * 16), (650, [None] * 16), (None, [1.0] * 16), (605, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(df, block_rows=200, query_rows=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for query in range(0, 600, 50):
        scores = unit @ unit[query]
        scores[query] = -9
        best = np.lexsort((np.arange(600), -np.round(scores, 12)))[:5]
        hits += len(set(best.tolist()) & {i for i, _ in got[query]})
    assert set(got) == set(range(0, 600, 50))
    assert hits >= 0.9 * 60
    assert [i for i, _ in got[50]] == [100, 101, 102, 103, 104]
    assert ann.nearest(df.limit(0)).count() == 0
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3


def test_recall_on_the_table(spark):
    df = queries.table(spark, SF_DIR, "embeddings")
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    unit = np.array([r["embedding"] for r in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in queries.op5_nearest_neighbours(spark, SF_DIR).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[at]
        scores[at] = -9
        hits += len(found[ids[at]] & set(ids[np.lexsort((ids, -scores))[:5]].tolist()))
        total += 5
    assert hits >= 0.9 * total


CONTROL = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>", "a<", "[", "<</SYS>> x\ny", "\\", "[\\INST]", "<s", "</s", " ", "\n", ""]


def test_chat_turns_come_back(spark):
    rng = random.Random(2)
    turns = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choices([*CONTROL, "plain "], k=rng.randint(0, 4))) if conv else None
            turns.append((conv, turn, rng.choice(["user", "assistant", "system", "to\\ol\nx", None]), text))
    turns += [(None, None, "user", "a"), (5, 0, "user", "again"), (5, 0, "user", "again")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    segments = chat.format_turns(df)
    parts = defaultdict(list)
    for r in segments.collect():
        parts[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["segment"], r["loss_start"], r["loss_end"]))
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    source = defaultdict(list)
    for conv, _, role, text in turns:
        source[conv].append((role or "", text or ""))
    for conv, rows in parts.items():
        rows.sort(key=lambda r: r[:3])
        parser, loss, recovered = chat.Parser(), "", []
        formatted = "".join(r[2] for r in rows)
        recovered = parser.feed(formatted)
        parser.close()
        assert sorted(recovered) == sorted(source[conv])
        loss = "".join(chat.unescape(s[a:b]) for _, _, s, a, b in rows if a is not None)
        assert loss == "".join(t for role, t in recovered if role == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in recovered).encode()).hexdigest()
        assert got[conv]["turns_sha256"] == digest
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["formatted_chars"]) == (len(recovered), len(formatted))
        assert got[conv]["loss_chars"] == len(loss)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_parser_refuses_broken_text():
    for broken in ("x", "[INST] a", "[INST] a </s>", "<s>a</s>", "<<SYS>>a<</SYS>>"):
        parser = chat.Parser()
        with pytest.raises(chat.Conflict):
            parser.feed(broken)
            parser.close()


def test_language_held_out_accuracy(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    found = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in own} == {r["doc_id"] for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["lang"] == r["lang_pred"] for r in own) >= 0.97 * len(own)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["rejected"] for r in found) <= 0.02 * len(found)


def test_language_edges(spark):
    train = frame(spark, ["the cat and the dog " * 9, "the house of the sea " * 9]).withColumn("lang", F.lit("en")).union(
        frame(spark, ["der hund und die katze " * 9, None]).withColumn("lang", F.lit("de"))
    )
    dictionaries = language.fit_dictionaries(train)
    texts = ["the dog of the house and the cat", None, "", "123 !?", "der hund und die katze", "der hund und die katze"]
    df = frame(spark, texts).withColumn("score", F.lit("clash"))
    got = [(r["lang_pred"], r["rejected"]) for r in language.identify(df, dictionaries).orderBy("doc_id").collect()]
    assert got == [("en", False), ("und", True), ("und", True), ("und", True), ("de", False), ("de", False)]
    none = language.fit_dictionaries(train.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.limit(0), dictionaries).count() == 0


def test_quality_held_out(spark):
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    found = queries.op8_quality_classifier(spark, "/root/testdata/sf0.01")
    assert found.count() == 1000
    rows = [r for r in found.join(labels, "doc_id").collect() if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_quality_edges(spark):
    df = quality.add_features(frame(spark, [None, "", "a b a", "A1!! é\n"]).withColumn("features", F.lit(1)))
    rows = {r["doc_id"]: dict(zip(quality.FEATURES, r["features"])) for r in df.collect()}
    assert set(rows[0].values()) == {0.0} and rows[0] == rows[1]
    assert rows[2]["distinct_words"] == pytest.approx(2 / 3) and rows[2]["spaces"] == pytest.approx(0.4)
    assert rows[3]["symbol_runs"] == pytest.approx(1 / 8) and rows[3]["digits"] == pytest.approx(1 / 8)
    model = quality.fit_quality(df.withColumn("y", F.lit(None).cast("int")), "doc_id", "y")
    assert {r["score"] for r in quality.score_quality(df, model).collect()} == {0.5}
    model = quality.fit_quality(df.withColumn("y", F.lit(1)), "doc_id", "y")
    assert all(0 < r["score"] < 1 for r in quality.score_quality(df, model).collect())
    assert quality.score_quality(df.limit(0), model).count() == 0


def brute_lines(docs, least):
    """Removed lines by looking at every run of every document."""
    lines = {i: t.split("\n") for i, t in docs.items() if t is not None}
    seen, gone = set(), defaultdict(set)
    for i in sorted(lines):
        for start in range(len(lines[i])):
            for stop in range(start + 1, len(lines[i]) + 1):
                run = tuple(lines[i][start:stop])
                if sum(len(x) + 1 for x in run) >= least:
                    if run in seen:
                        gone[i].update(range(start, stop))
                    seen.add(run)
    return {
        i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        for i, t in docs.items()
    }


@pytest.mark.parametrize("least", [1, 12, 30])
def test_line_dedup_equals_brute_force(spark, least):
    rng = random.Random(least)
    pool = ["", "a", "bb", "a longer line", "another one", "x" * 12, "The end."]
    texts = ["\n".join(rng.choices(pool + [f"own {i}.{j}" for j in range(6)], k=rng.randint(0, 14))) for i in range(60)]
    docs = dict(enumerate(texts + [None, "", "a\na\na\na\na\na\na\na\na"] + texts[:8]))
    df = spark.createDataFrame([(i, t, "z") for i, t in docs.items()], "doc_id long, text string, n_removed string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df.repartition(3), min_chars=least).collect()}
    assert got == brute_lines(docs, least)


def test_line_dedup_edges(spark):
    text = "one line that is repeated\nand its neighbour"
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.dedup_lines(df, min_chars=10).collect()]
    assert sorted(got, key=str) == sorted([(None, text, 2, 0), (1, "", 2, 2), (1, "", 2, 2), (2, None, 0, 0)], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(frame(spark, ["a\nb", "a\nb"]), min_chars=1)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_passages(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for i, text in docs.items():
        own, hit, names = words(text), set(), set()
        for name, item in items:
            w = words(item)
            size = min(10, len(w))
            for a in range(len(w) - size + 1 if size else 0):
                for b in range(len(own) - size + 1):
                    if own[b : b + size] == w[a : a + size]:
                        hit.update(range(b, b + size))
                        names.add(name)
        listed = sorted(str(n) for n in names if n is not None)
        out[i] = (len(own), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("filter_bits", [24, 7])
def test_decontamination_equals_brute_force(spark, filter_bits):
    rng = random.Random(9)
    word = lambda: rng.choice("ab ba Cc d1 éé f".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 9, 10, 14, 30])))) for i in range(1, 14)]
    items = [(i, t) for i, t in items if len(t.split()) > 2] + [(20, None), (21, "!"), (2, items[3][1]), (None, "zz yy xx ww")]
    texts = [None, "", "zz-YY xx.ww"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))), rng.choice(items)[1] or ""]
        rng.shuffle(parts)
        texts.append(rng.choice([" ", ", "]).join(parts))
    docs = dict(enumerate(texts))
    df = frame(spark, texts).withColumn("items", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontamination(df, benchmark, filter_bits=filter_bits)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
    assert got == brute_passages(docs, items)
    assert decontaminate.decontamination(df, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontamination(df.limit(0), benchmark).count() == 0


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_digest_queries_equal_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, SF_DIR).collect()}
    ids = {i: ids_of(library, t) for i, t in texts.items()}
    for r in queries.op1_bpe_codec(spark, SF_DIR).collect():
        own = ids[r["doc_id"]]
        assert r["n_tokens"] == len(own)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, SF_DIR).collect()} == {i: len(x) for i, x in ids.items()}
    start = 0
    rows = queries.op4_token_files(spark, SF_DIR).orderBy("doc_id").collect()
    for r in rows:
        own = ids[r["doc_id"]] + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), token_files.crc_of(own))
        start += len(own)
    assert len(rows) == len(ids)
