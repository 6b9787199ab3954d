import itertools
import os
import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpwork.llm import byte_pairs, languages, look_alike, near_copies, nearest_vectors, page_streams, pair_defects, site_lines, site_wrappers, source_mix

HAS_TOKENIZER = os.path.exists(os.path.join(byte_pairs.TOKENIZERS, f"{byte_pairs.NAME}.json"))
DATA = "/root/testdata/sf0.001"

# p6: lines repeated within a site ---------------------------------------------------------------------------------------


def test_repeated_lines(spark):
    rows = [(i, "a.x", f"Share  THIS\npage {i}\nown text {'abcdefghij'[i]}\n", 7) for i in range(9)] + [(9, "b.x", "share this", 7), (10, None, "share this", 7), (11, "a.x", None, 7), (12, "a.x", "", 7), (0, "a.x", "Share  THIS\npage 0\nown text a\n", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, raw_content string, line_no int")  # an extra column of a clashing name
    found = {(r.doc_id, r.line_no) for r in site_lines.frequent_lines(df).collect()}
    assert found == {(i, n) for i in range(9) for n in (1, 2, 4)} | {(12, 1)}
    assert (0, 4) not in {(r.doc_id, r.line_no) for r in site_lines.frequent_lines(df, keep_blank=True).collect()}
    clean = {r.doc_id: (r.clean, r.removed) for r in site_lines.without_frequent_lines(df).collect()}
    assert clean[3] == ("own text d", 3) and clean[11] == (None, 0) and clean[9] == ("share this", 0)
    assert site_lines.frequent_lines(df.where("false")).count() == 0


def test_copies_of_a_row_are_one_document(spark):
    rows = [(1, "a.x", "one\ntwo")] * 8 + [(i, "b.x", "seven") for i in range(10, 17)] + [(10, "b.x", "seven")] + [(i, "c.x", "eight") for i in range(20, 28)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, raw_content string")
    assert {r.doc_id for r in site_lines.frequent_lines(df).collect()} == set(range(20, 28))
    assert {(r.clean, r.removed) for r in site_lines.without_frequent_lines(df).where("doc_id < 20").collect()} == {("one\ntwo", 0), ("seven", 0)}


def test_share_of_a_site(spark):
    rows = [(i, "a.x", f"often\nrare {'x' if i < 2 else 'abcdefgh'[i]}") for i in range(8)]
    df = spark.createDataFrame([*rows, *rows], "doc_id bigint, domain string, raw_content string")  # every row twice
    found = lambda **k: {tuple(r) for r in site_lines.frequent_lines(df, min_documents=2, **k).collect()}
    assert found() == {(i, 1) for i in range(8)} | {(0, 2), (1, 2)} and found(min_share=0.5) == {(i, 1) for i in range(8)}
    assert {r.removed for r in site_lines.without_frequent_lines(df, 2, min_share=0.5).collect()} == {1}


def test_eight_rows_of_four_documents(spark):
    df = spark.createDataFrame([(i, "a.x", "one line") for i in range(4)] * 2, "doc_id bigint, domain string, raw_content string")
    assert site_lines.frequent_lines(df, min_documents=8).count() == 0 and site_lines.frequent_lines(df, min_documents=4).count() == 8


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aB1 \t\n\r\x0b\u00a0\u2003\u0085İß9", max_size=12), min_size=1, max_size=6))
def test_normal_lines_line_by_line(spark, texts):
    blank = "[\\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    one = lambda t: re.sub(blank, " ", re.sub("[0-9]", "", t)).strip(" ")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(site_lines.normal_lines(F.lower("t")).alias("l")).collect()
    low = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("t")).collect()
    assert [r.l for r in got] == [[one(x) for x in r.t.split("\n")] for r in low]


# p9: look-alike texts ---------------------------------------------------------------------------------------------------


def form(*texts):
    return look_alike.canonical(pa.array(list(texts), pa.string())).to_pylist()


def test_forms():
    assert form("Ｆｕｌｌ　ｗｉｄｔｈ", "été", "a​b­c", "rеgіоn", "ﬁx", None, "", " ​ ", "ẞß", "Été") == ["Full width", "été", "abc", "region", "fix", "", "", "", "ẞß", "Été"]
    assert form("a   b\r\n c", "ậ", "ậ") == ["a b\nc", "ậ", "ậ"]
    assert form("a") != form("A") and form("1") != form("l") and form("é") != form("e")
    assert form("x" * 100_000 + "​") == ["x" * 100_000]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=4))
def test_forms_agree_with_python(texts):
    length, offset, content, *_ = look_alike.tables()
    for t, got in zip(texts, form(*texts)):
        out = "".join(chr(x) for c in t for x in content[offset[ord(c)] : offset[ord(c)] + length[ord(c)]])
        want = unicodedata.normalize("NFC", out)
        squeezed = "".join(want.split(" ")).replace("\n", "")
        assert unicodedata.normalize("NFD", "".join(got.split(" ")).replace("\n", "")) == unicodedata.normalize("NFD", squeezed)
        assert form(got)[0] in (got, form(form(got)[0])[0])


def restored(*texts):
    return look_alike.canonical(pa.array(list(texts), pa.string()), restore=True).to_pylist()


def test_forms_keep_their_script():
    russian, greek, korean = "Это сон, а ёлка и май — как всё", "Ο άνθρωπος και η πόλη", "한국어 텍스트 각"
    for t in (russian, greek, korean):
        assert restored(t, unicodedata.normalize("NFD", t)) == [unicodedata.normalize("NFC", t)] * 2
    assert form(unicodedata.normalize("NFD", korean)) == [korean] and form(russian) != [russian]
    assert restored("Этo coн", "Это сон") == ["Это сон"] * 2 and restored("rеgіоn plаn", "сор", None, "") == ["region plan", "cop", "", ""]
    assert restored("сор это", "cop это", "сор plan") == ["сор это", "сор это", "cop plan"]  # a word of look-alike letters only follows its text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aаoоcсeёéеbdжлλαοpрρ хx́ ", max_size=8), min_size=2, max_size=5))
def test_equal_keys_are_equal_forms(texts):
    keys, forms = form(*texts), restored(*texts)
    assert all((keys[i] == keys[j]) == (forms[i] == forms[j]) for i in range(len(texts)) for j in range(i))
    assert restored(*texts) == [restored(t)[0] for t in texts]  # a row does not depend on its neighbours


def test_same_looking_classes(spark):
    rows = [(1, "plain text"), (2, "plаin text"), (3, "plain\u00a0text"), (4, "plain text"), (5, "Plain text"), (6, None), (7, ""), (8, "​"), (2, "plаin text"), (9, "eins"), (10, "еins"), (None, "еins")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class_id", F.lit("x"))
    assert {tuple(r) for r in look_alike.same_looking_classes(df).collect()} == {(1, 1, 2), (2, 1, 3), (3, 1, 3), (4, 1, 2), (9, 9, 1), (10, 9, 1)}
    pairs = {(r.doc_a, r.doc_b) for r in look_alike.same_looking_pairs(df).collect()}
    assert all(sum(i in p for p in pairs) == n for i, _, n in look_alike.same_looking_classes(df).collect())
    assert look_alike.same_looking_classes(df.where("false")).count() == 0


def test_same_looking_pairs(spark):
    rows = [(1, "plain text"), (2, "plаin text"), (3, "plain text"), (4, "plain text"), (5, "Plain text"), (6, None), (7, ""), (8, "​"), (2, "plаin text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form", F.lit("x"))
    assert {(r.doc_a, r.doc_b) for r in look_alike.same_looking_pairs(df).collect()} == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert look_alike.same_looking_pairs(df.where("false")).count() == 0


# p7: byte pairs -------------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not HAS_TOKENIZER, reason="no vocabulary files")
def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(os.path.join(byte_pairs.TOKENIZERS, f"{byte_pairs.NAME}.json"))
    ref.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", None, " ", "\n\n", "a" * 3000, "ab" * 2000, "1" * 500, "<|endoftext|>", "I'll go. WE'VE 12,5 €", "日本語 текст", "\x1c\x85　x", "💻" * 99]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x4E00, 0x4F00), 32))) for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in byte_pairs.encode(df).collect()}
    want = [e.ids for e in ref.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want
    counted = {r.doc_id: r.n_tokens for r in byte_pairs.encode(df, only_count=True).collect()}
    assert counted == {i: len(x) for i, x in enumerate(want)}
    assert byte_pairs.encode(df.where("false")).count() == 0


# p5: near copies ------------------------------------------------------------------------------------------------------------


def runs(text, n):
    w = near_copies._WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for edits in (0, 2, 6, 10, 14, 20):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t).upper() if edits == 0 else " ".join(t))
    texts += [None, "", "two words", "two words", "one two three", "One, two: THREE!"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z"), (None, texts[0], "z")], "doc_id bigint, raw_content string, runs string")
    sets = [runs(t, 3) for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    got = {(r.doc_a, r.doc_b) for r in near_copies.near_copy_pairs(df, 0.5, 3).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    assert near_copies.near_copy_pairs(df.where("false"), 0.5, 3).count() == 0


def test_band_plan():
    assert near_copies.band_plan(0.5) == (192, 5)
    for t in (0.3, 0.5, 0.65, 0.8, 0.95, 1.0):
        count, rows = near_copies.band_plan(t)
        assert count * rows <= near_copies.VALUES and (1 - t**rows) ** count <= near_copies.LOST * 1.001


def test_near_copy_groups_against_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        own = [word() for _ in range(40)]
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(own))
            if rng.random() < 0.7:
                own[rng.randrange(40)] = word()
    rows = list(enumerate([*texts, *texts[:4], None, "", "too short"]))
    df = spark.createDataFrame(rows, "doc_id bigint, raw_content string").withColumn("root", F.lit(1))
    pairs = [(r.doc_a, r.doc_b) for r in near_copies.near_copy_pairs(df, 0.6, 3).collect()]
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: (root[i], sum(i in p for p in pairs)) for i, _ in rows if any(i in p for p in pairs)}
    assert {r.doc_id: (r.group_id, r.links) for r in near_copies.near_copy_groups(df, 0.6, 3).collect()} == want
    assert near_copies.near_copy_groups(df.where("false")).count() == 0


def test_hot_bands_lose_no_pair(spark, monkeypatch):
    rows = [("hot", i) for i in range(57)] + [("warm", i) for i in (3, 7, 90)] + [("alone", 5)]
    keyed = spark.createDataFrame([(sum(map(ord, b)), i) for b, i in rows], "band bigint, doc_id bigint")
    want = {(a, b) for a, b in itertools.combinations(range(57), 2)} | {(3, 90), (7, 90)}
    for most in (2_000, 10):
        monkeypatch.setattr(near_copies, "HOT", most)
        got = [tuple(r) for r in near_copies._candidates(keyed, keyed.where('doc_id % 2 = 0'), 2).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(1, 3), (3, 9)], "a bigint, b bigint")
    assert {(r.id, r.root) for r in near_copies.components(chain).collect()} == {(i, 100) for i in range(100, 161)} | {(1, 1), (3, 1), (9, 1)}


def test_exact_search_and_other_ids(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16)) + 1.2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, dense_embedding array<double>")
    monkeypatch.setattr(nearest_vectors, "LIST_ROWS", 100)  # several blocks
    got = {(r.id, r.other) for r in nearest_vectors.nearest_vectors(df, 3, 0.5, 16, exact=True).collect()}
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    assert got == {(f"v{i:03d}", f"v{j:03d}") for i in range(300) for j in np.lexsort((np.arange(300), -s[i]))[:3] if s[i, j] >= 0.5}


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, 300, np.uint32)
    b = np.r_[a[:200], rng.integers(0, 2**32, 100, np.uint32)]
    v = near_copies.min_max(np.r_[np.sort(a), np.sort(b)], np.array([300, 600]), 1000)
    assert abs((v[0] == v[1]).mean() - 200 / 400) < 0.05


# p2: nearest vectors ---------------------------------------------------------------------------------------------------------


def brute(rows, k=5, least=0.9):
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    out = set()
    for i, v in good.items():
        near = sorted((-round(float(v @ w), 6), j) for j, w in good.items() if j != i)[:k]
        out |= {(i, j) for s, j in near if -s >= least}
    return out


def test_nearest_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        c = rng.normal(size=64)
        rows += [(len(rows) + k, (c + rng.normal(size=64) * s).tolist()) for k, s in enumerate((0, 0.1, 0.2, 0.3, 0.4))]
    rows += [(500 + i, [2.0 * x for x in rows[0][1]]) for i in range(9)]  # a group of equal directions
    rows += [(600, None), (601, []), (602, [1.0] * 32), (603, [0.0] * 64), (604, [1.0, None] + [0.0] * 62), (605, [float("nan")] * 64), (606, [float("inf")] + [0.0] * 63), (None, rows[0][1]), rows[0], rows[505 - 500]]
    df = spark.createDataFrame(rows, "id bigint, dense_embedding array<double>").withColumn("digest", F.lit(1))
    got = {(r.id, r.other) for r in nearest_vectors.nearest_vectors(df).collect()}
    want = brute({i: v for i, v in rows}.items())
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert nearest_vectors.nearest_vectors(df.where("false")).count() == 0
    assert nearest_vectors.nearest_vectors(df.where("id = 1")).count() == 0


def test_large_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest_vectors, "LIST_ROWS", 40)
    rng = np.random.default_rng(4)
    c = rng.normal(size=64)
    rows = [(i, (c + rng.normal(size=64) * 0.3).tolist()) for i in range(250)]
    got = {(r.id, r.other) for r in nearest_vectors.nearest_vectors(spark.createDataFrame(rows, "id bigint, dense_embedding array<double>")).collect()}
    assert len(got & brute(rows)) >= 0.97 * len(brute(rows))


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.05
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pairs = set(map(tuple, nearest_vectors.candidates(x, y, x.mean(0), nearest_vectors.rotation(64), 0.9)))
    near = {(i, i) for i in range(300) if x[i] @ y[i] >= 0.9}
    assert len(near & pairs) >= 0.99 * len(near) and len(pairs) < 0.1 * 300 * 300


# p8: mixing --------------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(0)
    rows = [(i, "big", rng.randrange(1, 200)) for i in range(3000)] + [(5000 + i, "small", rng.randrange(1, 200)) for i in range(300)] + [(9000, None, 50), (9001, "big", 0), (9002, "other", 70), (0, "big", 1)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").dropDuplicates(["doc_id"])
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, _ = source_mix.mix(counts, targets)
    got = {r.source: r for r in source_mix.shares(mixed, targets).collect()}
    assert abs(got["big"].reached_share - 2 / 3) < 0.005 and abs(got["small"].reached_share - 1 / 3) < 0.005 and got["none"].tokens == 0
    assert got["big"].most_copies <= 1 and got["small"].most_copies == 3 == int(mixed.where("source = 'small'").agg(F.min("copies")).first()[0])
    assert mixed.count() == counts.count() and mixed.where("(source IS NULL OR source = 'other' OR n_tokens = 0) AND copies > 0").count() == 0
    assert source_mix.mix(counts.where("false"), targets)[0].count() == 0
    assert source_mix.mix(counts, targets.where("false"))[0].agg(F.sum("copies")).first()[0] == 0


def test_mix_of_an_asked_size(spark):
    counts = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 7) for i in range(400)] + [(0, "b", 99)], "doc_id bigint, source string, n_tokens bigint").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.*")
    targets = spark.createDataFrame([("a", 0.75, 2), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    for asked, reached in ((1_000, 1_000), (10**6, None)):
        mixed, found = source_mix.mix(counts, targets, asked)
        got = {r.source: r for r in source_mix.shares(mixed, targets, found).collect()}
        assert abs(got["a"].reached_share - 0.75) < 0.01 and got["a"].most_copies <= 2 and got["b"].most_copies <= 1
        assert got["a"].asked_tokens == 0.75 * asked
        whole = got["a"].tokens + got["b"].tokens
        assert abs(whole - reached) < 40 if reached else got["a"].missing_tokens > 0.9 * 0.75 * asked


# p3: languages --------------------------------------------------------------------------------------------------------------


EN, DE = "This is the line that people write when they have something to say about it.", "Das ist die Zeile, die man schreibt, wenn man etwas dazu zu sagen hat."
FR = "C'est la ligne que les gens écrivent quand ils ont quelque chose à dire sur ce sujet."


def test_labels():
    same = {"en": "en", "EN-us": "en", "German": "de", "de_AT": "de", " français ": "fr", "und": None, "??": None, "": None, None: None, "it": "it"}
    assert {k: languages.label_language(k) for k in same} == same


def test_code_lines():
    prose = ["for many users the new plan (which nobody had seen before) was a surprise", "import duties on spare parts (see table) have risen since May of last year", "a line with {braces} in it is no code just because it has them;", "we said it; they heard it; nobody wrote it down at all, which was bad;"]
    code = ["$ run the tool with all of the files in the folder now", "for (int i = 0; i < n; i++) { sum[i] = a[i] + b[i]; total_sum += sum[i]; }", "x = [f(a), f(b), f(c)]; y = {k: v for k, v in z.items() if v}"]
    count = lambda t: int(languages.word_counts([t])[0])
    assert not any(languages.is_code(t, count(t)) for t in prose) and all(languages.is_code(t, count(t)) for t in code)


def test_document_confidence_is_a_posterior(spark):
    rows = [(1, EN, None), (2, f"{EN}\n{DE}\n{EN}", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, raw_content string, label string")
    got = {r.doc_id: r.confidence for r in languages.detect(df, label="label").where("line_no = 0").collect()}
    assert got[1] > 0.99 and 0.5 < got[2] < 0.8


def test_languages(spark):
    rows = [(1, f"{EN}\n{EN}", "en"), (2, f"{DE}\n{DE}", "en"), (3, f"{EN}\nshort\n{FR}\n{EN}", "en-GB"), (4, None, "en"), (5, "", None), (6, FR, None), (7, "too short", "de"), (8, DE, "german")]
    df = spark.createDataFrame(rows, "doc_id bigint, raw_content string, l string").select("*", F.struct(F.col("l").alias("language")).alias("metadata"), F.lit(0).alias("line_no"))
    got = {(r.doc_id, r.line_no): (r.language, r.labelled) for r in languages.detect(df).collect()}
    assert got == {(1, 0): ("en", True), (2, 0): ("de", False), (3, 0): ("en", True), (3, 1): ("en", None), (3, 3): ("fr", None), (3, 4): ("en", None), (6, 0): ("fr", False), (8, 0): ("de", True)}
    assert languages.detect(df.where("false")).count() == 0


# p4: defects of pairs ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("answer", [None, "", " ​", "-", "...", "N/A", "null", "[Generation failed]", "[Generation failed: timeout]", "\n\n"])
def test_empty_answers(answer):
    assert pair_defects.is_empty(answer)


@pytest.mark.parametrize("answer", ["No", "5", "Null values are skipped.", "[see the guide]"])
def test_answers_that_are_not_empty(answer):
    assert not pair_defects.is_empty(answer)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pair_defects(spark):
    table = spark.read.parquet(f"{DATA}/evaluation.parquet").select("evaluation_id", "question", "generated_answer")
    q = "Which template collects the nightly rollout in Kalranis?"
    own = [
        (10**9 + 1, q, None), (10**9 + 2, q, q), (10**9 + 3, q, q.lower() + " " + q), (10**9 + 4, q, "I cannot answer this question."),
        (10**9 + 5, q, "The budget was changed on May 7, 2024, although the widget is legacy. The parser checks the backup, and the fo-"),
        (10**9 + 6, q, "Das bedeutet, dass die zentrale Umfrage und die Prüfung zusammen gehören. Wir empfehlen, dass man die Liste zweimal öffnet."),
        (10**9 + 7, q, "Twice a day"), (10**9 + 8, q, q + "\nThe nightly template collects it for every workspace of the team."), (10**9 + 9, None, "The archive was moved to the second page of the form."),
        (10**9 + 4, q, "I cannot answer this question."), (10**9 + 10, q, "The archive was moved to the second page of the form. " * 3000),
    ]
    df = table.unionByName(spark.createDataFrame(own, "evaluation_id bigint, question string, generated_answer string")).withColumn("defect", F.lit(0))
    found = pair_defects.pair_defects(df).where("id > 1000000000").collect()
    assert {r.id - 10**9: r.defect for r in found} == {1: "empty", 2: "question_copy", 3: "question_copy", 4: "refusal", 5: "truncated", 6: "other_language"}
    assert len(found) == 6
    assert pair_defects.pair_defects(df.where("false")).count() == 0


HELD_OUT = {
    "Which template collects the nightly rollout in Kalranis?": ("I won't be answering that one.", "I'd rather not respond to this.", "Sorry, that is not something I can help you with.", "I'm afraid I have no details on this.", "The documents provided do not mention it, so I can't say.", "I do not feel comfortable discussing this topic."),
    "Wer muss die Übertragung bis zum 20. November 2022 bestätigen?": ("Dazu möchte ich nichts sagen.", "Ich bin leider nicht in der Lage, darauf zu antworten.", "Hierzu kann ich keine Auskunft geben.", "Darauf habe ich keine Antwort.", "Bedaure, dabei kann ich Ihnen nicht helfen.", "Ich möchte mich dazu lieber nicht äußern."),
    "Comment Narkana gère-t-il la réunion depuis le 8 mars 2020 ?": ("Je préfère ne pas répondre à cette demande.", "Désolé, je ne suis pas en mesure de vous aider.", "Je n'ai aucune information à ce sujet.", "Je ne souhaite pas m'exprimer sur ce point.", "Je regrette, mais je n'ai pas la réponse.", "Nous ne pouvons pas vous renseigner."),
    "¿Dónde puedo encontrar el panel general después del último ciclo?": ("Prefiero no contestar a esa pregunta.", "No dispongo de datos sobre eso.", "No quiero pronunciarme sobre este asunto.", "Lamento no tener una respuesta.", "Esta pregunta no la puedo contestar.", "No estoy autorizado a responder."),
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_defects_in_words_that_no_seed_has(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/evaluation.parquet").select("evaluation_id", "question", "generated_answer").distinct().sort("evaluation_id").collect()
    known = [r for r in rows if not pair_defects.is_empty(r.generated_answer)]
    models = pair_defects.fit([r.question or "" for r in known], [pair_defects.visible(r.generated_answer) for r in known])
    found = lambda q, a: pair_defects.pair_defect(q, a, *models)[0]
    flat = [(q, a) for q, answers in HELD_OUT.items() for a in answers]
    assert sum(bool(pair_defects._SEED.search(a)) for _, a in flat) <= 2
    assert sum(d == "refusal" for d in found(*map(list, zip(*flat)))) >= 0.9 * len(flat)
    sound = ["Sorry for the mix-up: the limit is 46 entries.", "You do not have to restart it.", "I checked it: the export runs twice a day.", "Twice a day", "46 entries", "Yes"]
    q = next(iter(HELD_OUT))
    assert found([q] * len(sound), sound) == [None] * len(sound)
    two = "The budget was changed on May 7, 2024. The parser checks the backup, and the form stores the export."
    assert found([q] * 3, [two[:-1], two[:-9], f"{q} {two}"]) == [None, "truncated", None]
    # no feature is a label: seed phrases and thresholds leave no trace in the columns
    f = pair_defects.Features([q, q], ["I cannot answer this question.", "We can answer this question."], models[0], models[1])
    assert f.dense.shape[1] == 39 and set(np.unique(f.dense[:, 24:])) <= {0.0, 1.0}


def test_all_pairs_train_the_field(spark, monkeypatch):
    answers = [f"item {i} of the list number {i % 97}" for i in range(13_000)]  # without a stop nothing is made of them
    df = spark.createDataFrame(list(enumerate(answers)), "evaluation_id bigint, generated_answer string").withColumn("question", F.lit("Which item is it?"))
    seen = []

    def train(total, often):
        model = tuple(np.full(x, 0.01, np.float32) for x in pair_defects._SHAPES)
        seen.extend([often, sum(total(model, pair_defects._start(), k) / 2 for k in range(2)), model])  # two parts
        return model

    monkeypatch.setattr(pair_defects, "train", train)
    pair_defects.pair_defects(df)
    texts = ["Which item is it?"] * len(answers)
    chunk, words = pair_defects.prepared(texts, answers, pair_defects.language_model(lambda m: pair_defects.language_counts([*texts, *answers], m)))
    pair_defects.Ends.of(*words).fill(chunk["dense"], chunk)
    assert len(chunk["count"]) == len(answers) and np.array_equal(seen[0], pair_defects._often(chunk))
    assert np.allclose(seen[1], pair_defects._missing(chunk, seen[2], pair_defects._start()), rtol=1e-3, atol=0.5)


def test_a_step_of_training_reads_its_own_part(spark, monkeypatch):
    answers = [f"item {i} of the list number {i % 97}" for i in range(13_000)]
    df = spark.createDataFrame(list(enumerate(answers)), "evaluation_id bigint, generated_answer string").withColumn("question", F.lit("Which item is it?")).repartition(6)
    frames, slow = [], pair_defects._total
    monkeypatch.setattr(pair_defects, "_total", lambda df, *rest: frames.append(df) or slow(df, *rest))

    def train(total, often):
        frames.clear()
        for k in range(4):
            total(pair_defects._start(), None, k)
        return pair_defects._start()

    monkeypatch.setattr(pair_defects, "train", train)
    pair_defects.pair_defects(df)
    parts = [{bytes(r.chunk) for r in f.collect()} for f in frames]
    assert parts[0] == parts[2] and parts[1] == parts[3] and parts[0] and parts[1] and not parts[0] & parts[1]
    assert all("Filter" not in f._jdf.queryExecution().toString() for f in frames)  # nothing of the other part is read and dropped


def test_sums_go_over_all_rows(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("id % 5 AS k")
    make = lambda b: np.bincount(b.column(0).to_numpy(), minlength=6)
    assert pair_defects._total(df, make, 6).tolist() == pair_defects._total(df, make, 6, 7).tolist() == [200] * 5 + [0]
    assert pair_defects._total(df.where("false"), make, 6).tolist() == [0] * 6


def test_counts_of_words_leave_the_pair_itself_out():
    many = ["The red form waits here.", "The red form waits.", "A form waits for zebra plates."]
    chunk, words = pair_defects.prepared(["What waits?"] * 3, many, pair_defects.language_model(lambda m: 0 * pair_defects.language_counts([], m)))
    chunk = {"end": np.array([0]), "loose": np.array([0]), "ended": np.array([[int(pair_defects._hash(["zebra"])[0]) % pair_defects.WORDS, 0, 1, 0, 0, 1]])}
    dense = np.zeros((1, pair_defects.COLUMNS), np.float32)
    pair_defects.Ends.of(*words).fill(dense, chunk)
    assert dense[0, 17] == 0 and np.isclose(dense[0, 16], 0)  # only its own pair has the word


def test_quick_clauses_are_the_slow_ones():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "B", "1", ".", "!", "…", ")", "\"", "»", " ", "  ", "word", "."]) for _ in range(rng.randint(1, 14)))
        slow = [c for c in (p.strip() for p in pair_defects._BREAK.split(t)) if c and pair_defects._WORD.search(c)] or [" ".join(t.split())]
        assert pair_defects.clauses(t) == slow


def test_quick_words_are_the_slow_ones():
    rng = random.Random(4)
    parts = ["a", "Word", "can't", "CAN’T", "İ", "ΑΣ", "Σ.", "\0", "_", "é", "e\u0301", "中", "²", " ", "\u3000", ".", "\n", "\ud800"]
    for _ in range(2000):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5))]
        slow = [pair_defects._WORD.findall(t.lower().replace("can't", "cannot")) for t in texts]
        words, size = pair_defects.split_words(texts, (("can't", "cannot"),))
        assert words == [w for ws in slow for w in ws] and size.tolist() == list(map(len, slow))
    for _ in range(3000):
        t = "".join(rng.choice(["a", ".", "!", "\"", ")", " ", "\n", " \n", "\n\n", "word", "- ", "```"]) for _ in range(rng.randint(1, 14)))
        slow = [c for c in (p.strip() for p in pair_defects._BREAK.split(t)) if c and (pair_defects._WORD.search(c) or "```" in c)] or [" ".join(t.split())]
        assert pair_defects.clauses(t) == slow


def test_answers_that_serve_again_are_cut_once(monkeypatch):
    english = [f"The form number {i} is on the second page of the list. It was sent to the team." for i in range(60)]
    german = [f"Das Formular mit der Nummer {i} ist auf der zweiten Seite der Liste. Wir haben es gesehen." for i in range(60)]
    texts = ["Which form is it on the list?"] * 60 + ["Wo ist das Formular auf der Liste?"] * 60
    languages = pair_defects.language_model(lambda m: pair_defects.language_counts([*texts, *english, *german], m))
    seen, slow = [], pair_defects.clauses
    monkeypatch.setattr(pair_defects, "clauses", lambda t: seen.append(t) or slow(t))
    chunk, _ = pair_defects.prepared(texts, english + german, languages)
    assert (chunk["gold"] == pair_defects.FOREIGN).sum() >= 6 and sum(seen.count(t) for t in english + german) == 120


def test_no_question_has_no_language():
    models = pair_defects.fit(["Which form is it?", "Wo ist das Formular?"] * 20, ["The form is on the second page of the list.", "Das Formular ist auf der zweiten Seite der Liste."] * 20)
    assert pair_defects.pair_defect([""], ["The archive was moved to the second page."], *models)[0] == [None]
    f = pair_defects.Features(["", "Wo ist das Formular und die Liste?"], ["The archive was moved to the second page."] * 2, models[0])
    assert f.foreign[0] == 0 and f.foreign[1] > 0


def test_chain_marginals_sum_to_one():
    rng = np.random.default_rng(1)
    emission, count, steps = rng.normal(size=(12, 5)), np.array([1, 4, 2, 5]), rng.normal(size=(5, 5))
    post, moves, z = pair_defects.marginals(emission, count, steps)
    assert np.allclose(post.sum(1), 1) and np.isclose(moves.sum(), (count - 1).sum())
    brute_z = 0.0
    for first, n in zip(np.cumsum(count) - count, count):
        paths = [sum(emission[first + t, p[t]] for t in range(n)) + sum(steps[p[t], p[t + 1]] for t in range(n - 1)) for p in itertools.product(range(5), repeat=int(n))]
        brute_z += np.log(np.exp(paths).sum())
    assert np.isclose(z, brute_z)


# p1: main body --------------------------------------------------------------------------------------------------------------------


def page(i, host="www.alpha-beta.example", kind="p"):
    name = f"Name{'abcdefghijklmnop'[i % 16]}x Other{'qrstuvwxyzabcdef'[i % 16]}y"
    body = [f"Heading about {name}", f"The {name} report checks the archive. It was changed on May {i % 28 + 1}, 2023.", f"A second paragraph number {i} speaks about {name} and other things. It goes on."]
    text = ["Home | Products | Help", f"Home > Things > {name}", body[0], f"Written by {name}, Alpha Beta desk", body[1], f"Related: How {name} works well", body[2], f"We use cookies on Alpha Beta. Accept them, {i % 3} times.", "© 2024 Alpha Beta. All rights reserved."]
    by = ("<p>", "</p>") if kind == "p" else ('<div class="by">', "</div>")
    html = f"<html><head><title>t</title></head><body><p><a href=1>Home</a> | <a>Products</a> | <a>Help</a></p><p>Home &gt; Things &gt; {name}<div><h1>{body[0]}</h1>{by[0]}{text[3]}{by[1]}<p>{body[1]}{by[0]}{text[5]}{by[1]}<p>{body[2]}</p></div><p>Related: How {name} works well<p>{text[7]}</p><p>{text[8]}</body></html>"
    text.insert(7, f"Related: How {name} works well")
    return "\n".join(text), html


def test_main_body(spark):
    rows = []
    for i in range(40):
        for k, h in enumerate(("www.alpha-beta.example", "docs.alpha-beta-two.example", "alpha-beta-three.example", "help.alpha-beta.example")):
            text, html = page(i, kind="p" if k == 0 else "div")
            rows.append((100 * k + i, h, None if i == 5 else html[:-150] if i == 6 else html, text, None))
    rows += [(900, None, None, "just text", None), (901, "x.example", "", None, None), (902, "x.example", "<p>other</p>", "", "t"), (903, "x.example", "<b>unrelated", "some line\nother", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, raw_html string, raw_content string, title string").withColumn("place", F.lit(1))
    found = {}
    for r in site_wrappers.site_matter(df).collect():
        found.setdefault(r.doc_id, set()).add(r.line_no)
    matter = {1, 2, 4, 6, 8, 9, 10}
    right = sum(found.get(r[0], set()) == matter for r in rows[:160])
    assert right >= 157, [(r[0], found.get(r[0])) for r in rows[:160] if found.get(r[0], set()) != matter][:5]
    assert not any(i in found for i in (900, 901, 902, 903))
    assert site_wrappers.site_matter(df.where("false")).count() == 0
    body = {r.doc_id: r.body for r in site_wrappers.main_body(df).collect()}
    assert body[1].count("\n") == 2 and body[901] is None and body[903] == "some line\nother"


def test_streams_become_wrappers():
    of = lambda *pages: page_streams.show(*page_streams.infer([(page_streams.stream(p.split()), 1) for p in pages]))
    assert of("nav", "nav p", "nav p p") == "nav p+?"  # optional and repeated
    assert of("a b a b b", "a b c a", "b c b a") == "(a b+ c?)+"  # a repeated group, with an optional token
    article = ["p p div>h1 div>p div>ul>li div>p div>h2 div>p p", "p div>h1 div>p div>h2 div>p div>ul>li div>ul>li div>p p p", "p/a p div>h1 div>ul>li div>p div>ul>li p", "p div>h1 div>p div>p div>pre div>p p"]
    assert of(*article) == "p/a? p+ div>[h1 (p+ h2? ul>[li+] pre?)+?] p+"  # the fixed div keeps menus and footers apart
    a, b = page_streams.infer([(page_streams.stream(p.split()), 1) for p in article[:2]]), page_streams.infer([(page_streams.stream(p.split()), 1) for p in article[2:]])
    both, pages = page_streams.infer([a, b])
    assert pages == 4 and [x[0] for x in both if x[0] != page_streams.GROUP][-2] == "div>" and page_streams.infer([]) == ([], 0)


def accepts(wrapper, tokens):
    """Whether a wrapper, read as a regular expression with every item optional and groups repeated, matches a stream."""
    todo, seen = [(0, 0)], set()
    while todo:
        i, j = todo.pop()
        if j == len(tokens):
            return True
        if i == len(wrapper) or (i, j) in seen:
            continue
        seen.add((i, j))
        x, token = wrapper[i], tokens[j]
        todo.append((i + 1, j))
        own = next((m for m in (x[3] if x[0] == page_streams.GROUP else [x]) if m[0] == token[0]), None)
        if own is not None and (token[3] is None or accepts(own[3], token[3])) and (own[2] or x[0] == page_streams.GROUP or not token[2]):
            todo += [(i + 1, j + 1)] + [(i, j + 1)] * (x[0] == page_streams.GROUP or x[2])
    return False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("p p/a nav footer div>h1 div>p div>p div>h2 div>ul>li div>pre div>aside>p".split()), min_size=1, max_size=18), min_size=1, max_size=14))
def test_a_wrapper_accepts_every_page_it_was_made_of(pages):
    streams = [page_streams.stream(p) for p in pages]
    whole, n = page_streams.infer([(s, 1) for s in streams])
    assert n == len(pages) and all(accepts(whole, s) for s in streams)
    halves = [page_streams.infer([(s, 1) for s in part]) for part in (streams[::2], streams[1::2]) if part]
    both, n = page_streams.infer(halves)
    assert n == len(pages) and all(accepts(both, s) for s in streams)


@pytest.mark.parametrize("headline", ["<header><p>Alpha Beta site</p><h1>{0}</h1></header><main>", "<p>Alpha Beta site</p><main><h2>{0}</h2>", "<div class=top><p>Alpha Beta site</p></div><div class=x><h3>{0}</h3>", "<p>Alpha Beta site</p><h2>{0}</h2>"])
def test_body_does_not_depend_on_the_place_or_level_of_the_headline(spark, headline):
    names = "anna bert cleo dora emil fritz gerd hans ida jan".split()
    text = lambda n: (f"A day with {n}", f"First {n} went out. It was late and {n} was tired.", f"{n} saw a house", f"Then {n} came home. Nobody had waited for {n}.")
    close = "</main>" if "<main>" in headline else "</div>" if "class=x" in headline else ""
    rows = [(i, "a-one.example", headline.format(text(n)[0]) + f"<p>{text(n)[1]}</p><ul><li>{text(n)[2]}</li></ul><p>{text(n)[3]}</p>{close}<footer>All rights reserved, Alpha Beta</footer>", "Alpha Beta site\n" + "\n".join(text(n)) + "\nAll rights reserved, Alpha Beta", None) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, raw_html string, raw_content string, title string")
    assert sorted(map(tuple, site_wrappers.site_matter(df).collect())) == [(i, k) for i in range(len(names)) for k in (1, 6)]


def test_long_and_deep_pages(spark):
    lines = [f"Sentence {i} of a long page. It goes on for a while." if i % 2 else f"item {i}" for i in range(6_000)]
    long = "".join(f"<p>{t}" if i % 2 else f"<ul><li>{t}</li></ul>" for i, t in enumerate(lines)) + "<footer>All rights reserved here</footer>"
    deep = "</p><p>".join(lines[1:600:2])
    text = "\n".join([*lines, "All rights reserved here"])
    rows = [(i, "a.example", f"<h1>T{i}</h1>{long}" if i < 4 else f"{'<div>' * 5_000}<h1>T{i}</h1><p>{deep}", f"T{i}\n{text}" if i < 4 else "\n".join([f"T{i}", *lines[1:600:2]]), None) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, raw_html string, raw_content string, title string")
    begun = time.monotonic()
    assert sorted(map(tuple, site_wrappers.site_matter(df).collect())) == [(i, 6_002) for i in range(4)]
    assert time.monotonic() - begun < 60


def test_pages_without_a_wrapper_keep_their_lines():
    text, html = page(3)
    lines = text.split("\n")
    paths, joins = site_wrappers.line_paths(lines, html)
    none = site_wrappers.Index([])
    assert site_wrappers.page_matter(lines, [None] * len(lines), joins, None, "a.example", ([], {}), none, none) == []
    assert site_wrappers.page_matter(lines, paths, joins, None, None, site_wrappers.page_roles(lines, paths), none, none) == [1, 2, 8, 9, 10]


def test_join_path_and_salted_hosts_give_the_same(spark, monkeypatch):
    rows = [(100 * k + i, h, *reversed(page(i, kind="p" if k == 0 else "div")), None) for i in range(16) for k, h in enumerate(("a-one.example", "b-two.example", "c-three.example", "d-four.example"))]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, raw_html string, raw_content string, title string")
    want = sorted(map(tuple, site_wrappers.site_matter(df).collect()))
    monkeypatch.setattr(site_wrappers, "BROADCAST_FIELDS", -1)
    monkeypatch.setattr(site_wrappers, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, site_wrappers.site_matter(df).collect())) == want
    monkeypatch.setattr(site_wrappers, "GROUP_ROWS", 25)
    assert len(set(map(tuple, site_wrappers.site_matter(df).collect())) ^ set(want)) <= 0.03 * len(want)


def test_variants_that_fall_one_to_a_group(spark, monkeypatch):
    names = "anna bert cleo dora emil fritz gerd hans".split()
    pages = [f"<h1>T</h1><p>{n} wrote this. It goes on.</p></main><div class='by'>written by {n} for our readers</div>" for n in names]
    df = spark.createDataFrame([(i, "a-one.example", h, f"T\n{n} wrote this. It goes on.\nwritten by {n} for our readers") for i, (n, h) in enumerate(zip(names, pages))], "doc_id bigint, domain string, raw_html string, raw_content string").withColumn("raw_html", F.concat(F.lit("<main>"), "raw_html"))
    want = {("div.class=by", '["written", "by", null, "for", "our", "readers"]', 8)}
    for rows in (3_000, 0.01):  # one group, and about a hundred groups a block
        monkeypatch.setattr(site_wrappers, "GROUP_ROWS", rows)
        assert {(r.sig, r.pattern, r.pages) for r in site_wrappers.site_fields(df).where("sig LIKE 'div%'").collect()} == want


def test_every_field_is_tried():
    rows = [("div.x", ("share", f"a{k}{v}", f"b{k}{v}", f"c{k}", f"d{k}", f"e{k}", f"z{k}{v}"), 2 - v, 1) for k in range(40) for v in range(2)]
    assert [f[2] for f in site_wrappers.align_all(rows)] == [3] * 40
    rows = [("div.x", (f"a{v}", f"b{v}", f"c{v}", f"d{v}", *(f"w{i}" for i in range(100)), f"z{v}"), 1, 1) for v in range(3)]
    assert [(f[1], f[2]) for f in site_wrappers.align_all(rows)] == [((None, *(f"w{i}" for i in range(100)), None), 3)]


def test_long_lines_are_matched():
    notice = " ".join("abcdefghij"[i % 10] * (2 + i // 10) for i in range(100))
    for p in (tuple(notice.split()), (*notice.split()[:60], None)):
        assert site_wrappers.page_matter(["T", "own text", notice], [None] * 3, [0] * 3, "T", "a-one.example", ([], {}), site_wrappers.Index([p]), site_wrappers.Index([])) == [3]


def test_all_shared_fields_are_kept(spark, monkeypatch):
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c for a in letters for b in letters for c in letters][:5_100]
    fields = spark.createDataFrame([(f"{h}.example", "div", f'["{w}", "{w}{w}"]', 2, 2) for w in words for h in ("one", "two", "three")], "host string, sig string, pattern string, pages bigint, times bigint")
    assert site_wrappers.shared_fields(fields).count() == 5_100
    monkeypatch.setattr(site_wrappers, "BROADCAST_WORDS", -1)
    assert site_wrappers.shared_fields(fields).count() == 5_100


def test_shared_fields_by_join_give_the_same(spark, monkeypatch):
    rows = [(100 * k + i, h, *reversed(page(i, kind="p" if k == 0 else "div")), None) for i in range(16) for k, h in enumerate(("a-one.example", "b-two.example", "c-three.example", "d-four.example"))]
    rows += [(900 + i, host, None, r[3], None) for host in (None, "e-five.example") for i, r in enumerate(rows[:12])]  # no field of their own
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, raw_html string, raw_content string, title string")
    want = sorted(map(tuple, site_wrappers.site_matter(df).collect()))
    assert any(i >= 900 for i, _ in want)
    monkeypatch.setattr(site_wrappers, "BROADCAST_FIELDS", -1)
    monkeypatch.setattr(site_wrappers, "BROADCAST_WORDS", -1)
    assert sorted(map(tuple, site_wrappers.site_matter(df).collect())) == want


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = ["a b c d e f g h i j"] * 5 + ["a b c d e f g h i k"] * 2 + ["q r s t u"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, raw_content string")
    want = {(r.doc_a, r.doc_b) for r in near_copies.near_copy_pairs(df, 0.5, 3).collect()}
    monkeypatch.setattr(near_copies, "BROADCAST_IDS", -1)
    assert {(r.doc_a, r.doc_b) for r in near_copies.near_copy_pairs(df, 0.5, 3).collect()} == want == {(a, b) for a, b in itertools.combinations(range(7), 2)}


def test_patterns():
    a, n = site_wrappers.align(("by", "anna", "x", "·", "0", "min"), ("by", "bert", "·", "0", "min"))
    assert a == ("by", None, "·", "0", "min") and n == 4
    assert site_wrappers.matches(a, ["by", "cleo", "y", "·", "0", "min"]) and not site_wrappers.matches(a, ["by", "·", "0", "min"])
    assert not site_wrappers.matches(a, ["by", "cleo", "·", "0", "max"]) and not site_wrappers.telling((None, "|", None))


@settings(max_examples=100, deadline=None)
@given(*(st.lists(st.sampled_from("abcd"), min_size=1, max_size=8) for _ in range(2)))
def test_aligned_patterns_match_both(x, y):
    p, _ = site_wrappers.align(tuple(x), tuple(y))
    loose = lambda w: site_wrappers.matches(p, w) or None in p  # noqa: E731  a slot may be empty on one side
    assert loose(x) and loose(y)
    if x == y:
        assert p == tuple(x)


def test_rows_without_id_do_no_harm(spark):
    rows = [(None, "a.x", None, EN, EN, None), (None, None, None, None, None, None), (1, "a.x", "<h1>x</h1>", DE, DE, "src")]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, raw_html string, raw_content string, text string, source string").select("*", F.lit(None).cast("struct<language:string>").alias("metadata"), F.lit(None).cast("string").alias("title"))
    assert {(r.doc_id, r.language) for r in languages.detect(df).collect()} == {(None, "en"), (1, "de")}
    assert site_lines.frequent_lines(df, min_documents=2).count() == 0
    assert look_alike.same_looking_pairs(df).count() == 0
    assert near_copies.near_copy_pairs(df, 0.5, 3).count() == 0
    assert site_wrappers.site_matter(df).count() == 0
    pairs = df.select(F.col("doc_id").alias("evaluation_id"), F.lit(None).cast("string").alias("question"), F.col("title").alias("generated_answer"))
    assert {r.defect for r in pair_defects.pair_defects(pairs).collect()} == {"empty"}
    if HAS_TOKENIZER:
        assert byte_pairs.encode(df).count() == 3
        assert source_mix.mix(source_mix.token_counts(df), spark.createDataFrame([("src", 1.0, 2)], "source string, target_share double, max_repeats int"))[0].where("copies > 0").count() == 1
