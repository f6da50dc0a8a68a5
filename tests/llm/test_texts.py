import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import encoding, language, mixing, splitting

PATH = encoding.tokenizer_path("byte_bpe_50k")


@pytest.fixture(scope="module")
def bpe():
    return encoding.Bpe(PATH)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=120, deadline=None, suppress_health_check=[])
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_equal_the_public_tokenizer(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    ids, offsets = encoding.load(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_hard_words(bpe, reference):
    texts = ["a" * 3000, "aaa bbb  \n\n\n  x", "<|endoftext|>", "日本語" * 200, "é‍👩‍💻", "\t" * 50, "!?" * 500, "Nguyễn Văn A's", "1234567890" * 30, ""]
    ids, offsets = bpe.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [reference.encode(x, add_special_tokens=False).ids for x in texts]
    assert bpe.count(texts).tolist() == np.diff(offsets).tolist()


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    got = encoding.encode_corpus(df, "doc_id", "text", PATH).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == [(0, [87]), (1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
    assert sorted(r.n for r in encoding.with_token_counts(df, "text", PATH, "n").collect()) == [0, 0, 0, 1, 2]


def test_word_cache_starts_anew(monkeypatch, bpe, reference):
    monkeypatch.setattr(encoding, "MAX_WORDS", 5)
    for x in ("one two three four five six", "seven eight nine", "one two"):
        assert bpe.encode([x])[0].tolist() == reference.encode(x, add_special_tokens=False).ids


SENTENCES = ["The sea is blue and the fish swim.", "Waves roll on the sea at night.", "Bread needs flour and water.", "Bake the bread with flour.", "機械学習は面白い。", "Học máy rất thú vị."]


def check_pieces(text, pieces, bpe, limit, overlap):
    ids = bpe.encode([text])[0]
    assert pieces[0][0] == 0 and pieces[-1][1] == len(ids)
    for (_, end, *_), (start, *_) in zip(pieces, pieces[1:]):
        assert end - start == overlap
    assert all(p[2] == p[1] - p[0] <= limit for p in pieces)
    assert all(bpe.count([p[4]])[0] <= limit and p[4] in text for p in pieces)


def test_pieces_keep_to_the_limit(bpe):
    rng = random.Random(2)
    for limit, overlap in ((40, 0), (40, 10), (200, 60)):
        for text in (" ".join(rng.choices(SENTENCES, k=150)), "\n\n".join(rng.choices(SENTENCES, k=90)), "語" * 900, "a" * 5000, "x " * 900, "🙂" * 300):
            check_pieces(text, splitting.split_text(text, bpe, limit, overlap), bpe, limit, overlap)
    assert splitting.split_text("short", bpe, 40, 10) == [] and splitting.split_text("", bpe, 40, 10) == []
    with pytest.raises(ValueError):
        splitting.split_text("x" * 999, bpe, 40, 20)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab's lt\n1.,é語\u00a0🙂", min_size=60, max_size=300), st.integers(8, 30))
def test_pieces_of_odd_texts_keep_to_the_limit(text, limit):
    b = encoding.load(PATH)
    try:
        pieces = splitting.split_text(text, b, limit, 3)
    except ValueError:
        return  # no piece of so few tokens is longer than the overlap
    if pieces:
        check_pieces(text, pieces, b, limit, 3)


def test_the_deepest_valley_is_the_topic_change():
    text = " ".join(SENTENCES[:2] * 8 + SENTENCES[2:4] * 8)
    words, _ = encoding.load(PATH).words(text)
    at, depth = splitting.gaps(text, words, np.cumsum([0, *map(len, words)]), splitting.Terms())
    assert text[at[depth.argmax()] :].startswith("Bread")


def test_similarities_equal_counting():
    rng = random.Random(2)
    for n in (2, 3, 7, 30):
        words = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))] for _ in range(n)]
        term, place = np.array([ord(x) for s in words for x in s], dtype=np.int64), np.array([i for i, s in enumerate(words) for _ in s], dtype=np.int64)
        got = splitting.similarities(term, place, n)
        for g in range(n - 1):
            left, right = (Counter(x for s in part for x in s) for part in (words[max(0, g + 1 - splitting.BLOCK) : g + 1], words[g + 1 : g + 1 + splitting.BLOCK]))
            norm = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
            assert got[g] == pytest.approx(sum(left[k] * right[k] for k in left) / norm if norm else 0.0)


def test_split_oversized(spark, bpe):
    long = " ".join(SENTENCES * 60)
    df = spark.createDataFrame([(1, long, 1), (2, "short", 1), (3, None, 1), (4, "", 1)], "doc_id long, text string, piece_no int")
    rows = splitting.split_oversized(df, "doc_id", "text", PATH, 100, 20).orderBy("piece_no").collect()
    assert {r.doc_id for r in rows} == {1} and [r.piece_no for r in rows] == list(range(1, len(rows) + 1)) and all(r.n_tokens <= 100 for r in rows)
    assert splitting.split_oversized(df.limit(0), "doc_id", "text", PATH, 100, 20).count() == 0


def test_pfair_stays_within_a_block():
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    order = mixing.pfair(shares, {"a": 500, "b": 300, "c": 200})
    done = dict.fromkeys(shares, 0)
    for n, (s, _, _) in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - shares[x] * n) < 1 for x in shares)


def test_plan_caps():
    shares = {s.source: s for s in mixing.plan([("a", 0.5, 4), ("b", 0.5, 2), ("gone", 0.3, 9)], {"a": 1000, "b": 100})}
    assert shares["b"].quota == pytest.approx(200) and shares["b"].passes == 2 and shares["b"].rest == 0 and shares["gone"].quota == 0
    assert shares["a"].quota == pytest.approx(200)


def test_mixture_reaches_the_shares(spark):
    rng = random.Random(1)
    rows = [(i, s, rng.randint(0, 30)) for i, s in enumerate(["a"] * 3000 + ["b"] * 400 + ["c"] * 300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    available, largest = mixing.available_tokens(df)
    shares = mixing.plan([("a", 0.5, 3), ("b", 0.3, 4), ("c", 0.2, 2), ("d", 0.1, 1)], available)
    mixed = mixing.mixture(df, shares, largest)
    report = {r.source: r for r in mixing.report(mixed, shares).collect()}
    live = {"a": 0.5, "b": 0.3, "c": 0.2}
    block = max(sum(s.quota for s in shares) / mixing.BLOCKS, largest)
    assert all(abs(report[s.source].tokens - s.quota) <= block for s in shares)
    ends = [(r.source, r.position, r.position + r.n_tokens) for r in mixed.orderBy("source", "position").collect()]
    assert all(b == c for (s, _, b), (t, c, _) in zip(ends, ends[1:]) if s == t)  # the copies of a source lie end to end
    assert all(abs(report[s].actual_share - x) < 0.01 for s, x in live.items()) and report["d"].tokens == 0
    used = {(r.doc_id): r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    cap = {"a": 3, "b": 4, "c": 2}
    assert all(n <= cap[rows[d][1]] for d, n in used.items()) and mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    assert mixing.mixture(df.limit(0), mixing.plan([("a", 1.0, 2)], {}), 1).count() == 0
    assert mixing.report(mixing.mixture(df.limit(0), mixing.plan([("a", 1.0, 2)], {}), 1), mixing.plan([("a", 1.0, 2)], {})).first().tokens == 0


WORDS = {
    "vi": "chúng tôi cần tuyển nhân viên làm việc tại công ty với mức lương tốt và môi trường trẻ trung cho bạn", "en": "we are looking for people who want to work in our office with a good team and the right tools for you",
    "ja": "私たちは会社で一緒に働く人を探しています。経験がある方を歓迎します。勤務時間は調整できます。", "ko": "우리는 함께 일할 사람을 찾고 있습니다. 경력이 있는 분을 환영합니다. 근무 시간은 조정할 수 있습니다.",
    "fr": "nous cherchons des personnes qui veulent travailler dans notre bureau avec une bonne équipe et les outils pour vous", "de": "wir suchen Leute die in unserem Büro mit einem guten Team und den richtigen Werkzeugen arbeiten möchten und für Sie",
}


def made(lang, rng, n=18):
    if lang in ("ja", "ko"):
        parts = [p for p in WORDS[lang].split("。" if lang == "ja" else ". ") if p]
        return ("。" if lang == "ja" else ". ").join(rng.choices(parts, k=4))
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    langs = [x for x in WORDS for _ in range(60)]
    labels = [rng.choice(list(WORDS)) if rng.random() < 0.1 else x for x in langs]
    return language.fit([made(x, rng) for x in langs], labels)


def test_held_out_accuracy(model):
    rng = random.Random(99)
    langs = [x for x in WORDS for _ in range(40)]
    names = list(language.LANGUAGES)
    right = sum(names[model.log_probabilities(language.windows(made(x, rng))).mean(axis=0).argmax()] == x for x in langs)
    assert right / len(langs) >= 0.95


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (24, language.WINDOW)).astype(np.uint8), rng.integers(0, 6, 24)
    net = language.ByteConv(6)
    before = -net.log_probabilities(x)[np.arange(24), y].mean()
    net.train(x, y, np.ones(24), 30, rng)
    assert -net.log_probabilities(x)[np.arange(24), y].mean() < before / 2


def test_labels_paragraphs_windows(spark):
    labels = ["EN", "en-US", "vie", " ja-JP ", "und", "n/a", "", None, "xx", "zh_CN"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    assert [r.y for r in df.select("i", language.canonical_label(F.col("x")).alias("y")).orderBy("i").collect()] == ["en", "en", "vi", "ja", None, None, None, None, None, None]
    assert language.paragraphs("a\r\n \r\nb\n\n\n\nc\nd") == ["a", "b", "c\nd"] and language.paragraphs(" \n\n ") == []
    assert language.windows("x" * 300).shape == (3, language.WINDOW) and language.windows("").shape == (1, language.WINDOW)


def test_sample_takes_different_texts_of_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 20)
    texts = [("the same advertisement over and over, word for word " + "!" * 5, "en")] * 3000 + [(f"another advertisement, the one with the number {k} on it", "en-US") for k in range(400)]
    texts += [(f"une annonce assez longue pour le tri, avec le nombre {k}", "fra") for k in range(7)] + [("short", "de"), (None, "de"), ("a text without a usable label, longer than forty", "??")]
    df = spark.createDataFrame(texts, "text string, label string")
    rows = language.labelled_sample(df, "text", "label").collect()
    assert len({r.text for r in rows}) == len(rows)
    assert {x: sum(r.lang == x for r in rows) for x in ("en", "fr", "de")} == {"en": 20, "fr": 7, "de": 0}
    assert {r.text for r in language.labelled_sample(df.repartition(7), "text", "label").collect()} == {r.text for r in rows}
    assert language.labelled_sample(df.limit(0), "text", "label").count() == 0


def test_languages_of(spark, model):
    rng = random.Random(5)
    mixed = made("vi", rng) + "\n\n* 123 *\n\n" + made("ja", rng) + "\n\n" + made("vi", rng)
    rows = [("t", 1, made("en", rng, 200), "en"), ("t", 2, mixed, "en"), ("t", 3, None, "en"), ("t", 4, " \n ", None), ("t", 5, "123 --", "en"), ("t", 6, made("de", rng, 4000), "DE")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "field string, item_id long, text string, label string, parts string")
    got = {r.item_id: r for r in language.languages_of(df, model).collect()}
    assert set(got) == {1, 2, 6} and (got[1].main, got[1].mixed, got[2].main, got[2].mixed, got[6].label) == ("en", False, "vi", True, "de")
    assert [(p.para_no, p.lang) for p in got[2].parts] == [(1, "vi"), (2, None), (3, "ja"), (4, "vi")]
    assert all(0 <= r.main_confidence <= 1 for r in got.values())
    assert language.languages_of(df.limit(0), model).count() == 0
