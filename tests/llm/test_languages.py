from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from stepwell.llm import languages

from .conftest import ODD

WORDS = {
    "en": "the and that with this from have were which their would there about could other these".split(),
    "de": "und der die das nicht ist ein eine auch sich mit dem den werden wurde zwischen".split(),
    "fr": "les des une est dans pour que qui sur pas plus avec sont cette mais comme".split(),
}


def text_in(lang, n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang], n))


def words_of(text):
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            yield word
            word = ""


def grams_of(text):
    """Trigrams of the words, both ends marked."""
    return Counter(
        tuple(ord(c) if c else 0 for c in ("", *w, "")[i : i + 3])
        for w in words_of(text)
        for i in range(len(w))
    )


def gram_key(gram):
    return gram[0] << 42 | gram[1] << 21 | gram[2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB\u00c9\u0130\u03a3 1.\n\0\u4e2d", max_size=12), min_size=1, max_size=5))
def test_trigrams(texts):
    keys, of = languages.trigrams(texts)
    for i, text in enumerate(texts):
        assert Counter(keys[of == i].tolist()) == {gram_key(g): n for g, n in grams_of(text).items()}


def brute(train, text):
    """Best penalised mixture among all sets of languages, by plain expectation-maximisation."""
    counts = defaultdict(Counter)
    for lang, t in train:
        counts[lang].update(grams_of(t))
    total = {k: sum(c.values()) for k, c in counts.items()}
    whole = Counter()
    for c in counts.values():
        whole.update(c)
    floor = languages.FLOOR
    docs = Counter(lang for lang, _ in train)
    grams = {g: n for g, n in grams_of(text).items() if g in whole}
    n = sum(grams.values())
    share = {g: whole[g] / sum(whole.values()) for g in grams}
    p = {k: {g: (1 - floor) * counts[k][g] / total[k] + floor * share[g] for g in grams} for k in counts}
    best = None
    for size in range(1, len(counts) + 1):
        for chosen in combinations(sorted(counts), size):
            pi = dict.fromkeys(chosen, 1 / size)
            for _ in range(500):
                mixed = {g: sum(pi[k] * p[k][g] for k in chosen) for g in grams}
                pi = {k: sum(c * pi[k] * p[k][g] / mixed[g] for g, c in grams.items()) / n for k in chosen}
            like = sum(c * math.log(sum(pi[k] * p[k][g] for k in chosen)) for g, c in grams.items())
            value = like / languages.ORDER - size * 0.5 * math.log(1 + n / languages.ORDER)
            if best is None or value > best[0]:
                best = value, pi
    pi = best[1]
    lang = max(pi, key=pi.get)
    letters = n / languages.ORDER
    weight = letters / (letters + languages.PRIOR_LETTERS)
    return lang, pi[lang] * weight + docs[lang] / len(train) * (1 - weight), set(pi)


TRAIN = [(k, text_in(k, 40, 10 * j + i)) for j, k in enumerate(WORDS) for i in range(6 - j)]


@pytest.fixture(scope="module")
def model(spark):
    return languages.fit(spark.createDataFrame(TRAIN, "lang string, text string"))


def test_against_brute_force(model):
    texts = [
        text_in("en", 30, 1), text_in("de", 5, 2), text_in("fr", 3, 3), text_in("en", 1, 4),
        text_in("en", 40, 5) + " " + text_in("de", 30, 6),
        text_in("fr", 50, 7) + "\n" + text_in("en", 20, 8) + ". " + text_in("de", 35, 9),
    ]
    for text, (lang, score, names, shares) in zip(texts, languages.identify(model, texts), strict=True):
        expected = brute(TRAIN, text)
        assert (lang, set(names)) == (expected[0], expected[2])
        assert score == pytest.approx(expected[1], abs=2e-3)
        assert sum(shares) == pytest.approx(1) and shares == sorted(shares, reverse=True)


def test_odd_texts(model):
    texts = ["", "12 3.4 \n", "\u65e5\u672c\u8a9e", "the", "THE AND"]
    found = languages.identify(model, texts)
    assert [x[0] for x in found] == ["und", "und", "en", "en", "en"]
    assert found[0][1:] == (0.0, [], []) and found[2][1] == pytest.approx(6 / 15)
    assert found[2][1] < found[3][1] < 1
    assert languages.identify(model, texts + [text_in("de", 9, 1)])[:5] == found


def test_long_texts_in_pieces(model, monkeypatch):
    text = text_in("de", 400, 3)
    whole = languages.identify(model, [text, "x", text])
    monkeypatch.setattr(languages, "CHARS_AT_ONCE", 50)
    assert languages.identify(model, [text, "x", text]) == whole
    assert "".join(languages._split(text)) == text


def test_query_on_odd_rows(spark, docs):
    rows = [(i, text_in("en", 20, i)) for i in range(100, 140)]
    table = docs(*ODD, *rows).unionByName(docs(*[(i, text_in("de", 20, i)) for i in range(200, 240)], lang="de"))
    table = table.unionByName(docs((300, "le chat"), (None, "die und"), lang=None))
    found = languages.predicted(table.repartition(3)).collect()
    assert len(found) == table.count()
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        if r.doc_id and r.doc_id >= 100 and r.doc_id < 300:
            assert r.lang_pred == ("en" if r.doc_id < 200 else "de")
    by_id = {r.doc_id: r.lang_pred for r in found}
    assert [by_id[i] for i in (2, 3, 4)] == ["und"] * 3
    assert languages.predicted(table.limit(0)).count() == 0
    untrained = docs((1, "some text"), lang=None)
    assert [r.lang_pred for r in languages.predicted(untrained).collect()] == ["und"]


def test_counts_are_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(languages, "HELD_GRAMS", 30)
    monkeypatch.setattr(languages, "CHARS_AT_ONCE", 100)
    table = docs(*[(i, text_in("fr", 30, i)) for i in range(30)])
    got = {r.gram: r.n for r in languages.count_trigrams(table.repartition(4)).collect()}
    expected = Counter()
    for i in range(30):
        expected.update({gram_key(g): n for g, n in grams_of(text_in("fr", 30, i)).items()})
    assert got == expected


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = languages.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, rows = found.selectExpr("count_if(lang_pred = lang)", "count(*)").head()
    assert right >= 0.99 * rows
