from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from stepwell.llm import mixing, quality

from .conftest import DOCS, ODD


def plain_symbols(text):
    return "\2" * quality.ORDER + (text or "").replace("\0", "\2") + "\2"


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney, gram by gram: p(symbol after its context)."""
    levels = [Counter()]
    for text in map(plain_symbols, texts):
        levels[0].update(text[i + 1 - quality.ORDER : i + 1] for i in range(quality.ORDER, len(text)))
    for _ in range(quality.ORDER - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels.reverse()
    discounts, contexts = [], []
    for level in levels:
        n1, n2, n3, n4 = (sum(c == i for c in level.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [min(max(i - (i + 1) * y * b / a, 0.1), i - 0.05) if a else 0.5 * i
             for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        discounts.append(d)
        seen = {}
        for g, c in level.items():
            seen.setdefault(g[:-1], []).append(c)
        contexts.append(seen)

    def p(gram):
        if not gram:
            return 1 / quality.CODE_POINTS
        below = p(gram[1:])
        counts = contexts[len(gram) - 1].get(gram[:-1])
        if not counts:
            return below
        d = discounts[len(gram) - 1]
        own = levels[len(gram) - 1].get(gram, 0)
        left = sum(d[min(c, 3) - 1] for c in counts) / sum(counts)
        return (max(own - d[min(own, 3) - 1], 0) / sum(counts) if own else 0) + left * below

    return p


def plain_perplexity(p, text):
    s = plain_symbols(text)
    logs = [math.log10(p(s[i + 1 - quality.ORDER : i + 1])) for i in range(quality.ORDER, len(s))]
    return 10 ** (-sum(logs) / len(logs))


TEXTS = ["the cat sat on the mat.", "the dog sat, the cat ran!", "a mat is a mat", "", "Der Bär 熊 \U0001f600",
         "кот сидел на ковре", "the cat sat on the mat. the cat sat on the mat."]


@pytest.mark.parametrize("piece", [7, quality.PIECE])
def test_perplexities_equal_the_plain_recursion(spark, docs, monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    counts = quality.count_n_grams(docs(*TEXTS))
    p = plain_kneser_ney(TEXTS)
    model = quality.kneser_ney(quality.materialize(counts))
    others = ["a dog ran on a cat", "熊熊 кот", "zzz ### 17", None, "nul \0 inside", "the cat sat on the mat.", "x"]
    rows = [*TEXTS, *others]
    got = {r.doc_id: r.perplexity for r in quality.with_perplexity(docs(*rows), model).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        assert got[i] == pytest.approx(plain_perplexity(p, text), rel=1e-4)


@pytest.mark.parametrize("most, held", [(0, 20), (150, quality.HELD_GRAMS), (quality.MAX_GRAMS, 20)])
def test_every_trusted_text_counts_for_the_other_half(spark, docs, monkeypatch, most, held):
    monkeypatch.setattr(quality, "MAX_GRAMS", most)
    monkeypatch.setattr(quality, "HELD_GRAMS", held)
    monkeypatch.setattr(quality, "PIECE", 50)
    rng = random.Random(6)
    words = "the of and to in a is that for it кот сидел熊 😀".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    rows = [*enumerate(TEXTS + texts), (100, None), (101, texts[0]), (100, "a second row"), (None, "without an id")]
    labels = spark.createDataFrame(
        [(i, int(i % 5 > 0), 0) for i in range(36)] + [(100, 1, 0)], "doc_id long, quality int, toxic int"
    )
    table = docs(*rows)
    model = quality.fit(table, labels)
    assert all(level.grams.size <= most for level in model.levels)
    assert sum(level.tables is None for level in model.levels) == {0: 0, 150: 2}.get(most, quality.ORDER)
    half = {r.text: r.half for r in table.select("text", quality.half().alias("half")).collect()}
    trusted = [t for i, t in rows if i == 100 or (i is not None and i < 36 and i % 5)]
    p = [plain_kneser_ney([t for t in trusted if half[t] != h]) for h in (0, 1)]
    wanted = sorted((-1 if i is None else i, plain_perplexity(p[half[t]], t)) for i, t in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.perplexity) for r in model.scored.collect())
    assert [i for i, _ in got] == [i for i, _ in wanted]
    assert [x for _, x in got] == pytest.approx([x for _, x in wanted], rel=1e-4)
    judged = quality.classified(model.scored, model.thresholds)
    kept = Counter(r.doc_id for r in judged.filter("keep").collect())
    assert Counter(r.doc_id for r in quality.kept(table, labels).collect()) == kept


@pytest.mark.parametrize("mapped", [0, 100, quality.MAX_MAPPED])
def test_large_orders_are_read_where_the_texts_lie(spark, docs, monkeypatch, mapped):
    monkeypatch.setattr(quality, "MAX_GRAMS", 60)
    monkeypatch.setattr(quality, "MAX_MAPPED", mapped)
    monkeypatch.setattr(quality, "SORTED_GRAMS", 50)
    monkeypatch.setattr(quality, "ROWS", 7)
    p = [plain_kneser_ney(TEXTS[::2]), plain_kneser_ney(TEXTS[1::2])]
    even = (F.col("doc_id") % 2).cast("int")
    model = quality.kneser_ney(quality.materialize(quality.count_n_grams(docs(*TEXTS), even)))
    large = [level for level in model if level.tables]
    here = [level for level in large if level.files]
    assert large and all(level.grams.size <= 60 for level in model)
    assert {0: not here, 100: 0 < len(here) < len(large)}.get(mapped, here == large)
    for level in here:
        for name, table in zip(level.files, level.tables, strict=True):
            key, log = quality._mapped(name)
            assert np.all(key[1:] > key[:-1]) and key.size == log.size == table.count()
    others = ["a dog ran on a cat", "熊熊 кот", "zzz ### 17", None, "nul \0 inside", "x", "the cat sat on the mat."]
    rows = [*TEXTS, *others]
    scored = quality.with_perplexity(docs(*rows), model, even)
    moved = "Exchange" in scored._jdf.queryExecution().executedPlan().toString()
    assert moved == (here != large)
    got = {r.doc_id: r.perplexity for r in scored.collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        assert got[i] == pytest.approx(plain_perplexity(p[i % 2], text), rel=1e-4)


@pytest.mark.parametrize("step", [1, 1 << 40, (1 << 63) + 1, pow(int(quality.BASE), -1, 1 << 64)])
def test_equal_keys_come_side_by_side(step):
    for size in (0, 1, 2, 1000):  # the last step gives keys that have one hash
        with np.errstate(over="ignore"):
            key = np.random.default_rng(size).integers(0, 300, size).astype(np.uint64) * np.uint64(step)
        order, starts = quality._distinct(key)
        assert sorted(order) == list(range(size)) and starts.size == np.unique(key).size
        assert all(np.unique(run).size == 1 for run in np.split(key[order], starts[1:]) if size)


def test_a_task_counts_any_number_of_n_grams_in_bounded_memory():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0x4E00, 0x9FFF, 300_000).astype("<u4").tobytes().decode("utf-32-le") for _ in range(16)]
    batches = (pd.DataFrame({"text": [text], "model": [i % 2]}) for i, text in enumerate(texts))
    tracemalloc.start()
    counted = [(rows["n"].sum(), len(rows)) for rows in quality.tallied(batches, quality.HELD_GRAMS)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in counted) == 16 * 300_001
    assert max(size for _, size in counted) <= quality.ROWS
    assert peak < 200e6  # two such tasks share an executor of 3000 MB, 60 % of it heap


def test_probabilities_of_a_context_sum_to_one():
    p = plain_kneser_ney(TEXTS)
    seen = {c for t in TEXTS for c in plain_symbols(t)}
    for context in ("the c", "a mat", "zzzzz", "\2" * 5):
        unseen = quality.CODE_POINTS - len(seen)
        assert sum(p(context + c) for c in seen) + unseen * p(context + "\x07") == pytest.approx(1, abs=1e-9)


def test_thresholds_and_decisions_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["en", "de", None]), rng.choice([3, 3, 3, 9]), 1 + rng.random() * rng.choice([1, 10]))
        for i in range(900)
    ]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, band int, perplexity double")
    trusted = [r for r in rows if r[0] % 2 and r[1] != "de"]
    found = quality.limits(scored.filter("doc_id % 2 = 1 and not lang <=> 'de'"), 0.99)

    def quantile(values):
        values = sorted(values)
        return values[max(math.ceil(0.99 * len(values)) - 1, 0)]

    def threshold(lang, band):
        narrow = [r[3] for r in trusted if r[1:3] == (lang, band)]
        wide = [r[3] for r in trusted if r[1] == lang]
        return quantile(narrow) if len(narrow) >= 100 else quantile(wide) if wide else None

    judged = quality.classified(scored, found).collect()
    assert len(judged) == len(rows)
    assert {len([r for r in trusted if r[1:3] == ("en", b)]) >= 100 for b in (3, 9)} == {True, False}
    for r in judged:
        wanted = threshold(r.lang, r.band)
        assert r.threshold == wanted and r.keep == (wanted is None or r.perplexity <= wanted)


def test_a_sample_with_too_many_n_grams_is_halved(spark, docs, monkeypatch):
    good, _ = good_and_junk()
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    whole = quality.fit(docs(*good), labels).levels[-1].grams.size
    monkeypatch.setattr(quality, "MAX_GRAMS", whole - 1)
    model = quality.fit(docs(*good), labels)
    assert 0 < model.levels[-1].grams.size < whole and model.scored.count() == len(good)


def good_and_junk():
    rng = random.Random(2)
    words = "the of and to in a is that for it as was with be by on not he his but at are this".split()
    good = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))) for i in range(200)]
    return good, [(1000 + i, "".join(rng.choice("#$%|~^zqx ") for _ in range(120))) for i in range(40)]


def test_classifier_on_labels_it_has_not_seen(spark, docs):
    good, junk = good_and_junk()
    rows = [*good, *junk, *ODD]
    labels = spark.createDataFrame(
        [(i, 1, 0) for i, _ in good[:120]] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (1000, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    table = docs(*rows)
    kept = quality.kept(table, labels)
    assert kept.columns == table.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert sum(ids[i] for i, _ in good[120:]) >= 76 and not any(ids[i] for i, _ in junk)
    model = quality.fit(table, labels)
    judged = quality.classified(model.scored, model.thresholds)
    assert judged.count() == len(rows)
    assert judged.filter("keep").count() == kept.count()


def test_the_pipeline_counts_every_trusted_text(spark, docs, monkeypatch, tmp_path):
    good, junk = good_and_junk()
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counted, plain = [], quality.kneser_ney

    def watched(counts):
        counted.append(counts.agg(F.sum("n")).head()[0])
        return plain(counts)

    monkeypatch.setattr(quality, "kneser_ney", watched)
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs(*good, *junk), str(tmp_path)).collect()}
    assert counted == [sum(len(text) + 1 for _, text in good)]
    assert sum(i in kept for i, _ in good) >= 190 and not any(i in kept for i, _ in junk)


def test_the_pipeline_shuffles_no_text_for_a_large_model(spark, docs, monkeypatch, tmp_path):
    good, junk = good_and_junk()
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = docs(*good, *junk)
    wanted = sorted(r.doc_id for r in corpus_pipeline.keep_good(spark, table, str(tmp_path)).collect())
    monkeypatch.setattr(quality, "MAX_GRAMS", 500)
    kept = corpus_pipeline.keep_good(spark, table, str(tmp_path))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == wanted and wanted


def test_without_labels_or_rows_everything_stays(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept(docs(*ODD), none).count() == len(ODD)
    assert quality.kept(docs(*ODD).limit(0), none).count() == 0


TARGETS = {"source": {"a": 0.5, "b": 0.2}, "lang": {"en": 0.7, "fr": 0.3}}


def mixture(spark):
    rng = random.Random(3)
    rows = [
        (i, "w " * rng.randrange(1, 30), rng.choice(["en", "en", "en", "fr"]), rng.choice("aabcd"), 1, 1, "k", "f")
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("weight", F.lit(9)).withColumn("kept", F.lit("x"))


@pytest.mark.parametrize("max_cells", [1000, 0])
def test_expected_shares_equal_the_targets(spark, max_cells):
    rows = mixing.sampled(mixture(spark), TARGETS, max_cells=max_cells).cache()
    total = rows.agg(F.sum(F.col("tokens") * F.col("probability"))).head()[0]
    for dimension, wanted in {"source": {"a": 0.5, "b": 0.2, "other": 0.3}, "lang": {"en": 0.7, "fr": 0.3}}.items():
        got = rows.groupBy(f"_at_{dimension}").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()
        assert {r[0]: r.t / total for r in got} == pytest.approx(wanted, rel=1e-6)
    assert rows.agg(F.max("probability")).head()[0] == pytest.approx(1)
    kept = rows.filter("kept").agg(F.sum("tokens")).head()[0]
    assert kept == pytest.approx(total, rel=0.1)


def test_mixing_odd_rows(spark, docs):
    table = docs(*ODD, lang=None, source=None)
    targets = {**TARGETS, "topic": {"prose": 0.9}}
    assert mixing.sampled(table, targets).count() == len(ODD)
    mixed = mixing.mixed(table, targets)
    assert mixed.columns == table.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    assert counts[1] in (0, 2)  # repeated rows share their fate
    assert mixing.mixed(table.limit(0), targets).count() == 0


def starved(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), "en", rng.choice("bbc"), 1, 1, "k", "f") for i in range(2000)]
    return spark.createDataFrame([(9999, "one few", "fr", "a", 1, 1, "k", "f"), *rows], DOCS)


def test_a_starved_category_does_not_set_the_scale(spark):
    table = starved(spark)
    for max_cells in (1000, 0):
        kept = mixing.sampled(table, TARGETS, 0.1, max_cells=max_cells).filter("kept")
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert 9999 in ids
        assert len(ids) >= 150


def plain_raking(cells, targets, bound=math.inf):
    """cells: {(source, lang): tokens}; the loop over every cell, dimension by dimension."""
    weight = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(mixing.ROUNDS):
        worst = 0.0
        for i, wanted in enumerate(targets):
            has = Counter()
            for cell, tokens in cells.items():
                has[cell[i]] += tokens * weight[cell] / total
            worst = max(worst, *(abs(has[c] - s) for c, s in wanted.items()))
            weight = {c: min(w * wanted[c[i]] / has[c[i]], bound) for c, w in weight.items()}
        if worst < mixing.TOLERANCE:
            break
    return weight


def plain_probabilities(cells, weight, size):
    """c by bisection on the expected tokens."""
    goal, low, high = size * sum(cells.values()), 0.0, 1e9
    for _ in range(200):
        c = (low + high) / 2
        got = sum(t * min(1, c * weight[cell]) for cell, t in cells.items())
        low, high = (c, high) if got < goal else (low, c)
    return {cell: min(1, low * w) for cell, w in weight.items()}


@pytest.mark.parametrize("max_cells", [1000, 0])
@pytest.mark.parametrize(("size", "bound"), [(0.05, None), (0.3, None), (0.8, None), (0.3, 1.4)])
def test_probabilities_equal_a_plain_loop(spark, max_cells, size, bound):
    table = mixture(spark)
    got = mixing.weights(table, TARGETS, size, bound, max_cells).collect()
    cells = {(r._at_source, r._at_lang): r.tokens for r in got}
    wanted = [{"a": 0.5, "b": 0.2, "other": 0.3}, {"en": 0.7, "fr": 0.3}]
    weight = plain_raking(cells, wanted, bound or math.inf)
    expected = plain_probabilities(cells, weight, size)
    assert {(r._at_source, r._at_lang): r.weight for r in got} == pytest.approx(weight, rel=1e-9)
    assert {(r._at_source, r._at_lang): r.probability for r in got} == pytest.approx(expected, rel=1e-6)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(size * sum(cells.values()), rel=1e-9)


def test_missed_shares_are_reported(spark):
    table = mixing.weights(starved(spark), TARGETS, 0.1)
    got = {(r.dimension, r.category): r for r in mixing.shares(table, TARGETS).collect()}
    assert got["source", "a"].wanted == pytest.approx(0.5) and got["source", "a"].expected < 0.01
    assert got["lang", "fr"].wanted == pytest.approx(0.3) and got["lang", "fr"].tokens == 2
    for dimension in TARGETS:
        rows = [r for (d, _), r in got.items() if d == dimension]
        assert sum(r.wanted for r in rows) == pytest.approx(1) and sum(r.expected for r in rows) == pytest.approx(1)
    exact = mixing.shares(mixing.weights(mixture(spark), TARGETS), TARGETS).collect()
    assert len(exact) == 5 and all(r.expected == pytest.approx(r.wanted, rel=1e-6) for r in exact)


def test_contradicting_targets_and_sizes_end(spark):
    # "fr" occurs in the dropped source "a" only
    targets = {"source": {"a": 0.0, "b": 1.0}, "lang": {"en": 0.5, "fr": 0.5}}
    for size in (None, 0.1, 1.0):
        rows = mixing.weights(starved(spark).filter("source <> 'c'"), targets, size).collect()
        assert len(rows) == 2 and all(0 <= r.probability <= 1 for r in rows)
        assert any(r.probability > 0 for r in rows)
    with pytest.raises(ValueError):
        mixing.weights(starved(spark), targets, 1.5)
