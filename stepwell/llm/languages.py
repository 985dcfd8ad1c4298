"""Language identification by multilingual mixture inference.

A text is a bag of letter trigrams of its words (lower case, both ends marked). Every language has a
distribution over trigrams, smoothed towards the whole training corpus:
``p(g | k) = (1 - FLOOR) f_k(g) + FLOOR q(g)``. A text's trigrams are drawn from a mixture of
languages whose proportions expectation-maximisation estimates. Which languages take part is chosen
by penalised likelihood: from the best single language on, the one whose likelihood rises steepest
joins, and stays if the log likelihood, divided by ``ORDER`` as every letter is in that many
trigrams, rises by more than half the logarithm of the text's letters (BIC); one that the others
make superfluous leaves again. As the likelihood is concave, its slope bounds what any language can
add, so most texts need no iteration.

Training counts every trigram of every training text; counts are added up per task, then grouped.
The model keeps a language's trigrams with at least ``MIN_SHARE`` of its occurrences (rarer ones
tell languages apart no better than chance decides which are seen), hence at most 1 / share of them
for each language, and ``MAX_ENTRIES`` in all: the share rises with the number of languages. That
bounded table goes to every task. A label on under ``MIN_LANGUAGE`` of the training documents is
not learned. What is not listed counts as ``FLOOR q(g)``, the same factor for every language.

Defined cases: ``und`` and score 0 where the text is null or has no letter; with no listed trigram
(another script) the most frequent language and its share. Ties go to the language with more
training documents, then to the smaller name. Rows with a null language train nothing; a row with a
null id is in the training part. Equal rows count once each. Without any training row every text is
``und``. Extra columns are ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import ranges, small_batches, text_or_empty

ORDER, BITS = 3, 21
FLOOR = 0.02
MIN_SHARE, MAX_ENTRIES = 2e-5, 1 << 21
MIN_LANGUAGE = 1e-6
#: Weight of the corpus' language shares in a score, in letters of text.
PRIOR_LETTERS = 2.0
TOLERANCE, ROUNDS = 1e-6, 200
UNKNOWN = "und"
HELD_OUT = 2
#: Characters looked at together, and distinct trigrams a task holds before it hands them on.
CHARS_AT_ONCE, HELD_GRAMS = 1 << 20, 1 << 20


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _split(text: str) -> Iterator[str]:
    """Pieces of about ``CHARS_AT_ONCE`` characters that end before a blank."""
    start = 0
    while len(text) - start > CHARS_AT_ONCE:
        end = text.find(" ", start + CHARS_AT_ONCE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the texts' words, each as 63 bits of code points (0: a word's end), and the
    number of the text that each stands in."""
    joined = "\0".join(texts).lower() if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    # one mark after every word; texts are kept apart by the marks between their words
    kept = letter | np.r_[False, letter[:-1]][: codes.size]
    of = np.cumsum(codes == 0)
    if codes.size and of[-1] != len(texts) - 1:  # a text holds the character 0 itself
        of = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])[:-1]
    of = of[kept]
    seq = np.r_[0, np.where(letter, codes, 0)[kept].astype(np.int64), 0]
    middle = seq[1:-1] != 0
    keys = (seq[:-2] << (2 * BITS) | seq[1:-1] << BITS | seq[2:])[middle]
    return keys, of[middle]


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of bounded length together, with the number of the first."""
    first, run, chars = 0, [], 0
    for i, text in enumerate(texts):
        if run and chars + len(text) > CHARS_AT_ONCE:
            yield first, run
            first, run, chars = i, [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield first, run


def count_trigrams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n``: how often each trigram occurs in all texts of each language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([n for _, n in held[lang]]), keys.size)
            return keys, counts.astype(np.int64)

        def flush() -> Iterator[pd.DataFrame]:
            for lang in held:
                keys, counts = merged(lang)
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": counts})
            held.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for text in texts if len(texts) == 1 else ["\n".join(texts)]:
                    for piece in _split(text):
                        held.setdefault(lang, []).append(np.unique(trigrams([piece])[0], return_counts=True))
                        size += held[lang][-1][0].size
            if size > HELD_GRAMS:
                for lang in held:
                    held[lang] = [merged(lang)]
                size = sum(x[0][0].size for x in held.values())
                if size > HELD_GRAMS // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    parts = docs.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages by falling prior, the listed trigrams, and for each the languages that list it
    (``langs[at[i]:at[i + 1]]``) with ``gain``: p(g | language) / p(g | a language without it), less 1."""

    names: list[str]
    prior: np.ndarray
    grams: np.ndarray
    at: np.ndarray
    langs: np.ndarray
    gain: np.ndarray


def fit(docs: DataFrame) -> Model:
    """The model of the training rows ``docs`` (lang, text)."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull()).select("lang", text_or_empty().alias("text"))
    per_language = known.groupBy("lang").count()
    rows = per_language.agg(F.sum("count")).head()[0] or 0
    listed = per_language.filter(F.col("count") >= rows * MIN_LANGUAGE)  # at most 1 / MIN_LANGUAGE
    names = sorted(listed.collect(), key=lambda r: (-r["count"], r.lang))
    number = {r.lang: i for i, r in enumerate(names)}
    share = max(MIN_SHARE, len(names) / MAX_ENTRIES)
    counts = materialize(count_trigrams(known.join(F.broadcast(listed.select("lang")), "lang", "left_semi")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    whole = counts.agg(F.sum("n")).head()[0] or 0
    own = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    entry = F.when(F.col("share") >= share, F.struct("lang", "share"))
    entries = (
        own.groupBy("gram").agg(F.sum("n").alias("in_all"), F.collect_list(entry).alias("x"))
        .select("gram", "in_all", F.explode("x").alias("x")).select("gram", "in_all", "x.*")
        .toPandas()  # at most MAX_ENTRIES rows
    )
    entries = entries.assign(number=entries["lang"].map(number)).sort_values(["gram", "number"])
    grams, at = np.unique(entries["gram"].to_numpy(np.int64), return_index=True)
    ratio = entries["share"].to_numpy(float) * whole / entries["in_all"].to_numpy(float)
    prior = np.array([r["count"] for r in names], float)
    return Model(
        [r.lang for r in names],
        prior / max(prior.sum(), 1),
        grams,
        np.r_[at, len(entries)].astype(np.int64),
        entries["number"].to_numpy(np.int64),
        (1 - FLOOR) / FLOOR * ratio,
    )


def mixture(model: Model, grams: np.ndarray, times: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of a text and their proportions, from its listed trigrams (by their place in
    the model) and how often each occurs."""
    k, n = len(model.names), float(times.sum())
    if not n:
        return [0], np.ones(1)
    index, size = ranges(model.at, grams)
    row = np.repeat(np.arange(grams.size), size)
    langs, gain = model.langs[index], model.gain[index]
    single = np.bincount(langs, times[row] * np.log1p(gain), k)
    chosen = [int(np.argmax(single / ORDER + np.log(model.prior)))]

    def factors(languages: list[int]) -> np.ndarray:
        out = np.ones((grams.size, len(languages)))
        for j, lang in enumerate(languages):
            mine = langs == lang
            out[row[mine], j] += gain[mine]
        return out

    def proportions(languages: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        given = factors(languages)
        share, before = np.full(len(languages), 1 / len(languages)), -math.inf
        for _ in range(ROUNDS if len(languages) > 1 else 1):
            mixed = given @ share
            now = float(times @ np.log(mixed))
            if now - before <= TOLERANCE * n:
                break
            before = now
            share = share * (given.T @ (times / mixed)) / n
            share /= share.sum()
        mixed = given @ share
        return share, mixed, float(times @ np.log(mixed))

    penalty = ORDER * 0.5 * math.log(1 + n / ORDER)
    share, mixed, likelihood = proportions(chosen)
    while len(chosen) < k:
        weight = times / mixed
        slope = weight.sum() + np.bincount(langs, weight[row] * gain, k) - n
        slope[chosen] = -math.inf
        new = int(np.argmax(slope))
        if slope[new] <= penalty:  # concave: nothing can rise by more
            break
        found = proportions([*chosen, new])
        if found[2] - likelihood <= penalty:
            break
        chosen, (share, mixed, likelihood) = [*chosen, new], found
        for lang in chosen[:-1]:
            rest = [x for x in chosen if x != lang]
            without = proportions(rest)
            if likelihood - without[2] <= penalty:
                chosen, (share, mixed, likelihood) = rest, without
    return chosen, share


def identify(model: Model, texts: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
    """Per text the predicted language, its score, and all its languages with their proportions.

    The score is the language's proportion, drawn towards its share in training by the weight of
    ``PRIOR_LETTERS`` letters, so a text of a few letters is never certain.
    """
    out = []
    for first, run in _runs(texts):
        keys, of = trigrams(run)
        place = np.searchsorted(model.grams, keys)
        listed = np.flatnonzero(place < model.grams.size)
        listed = listed[model.grams[place[listed]] == keys[listed]]
        has_letter = np.bincount(of, minlength=len(run)) > 0
        place, bounds = place[listed], np.searchsorted(of[listed], np.arange(len(run) + 1))
        for i in range(len(run)):
            if not has_letter[i] or not model.names:
                out.append((UNKNOWN, 0.0, [], []))
                continue
            grams, times = np.unique(place[bounds[i] : bounds[i + 1]], return_counts=True)
            chosen, share = mixture(model, grams, times.astype(float))
            best = max(range(len(chosen)), key=lambda j: (share[j], -chosen[j]))
            letters = times.sum() / ORDER
            weight = letters / (letters + PRIOR_LETTERS)
            score = float(share[best] * weight + model.prior[chosen[best]] * (1 - weight))
            order = sorted(range(len(chosen)), key=lambda j: (-share[j], chosen[j]))
            names = [model.names[chosen[j]] for j in order]
            if not grams.size:
                share = model.prior[chosen]
            out.append((model.names[chosen[best]], min(score, 1.0), names, [float(share[j]) for j in order]))
    return out


def with_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``found``: lang_pred, score, languages and shares of every text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, languages array<string>, shares array<double>")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = identify(held.value, texts.tolist())
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages", "shares"])

    return docs.withColumn("found", find(text_or_empty()))


def predicted(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages, shares`` per row, learned from the rows that
    are not held out."""
    rows = docs.select("doc_id", "lang", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")))
    found = with_languages(rows.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "found.*")
