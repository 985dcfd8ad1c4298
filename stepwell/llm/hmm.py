"""Language-model scoring with a hidden Markov model over words.

Every token belongs to one of ``SYMBOLS`` symbols (its last bytes, hashed; the end of a text has its
own). A latent state emits a symbol, and the symbol's tokens follow their smoothed counts:
``P(token | state) = P(symbol | state) * (c + 1) / (symbol's tokens + symbol's words + 1)``. So the
trained part of the model has a fixed size, while the counts grow with the corpus and stay in
Spark. As the second factor does not depend on the state, a text's likelihood is the product of the
likelihood of its symbols and its tokens' factors, exactly.

Training: token counts are grouped over the whole training set. Baum-Welch runs over all training
texts; each task adds up its expected counts and only those sums are grouped and collected, which
is a bounded number of values. Training texts are cut into sequences of ``SEQUENCE`` tokens.
Scoring: the scaled forward recursion over the whole text. Long texts are cut into pieces whose
transfer matrices are multiplied, which is the same recursion in another order.

A token's count is looked up by joining documents' distinct words with the counts. The most
frequent ``FREQUENT`` words, a third of all rows in the extreme, never enter that join: they are
broadcast, a fixed number of short rows. What remains has no hot key.

Defined cases: a null text counts as empty and has one token, its end; a null id is in the training
part; repeated rows and ids count and score once each; with an empty training part all counts are
zero. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import small_batches, text_or_empty

STATES, SYMBOLS, SUFFIX = 6, 4096, 4
SEQUENCE = 128
ROUNDS = 3
FREQUENT = 1 << 16
#: Words a task holds before it hands their counts on, and sequences it computes on at once.
HELD_WORDS, AT_ONCE = 400_000, 1024
END = b""
HELD_OUT = 2


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == HELD_OUT, F.lit(False))


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case, then the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def symbol(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % (SYMBOLS - 1) + 1 if word else 0


class _Words:
    """Numbers of words with what a task looks up by them: the frequent ones first, then those it
    has met, forgotten when they get too many."""

    def __init__(self, frequent: dict[bytes, int]):
        self.frequent = len(frequent)
        self.first = dict(zip(frequent, range(len(frequent)), strict=True))
        self.logs = np.array([math.log10(c + 1) for c in frequent.values()] + [0.0])  # the last: any other
        self.symbols = np.fromiter(map(symbol, frequent), np.uint16, len(frequent))
        self.number = dict(self.first)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.number)
        if len(self.number) + len(new) > HELD_WORDS + self.frequent:
            self.number, self.symbols = dict(self.first), self.symbols[: self.frequent]
            new = set(words).difference(self.number)
        if new:
            at = len(self.number)
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            if at + len(new) > self.symbols.size:
                self.symbols = np.resize(self.symbols, max(2 * self.symbols.size, at + len(new)))
            self.symbols[at : at + len(new)] = [symbol(w) for w in new]
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def _symbol_column(word: Column) -> Column:
    suffix = F.when(F.length(word) > SUFFIX, F.substring(word, -SUFFIX, SUFFIX)).otherwise(word)
    return F.when(F.length(word) == 0, 0).otherwise(F.crc32(suffix) % (SYMBOLS - 1) + 1).cast("int")


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, train, total)``: occurrences in the training part and in all of ``docs``
    (text, held_out)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train: Counter = Counter()
        held: Counter = Counter()

        def flush() -> Iterator[pd.DataFrame]:
            for counts, in_train in ((train, 1), (held, 0)):
                total = np.fromiter(counts.values(), np.int64, len(counts))
                words = pd.Series(list(counts), dtype=object)
                yield pd.DataFrame({"word": words, "train": total * in_train, "total": total})
                counts.clear()

        for batch in batches:
            for text, out in zip(batch["text"], batch["held_out"], strict=True):
                (held if out else train).update(tokens(text))
                if len(train) + len(held) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    parts = docs.select("text", "held_out").mapInPandas(count, "word binary, train long, total long")
    return parts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x symbols


def _pieces(texts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in rows of ``length``, their lengths, and for each row whether it begins a text."""
    counts = np.array([-(-t.size // length) for t in texts])
    rows = np.zeros((counts.sum(), length), np.int64)
    lengths = np.full(len(rows), length)
    begins = np.zeros(len(rows), bool)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        rows[at : at + n].ravel()[: text.size] = text
        lengths[at + n - 1] = text.size - length * (n - 1)
        begins[at] = True
        at += n
    return rows, lengths, begins


def _expected(model: Hmm, rows: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Expected counts (start, move, emit) over sequences, by scaled forward and backward passes."""
    order = np.argsort(-lengths, kind="stable")
    rows, lengths, begins = rows[order], lengths[order], begins[order]
    n, longest = len(rows), int(lengths[0])
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # rows longer than t
    k = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    usual = model.start @ np.linalg.matrix_power(model.move, 64)  # where a text is in its midst
    alpha = np.zeros((longest, n, k))
    scale = np.ones((longest, n))
    for t in range(longest):
        m = active[t]
        now = np.where(begins[:m, None], model.start, usual) if t == 0 else alpha[t - 1, :m] @ model.move
        now = now * emit[rows[:m, t]]
        scale[t, :m] = now.sum(axis=1)
        alpha[t, :m] = now / scale[t, :m, None]
    beta = np.ones((n, k))
    move = np.zeros((k, k))
    start = np.zeros(k)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        if t:
            ahead = emit[rows[:m, t]] * beta[:m] / scale[t, :m, None]
            move += alpha[t - 1, :m].T @ ahead
        alpha[t, :m] *= beta[:m]  # from here on the share of each state at this place
        if t:
            beta[:m] = ahead @ model.move.T
    start = alpha[0, begins].sum(axis=0)
    at = rows[:, :longest].T.ravel()  # places beyond a sequence's end have no share
    found = np.array([np.bincount(at, alpha[:, :, s].ravel(), SYMBOLS) for s in range(k)])
    return [start, move * model.move, found]


def log_likelihoods(model: Hmm, texts: list[np.ndarray], length: int = SEQUENCE) -> np.ndarray:
    """log10 probability of each sequence of symbols (none is empty)."""
    rows, lengths, begins = _pieces(texts, length)
    order = np.argsort(-lengths, kind="stable")
    k = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    matrix = np.empty((len(rows), k, k))
    logs = np.empty(len(rows))
    for a in range(0, len(rows), AT_ONCE):
        take = order[a : a + AT_ONCE]
        part, sizes = rows[take], lengths[take]
        now = np.broadcast_to(np.eye(k), (len(take), k, k)).copy()
        log = np.zeros(len(take))
        for t in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -t, "left"))
            moved = (now[:m].reshape(-1, k) @ model.move).reshape(m, k, k)
            if t == 0:
                moved[begins[take[:m]]] = np.eye(k)
            moved *= emit[part[:m, t]][:, None, :]
            if t % 8 == 7:
                top = moved.max(axis=(1, 2))
                moved /= top[:, None, None]
                log[:m] += np.log10(top)
            now[:m] = moved
        top = now.max(axis=(1, 2))
        matrix[take] = now / top[:, None, None]
        logs[take] = log + np.log10(top)
    first = np.flatnonzero(begins)
    counts = np.diff(np.r_[first, len(rows)])
    by_count = np.argsort(-counts, kind="stable")
    first, sizes = first[by_count], counts[by_count]
    state = np.broadcast_to(model.start, (len(texts), k)).copy()
    total = np.zeros(len(texts))
    for c in range(int(sizes[0]) if len(texts) else 0):
        m = int(np.searchsorted(-sizes, -c, "left"))
        now = np.einsum("nk,nkj->nj", state[:m], matrix[first[:m] + c])
        top = now.sum(axis=1)
        state[:m] = now / top[:, None]
        total[:m] += np.log10(top) + logs[first[:m] + c]
    out = np.empty(len(texts))
    out[by_count] = total
    return out


def _sum_over_tasks(rows: DataFrame, add, size: int) -> np.ndarray:
    """Sum of the vectors that ``add(batch, vector)`` fills, over all tasks."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vector = np.zeros(size)
        for batch in batches:
            add(batch, vector)
        at = np.flatnonzero(vector)
        yield pd.DataFrame({"at": at, "value": vector[at]})

    summed = rows.mapInPandas(task, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    got = summed.toPandas()  # at most ``size`` rows
    out = np.zeros(size)
    out[got["at"]] = got["value"]
    return out


def train(rows: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over ``rows`` (symbols, top). ``prior``: the symbols' overall shares.

    States start from the texts grouped by their most frequent symbol, which tells languages and
    registers apart; the commonest of these symbols get a state each.
    """
    k = STATES
    tops = rows.groupBy("top").count().orderBy(F.desc("count"), "top").limit(k).collect()
    state_of = {r.top: i for i, r in enumerate(tops)}

    def first(batch: pd.DataFrame, vector: np.ndarray) -> None:
        for data, top in zip(batch["symbols"], batch["top"], strict=True):
            state = state_of.get(top, top % k)
            counts = np.bincount(np.frombuffer(data, "<u2"), minlength=SYMBOLS)
            vector[state * SYMBOLS : (state + 1) * SYMBOLS] += counts

    emit = _sum_over_tasks(rows, first, k * SYMBOLS).reshape(k, SYMBOLS)
    model = _model(np.ones(k), np.eye(k) * 50 * k + 1, emit, prior)
    for _ in range(rounds):
        now = rows.sparkSession.sparkContext.broadcast(model)

        def add(batch: pd.DataFrame, vector: np.ndarray, now=now) -> None:
            texts = [np.frombuffer(x, "<u2") for x in batch["symbols"]]
            pieces = _pieces(texts, SEQUENCE)
            for a in range(0, len(pieces[0]), AT_ONCE):
                parts = _expected(now.value, *(x[a : a + AT_ONCE] for x in pieces))
                vector += np.concatenate([p.ravel() for p in parts])

        found = _sum_over_tasks(rows, add, k + k * k + k * SYMBOLS)
        model = _model(found[:k], found[k : k + k * k].reshape(k, k), found[k + k * k :].reshape(k, -1), prior)
    return model


def _model(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
    """Expected counts as probabilities, smoothed so that none is zero."""
    start, move, emit = start + 0.1, move + 0.1, emit + 100 * prior
    return Hmm(
        start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)
    )


def _most_frequent(counts: DataFrame) -> DataFrame:
    """At most ``FREQUENT`` rows: the words over a bound found from a histogram of their logarithmic
    frequency, so that no task or driver sorts the words or holds a task's candidates."""
    level = F.floor(F.log2("total") * 16)
    histogram = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # < 1024 rows
    words, lowest = 0, None
    for row in histogram:
        words += row["count"]
        if words > FREQUENT:
            break
        lowest = row.level
    return counts.filter(level >= lowest) if lowest is not None else counts.limit(0)


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text")
    )
    counts = materialize(count_words(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).head()
    often = _most_frequent(counts).select("word", "train").toPandas()  # at most FREQUENT rows
    frequent = spark.sparkContext.broadcast(
        dict(zip(map(bytes, often["word"]), often["train"].tolist(), strict=True))
    )
    by_symbol = (
        counts.groupBy(_symbol_column(F.col("word")).alias("symbol"))
        .agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("words")).toPandas()
    )
    weight = np.ones(SYMBOLS)
    weight[by_symbol["symbol"]] += by_symbol["n"].to_numpy(float) + by_symbol["words"].to_numpy(float)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words(frequent.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = tokens(text)
                numbers = known.numbers(words)
                symbols = known.symbols[numbers].astype("<u2")
                logs = known.logs[np.minimum(numbers, known.frequent)]
                rare = Counter([words[i] for i in np.flatnonzero(numbers >= known.frequent)])
                rows.append(
                    (
                        len(words),
                        symbols.tobytes(),
                        int(np.bincount(symbols[:-1]).argmax()) if len(words) > 1 else 0,
                        float(logs.sum()),
                        int(np.count_nonzero(logs)),  # zero for words that the training part does not have
                        list(rare),
                        list(rare.values()),
                    )
                )
            columns = ["n_tokens", "symbols", "top", "log_counts", "n_known", "rare", "times"]
            yield pd.concat(
                [batch[["doc_id", "held_out"]].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read_rows = texts.mapInPandas(
        read,
        f"doc_id {kind}, held_out boolean, n_tokens long, symbols binary, top int, log_counts double, "
        "n_known long, rare array<binary>, times array<int>",
    )
    rows = materialize(read_rows.withColumn("row", F.monotonically_increasing_id()))
    model = train(rows.filter("not held_out").select("symbols", "top"), weight / weight.sum(), rounds)
    held = spark.sparkContext.broadcast((model, np.log10(weight)))

    @F.pandas_udf("double")
    def shape(data: pd.Series) -> pd.Series:
        now, logs = held.value
        sequences = [np.frombuffer(x, "<u2") for x in data]
        given = np.array([logs[s].sum() for s in sequences])
        return pd.Series(log_likelihoods(now, sequences) - given)

    lookups = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    rare = (
        lookups.join(counts.filter("train > 0").select("word", "train"), "word")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("train") + 1)).alias("rare_logs"), F.sum("times").alias("rare_known"))
    )
    log_counts = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    scored = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", shape("symbols").alias("shape"))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (log_counts + F.col("shape")).alias("score"),
    )
