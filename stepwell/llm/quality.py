"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The model predicts characters (code points, case kept) from the ORDER - 1 before them; a boundary
stands before and after each text. Every trusted text counts: texts fall into two halves by hash, and
there is a model for each half, trained on all trusted texts of the other one. So no text is scored by
a model that has seen it, and equal texts have equal scores. Tasks add up their n-grams before
anything is shuffled; counts of all orders are sharded by n-gram, and joins of these shards with those
of their contexts and of the next lower order give the discounted, interpolated probabilities. Below
order 1 every code point is equally likely, so scripts that the trusted texts do not have cost what
they are worth.

Texts are scored where they lie. Orders of at most ``MAX_GRAMS`` n-grams are broadcast whole; those of
at most ``MAX_MAPPED`` go to every executor as sorted files that its workers memory-map, so they take
disk and no worker's memory. Of a highest order with more, only the most frequent n-grams are broadcast:
each text's other n-grams are joined with the tables of the orders that executors do not have. All ways
give the same perplexities.

A document is rejected if its perplexity exceeds its threshold, a quantile of the perplexities of
all trusted documents of its language. Long texts vary less than short ones, so a language has a
threshold per length class (twice the characters, the next class) where it has enough trusted
documents to have that quantile, and one for its other classes.

Defined cases: a null text counts as empty (its end is predicted after the start); U+0000 and
U+0002 inside a text read as the boundary; a null language is a language of its own; a language
without trusted documents has no threshold and keeps all its documents; for a half whose model has no
trusted text every character is equally likely. Labels with a null id are ignored, repeated labels
count once and a document is trusted only if all its labels say so. Repeated rows give a row each;
extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast, SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import small_batches, text_or_empty

ORDER = 6
#: n-grams of an order that are broadcast, so that every worker holds them.
MAX_GRAMS = 1 << 22
#: n-grams of an order that executors have as files, 12 bytes each and as much for their contexts at
#: most; an order with more is joined.
MAX_MAPPED = 1 << 27
#: Distinct n-grams that a task holds before it hands them on.
HELD_GRAMS = 1 << 19
#: Ids of trusted documents that are broadcast; more are joined by a shuffle.
MAX_IDS = 1 << 22
QUANTILE = 0.995
#: A language's threshold is broadcast while there are at most this many languages.
MAX_LANGUAGES = 10_000
#: Symbols scored at once; longer texts go in pieces.
PIECE = 1 << 18
#: Counted n-grams handed on at once.
ROWS = 1 << 16
#: n-grams that a task sorts for a file.
SORTED_GRAMS = 1 << 20
CODE_POINTS = 0x110000
BOUNDARY = 2
#: An n-gram's key is the polynomial of its code points in this odd number, modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the second half's model are changed by this number, so both models share a table.
SALT = np.uint64(0xD6E8FEB86659FD93)


def symbols(text: str) -> np.ndarray:
    """Code points of a text between boundaries, ORDER before it and one after."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(codes.size + ORDER + 1, BOUNDARY, np.uint32)
    out[ORDER:-1] = codes
    out[out == 0] = BOUNDARY
    return out


def pieces(texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of the texts' symbols and the number of the text each belongs to, -1 for the
    ORDER symbols that only stand before a stretch."""
    held, owners, size = [], [], 0
    for number, text in enumerate(texts):
        whole = symbols(text)
        for at in range(ORDER, whole.size, PIECE):
            part = whole[at - ORDER : at + PIECE]
            owner = np.full(part.size, number, np.int64)
            owner[:ORDER] = -1
            held.append(part)
            owners.append(owner)
            size += part.size
            if size >= PIECE:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners)


def keys(codes: np.ndarray) -> list[np.ndarray]:
    """For every order n from 0 to ORDER the key of the n symbols that end at each place."""
    found = [np.zeros(codes.size, np.uint64)]
    wide, power = codes.astype(np.uint64) + np.uint64(1), np.uint64(1)
    for n in range(ORDER):
        longer = found[-1].copy()
        longer[n:] += wide[: codes.size - n] * power
        found.append(longer)
        power = np.uint64(int(power) * int(BASE) % (1 << 64))
    return found


def half() -> Column:
    """The half that a text belongs to, 0 or 1, by hash."""
    return F.xxhash64(text_or_empty()).bitwiseAND(1).cast("int")


def count_n_grams(docs: DataFrame, model: Column | None = None) -> DataFrame:
    """``(model, gram, n)``: the strings of ORDER symbols of all texts, added up in each task before
    the shuffle; ``model`` tells whose counts a text adds to (0 for all texts without it)."""
    small_batches(docs.sparkSession)
    most = HELD_GRAMS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return tallied(batches, most)

    texts = docs.select(text_or_empty().alias("text"), (F.lit(0) if model is None else model).alias("model"))
    # The fewer tasks, the fewer rows for one n-gram; their number follows the cluster.
    texts = texts.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    parts = texts.mapInPandas(count, "model int, gram string, n long")
    return parts.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def tallied(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The n-grams of a task's texts and their counts; what is held is handed on when it has more
    than ``most`` distinct ones. Two workers share an executor with its JVM, so new n-grams are added
    to the others as soon as they are half as many."""
    held, size = _Held(), 0
    for batch in batches:
        models = batch["model"].to_numpy(np.int8)
        for codes, owner in pieces(batch["text"].to_numpy()):
            ends = np.flatnonzero(owner >= 0)
            key, which = keys(codes)[ORDER][ends], models[owner[ends]]
            key = _salted(key, which)
            order, starts = _distinct(key)
            first = order[starts]
            at = ends[first][:, None] + np.arange(1 - ORDER, 1)
            held.key.append(key[first])
            held.n.append(np.diff(starts, append=order.size))
            held.which.append(which[first])
            held.grams.append(np.ascontiguousarray(codes[at]).view(f"<U{ORDER}").ravel())
            size += first.size
            del key, which, order, starts, first, at
            if size > most + most // 2:
                size = held.add_up()
                if size > most:
                    yield from held.rows()
                    held, size = _Held(), 0
    if size:
        held.add_up()
        yield from held.rows()


@dataclass
class _Held:
    """Counted n-grams, column by column in parts: salted key, count, model and string."""

    key: list[np.ndarray] = field(default_factory=list)
    n: list[np.ndarray] = field(default_factory=list)
    which: list[np.ndarray] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)

    def add_up(self) -> int:
        """Make one part of each column, with one entry per n-gram. A column's old parts go before
        the next column's are put together, so no two columns are in memory twice."""
        self.key = [np.concatenate(self.key)]
        order, starts = _distinct(self.key[0])
        first = order[starts]
        self.key = [self.key[0][first]]
        self.n = [np.concatenate(self.n)]
        self.n = [np.add.reduceat(self.n[0][order], starts)]
        del order, starts
        self.which = [np.concatenate(self.which)]
        self.which = [self.which[0][first]]
        self.grams = [np.concatenate(self.grams)]
        self.grams = [self.grams[0][first]]
        return first.size

    def rows(self) -> Iterator[pd.DataFrame]:
        which, n, grams = self.which[0], self.n[0], self.grams[0]
        self.key = []
        for at in range(0, n.size, ROWS):
            part = slice(at, at + ROWS)
            yield pd.DataFrame({"model": which[part], "gram": grams[part].astype(object), "n": n[part]})


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys side by side, by their first 16 bits, and where each distinct one
    begins in it. Numbers sort faster than places, so a key's first bits, a hash of it and its place are
    sorted as one number."""
    place = np.uint64((1 << key.size.bit_length()) - 1)
    packed = (key * BASE) >> np.uint64(16)
    packed |= key & np.uint64(0xFFFF << 48)
    packed &= ~place
    packed |= np.arange(key.size, dtype=np.uint64)
    packed.sort()
    order = (packed & place).astype(np.int64)
    found = key[order]
    new = np.ones(key.size, bool)
    new[1:] = found[1:] != found[:-1]
    packed &= ~place
    if np.any(new[1:] & (packed[1:] == packed[:-1])):  # other keys with the same hash may lie between equal ones
        order = np.argsort(key)
        found = key[order]
        new[1:] = found[1:] != found[:-1]
    return order, np.flatnonzero(new)


def _salted(key: np.ndarray, model: np.ndarray) -> np.ndarray:
    return key ^ (model.astype(np.uint64) * SALT)


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """Per model the modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    of = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    found = {}
    for model, n1, n2, n3, n4 in counts.groupBy("model").agg(*of).collect():  # two rows at most
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        found[model] = [
            min(max(i - (i + 1) * y * b / a, 0.1), i - 0.05) if a else 0.5 * i
            for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)
        ]
    return found


def _discount(counts: DataFrame) -> Column:
    chosen = F.lit(0.0)
    for model, (d1, d2, d3) in _discounts(counts).items():
        own = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        chosen = F.when(F.col("model") == model, own).otherwise(chosen)
    return chosen


@dataclass
class Level:
    """n-grams of one order, sorted by key, with their log10 probability, and their contexts, sorted
    by key, with the log10 share they leave to the next lower order. An order of more than
    ``MAX_GRAMS`` has tables of all of them, ``(model, gram, p)`` and ``(model, context, left_over)``;
    its arrays hold no contexts, and only the highest order's hold n-grams, the most frequent. Up to
    ``MAX_MAPPED`` it also has the names of the files that hold what its tables do."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_left: np.ndarray
    tables: tuple[DataFrame, DataFrame] | None = None
    files: tuple[str, str] | None = None

    def all_grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and logarithms, those in memory first."""
        yield self.grams, self.log_p
        if self.files:
            yield _mapped(self.files[0])

    def all_contexts(self) -> tuple[np.ndarray, np.ndarray]:
        return _mapped(self.files[1]) if self.files else (self.contexts, self.log_left)


@lru_cache(maxsize=64)
def _mapped(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys and logarithms of a file that :func:`_shipped` made."""
    file = SparkFiles.get(name)
    count = os.path.getsize(file) // 12
    key = np.memmap(file, np.uint64, "r", 0, (count,))
    return key.view(np.ndarray), np.memmap(file, np.float32, "r", 8 * count, (count,)).view(np.ndarray)


def _keyed(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the strings in ``text``, which are of one length, and the logarithms of ``value``."""
    codes = [np.frombuffer(s.encode("utf-32-le"), "<u4") for s in batch["text"]]
    last = np.stack(codes)[:, ::-1].astype(np.uint64) + np.uint64(1)
    powers = [pow(int(BASE), n, 1 << 64) for n in range(last.shape[1])]
    key = (last * np.array(powers, np.uint64)).sum(axis=1, dtype=np.uint64)
    return _salted(key, batch["model"].to_numpy()), np.log10(batch["value"].to_numpy()).astype(np.float32)


def _collected(rows: DataFrame, text: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the strings in ``text`` and the logarithms of ``value``."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keyed, logs = [], []
        for batch in batches:
            if len(batch):
                key, log = _keyed(batch)
                keyed.append(key)
                logs.append(log)
        if keyed:
            yield pd.DataFrame({"key": [np.concatenate(keyed).tobytes()], "log": [np.concatenate(logs).tobytes()]})

    few = rows.select("model", F.col(text).alias("text"), F.col(value).alias("value"))
    parts = few.mapInPandas(packed, "key binary, log binary").collect()  # a row per task
    key = np.frombuffer(b"".join(bytes(r.key) for r in parts), np.uint64)
    log = np.frombuffer(b"".join(bytes(r.log) for r in parts), np.float32)
    del parts
    order = np.argsort(key)
    return key[order], log[order]


def _shipped(rows: DataFrame, text: str, value: str, size: int) -> str:
    """Hand all executors a file of the sorted keys of the strings in ``text``, about ``size`` of them,
    and then of the logarithms of ``value``; its name. Tasks sort ranges of keys, and the driver appends
    one after the other, so it holds a part at a time."""
    sign = np.uint64(1 << 63)  # Spark sorts signed numbers

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                key, log = _keyed(batch)
                yield pd.DataFrame({"key": (key ^ sign).view(np.int64), "log": log})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += len(batch)
            if many >= ROWS:
                yield pack(pd.concat(held))
                held, many = [], 0
        if held:
            yield pack(pd.concat(held))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["key"].to_numpy(np.int64).view(np.uint64) ^ sign
        return pd.DataFrame({"key": [key.tobytes()], "log": [rows["log"].to_numpy(np.float32).tobytes()]})

    few = rows.select("model", F.col(text).alias("text"), F.col(value).alias("value"))
    few = materialize(few.mapInPandas(keyed, "key long, log float"))  # ranges are found by a first pass
    parts = few.repartitionByRange(-(-size // SORTED_GRAMS), "key").sortWithinPartitions("key")
    folder = os.path.join(SparkFiles.getRootDirectory(), "shipped")  # the driver's, until it stops
    os.makedirs(folder, exist_ok=True)
    name = f"n-grams-{uuid.uuid4().hex}"
    with open(os.path.join(folder, name), "wb") as out, tempfile.TemporaryFile() as logs:
        for part in parts.mapInPandas(packed, "key binary, log binary").toLocalIterator():
            out.write(part.key)
            logs.write(part.log)
        logs.seek(0)
        shutil.copyfileobj(logs, out)
    rows.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


def _frequent(rows: DataFrame) -> DataFrame:
    """The n-grams that occur at least so often that there are at most ``MAX_GRAMS``."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = dict(rows.groupBy(power).count().collect())  # 64 rows at most
    least, many = 64, 0
    while least and many + sizes.get(least - 1, 0) <= MAX_GRAMS:
        least -= 1
        many += sizes.get(least, 0)
    return rows.filter(power >= least)


def kneser_ney(counts: DataFrame) -> list[Level]:
    """The levels, order 1 first, from ``counts`` (model, gram, n) of the highest order."""
    tables = [counts]  # lower orders count distinct predecessors
    for _ in range(ORDER - 1):
        shorter = tables[-1].groupBy("model", F.expr("substring(gram, 2)").alias("gram"))
        tables.append(materialize(shorter.agg(F.count("*").alias("n"))))
    found: list[Level] = []
    lower = None
    for order, level in enumerate(reversed(tables), 1):
        n = F.col("n")
        keyed = level.withColumn("context", F.expr(f"substring(gram, 1, {order - 1})"))
        keyed = keyed.withColumn("discount", _discount(level))
        contexts = materialize(
            keyed.groupBy("model", "context").agg(
                F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("left_over")
            )
        )
        own = keyed.join(contexts, ["model", "context"]).withColumn("own", (n - F.col("discount")) / F.col("total"))
        if lower is None:
            joined = own.withColumn("below", F.lit(1.0 / CODE_POINTS))
        else:
            joined = own.withColumn("suffix", F.expr("substring(gram, 2)")).join(
                lower.select("model", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["model", "suffix"]
            )
        p = F.col("own") + F.col("left_over") * F.col("below")
        lower = materialize(joined.select("model", "gram", "n", p.alias("p")))
        size = lower.count()
        if size <= MAX_GRAMS:
            found.append(Level(*_collected(lower, "gram", "p"), *_collected(contexts, "context", "left_over")))
            continue
        hot = np.empty(0, np.uint64), np.empty(0, np.float32)
        if order == ORDER:
            hot = _collected(_frequent(lower), "gram", "p")
        none = np.empty(0, np.uint64), np.empty(0, np.float32)
        files = None
        if size <= MAX_MAPPED:
            files = _shipped(lower, "gram", "p", size), _shipped(contexts, "context", "left_over", size)
        found.append(Level(*hot, *none, (lower.drop("n"), contexts.drop("total")), files))
    return found


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys, and whether they are there."""
    if not sorted_keys.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), sorted_keys.size - 1)
    return at, sorted_keys[at] == wanted


def _whole(model: list[Level]) -> int:
    """The highest order up to which executors have all n-grams."""
    return sum(level.tables is None or level.files is not None for level in model)  # a higher order never has fewer


def _log_p(model: list[Level], key: list[np.ndarray], places: np.ndarray, of: np.ndarray, top: int) -> np.ndarray:
    """log10 probability, by the orders up to ``top``, of the symbols at ``places``; ``of`` tells the
    model of each."""
    log_p = np.zeros(places.size)
    left = np.arange(places.size)  # those not found in any higher order
    for n in range(top, 0, -1):
        level = model[n - 1]
        for grams, log in level.all_grams():
            at, known = _find(grams, _salted(key[n][places[left]], of[left]))
            log_p[left[known]] += log[at[known]]
            left = left[~known]
        contexts, log = level.all_contexts()
        at, known = _find(contexts, _salted(key[n - 1][places[left] - 1], of[left]))
        log_p[left[known]] += log[at[known]]
    log_p[left] -= np.log10(CODE_POINTS)
    return log_p


def _broadcast(docs: DataFrame, model: list[Level]) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast([replace(level, tables=None) for level in model])


def with_perplexity(docs: DataFrame, model: list[Level], of: Column | None = None) -> DataFrame:
    """``docs`` with ``perplexity`` per symbol, by the model that ``of`` tells (0 without it)."""
    small_batches(docs.sparkSession)
    of = F.lit(0) if of is None else of
    if _whole(model) < len(model):
        return _with_joined_perplexity(docs, model, of)
    shared = _broadcast(docs, model)

    @F.pandas_udf("double")
    def perplexity(texts: pd.Series, of: pd.Series) -> pd.Series:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        models = of.to_numpy()
        for codes, owner in pieces(texts.to_numpy()):
            ends = np.flatnonzero(owner >= 0)
            key, own = keys(codes), owner[ends]
            which = models[own]
            order, starts = _distinct(_salted(key[ORDER][ends], which))
            first = order[starts]
            log_p = _log_p(shared.value, key, ends[first], which[first], ORDER)
            total += np.bincount(own[order], np.repeat(log_p, np.diff(starts, append=order.size)), len(texts))
            count += np.bincount(own, minlength=len(texts))
        return pd.Series(10 ** (-total / np.maximum(count, 1)))

    return docs.withColumn("perplexity", perplexity(text_or_empty(), of))


def _with_joined_perplexity(docs: DataFrame, model: list[Level], of: Column) -> DataFrame:
    """:func:`with_perplexity` for a model too large to broadcast. Frequent n-grams are priced where
    the texts lie, each text's others by joins; texts are known by their digest."""
    top = _whole(model)
    shared = _broadcast(docs, model)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            models = batch["model"].to_numpy()
            digests = batch["digest"].to_numpy()
            for codes, owner in pieces(batch["text"].to_numpy()):
                ends = np.flatnonzero(owner >= 0)
                key, own = keys(codes)[ORDER][ends], owner[ends]
                at, hot = _find(shared.value[-1].grams, _salted(key, models[own]))
                texts = np.unique(own)
                yield pd.DataFrame({
                    "digest": digests[texts],
                    "model": models[texts],
                    "gram": None,
                    "log": np.bincount(own[hot], shared.value[-1].log_p[at[hot]], len(batch))[texts],
                    "n": np.bincount(own, minlength=len(batch))[texts],
                })
                cold = np.flatnonzero(~hot)
                by_text = np.lexsort((key[cold], own[cold]))
                cold = cold[by_text]
                if cold.size:
                    new = np.ones(cold.size, bool)
                    new[1:] = (key[cold[1:]] != key[cold[:-1]]) | (own[cold[1:]] != own[cold[:-1]])
                    first = np.flatnonzero(new)
                    symbols_at = ends[cold[first]][:, None] + np.arange(1 - ORDER, 1)
                    grams = np.ascontiguousarray(codes[symbols_at]).view(f"<U{ORDER}").ravel()
                    yield pd.DataFrame({
                        "digest": digests[own[cold[first]]],
                        "model": models[own[cold[first]]],
                        "gram": grams.astype(object),
                        "log": 0.0,
                        "n": np.diff(np.append(first, cold.size)),
                    })

    @F.pandas_udf("double")
    def broadcast_orders(grams: pd.Series, of: pd.Series) -> pd.Series:
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.arange(ORDER - 1, codes.size, ORDER)
        return pd.Series(_log_p(shared.value, keys(codes), ends, of.to_numpy(), top))

    digest = F.sha2(text_or_empty(), 256)
    texts = docs.select(digest.alias("digest"), text_or_empty().alias("text"), of.alias("model"))
    found = materialize(texts.mapInPandas(lines, "digest string, model int, gram string, log double, n long"))
    cold = found.filter("gram is not null")
    priced = cold.select("model", "gram").distinct()
    priced = priced.withColumn("price", broadcast_orders("gram", "model"))
    for n in range(top + 1, ORDER + 1):
        grams, contexts = model[n - 1].tables
        ending = F.expr(f"substring(gram, {ORDER - n + 1})")
        before = F.expr(f"substring(gram, {ORDER - n + 1}, {n - 1})")
        known = grams.select("model", F.col("gram").alias("ending"), F.log10("p").alias("known"))
        left = contexts.select("model", F.col("context").alias("before"), F.log10("left_over").alias("left"))
        priced = (
            priced.withColumn("ending", ending).withColumn("before", before)
            .join(known, ["model", "ending"], "left").join(left, ["model", "before"], "left")
            .withColumn("price", F.coalesce("known", F.coalesce("left", F.lit(0.0)) + F.col("price")))
            .select("model", "gram", "price")
        )
    joined = cold.join(priced, ["model", "gram"]).select(
        "digest", "model", (F.col("price") * F.col("n")).alias("log"), F.lit(0).cast("long").alias("n")
    )
    hot = found.filter("gram is null").select("digest", "model", "log", "n")
    # A text that several rows have adds up as often on either side of the division.
    scores = hot.unionByName(joined).groupBy(F.col("digest").alias("_digest"), F.col("model").alias("_model")).agg(
        F.pow(F.lit(10.0), -F.sum("log") / F.sum("n")).alias("perplexity")
    )
    same = (digest == F.col("_digest")) & (of == F.col("_model"))
    return docs.join(scores, same).select(*[docs[c] for c in docs.columns], "perplexity")


@dataclass
class Model:
    levels: list[Level]
    thresholds: DataFrame
    scored: DataFrame


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("trusted_id"))
        .agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good"))
        .filter("good = 1").select("trusted_id")
    )


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> Model:
    """Train on all trusted documents, each for the half that it is not in, then score every document
    by its half's model and take each language's ``quantile`` over all its trusted ones."""
    trusted = materialize(trusted_ids(labels))
    on = F.col("doc_id").cast("long") == F.col("trusted_id")
    ids = F.broadcast(trusted) if trusted.count() <= MAX_IDS else trusted
    texts = docs.select("doc_id", "text").join(ids, on, "left_semi")
    model = kneser_ney(materialize(count_n_grams(texts, 1 - half())))
    rows = with_perplexity(docs.select("doc_id", "lang", "text"), model, half())
    scored = materialize(rows.select("doc_id", "lang", band(), "perplexity"))
    return Model(model, limits(scored.join(ids, on, "left_semi"), quantile), scored)


def band() -> Column:
    """Length class of a text: twice the characters, the next one."""
    return F.floor(F.log2(F.char_length(text_or_empty()) + 1)).cast("int").alias("band")


def limits(trusted: DataFrame, quantile: float) -> DataFrame:
    """``of_lang, of_band, threshold``: the quantile of perplexity per language and length class with
    enough rows to have that quantile, and per language (``of_band`` null)."""
    found = [F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"), F.count("*").alias("rows")]
    lang = F.col("lang").alias("of_lang")
    narrow = trusted.groupBy(lang, F.col("band").alias("of_band")).agg(*found)
    wide = trusted.groupBy(lang, F.lit(None).cast("int").alias("of_band")).agg(*found)
    enough = F.col("rows") * (1 - quantile) >= 1 - 1e-9
    return materialize(narrow.filter(enough).unionByName(wide).drop("rows"))


def classified(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``scored`` (with lang, band, perplexity) and its ``threshold`` and decision ``keep``."""
    narrow = thresholds.filter("of_band is not null").withColumnRenamed("threshold", "narrow")
    wide = thresholds.filter("of_band is null").drop("of_band").withColumnRenamed("threshold", "wide")
    if wide.count() <= MAX_LANGUAGES:  # a language has some 32 length classes at most
        narrow, wide = F.broadcast(narrow), F.broadcast(wide)
    same = F.col("lang").eqNullSafe(F.col("of_lang"))
    joined = scored.join(narrow, same & (F.col("band") == F.col("of_band")), "left").drop("of_lang", "of_band")
    joined = joined.join(wide, same, "left").drop("of_lang")
    joined = joined.withColumn("threshold", F.coalesce("narrow", "wide")).drop("narrow", "wide")
    return joined.withColumn("keep", F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps. Texts are scored anew where they lie rather
    than joined to their scores, so no text is shuffled."""
    model = fit(docs, labels, quantile)
    own = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", band())
    decided = classified(with_perplexity(own, model.levels, half()), model.thresholds)
    return decided.filter("keep").select("_row.*")
