"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

A filter is a direction on the sphere, and a vector lies in the filters of its nearest directions,
always the same number of them. Two near vectors share some filter with high probability,
unrelated ones rarely. So that many directions need no long scan, they form a product code: the
coordinates, after a random rotation, are cut into blocks, each block has its own small random
code, and a direction is one code word per block. The cosine with a direction is a sum over
blocks; a vector is list-decoded to its best directions by extending the best partial sums block
by block.

Vectors are joined on filters, and pairs inside a filter are verified with double precision. A
filter never emits its pairs. For each member it emits the copies it links to, counting a pair
only in the smallest filter both share, and a spanning forest of the links. A filter with many
members is cut into blocks of ``BLOCK`` and pairs of blocks are separate tasks.

The code grows with the number of distinct vectors: a filter holds ``MEMBERS`` unrelated vectors
on average, and the shortest lists are taken that find ``RECALL`` of the pairs at exactly the wanted
cosine (nearer ones are found more often), measured on random pairs. Under the rotation that
recall depends on a pair's cosine only, not on the data. Where no list is long enough, as in few
dimensions, filters grow until one is. Up to ``EXACT`` vectors, or where filters would save
nothing, all pairs are compared (see :func:`plan`).

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component, and a
vector whose id is null, links with nothing and is its own component. Vectors of different lengths
never link. Equal vectors are one class with copies; a repeated id gives a row each, and rows with
the same id count as different vectors. Extra columns (labels) are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import components, join_hot

MEMBERS = 64
LISTED = (16, 24, 32, 48, 64)
WORDS = 4096
RECALL, PAIRS = 0.999, 4000
EXACT = 4096
BLOCK = 2048
STEP = 1000
SEED = 20


@dataclass(frozen=True)
class Code:
    dim: int
    blocks: int
    words: int
    threshold: float = -math.inf
    listed: int = 0

    def books(self) -> list[tuple[np.ndarray, slice]]:
        """Per block its unit code words and the coordinates it covers."""
        rng = np.random.default_rng([SEED, self.dim, self.blocks, self.words])
        cuts = np.linspace(0, self.dim, self.blocks + 1).astype(int)
        books = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            words = rng.standard_normal((self.words, b - a))
            words /= np.linalg.norm(words, axis=1, keepdims=True) * math.sqrt(self.blocks)
            books.append((words, slice(a, b)))
        return books

    def rotation(self) -> np.ndarray:
        rng = np.random.default_rng([SEED, self.dim])
        return np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]

    def nearest(self, unit: np.ndarray, books) -> np.ndarray:
        """For each row of ``unit``, the sorted numbers of its ``listed`` best filters (of all, if fewer)."""
        number, total = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for words, at in books:
            scores = unit[:, at] @ words.T
            top = min(self.listed, self.words)
            word = np.argpartition(-scores, top - 1, axis=1)[:, :top]
            best = np.take_along_axis(scores, word, 1)
            order = np.argsort(-best, axis=1, kind="stable")
            word, best = np.take_along_axis(word, order, 1), np.take_along_axis(best, order, 1)
            # both sides are in descending order: (i, j) is beaten by (i + 1) * (j + 1) - 1 others
            i, j = np.nonzero(np.outer(np.arange(total.shape[1]) + 1, np.arange(top) + 1) <= self.listed)
            sums = total[:, i] + best[:, j]
            keep = np.argsort(-sums, axis=1, kind="stable")[:, : self.listed]
            number = np.take_along_axis(number[:, i] * self.words + word[:, j], keep, 1)
            total = np.take_along_axis(sums, keep, 1)
        return np.sort(number, axis=1)

    def finds(self, cosine: float, least: float, pairs: int = PAIRS) -> bool:
        """Whether at least the share ``least`` of random pairs at this cosine share a filter."""
        rng = np.random.default_rng([SEED, self.dim, pairs])
        books, missed, step = self.books(), 0, 250
        for _ in range(0, pairs, step):
            x, z = rng.standard_normal((2, step, self.dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            z -= (z * x).sum(axis=1, keepdims=True) * x
            z /= np.linalg.norm(z, axis=1, keepdims=True)
            y = cosine * x + math.sqrt(max(1 - cosine * cosine, 0)) * z
            a, b = self.nearest(x, books), self.nearest(y, books)
            missed += step - int((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).sum())
            if missed > (1 - least) * pairs:
                return False
        return True

    def decode(self, unit: np.ndarray, books) -> list[np.ndarray]:
        """For each row of ``unit``, the sorted numbers of its filters: the ``listed`` best, or if
        that is 0 all over the threshold."""
        if self.listed:
            return list(self.nearest(unit @ self.rotation(), books))
        scores = [unit[:, at] @ words.T for words, at in books]
        best = np.cumsum([s.max(axis=1) for s in scores][::-1], axis=0)[::-1]
        row = np.arange(len(unit))
        number = np.zeros(len(unit), np.int64)
        total = np.zeros(len(unit))
        for i, s in enumerate(scores):
            rest = best[i + 1] if i + 1 < len(scores) else np.zeros(len(unit))
            sums = total[:, None] + s[row]
            at, word = np.nonzero(sums + rest[row][:, None] > self.threshold)
            total, number, row = sums[at, word], number[at] * self.words + word, row[at]
        cuts = np.searchsorted(row, np.arange(1, len(unit)))
        return [np.sort(x) for x in np.split(number, cuts)]


def plan(vectors: int, dim: int, min_cosine: float = 0.95) -> Code:
    """Code for so many distinct vectors of ``dim`` components; one single filter compares all pairs."""
    members = MEMBERS
    while vectors > EXACT and dim > 1 and members < vectors:
        for listed in LISTED:
            filters = vectors * listed / members
            blocks = next(b for b in range(1, 64) if filters <= WORDS**b)
            if filters <= listed**2 or blocks > dim:
                continue  # as many comparisons as all pairs are
            code = Code(dim, blocks, math.ceil(filters ** (1 / blocks)), listed=listed)
            if code.finds(min_cosine, RECALL):
                return code
        members *= 2
    return Code(dim, 1, 1, listed=1)


def _typed(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding, valid)``: rows that are not valid link with nothing."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False)))


def classes(rows: DataFrame) -> DataFrame:
    """``(class_id, embedding, copies)``: distinct valid vectors, named by their smallest id."""
    return (
        rows.filter("valid").groupBy("embedding")
        .agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    )


def _units(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_classes(found: DataFrame, min_cosine: float) -> DataFrame:
    """``(class_id, other, linked)`` from ``found`` (class_id, embedding, copies): for each class
    and filter the copies it links to there, and a link of the spanning forest (or null)."""
    spark = found.sparkSession
    sizes = {r.dim: r["count"] for r in found.groupBy(F.size("embedding").alias("dim")).count().collect()}
    codes = {dim: plan(count, dim, min_cosine) for dim, count in sizes.items()}

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = {dim: code.books() for dim, code in codes.items()}
        for batch in batches:
            for dim, rows in batch.groupby(batch["embedding"].map(len)):
                unit = _units(rows["embedding"])
                filters = [f for at in range(0, len(unit), STEP) for f in codes[dim].decode(unit[at : at + STEP], books[dim])]
                yield pd.DataFrame({"class_id": rows["class_id"].to_numpy(), "dim": dim, "filters": filters})

    lists = materialize(found.mapInPandas(listed, "class_id long, dim int, filters array<long>"))
    member = lists.select("class_id", "dim", F.explode("filters").alias("filter"))
    blocks = member.groupBy("dim", "filter").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    placed = member.join(blocks, ["dim", "filter"]).withColumn(
        "own", F.pmod(F.xxhash64("class_id"), F.col("n")).cast("int")
    )
    other = F.explode(F.expr("sequence(0, n - 1)")).alias("other_block")
    cells = placed.select("class_id", "dim", "filter", "own", other).select(
        "class_id", "dim", "filter",
        F.least("own", "other_block").alias("i"),
        F.greatest("own", "other_block").alias("j"),
        "own",
    )
    rows = cells.join(lists.select("class_id", "filters"), "class_id").join(found, "class_id")

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, number, i, j = key
        left, right = group[group["own"] == i], group[group["own"] == j]
        if not len(left) or not len(right):
            return group.iloc[:0].assign(other=0, linked=0)[["class_id", "other", "linked"]]
        near = _units(left["embedding"]) @ _units(right["embedding"]).T >= min_cosine
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        first = _first_here(np.stack(left["filters"].to_numpy()), np.stack(right["filters"].to_numpy()), a, b, number)
        a, b = a[first], b[first]
        ids_a, ids_b = left["class_id"].to_numpy(), right["class_id"].to_numpy()
        copies_a, copies_b = left["copies"].to_numpy(), right["copies"].to_numpy()
        ids = np.r_[ids_a[a], ids_b[b]]
        linked = pd.Series(np.r_[copies_b[b], copies_a[a]]).groupby(ids).sum()
        return pd.concat(
            [
                pd.DataFrame({"class_id": linked.index.to_numpy(), "other": None, "linked": linked.to_numpy()}),
                pd.DataFrame(_forest(ids_a[a], ids_b[b]), columns=["class_id", "other"]).assign(linked=0),
            ]
        ).astype({"class_id": "int64", "other": "Int64", "linked": "int64"})

    return rows.groupBy("dim", "filter", "i", "j").applyInPandas(verify, "class_id long, other long, linked long")


def _first_here(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    """Whether the pairs (a, b) of rows share no filter smaller than ``number``."""
    left = np.where(left < number, left, -1)
    first = np.ones(a.size, bool)
    for at in range(0, a.size, STEP):
        x, y = left[a[at : at + STEP]], right[b[at : at + STEP]]
        first[at : at + STEP] = ~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return first


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that join two trees, in order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (vec_id, embedding)."""
    rows = _typed(vectors)
    found = materialize(classes(rows))
    links = materialize(link_classes(found, min_cosine))
    counted = links.groupBy("class_id").agg(F.sum("linked").alias("linked"))
    edges = links.filter("other is not null").select(F.col("class_id").alias("a"), F.col("other").alias("b"))
    labels = materialize(
        found.join(counted, "class_id", "left")
        .join(components(edges).withColumnRenamed("node", "class_id"), "class_id", "left")
        .select(
            "embedding",
            "copies",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("root", "class_id").alias("component_id"),
        )
    )
    linked = join_hot(rows.filter("valid"), labels, "embedding", "copies")
    alone = rows.filter(~F.col("valid")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    both = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
