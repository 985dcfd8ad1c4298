"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells: one category per dimension (source, language, topic). Raking scales the
cells' weights until the token totals of every dimension match its target shares, all dimensions
at once. A document is then sampled with probability ``min(1, c * weight)`` of its cell.

Without ``size``, ``c`` makes the largest probability one: expected token shares equal the targets,
nothing is drawn twice, and the sample is as large as the scarcest cell allows. With ``size``, ``c``
is solved so that this share of all tokens is expected: cells too scarce for it keep all they have
(probability one), the weights of the others keep their proportions, and categories made of scarce
cells fall short of their targets. ``max_weight`` bounds the weights while raking; there is no bound
by default. :func:`shares` tells for each category what was wanted and what is expected.

Targets list categories; every value they don't list, and null, falls into ``OTHER``. So the
number of cells is bounded by the targets, never by the data. One partial aggregation over the
documents gives the cells' tokens. Up to ``MAX_CELLS`` cells the raking itself is arithmetic on
that small table; beyond, it is a loop of grouped sums and joins (:func:`rake_by_join`) with the
same steps.

Defined cases: an unlisted ``OTHER`` takes what the listed shares leave of 1, or if they leave
nothing the share it has; categories without tokens are left out, and the shares of the others are
divided by their sum. A share of 0 drops a category. Where targets contradict each other (a
category lies in cells of dropped ones only) raking ends after ``ROUNDS`` rounds with the weights it
has, which follow the last dimension. A ``size`` beyond what cells with a weight hold keeps all of
those. A null text counts as empty; a document without tokens follows its cell's weight.
Sampling hashes (doc_id, text), so repeated rows share their fate. Extra columns stay; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import checkpointed, materialize
from .common import text_or_empty

Targets = Mapping[str, Mapping[str, float]]

OTHER = "other"
MAX_CELLS = 100_000
ROUNDS, TOLERANCE = 200, 1e-10
#: Shares below this are not scaled up any more.
LOST = 1e-200


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of a text."""
    return (
        F.when(text == "", "empty")
        .when(F.lower(text).rlike(r"\blicen[sc]e"), "legal")
        .when(text.rlike(r"https?://|\S@\S"), "contact")
        .when(text.contains(" | "), "table")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, targets: Targets) -> DataFrame:
    """``(row, doc_id, text, tokens)`` and one category column ``_at_<dimension>`` per dimension;
    ``row`` holds the row as it was."""
    text = text_or_empty()
    columns = [
        F.struct(*docs.columns).alias("row"),
        "doc_id",
        text.alias("text"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
    ]
    for dimension, shares in targets.items():
        value = topic_of(text) if dimension == "topic" and "topic" not in docs.columns else F.col(dimension)
        category = F.when(value.isin(*shares), value.cast("string")).otherwise(F.lit(OTHER))
        columns.append(category.alias(f"_at_{dimension}"))
    return docs.select(*columns)


def _shares(found: Mapping[str, float], wanted: Mapping[str, float]) -> dict[str, float]:
    """Target shares over the categories that have tokens; ``found``: their tokens."""
    total = sum(found.values())
    present = {c for c, tokens in found.items() if tokens > 0}
    rest = 1 - sum(wanted.values())
    rest = rest if rest > 1e-9 else found.get(OTHER, 0) / max(total, 1)
    shares = {c: float(wanted.get(c, rest)) for c in present}
    scale = sum(shares.values())
    return {c: s / scale if scale else 0.0 for c, s in shares.items()}


def rake(
    cells: pd.DataFrame, targets: Targets, max_weight: float | None = None, rounds: int = ROUNDS
) -> np.ndarray:
    """Weight per row of ``cells`` (category columns and ``tokens``)."""
    tokens = cells["tokens"].to_numpy(float)
    weight = np.ones(len(cells))
    plans = []
    for dimension, wanted in targets.items():
        codes, names = pd.factorize(cells[f"_at_{dimension}"])
        shares = _shares(dict(zip(names, np.bincount(codes, tokens, len(names)), strict=True)), wanted)
        plans.append((codes, np.array([shares.get(n, 0.0) for n in names])))
    total = tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for codes, shares in plans:
            has = np.bincount(codes, tokens * weight, len(shares)) / total
            factor = np.divide(shares, has, out=np.ones_like(has), where=has > LOST)
            worst = max(worst, float(np.abs(has - shares).max(initial=0.0)))
            weight = np.minimum(weight * factor[codes], max_weight or np.inf)
        if worst < TOLERANCE:
            break
    return weight


def rake_by_join(
    cells: DataFrame, targets: Targets, max_weight: float | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """``cells`` with ``weight``, for more cells than the driver should hold: one grouped sum and one
    join per dimension and round. Categories per dimension are bounded by the targets."""
    now = cells.withColumn("weight", F.lit(1.0))
    total = cells.agg(F.sum("tokens")).head()[0] or 0
    plans = {}
    for dimension, wanted in targets.items():
        sums = cells.groupBy(f"_at_{dimension}").agg(F.sum("tokens").alias("t")).collect()
        plans[dimension] = _shares({r[0]: r[1] for r in sums}, wanted)
    for _ in range(rounds):
        worst = 0.0
        for dimension, shares in plans.items():
            at = f"_at_{dimension}"
            sums = now.groupBy(at).agg(F.sum(F.col("tokens") * F.col("weight")).alias("t")).collect()
            has = {r[0]: r.t / total for r in sums if total}
            worst = max([worst, *(abs(has[c] - s) for c, s in shares.items())])
            factors = [(c, shares.get(c, 0.0) / h if h > LOST else 1.0) for c, h in has.items()]
            if not factors:
                return now
            table = cells.sparkSession.createDataFrame(factors, "category string, factor double")
            now = (
                now.join(table, now[at] == table["category"])
                .withColumn("weight", F.least(F.col("weight") * F.col("factor"), F.lit(max_weight or float("inf"))))
                .drop("category", "factor")
            )
        now = checkpointed(now)
        if worst < TOLERANCE:
            break
    return now


def _scale(cells: DataFrame, size: float | None) -> float:
    """The ``c`` of :func:`weights`, from a grouped sum per round: cells that reach probability one
    keep it, and the rest of the size is spread over the others. Every round but the last adds such
    cells."""
    if size is None:
        top = cells.filter("tokens > 0").agg(F.max("weight")).head()[0]
        return 1 / top if top else 1.0
    c, full = 0.0, -1
    while True:
        whole = F.col("weight") * c >= 1
        held = F.when(whole, F.col("tokens")).otherwise(0)
        free = F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("weight"))
        row = cells.agg(F.sum("tokens"), F.sum(held), F.sum(free), F.count_if(whole)).head()
        if row[3] == full or not row[2]:
            return c or 1.0
        c, full = max(c, (size * row[0] - row[1]) / row[2]), row[3]


def weights(
    docs: DataFrame,
    targets: Targets,
    size: float | None = None,
    max_weight: float | None = None,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """``(_at_..., tokens, weight, probability)`` per cell that occurs."""
    if size is not None and not 0 < size <= 1:
        raise ValueError("size is a share of the tokens")
    spark = docs.sparkSession
    at = [f"_at_{d}" for d in targets]
    cells = materialize(with_cells(docs, targets).groupBy(*at).agg(F.sum("tokens").alias("tokens")))
    if cells.count() <= max_cells:
        table = cells.toPandas()
        table["weight"] = rake(table, targets, max_weight)
        raked = spark.createDataFrame(
            [tuple(r) for r in table[[*at, "tokens", "weight"]].itertuples(index=False)],
            ", ".join([*(f"{c} string" for c in at), "tokens long", "weight double"]),
        )
    else:
        raked = rake_by_join(cells, targets, max_weight).select(*at, "tokens", "weight")
    c = F.lit(float(_scale(raked, size)))
    return raked.withColumn("probability", F.least(F.lit(1.0), c * F.col("weight")))


def shares(table: DataFrame, targets: Targets) -> DataFrame:
    """``dimension, category, tokens, wanted, expected`` per category of :func:`weights`' table: its
    tokens, its target share (of the categories that have tokens) and its share of the sample."""
    out = []
    for dimension, listed in targets.items():
        sums = table.groupBy(F.col(f"_at_{dimension}").alias("category")).agg(
            F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("drawn")
        ).collect()  # categories are bounded by the targets
        wanted = _shares({r.category: r.tokens for r in sums}, listed)
        total = sum(r.drawn for r in sums) or 1.0
        out += [(dimension, r.category, r.tokens, wanted.get(r.category, 0.0), r.drawn / total) for r in sums]
    return table.sparkSession.createDataFrame(
        sorted(out), "dimension string, category string, tokens long, wanted double, expected double"
    )


def sampled(
    docs: DataFrame,
    targets: Targets,
    size: float | None = None,
    seed: int = 11,
    max_weight: float | None = None,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """:func:`with_cells` with ``weight``, ``probability`` and ``kept``."""
    table = weights(docs, targets, size, max_weight, max_cells).drop("tokens")
    if table.count() <= max_cells:
        table = F.broadcast(table)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) / float(1 << 53)
    return (
        with_cells(docs, targets).join(table, [f"_at_{d}" for d in targets])
        .withColumn("kept", drawn < F.col("probability"))
    )


def mixed(docs: DataFrame, targets: Targets, size: float | None = None, seed: int = 11) -> DataFrame:
    """The sampled rows of ``docs``, its columns as they were."""
    return sampled(docs, targets, size, seed).filter("kept").select("row.*")
