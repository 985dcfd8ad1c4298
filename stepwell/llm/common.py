"""What several operators of this package share: components, hot-key joins, batches of text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import checkpointed

#: Texts handed to a Python worker at once; a row may be a very long text.
TEXTS_PER_BATCH = 256
#: A key with more than this share of the rows is hot, so there are at most 1 / HOT_SHARE.
HOT_SHARE = 1e-3


def small_batches(spark: SparkSession, rows: int = TEXTS_PER_BATCH) -> None:
    """Bound a Python worker's memory: at most ``rows`` rows in an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ranges(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the slices ``at[i] : at[i + 1]`` for every i of ``which``, and their lengths."""
    size = at[which + 1] - at[which]
    return np.arange(size.sum()) + np.repeat(at[which] - np.cumsum(size) + size, size), size


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, copies: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per ``key`` and in ``copies`` the
    number of ``rows`` of that key.

    Keys with over ``HOT_SHARE`` of all rows are broadcast: there are at most 1 / HOT_SHARE of
    them whatever the size, so no task gets all rows of a hot key. All others are shuffled.
    """
    total = keyed.agg(F.sum(copies)).head()[0] or 0
    hot = F.col(copies) > max(total * HOT_SHARE, 1)
    often = keyed.filter(hot).limit(int(1 / HOT_SHARE) + 1)
    left = rows.join(F.broadcast(often.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    spread = left.filter(F.col("_hot").isNull()).drop("_hot").join(keyed.filter(~hot), key)
    dense = rows.join(F.broadcast(often), key)
    return dense.unionByName(spread)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list ``(a, b)`` of longs: ``(node, root)``, the root being
    the smallest node, for every node that has an edge.

    Large-star and small-star steps in turn: each step links nodes to the smallest neighbour, and
    the steps needed grow with the logarithm of the longest path. Neighbourhoods are reduced by
    partial aggregation and a join that adaptive execution can split; no group is gathered.
    """
    now = checkpointed(
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select("hi", "lo").unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = (
            both.filter("lo > hi").join(least, "hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .filter("hi != lo").distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .filter("hi != lo")
            .unionByName(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        now, before = checkpointed(small), mark
        mark = _mark(now)
        if mark == before:
            break
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and checksum; the steps have come to rest when neither changes."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).head()
    return row[0], row[1] or 0
