"""Exact medians of whole numbers, from value counts.

The input holds one row per (group, value) with the number of times the value occurs, not one
row per user: equal values are combined inside each task, before the shuffle.

Values known to lie below ``ORDERED_AT_ONCE`` are put in order by one window per group, so a
task orders that many distinct values at most. Where they may be larger (a window of a year, no
window at all) the middle is found by refinement. Values are counted per bucket of
``2 ** BUCKET_BITS`` values, wherever a group's buckets lie. A group's bucket counts tell which
bucket holds its middle and how far inside; only those one or two buckets are put in order. So no
task orders more than one bucket, and a group of any size is spread over tasks by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values per group that one task orders (seconds: seven weeks).
ORDERED_AT_ONCE = 1 << 22
#: A bucket is about nine hours of seconds; a year has under a thousand buckets.
BUCKET_BITS = 15


def with_medians(
    counts: DataFrame,
    group: Sequence[str],
    value: str,
    n: str,
    sums: Sequence[str],
    below: int | None = None,
) -> DataFrame:
    """One row per group: the sums of the columns ``sums``, and ``median``, the median of
    ``value`` (a long) where each occurs ``n`` times.

    ``below`` bounds the values (0 up to it), if a bound is known. NULL values count in the sums
    only; a group without values has a NULL median. Groups may have NULL keys.
    """
    if below is not None and below <= ORDERED_AT_ONCE:
        return _ordered(counts, list(group), value, n, list(sums))
    return _refined(counts, list(group), value, n, list(sums))


def _ordered(counts: DataFrame, group: list[str], value: str, n: str, sums: list[str]) -> DataFrame:
    whole = Window.partitionBy(*group)
    running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    holds = f"({{rank}} <= upto AND {{rank}} > upto - {n})".format
    lower, upper = holds(rank="(total + 1) div 2"), holds(rank="total div 2 + 1")
    weight = F.expr(f"CASE WHEN {value} IS NULL THEN 0L ELSE {n} END")
    marked = counts.withColumns(
        {"upto": F.sum(weight).over(running), "total": F.sum(weight).over(whole)}
    ).withColumn("at_median", F.expr(f"CASE WHEN {lower} OR {upper} THEN {value} END"))
    return marked.groupBy(*group).agg(
        *[F.sum(s).alias(s) for s in sums], F.avg("at_median").alias("median")
    )


def _middle(total: str, listed: str, key: str, weight: str) -> str:
    """SQL: where the one or two middle ranks of ``total`` fall in the ordered array ``listed`` of
    (key, weight): ``lower`` and ``upper`` keys with the ranks left inside them."""
    none = f"named_struct('key', CAST(NULL AS BIGINT), 'rank', 0L)"
    start = f"named_struct('seen', 0L, 'lower', {none}, 'upper', {none})"

    def found(name: str, rank: str) -> str:
        here = f"a.seen < {rank} AND a.seen + x.{weight} >= {rank}"
        return f"IF({here}, named_struct('key', x.{key}, 'rank', {rank} - a.seen), a.{name})"

    step = (
        f"named_struct('seen', a.seen + x.{weight},"
        f" 'lower', {found('lower', f'(({total} + 1) div 2)')},"
        f" 'upper', {found('upper', f'({total} div 2 + 1)')})"
    )
    return f"aggregate({listed}, {start}, (a, x) -> {step})"


def _at_rank(listed: str, rank: str) -> str:
    """SQL: the value at ``rank`` (from 1) of the ordered array ``listed`` of (value, n)."""
    start = "named_struct('seen', 0L, 'value', CAST(NULL AS BIGINT))"
    here = f"a.seen < {rank} AND a.seen + x.n >= {rank}"
    step = f"named_struct('seen', a.seen + x.n, 'value', IF({here}, x.value, a.value))"
    return f"aggregate({listed}, {start}, (a, x) -> {step}).value"


def _refined(counts: DataFrame, group: list[str], value: str, n: str, sums: list[str]) -> DataFrame:
    entry = f"CASE WHEN {value} IS NOT NULL AND {n} > 0 THEN struct({value} AS value, {n} AS n) END"
    buckets = counts.groupBy(*group, F.expr(f"shiftright({value}, {BUCKET_BITS})").alias("bucket")).agg(
        *[F.sum(s).alias(s) for s in sums], F.expr(f"collect_list({entry})").alias("_values")
    )
    in_bucket = "aggregate(_values, 0L, (a, x) -> a + x.n)"
    listed = f"collect_list(CASE WHEN size(_values) > 0 THEN struct(bucket, {in_bucket} AS n) END)"
    totals = buckets.groupBy(*group).agg(
        *[F.sum(s).alias(s) for s in sums],
        F.expr(f"array_sort({listed})").alias("_buckets"),
    ).withColumn("_total", F.expr("aggregate(_buckets, 0L, (a, x) -> a + x.n)"))
    middle = totals.select(
        *[F.col(c).alias(f"_{c}") for c in group],
        *sums,
        F.expr(_middle("_total", "_buckets", "bucket", "n")).alias("_at"),
    )
    # two rows per group: the ranks wanted, each with its bucket
    wanted = middle.select(
        *[f"_{c}" for c in group], *sums, F.expr("explode(array(_at.lower, _at.upper)) AS _want")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    same.append(F.col("bucket") == F.col("_want.key"))
    # Both sides read every column of ``buckets``, so that one exchange serves both.
    sides = buckets.withColumnsRenamed({s: f"_bucket_{s}" for s in sums})
    found = wanted.join(sides, reduce(lambda a, b: a & b, same), "left")
    picked = F.expr(_at_rank("array_sort(_values)", "_want.rank"))
    return (
        found.select(
            *[F.col(f"_{c}").alias(c) for c in group],
            *[F.coalesce(s, f"_bucket_{s}").alias(s) for s in sums],
            picked.alias("_picked"),
        )
        .groupBy(*group)
        .agg(*[F.max(s).alias(s) for s in sums], F.avg("_picked").alias("median"))
    )
