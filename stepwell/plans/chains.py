"""Step chains of users with too many events for one task, in one pass whatever the number of steps.

A heavy user's events are cut by time into slices; equal times stay together, so whatever happens in
a later slice happens strictly later. A slice's summary tells, for every step, how a chain that still
waits for that step when the slice begins goes on inside it: the times at which it and the steps
after it are reached. Summaries compose in the order of the slices, and there are at most
``MAX_SLICES`` short ones per user. So events cross the network once, to their slice; each slice is
ordered once; and one small row per slice is folded into the user's times.

Inside a slice, read from the latest event back, the chain of an event of step i is its time and the
chain of the earliest event of step i + 1 seen so far: one window per step over the same order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros
from .scratch import checkpointed

#: Slices per user; a user with more than this many times a task's rows has longer ones.
MAX_SLICES = 1024
#: Heavy users whose slice bounds are broadcast at most.
MAX_BROADCAST = 100_000
_MICROS = micros("event_ts")
_NONE = "CAST(array() AS array<{kind}>)"  # an empty chain


def slice_bounds(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``_user_id`` and ``_bounds``: the last times of a user's slices but the latest, from a
    sketch of the user's times. Kept, since a sketch may come out differently when made again."""
    users = heavy.select(
        F.col("user_id").alias("_user_id"),
        F.least(F.col("slices"), F.lit(MAX_SLICES)).cast("int").alias("_slices"),
    )
    times = rows.join(F.broadcast(users), F.col("user_id") == F.col("_user_id"))
    sketches = times.groupBy("_user_id", "_slices").agg(
        F.expr(f"kll_sketch_agg_bigint({_MICROS})").alias("_times")
    )
    # the ranks must be constant: all those that any number of slices takes its bounds from
    shares = ", ".join(f"{i / MAX_SLICES}D" for i in range(1, MAX_SLICES))
    cuts = f"kll_sketch_get_quantile_bigint(_times, array({shares}))"
    last = f"CAST({{}} * _slices / {MAX_SLICES} AS INT)".format  # of the slice's ranks
    taken = f"filter({cuts}, (x, j) -> {last('(j + 1)')} > {last('j')})"
    bounds = f"IF(_slices < 2, array(), array_distinct({taken}))"
    return checkpointed(sketches.select("_user_id", F.expr(bounds).alias("_bounds")))


def times_by_slices(
    rows: DataFrame,
    entity: Sequence[str],
    count: int,
    heavy: DataFrame,
    carried: dict[str, Column],
) -> DataFrame:
    """``entity``, ``t0`` .. and the aggregates ``carried`` (a bit_or each) of the heavy users.

    ``rows`` holds user_id, event_ts, step and the other columns of ``entity``; ``heavy`` holds
    user_id and slices.
    """
    bounds = slice_bounds(rows, heavy)
    known = F.broadcast(bounds) if bounds.count() <= MAX_BROADCAST else bounds
    entity, kind = list(entity), rows.schema["event_ts"].dataType.simpleString()
    none = _NONE.format(kind=kind)
    placed = (
        rows.join(known, F.col("user_id") == F.col("_user_id"))
        .select(*rows.columns, F.expr(_MICROS).alias("_at"), "_bounds")
        .withColumn("_slice", F.expr("size(filter(_bounds, b -> b < _at))"))
        .drop("_bounds")
        .repartition(*entity, "_slice")
        .withColumn("_tail", F.expr(none))
    )
    later = (
        Window.partitionBy(*entity, "_slice")
        .orderBy(F.col("_at").desc())
        .rangeBetween(Window.unboundedPreceding, -1)  # strictly later events
    )

    def earliest(step: int) -> Column:
        return F.expr(f"min(CASE WHEN step = {step} THEN struct(event_ts, _tail) END)")

    for step in range(count - 1, 0, -1):
        chain = f"IF(_next IS NULL, {none}, concat(array(_next.event_ts), _next._tail))"
        tail = F.expr(f"CASE WHEN step = {step - 1} THEN {chain} ELSE _tail END")
        placed = placed.withColumn("_next", earliest(step).over(later)).withColumn("_tail", tail).drop("_next")

    def chain_from(step: int) -> str:
        return f"IF(_from{step} IS NULL, {none}, concat(array(_from{step}.event_ts), _from{step}._tail))"

    summaries = placed.groupBy(*entity, "_slice").agg(
        *[earliest(s).alias(f"_from{s}") for s in range(count)],
        *[aggregate.alias(name) for name, aggregate in carried.items()],
    )
    chains = ", ".join(chain_from(s) for s in range(count))
    one = F.expr(f"struct(_slice, array({chains}) AS chains)")
    users = summaries.groupBy(*entity).agg(
        F.array_sort(F.collect_list(one)).alias("_slices"),
        *[F.expr(f"bit_or({name})").alias(name) for name in carried],
    )
    # a chain that has n times waits for step n
    onward = f"coalesce(try_element_at(x.chains, size(reached) + 1), {none})"
    reached = F.expr(f"aggregate(_slices, {none}, (reached, x) -> concat(reached, {onward}))")
    return users.withColumn("_reached", reached).select(
        *entity, *[F.expr(f"get(_reached, {i}) AS t{i}") for i in range(count)], *carried
    )
