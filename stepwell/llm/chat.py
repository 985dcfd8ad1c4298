"""Chat formatting in budgeted windows.

Every turn costs tokens; prefix sums of them place the turns of a conversation. A window's own
turns are the ones that lie inside one stretch of ``budget`` minus the system turn and the
history (or half of what the system turn leaves, if that is more). A turn that crosses the end of a
stretch is a window of its own. Each window starts with the conversation's system turn and repeats
the last turns before its own that fit in ``history`` tokens and in what system turn and own turns
leave of the budget. So windows are aligned to turns, follow from the prefix sums alone, and exceed
the budget only where a single turn with the system turn does; such a window repeats nothing. Loss falls on the assistant texts of a window's own turns only:
repeated ones are masked, so every assistant text is a target once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts, a backslash is put
into anything that could read as the start of a control string (``<``, any number of backslashes,
``|``), which is undone by taking one backslash out; in roles, backslashes and line ends are escaped.

Prefix sums are taken within blocks of turns first and across blocks then, and windows are grouped
on their own, so a conversation with very many turns is spread over tasks.

Defined cases: a null text or role counts as empty; turns are ordered by (turn, role, text), nulls
last, repeated rows stay as turns of their own; a null conversation id is a conversation; only a
first turn with role "system" is retained; a conversation of a system turn alone is one window
without targets. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a turn besides its text: the marks, the role and the line ends.
TURN_TOKENS = 5
TURNS_PER_BLOCK = 1024
WINDOWS_PER_PART = 1024


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    plain = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))
    return plain


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text of ``(role, text, is_target)`` turns, and the spans under the loss."""
    parts, spans, at = [], [], 0
    for role, text, target in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if target:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def turn_tokens(text: Column) -> Column:
    """Words and marks of a text, plus what the template adds."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + TURN_TOKENS


def placed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``ordinal`` and ``before``: number and tokens of the turns before it in its
    conversation (a leading system turn costs nothing there), and the system turn's tokens."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        text_or_empty("role").alias("role"),
        text_or_empty().alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    rows = rows.withColumn("block", F.expr(f"coalesce(turn div {TURNS_PER_BLOCK}, {1 << 62}L)"))
    order = [F.asc_nulls_last("turn"), F.col("role"), F.col("text")]
    totals = rows.groupBy("conv_id", "block").agg(
        F.sum("tokens").alias("block_tokens"),
        F.count("*").alias("block_turns"),
        F.min(F.struct(F.col("turn").isNull(), "turn", "role", "text")).alias("first"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("conv_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    starts = totals.select(
        F.col("conv_id").alias("_conv"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("block_turns").over(earlier), F.lit(0)).alias("turns_before"),
        F.first(
            F.when(F.col("first.role") == "system", turn_tokens(F.col("first.text"))).otherwise(0)
        ).over(everything).alias("system_tokens"),
    )
    row = Window.partitionBy("conv_id", "block").orderBy(*order)
    inside = rows.withColumn("ordinal", F.row_number().over(row) - 1).withColumn(
        "before", F.sum("tokens").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    found = inside.join(starts, same).withColumn("ordinal", F.col("ordinal") + F.col("turns_before"))
    is_system = (F.col("ordinal") == 0) & (F.col("role") == "system")
    return found.select(
        "conv_id", "ordinal", "role", "text", "system_tokens",
        is_system.alias("is_system"),
        F.when(is_system, 0).otherwise(F.col("tokens")).alias("tokens"),
        F.when(is_system, 0)
        .otherwise(F.col("before") + F.col("tokens_before") - F.col("system_tokens")).alias("before"),
    )


def windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """``conv_id, window, formatted, n_repeated, loss`` per window, in order of ``window``:
    the text, how many of its first turns are repeated, and the spans (start, end) under the loss."""
    if not 0 <= history < budget:
        raise ValueError("history must be smaller than the budget")
    left = F.lit(budget) - F.col("system_tokens")
    room = F.greatest(left - history, F.floor(left / 2), F.lit(1))
    at = placed(turns).withColumn("stretch", F.floor(F.col("before") / room))
    crosses = F.floor((F.col("before") + F.col("tokens") - 1) / room) > F.col("stretch")
    # the system turn stands in window 0, so the first turn after it does as well
    at = at.withColumn("window", F.col("stretch") * 2 + (crosses & (F.col("before") > 0)).cast("int"))
    own = at.select("conv_id", "window", "ordinal", "role", "text", F.lit(False).alias("repeated"))
    used = own
    if history:
        begun = (
            at.filter("not is_system").groupBy("conv_id", "window")
            .agg(
                F.min("before").alias("begin"),
                F.least(F.lit(history), F.lit(budget) - F.first("system_tokens") - F.sum("tokens")).alias("reach"),
            )
            .filter("reach > 0")
            .select(
                F.col("conv_id").alias("_conv"), F.col("window").alias("_window"), "begin", "reach",
                F.floor(F.col("begin") / history).alias("cell"),
            )
        )
        ends = F.col("before") + F.col("tokens")
        cells = F.array_distinct(F.array(F.floor(ends / history), F.floor((F.col("before") + history) / history)))
        again = (
            at.filter(~F.col("is_system") & (F.col("tokens") <= history))
            .select("conv_id", "ordinal", "role", "text", "before", ends.alias("ends"), F.explode(cells).alias("_cell"))
        )
        repeated = again.join(
            begun,
            again["conv_id"].eqNullSafe(begun["_conv"]) & (again["_cell"] == begun["cell"])
            & (begun["begin"] >= again["ends"]) & (begun["begin"] - begun["reach"] <= again["before"]),
        ).select("conv_id", F.col("_window").alias("window"), "ordinal", "role", "text", F.lit(True).alias("repeated"))
        used = own.unionByName(repeated)
    grouped = used.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "repeated", "role", "text"))).alias("turns")
    )
    system = (
        at.groupBy("conv_id").agg(
            F.max("window").alias("last"), F.max(F.when(F.col("is_system"), F.col("text"))).alias("system")
        )
        .filter("system is not null")
        .select(
            F.col("conv_id").alias("_conv"), "system",
            F.explode(F.expr(f"sequence(0L, last div {WINDOWS_PER_PART})")).alias("part"),
        )
    )
    whole = grouped.join(
        system,
        grouped["conv_id"].eqNullSafe(system["_conv"])
        & (F.expr(f"window div {WINDOWS_PER_PART}") == system["part"]) & (F.col("window") > 0),
        "left",
    ).select("conv_id", "window", "turns", "system")
    small_batches(turns.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            formatted, repeated, loss = [], [], []
            for row in rows:
                turn = [(t["role"], t["text"], not t["repeated"] and t["role"] == "assistant") for t in row["turns"]]
                head = [("system", row["system"], False)] if row["system"] is not None else []
                text, spans = format_turns(head + turn)
                formatted.append(text)
                repeated.append(len(head) + sum(t["repeated"] for t in row["turns"]))
                loss.append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("window"),
                    pa.array(formatted, pa.string()),
                    pa.array(repeated, pa.int32()),
                    pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["conv_id", "window", "formatted", "n_repeated", "loss"],
            )

    kind = turns.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(
        write,
        f"conv_id {kind}, window long, formatted string, n_repeated int, loss array<struct<start:long,end:long>>",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` per
    conversation, from the output of :func:`windows`.

    A digest of a whole conversation is sequential: its windows pass through one task in order, one
    at a time, and only the running digests are held.
    """
    rows = formatted.withColumn("_key", F.col("conv_id").cast("string"))
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "window")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = read  # no conversation yet
        turns = loss = None
        counts = [0, 0, 0]

        def done() -> pd.DataFrame:
            return pd.DataFrame(
                [(key, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])],
                columns=["_key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            out = []
            for name, text, repeated, spans in zip(
                batch["_key"], batch["formatted"], batch["n_repeated"], batch["loss"], strict=True
            ):
                if name != key:
                    if turns is not None:
                        out.append(done())
                    key, turns, loss, counts = name, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                own = parse_turns(text)[repeated:]
                for role, said in own:
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    under = unescape(text[span["start"] : span["end"]])
                    loss.update(under.encode("utf-8", "surrogatepass"))
                    counts[1] += len(under)
                counts[0] += len(own)
                counts[2] += len(text)
            if out:
                yield pd.concat(out)
        if turns is not None:
            yield done()

    small_batches(formatted.sparkSession)
    found = ordered.drop("conv_id").mapInPandas(
        read,
        "_key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
    kind = formatted.schema["conv_id"].dataType
    return found.withColumn("conv_id", F.col("_key").cast(kind)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )
