"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of units: words, and of unbroken stretches beyond ``UNIT_CHARS`` characters
(text of scripts without spaces, encoded data) the characters. So no unit depends on where a stretch
begins. Of all
runs of ``k`` units, a closed syncmer is one whose smallest run of ``s`` units (by hash) is its
first or its last. That depends on nothing outside the run, so an edit changes only the runs that
overlap it, and the anchors of unchanged passages stay the same in any context. The anchors, with
their positions, are the fingerprint.

Defined cases: a null text counts as empty; a text without units has no anchors; a text with
units but without a syncmer (it has few units) has its whole sequence as one anchor. So equal texts
have equal fingerprints. Likeness is Dice's over distinct anchors, 1.0 for two empty fingerprints.
Repeated rows and ids give a row each. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

UNIT_CHARS = 24
K, S = 5, 2


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?<!\S)\S{{1,{UNIT_CHARS}}}+(?!\S)|\S"), F.lit(0))


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with array ``out`` of ``(position, hash)``; ``text`` must not be null."""
    if not 0 < s < k:
        raise ValueError("s must lie between 1 and k - 1")
    span = k - s
    shifted = [F.expr(f"slice(_u, {i + 1}, size(_u))") for i in range(s)]
    inner = shifted[0]
    if s == 1:
        inner = F.transform("_u", lambda x: F.xxhash64(x))
    elif s == 2:
        inner = F.zip_with(shifted[0], shifted[1], lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    else:
        inner = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("_u") - s + 1, F.lit(1))),
            lambda i: F.xxhash64(F.slice("_u", i, s)),
        )
    runs = F.size("_u") - k + 1
    edge = F.filter(
        F.sequence(F.lit(1), F.greatest(runs, F.lit(1))),
        lambda i: (runs >= 1)
        & (
            F.array_min(F.slice("_h", i, span + 1))
            >= F.least(F.get("_h", i - 1), F.get("_h", i - 1 + span))
        ),
    )
    anchor = F.transform(
        "_e",
        lambda i: F.struct(i.alias("position"), F.xxhash64(F.slice("_u", i, k)).alias("hash")),
    )
    whole = F.array(F.struct(F.lit(1).alias("position"), F.xxhash64("_u").alias("hash")))
    return (
        df.withColumn("_u", units(F.col(text))).withColumn("_h", inner).withColumn("_e", edge)
        .withColumn(
            out,
            F.when(F.size("_e") > 0, anchor).when(F.size("_u") > 0, whole)
            .otherwise(F.expr("array() :: array<struct<position:int,hash:bigint>>")),
        )
        .drop("_u", "_h", "_e")
    )


def as_string(hashes: Column) -> Column:
    """A fingerprint as text: the anchors' hashes in order, 16 hex digits each."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of hashes, each hash counting once."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / sizes)


def aligned(a: Column, b: Column) -> Column:
    """Anchors of ``a`` that also occur in ``b``, with both positions (the first in ``b``): what a
    positional match of two documents starts from."""
    return F.filter(
        F.transform(
            a,
            lambda x: F.struct(
                x["position"].alias("left"),
                F.get(F.filter(b, lambda y: y["hash"] == x["hash"]), F.lit(0))["position"].alias("right"),
            ),
        ),
        lambda x: x["right"].isNotNull(),
    )


#: Ranges of ids per shuffle partition, so that partitions even out.
RANGES_PER_PARTITION = 8


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` dealt to ranges of ids, with ``range`` and ``guest``.

    The ranges' bounds are quantiles of the ids. The first row of each following range, in
    descending order, is dealt to the range before as well, as a guest that only serves as
    the last row's successor; there is one such row per range (and repeats of its id).
    """
    spark = docs.sparkSession
    ranges = max(2, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", shares, 0.25 / ranges)})
    docs = docs.withColumn("_range", _range_of(bounds))
    falling = Window.orderBy(F.desc("_range"))  # over one row per range
    rising = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = docs.groupBy("_range").agg(F.max("doc_id").alias("_top")).select(
        F.col("_range").alias("_of"),
        "_top",
        F.coalesce(F.lag("_range").over(falling), F.first("_range").over(rising)).alias("_before"),
    )
    is_head = (F.col("_range") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_top"))
    at_home = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    away = F.struct(F.col("_before").alias("range"), F.lit(1).alias("guest"))
    places = F.when(F.col("_of").isNotNull(), F.array(at_home, away)).otherwise(F.array(at_home))
    dealt = docs.join(F.broadcast(heads), is_head, "left").withColumn("_as", F.explode(places))
    return dealt.select(
        *[c for c in docs.columns if c != "_range"], "_as.range", "_as.guest"
    ).repartition("range")


def with_next(dealt: DataFrame, carried: list[str]) -> DataFrame:
    """The rows of :func:`in_ranges` with ``next_<c>`` for each carried column: that of the next row
    in descending order of (doc_id, text), nulls last; after the last row comes the first."""
    row = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    return (
        dealt.select("*", *[F.lead(c).over(row).alias(f"next_{c}") for c in carried])
        .filter("guest = 0").drop("range", "guest")
    )


def _range_of(bounds: list[int]) -> Column:
    """Number of bounds at most doc_id, -1 for null: a search in two steps of square-root length."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    firsts = F.lit(bounds[::step])
    rest = F.array(*[F.lit(bounds[i : i + step]) for i in range(0, len(bounds), step)])
    block = F.size(F.filter(firsts, lambda x: x <= F.col("doc_id")))
    inside = F.size(F.filter(F.get(rest, block - 1), lambda x: x <= F.col("doc_id")))
    return (
        F.when(F.col("doc_id").isNull(), -1).when(block == 0, 0)
        .otherwise((block - 1) * step + inside)
    )


def compare_with_edits(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edit replaces the last ``n_chars // 3`` characters by the first as many of the next
    document. ``near_edited`` and ``near_next`` compare the text's fingerprint with that of the
    edited text and of the next document. Texts are shuffled once; fingerprints are computed after.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own = with_anchors(in_ranges(rows), "text", "_a", k, s).select(
        "range", "guest", "doc_id", "text", F.col("_a.hash").alias("own")
    )
    linked = with_next(own, ["text", "own"]).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")),
        F.substring("next_text", F.lit(1), cut),
    )
    edits = linked.withColumn("edited", edited).drop("text", "next_text")
    both = with_anchors(edits, "edited", "_b", k, s).withColumn("other", F.col("_b.hash"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
