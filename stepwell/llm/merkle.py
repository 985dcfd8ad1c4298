"""Merkle manifest of a dataset: one digest per row, one tree per source, one tree over the sources.

Nodes of a tree are numbered from 0. In every run of ``arity`` consecutive nodes each knows its
siblings' numbers (its own XOR 1 in a binary tree, else by offsets of its slot in the run), so a
level is its own equijoin on those numbers; the rows of slot 0 then hold a whole run and emit its
parent. Each level keeps what stood left and right of a node. Going down again, a node's path to the
root is its own siblings before its parent's path, one join per level, whose rows shrink ``arity``
times per level upwards. Folding a leaf along its path gives the root again, or another one if the
row was changed.

Numbers come from one range exchange in the order wanted: rows are counted per partition, and an
offset per partition is added to the place within it. So no task holds a whole source, whatever its
share of the rows; rows that are equal in every key are told apart by their place in the input.

Defined cases: a null in a column is hashed as ``-``; null sources form one source, which comes
first; null ids come first in their source; rows with equal ids follow their digests, and equal rows
are leaves of their own. A row without id is never tampered with. An empty table has no leaf and an
empty result. Texts are hashed whole. Columns besides the five hashed are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a table of offsets (one per partition and group) that are broadcast at most.
MAX_BROADCAST = 100_000
NOTHING = "X''"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its length in bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    """SHA-256 of the texts one after another, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*texts), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(text: Column = None) -> Column:
    """Digest of a row of documents, with ``text`` in place of its own if given."""
    values = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return digest(*[field(v) for v in values])


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, their place within ``group`` by ``order`` (nulls first, equal rows in
    any order), and ``n``, the rows of the group."""
    keys = [*group, *order]
    told_apart = materialize(rows.withColumn("_input", F.monotonically_increasing_id()))
    placed = materialize(
        told_apart.repartitionByRange(*keys, "_input")
        .sortWithinPartitions(*keys, "_input")
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
        .drop("_input")
    )
    whole = ", ".join(f"`{c}`" for c in group) or "0"
    parts = placed.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    # one row per partition that a group has a part in
    parts = materialize(
        parts.withColumns(
            {
                "_before": F.expr(f"sum(_rows) OVER (PARTITION BY {whole} ORDER BY _part) - _rows"),
                "n": F.expr(f"sum(_rows) OVER (PARTITION BY {whole})"),
            }
        ).drop("_rows")
    )
    known = parts.select(*[F.col(c).alias(f"_of_{c}") for c in [*group, "_part"]], "_first", "_before", "n")
    if parts.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, "_part"]])
    idx = F.col("_before") + F.col("_row") - F.col("_first")
    return placed.join(known, same).select(*rows.columns, idx.alias("idx"), "n")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, idx, digest and others) with ``left`` and ``right``: the digests of its
    run's other nodes before and after it, in order."""
    slot = F.col("idx") % arity
    if arity == 2:
        wanted = [F.col("idx").bitwiseXOR(F.lit(1))]
    else:
        wanted = [F.col("idx") - slot + (slot + k) % arity for k in range(1, arity)]
    found = nodes
    for k, number in enumerate(wanted, 1):
        other = nodes.select(
            F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_sibling{k}")
        )
        at = (F.col("tree") == F.col("_tree")) & (number == F.col("_idx"))
        found = found.join(other, at, "left").drop("_tree", "_idx")
    # the k-th sibling lies k slots on, or from the run's start where that passes its end
    later = [F.when(slot + k < arity, F.col(f"_sibling{k}")) for k in range(1, arity)]
    earlier = [F.when(slot + k >= arity, F.col(f"_sibling{k}")) for k in range(1, arity)]
    joined = lambda parts: F.concat(*[F.coalesce(p, F.expr(NOTHING)) for p in parts])
    return found.select(*nodes.columns, joined(earlier).alias("left"), joined(later).alias("right"))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level: the rows of slot 0 hold their run's digests."""
    return level.filter((F.col("n") > 1) & (F.col("idx") % arity == 0)).select(
        "tree",
        F.expr(f"idx div {arity}").alias("idx"),
        F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        digest(as_hex("digest"), as_hex("right")).alias("digest"),
    )


def grow(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The levels of all trees from the leaves (tree, idx, n, digest and others) up, each written.

    A node that is alone in its level is its tree's root; the tree ends there.
    """
    most = leaves.agg(F.max("n")).head()[0] or 0
    levels = []
    nodes = leaves
    while True:
        levels.append(materialize(with_siblings(nodes, arity)))
        if most <= 1:
            return levels
        nodes = parents(levels[-1], arity)
        most = -(-most // arity)


STEP = "struct<left:binary,right:binary>"
#: Levels whose joins on the way down run as one query.
CHAINED = 3


def with_paths(levels: list[DataFrame], above: DataFrame | None, arity: int) -> DataFrame:
    """The leaves with ``top``, the digest of their tree's root, and ``path``: the siblings left and
    right at each level from the leaf up. ``above`` (tree, path) goes on from the trees' roots."""
    below_root = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth]
        roots = nodes.filter("n = 1")
        rest = F.expr(f"CAST(array() AS array<{STEP}>)")
        if above is not None:
            of_tree = above.select(F.col("tree").alias("_tree"), F.col("path").alias("_path"))
            roots = roots.join(of_tree, F.col("tree") == F.col("_tree"))
            rest = F.col("_path")
        found = roots.select(*nodes.columns, F.col("digest").alias("top"), rest.alias("path"))
        if below_root is not None:
            over = below_root.select(
                F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), "top", F.col("path").alias("_path")
            )
            own = F.array(F.struct("left", "right")).cast(f"array<{STEP}>")
            inner = nodes.filter("n > 1").join(
                over, (F.col("tree") == F.col("_tree")) & (F.expr(f"idx div {arity}") == F.col("_idx"))
            )
            found = found.unionByName(inner.select(*nodes.columns, "top", F.concat(own, "_path").alias("path")))
        below_root = found
        if depth:
            below_root = found.select("tree", "idx", "top", "path")
            if depth % CHAINED == 0:
                below_root = materialize(below_root)
    return below_root


def folded(leaf: str, path: str) -> Column:
    """The root that ``leaf`` (32 bytes) gives with the siblings of ``path``."""
    return F.aggregate(
        path,
        F.col(leaf),
        lambda node, step: digest(as_hex(step["left"]), as_hex(node), as_hex(step["right"])),
    )


def proof(path: str) -> Column:
    """Digest of the siblings of ``path``, from the leaf up and left to right."""
    siblings = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(as_hex(F.aggregate(siblings, F.expr(NOTHING), lambda a, b: F.concat(a, b))), 256)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


def without_newlines(text: Column) -> Column:
    return F.translate(text, "\n", "")


def manifest(docs: DataFrame, arity: int = ARITY, tampered_text: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, path, seen_leaf`` per row; digests are 32 bytes.

    ``path`` runs from the leaf over its source's root to the dataset's. ``seen_leaf`` is the digest
    with ``tampered_text`` in place of the text, null where that is null.
    """
    seen = F.lit(None).cast("binary")
    if tampered_text is not None:
        seen = F.when(tampered_text.isNotNull(), leaf_digest(tampered_text))
    leaves = docs.select("doc_id", "source", leaf_digest().alias("digest"), seen.alias("seen_leaf"))
    placed = numbered(leaves, ["source"], ["doc_id", "digest"])
    sources = numbered(placed.select("source").distinct(), [], ["source"])
    sources = materialize(sources.select("source", F.col("idx").alias("tree"), F.col("n").alias("trees")))
    known = sources.select(F.col("source").alias("_source"), "tree")
    if sources.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    inner = grow(placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), arity)

    subroots = reduce(DataFrame.unionByName, [x.filter("n = 1").select("tree", "digest") for x in inner])
    outer = grow(
        subroots.join(sources.select("tree", "trees"), "tree").select(
            F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest"
        ),
        arity,
    )
    top = with_paths(outer, None, arity)
    top = materialize(top.select(F.col("idx").alias("tree"), F.col("top").alias("root"), "path"))
    root = top.select("root").limit(1).collect()  # one digest
    found = with_paths(inner, top, arity)
    return found.select(
        "doc_id",
        "source",
        F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"),
        F.lit(bytes(root[0].root) if root else None).cast("binary").alias("root"),
        "path",
        "seen_leaf",
    )


def verified(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row, where half of
    the rows are read back without their line ends."""
    seen = F.when(is_tampered(F.col("doc_id")), without_newlines(F.col("text")))
    rows = manifest(docs, arity, seen).withColumn("_seen", F.coalesce("seen_leaf", "leaf"))
    found = rows.withColumn("_folded", folded("_seen", "path"))
    return found.select(
        "doc_id",
        *[as_hex(c).alias(c) for c in ("leaf", "subroot", "root")],
        proof("path").alias("proof_sha256"),
        as_hex("_folded").alias("folded_root"),
        (F.col("_folded") == F.col("root")).alias("verified"),
    )


def verified_sql(arity: int = ARITY) -> str:
    """:func:`verified` with the default arguments, for DuckDB over ``documents``."""

    def value(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(value, FIELDS[:-1]), value(text)]) + ")"

    # the table-free form of CRC-32: eight shifts per byte; only the last bit is needed
    bits = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))"
    byte = f"list_transform([xor(s, ascii(ch))], lambda c: {bits})[1]"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
        f" lambda ch: CAST(ascii(ch) AS BIGINT))), lambda s, ch: {byte.replace('ascii(ch)', 'ch')}), 4294967295)"
    )
    return f"""WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND ({crc}) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")}
                ELSE {leaf('text')} END AS seen
    FROM documents),
leaves AS (
    SELECT r, source, leaf AS d, count(*) OVER (PARTITION BY source) AS n,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
    FROM rows),
inner_tree AS (
    SELECT source, 0 AS level, i, n, d FROM leaves
    UNION ALL
    SELECT source, level + 1, i // {arity}, (n + {arity - 1}) // {arity}, sha256(string_agg(d, '' ORDER BY i))
    FROM inner_tree WHERE n > 1 GROUP BY source, level, i // {arity}, n),
subroots AS (
    SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
    FROM inner_tree WHERE n = 1),
outer_tree AS (
    SELECT 0 AS level, i, n, d FROM subroots
    UNION ALL
    SELECT level + 1, i // {arity}, (n + {arity - 1}) // {arity}, sha256(string_agg(d, '' ORDER BY i))
    FROM outer_tree WHERE n > 1 GROUP BY level, i // {arity}, n),
inner_runs AS (
    SELECT source, level, i // {arity} AS run, list(d ORDER BY i) AS ds FROM inner_tree WHERE n > 1
    GROUP BY source, level, i // {arity}),
outer_runs AS (
    SELECT level, i // {arity} AS run, list(d ORDER BY i) AS ds FROM outer_tree WHERE n > 1
    GROUP BY level, i // {arity}),
inner_walk AS (
    SELECT r, leaves.source, 0 AS level, i, seen AS acc, '' AS proof FROM leaves JOIN rows USING (r)
    UNION ALL
    SELECT r, w.source, w.level + 1, i // {arity},
           sha256(array_to_string(ds[:i % {arity}], '') || acc || array_to_string(ds[i % {arity} + 2:], '')),
           proof || array_to_string(ds[:i % {arity}], '') || array_to_string(ds[i % {arity} + 2:], '')
    FROM inner_walk w JOIN inner_runs g
      ON w.source IS NOT DISTINCT FROM g.source AND w.level = g.level AND i // {arity} = run),
outer_walk AS (
    SELECT r, 0 AS level, s.i, acc, proof
    FROM (SELECT r, arg_max(source, level) AS source, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof
          FROM inner_walk GROUP BY r) w
    JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source
    UNION ALL
    SELECT r, w.level + 1, i // {arity},
           sha256(array_to_string(ds[:i % {arity}], '') || acc || array_to_string(ds[i % {arity} + 2:], '')),
           proof || array_to_string(ds[:i % {arity}], '') || array_to_string(ds[i % {arity} + 2:], '')
    FROM outer_walk w JOIN outer_runs g ON w.level = g.level AND i // {arity} = run),
ends AS (SELECT r, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM outer_walk GROUP BY r)
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root,
       acc = t.d AS verified
FROM rows JOIN ends USING (r) JOIN subroots s ON rows.source IS NOT DISTINCT FROM s.source
CROSS JOIN (SELECT d FROM outer_tree WHERE n = 1) t"""
