"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint takes the majority of each bit over the hashes of its word shingles. Two
fingerprints at most ``max_bits`` apart agree, in at least one of ``SEGMENTS`` equal segments, but
for ``max_bits // SEGMENTS`` bits. So every distinct fingerprint is stored in one table per
segment under that segment's value, and probes each table with every value in a small Hamming
ball around its own. Fingerprints that meet are verified over all 64 bits.

Only distinct fingerprints take part, so copies cost nothing here. A bucket never emits its
pairs: it emits a spanning forest of its verified links, found by a search that drops each
fingerprint from the rest once it is reached, so a dense bucket costs about its size and keeps
every connection. Buckets stream through a task in key order.

A segment value may be shared by very many distinct fingerprints, e.g. those of pages made from one
template. Buckets in reach of a value with over ``HOT_VALUE`` of them are split by the other segment:
two fingerprints equal in this segment agree in one half of the other but for one bit; if they
differ in one bit here, at most two are left, and they agree in one third of the other. So no link
is lost, and the rows of a bucket are bounded whatever the input.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links
like any other; with fewer words than a shingle, the whole sequence is the shingle. Repeated rows
and ids are kept as they are, one result row per input row; a null id never names a component
unless the component has no other. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import components, join_hot, small_batches, text_or_empty

SEGMENTS, BITS = 2, 32
SEED = 42
CHUNK = 1 << 15
HOT_VALUE = 4096


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: words between ASCII white space, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - words_per_shingle + 1)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, count, CHUNK):
        upto = min(count, at + CHUNK)
        hashes = np.fromiter(
            (digest(b" ".join(words[i : i + words_per_shingle]), SEED) for i in range(at, upto)),
            np.uint64,
            upto - at,
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)`` per row; ``fp`` holds the unsigned fingerprint as a long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("text_key"),
        simhash(text_or_empty()).alias("fp"),
    )


def _spanning_links(values: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a forest that spans each cluster of ``values`` under the full distance."""
    rest, found = values, []
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= max_bits
            if near.any():
                reached, rest = rest[near], rest[~near]
                found.append((np.full(reached.size, at), reached))
                queue.extend(reached)
    return found


def _links_of_batch(key: np.ndarray, fp: np.ndarray, member: np.ndarray, max_bits: int) -> pd.DataFrame:
    """Links inside the complete buckets of a batch sorted by key."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if key.size:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, key.size])
        useful = (np.add.reduceat(member, starts) > 0) & (sizes > 1)
        pairs = starts[useful & (sizes == 2)]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= max_bits
        out.append((fp[pairs[near]], fp[pairs[near] + 1]))
        wide = useful & (sizes > 2)
        for start, size in zip(starts[wide], sizes[wide], strict=True):
            out += _spanning_links(fp[start : start + size], max_bits)
    a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
    b = np.concatenate([x for _, x in out]) if out else np.empty(0, np.uint64)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _split(rows: DataFrame, max_bits: int) -> DataFrame:
    """``rows`` (key, fp, member) of hot buckets, keyed by parts of the other segment as well."""
    half = BITS // 2
    other = F.expr(f"shiftrightunsigned(fp, {BITS} * (1 - cast(shiftright(key, {BITS}) as int)))")

    def part(number: int, at: int, bits: int, flip: int, member: Column) -> Column:
        value = F.shiftright(other, at).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.lit(flip))
        return F.struct((value + ((number + 1) << half)).alias("part"), member.alias("member"))

    ball = [0, *(1 << j for j in range(half))] if max_bits >= 2 else [0]
    halves = [part(h, h * half, half, flip, F.lit(flip == 0)) for h in (0, 1) for flip in ball]
    thirds = [part(2 + i, 11 * i, min(11, BITS - 11 * i), 0, F.col("member")) for i in range(3)]
    parts = F.when(F.col("member"), F.array(*halves, *thirds)).otherwise(F.array(*thirds))
    return rows.select("key", "fp", F.explode(parts).alias("p")).select(
        (F.col("key") + F.col("p.part") * (1 << (BITS + 1))).alias("key"), "fp", "p.member"
    )


def links(distinct: DataFrame, max_bits: int = 3, hot_value: int = HOT_VALUE) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints ``fp`` within ``max_bits`` of each other."""
    if not 0 <= max_bits < 2 * SEGMENTS:
        raise ValueError(f"max_bits must lie between 0 and {2 * SEGMENTS - 1}")
    ball = [0, *(1 << j for j in range(BITS))] if max_bits >= SEGMENTS else [0]
    flips = F.array(*[F.lit(m).cast("long") for m in ball])
    segment = F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)])).alias("segment")
    value = F.expr(f"shiftrightunsigned(fp, segment * {BITS}) & {(1 << BITS) - 1}L")
    members = distinct.select("fp", segment).select(
        "fp", (value + F.col("segment").cast("long") * (1 << BITS)).alias("own")
    )
    probes = members.select("fp", "own", F.explode(flips).alias("flip")).select(
        F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "fp", (F.col("flip") == 0).alias("member")
    )
    hot = materialize(
        members.groupBy("own").count().filter(F.col("count") > hot_value)
        .select(F.explode(F.transform(flips, lambda x: F.col("own").bitwiseXOR(x))).alias("key")).distinct()
    )
    if not hot.isEmpty():
        crowded = _split(probes.join(hot, "key", "left_semi"), max_bits)
        probes = probes.join(hot, "key", "left_anti").unionByName(crowded)
    probes = probes.repartition("key").sortWithinPartitions("key")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the bucket not yet complete
        for batch in batches:
            key = batch["key"].to_numpy()
            fp = batch["fp"].to_numpy().view(np.uint64)
            member = batch["member"].to_numpy()
            if not key.size:
                continue
            last = int(np.searchsorted(key, key[-1]))
            if held and (last or held[0][0][-1] != key[-1]):
                held.append((key[:last], fp[:last], member[:last]))
                yield _links_of_batch(*map(np.concatenate, zip(*held, strict=True)), max_bits)
                held = []
            elif last:
                yield _links_of_batch(key[:last], fp[:last], member[:last], max_bits)
            held.append((key[last:], fp[last:], member[last:]))
        if held:
            yield _links_of_batch(*map(np.concatenate, zip(*held, strict=True)), max_bits)

    return probes.mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``(doc_id, text_key, fingerprint, component_id)`` per row of ``docs``; ``component_id`` is
    the smallest id reachable by links of at most ``max_bits`` differing bits."""
    return _grouped(docs, words_per_shingle, max_bits).drop("root")


def _grouped(docs: DataFrame, words_per_shingle: int, max_bits: int) -> DataFrame:
    """Rows of :func:`near_duplicates` with ``root``, the smallest fingerprint of the component."""
    rows = materialize(fingerprints(docs, words_per_shingle))
    distinct = materialize(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    )
    roots = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    joined = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(joined.join(least, "root").select("fp", "component_id", "root", "copies"))
    return join_hot(rows, labels, "fp", "copies").select(
        "doc_id",
        "text_key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
    )


def deduplicated(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id (a null id
    last, ties by the text's hash), once even if the row is repeated. Rows without ids form components
like any others."""
    found = _grouped(docs, words_per_shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    kept = found.groupBy("root").agg(F.min(order).alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col("doc_id").cast("long").alias("_own"),
        F.xxhash64(text_or_empty()).alias("_hash"),
    )
    same = keyed["_own"].eqNullSafe(kept["_id"]) & (keyed["_hash"] == kept["_key"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_own", "_hash"]).select("_row.*")
