from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from stepwell.llm import simhash

from .conftest import ODD


def plain(text: str) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows: list[tuple[int, int]], max_bits: int = 3) -> list[int | None]:
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= max_bits and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return [least[g] for g in group]


def key(row):
    return tuple((v is None, v or 0) for v in row)


def check(spark, docs, rows):
    found = simhash.near_duplicates(docs(*rows)).collect()
    prints = [(i, plain(t)) for i, t in rows]
    expected = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, brute(prints), strict=True)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in found]
    assert sorted(got, key=lambda r: (key(r[::2]), r[1])) == sorted(expected, key=lambda r: (key(r[::2]), r[1]))


def test_odd_rows_and_an_empty_table(spark, docs):
    check(spark, docs, ODD)
    assert simhash.near_duplicates(docs(*ODD).limit(0)).count() == 0
    assert simhash.deduplicated(docs(*ODD).limit(0)).count() == 0


def test_near_copies_equal_brute_force(spark, docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 151 + group * 1000, " ".join(copy)))
    check(spark, docs, rows)


def test_forest_keeps_every_connection():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 62, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(300)]
    values = np.unique(np.array([int(centre) ^ f for f in flips], np.uint64))
    links = simhash._spanning_links(values, 3)
    pairs = [(int(a), int(b)) for x, y in links for a, b in zip(x, y, strict=True)]
    assert len(pairs) == len(values) - len(set(brute([(i, int(v)) for i, v in enumerate(values)])))
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)


def test_one_row_of_each_group_stays(spark, docs):
    table = docs(*ODD)
    kept = simhash.deduplicated(table)
    assert kept.columns == table.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for _, i in ids].count(1) == 1 and (False, 2) in ids and (False, 3) not in ids


@pytest.mark.parametrize("first", [None, 5])
def test_near_copies_without_ids_leave_one_row(spark, docs, first):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    near = [*words[:-1], "other"]
    table = docs((first, " ".join(words)), (None, " ".join(near)), (None, "apart from those two"))
    fingerprints = [int(r.fingerprint, 16) for r in simhash.near_duplicates(table).collect()]
    bits = sorted((a ^ b).bit_count() for i, a in enumerate(fingerprints) for b in fingerprints[:i])
    assert bits[0] <= 3 < bits[1]
    kept = [r.doc_id for r in simhash.deduplicated(table).collect()]
    assert len(kept) == 2 and kept.count(None) == (2 if first is None else 1)


def test_a_bucket_across_batches(spark):
    values = [(1 << 40) + i for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [(r.a, r.b) for r in simhash.links(table).collect()]
    group = {v: v for v in values}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        group[root(a)] = root(b)
    assert len({root(v) for v in values}) == 1


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_split_buckets_keep_every_connection(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    values = {int(x) for x in rng.integers(0, 1 << 62, 200, dtype=np.int64)}
    for base in (77 << 32, 5, (1 << 62) + 9):  # many share a segment or nearly share it
        shift = 0 if base > 1 << 31 else 32
        near = [base ^ (int(x) << shift) for x in rng.integers(0, 1 << 31, 150, dtype=np.int64)]
        values.update(near)
        for v in near:
            flips = rng.choice(63, rng.integers(0, 4), replace=False)
            values.add(v ^ sum(1 << int(b) for b in flips))
    rows = [(v, v) for v in sorted(values)]
    table = spark.createDataFrame([(v,) for v, _ in rows], "fp long")
    expected = dict(zip([v for v, _ in rows], brute(rows, max_bits), strict=True))
    for hot_value in (3, simhash.HOT_VALUE):
        found = simhash.components(simhash.links(table, max_bits, hot_value)).collect()
        got = dict.fromkeys(expected) | {r.node: r.root for r in found}
        assert {v: v if r is None else r for v, r in got.items()} == expected
