"""Exact medians: both ways against the statistics module, with buckets of a few values."""

from __future__ import annotations

import random
from collections import Counter
from statistics import median

import pytest
from stepwell.plans import medians

SCHEMA = "g string, value long, n long, other long"


def rows_of(groups):
    return [(g, v, n, 10 * n) for g, values in groups.items() for v, n in Counter(values).items()]


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(5)
    found = {f"g{i}": [rng.randrange(0, 10 ** (i % 5 + 1)) for _ in range(rng.randrange(1, 60))] for i in range(40)}
    found |= {"one": [7], "two": [1, 2], "same": [5] * 9, "none": [None] * 3, None: [3, None, 9], "zero": [0, 0]}
    found["far apart"] = [0] * 10 + [10**9] * 10
    return found


@pytest.mark.parametrize("below", [None, 1 << 62, 10], ids=["unknown", "wide", "ordered"])
@pytest.mark.parametrize("bits", [0, 2, 15])
def test_medians(spark, groups, monkeypatch, below, bits):
    monkeypatch.setattr(medians, "BUCKET_BITS", bits)
    table = spark.createDataFrame(rows_of(groups), SCHEMA).repartition(4)
    got = medians.with_medians(table, ["g"], "value", "n", ["n", "other"], below=below).collect()
    expected = {}
    for g, values in groups.items():
        known = [v for v in values if v is not None]
        expected[g] = (len(values), 10 * len(values), median(known) if known else None)
    assert {r.g: (r.n, r.other, r["median"]) for r in got} == expected


def test_no_group(spark, groups):
    table = spark.createDataFrame(rows_of({"a": [1, 2, 2, 9]}), SCHEMA)
    for below in (None, 10):
        assert [tuple(r) for r in medians.with_medians(table, [], "value", "n", ["n"], below).collect()] == [(4, 2.0)]
    empty = table.limit(0)
    assert medians.with_medians(empty, ["g"], "value", "n", ["n"]).count() == 0
