from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from stepwell.llm import merkle

from .conftest import DOCS, ODD


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha(*map(field, (row[0], row[3], row[2], row[4], text)))


def walk(nodes, arity):
    """Root of a list of digests, and each one's (left, right) siblings by level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i in range(len(nodes)):
            run = i - i % arity
            for leaf_at in under[i]:
                paths[leaf_at].append((nodes[run:i], nodes[i + 1 : run + arity]))
        under = [sum(under[i : i + arity], []) for i in range(0, len(nodes), arity)]
        nodes = [sha(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(rows, arity):
    first = lambda v: (v is not None, v if v is not None else 0)
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_source[name], key=lambda r: (first(r[0]), leaf(r, r[1])))
        trees[name] = (own, *walk([leaf(r, r[1]) for r in own], arity))
    root, outer = walk([trees[n][1] for n in names], arity)
    out = []
    for at, name in enumerate(names):
        own, subroot, paths = trees[name]
        for row, path in zip(own, paths, strict=True):
            path = path + outer[at]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None
            now = leaf(row, row[1].replace("\n", "") if changed else row[1])
            for left, right in path:
                now = sha(*left, now, *right)
            siblings = "".join("".join(left + right) for left, right in path)
            out.append((row[0], leaf(row, row[1]), subroot, root, sha(siblings), now, now == root))
    return sorted(out, key=str)


def rows_of(texts, source_of):
    return [(i, t, "en" if n % 3 else None, source_of(n), len(t) if t else None, 7, "k", "f") for n, (i, t) in enumerate(texts)]


MIXED = [None, "\u00e9", "z", "hot", "hot"]


@pytest.mark.parametrize(
    "arity, source_of",
    [(2, lambda n: MIXED[n % 5]), (3, lambda n: f"s{n}"), (5, lambda n: MIXED[n % 5])],
)
def test_against_brute_force(spark, arity, source_of):
    texts = ODD + [(100 - i, f"line {i % 7}\nnext") for i in range(40)] + [(5, "tie\n"), (5, "tie\n"), (5, "other")]
    rows = rows_of(texts, source_of)
    table = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted((tuple(r) for r in merkle.verified(table, arity).collect()), key=str)
    assert got == brute(rows, arity)
    assert any(not r[-1] for r in got)


def test_one_row_and_none(spark):
    one = spark.createDataFrame(rows_of([(4, "a\nb")], lambda n: None), DOCS)
    got = [tuple(r) for r in merkle.verified(one).collect()]
    assert got == brute([tuple(r) for r in one.collect()], 3)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")
    assert merkle.verified(one.limit(0)).count() == 0


def test_path_gives_the_root_only_for_the_row(spark, docs):
    table = docs(*[(i, f"text {i}") for i in range(20)])
    rows = merkle.manifest(table)
    assert rows.filter(merkle.folded("leaf", "path") == F.col("root")).count() == 20
    wrong = rows.withColumn("leaf", F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)))
    assert wrong.filter(merkle.folded("leaf", "path") == F.col("root")).count() == 0


def test_numbers_do_not_depend_on_partitions(spark):
    table = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = merkle.numbered(table.repartition(13), ["g"], ["v"]).collect()
    for g in range(3):
        own = sorted((r.v, r.idx, r.n) for r in got if r.g == g)
        assert [(i, len(own)) for i in range(len(own))] == [(i, n) for _, i, n in own]
