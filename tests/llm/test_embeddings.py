from __future__ import annotations

import numpy as np
from stepwell.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, copies int, valid int"


def brute(ids, vectors, least=0.95):
    good = [
        i for i, v in enumerate(vectors)
        if ids[i] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {i: [] for i in range(len(ids))}
    unit = {i: np.array(vectors[i], float) / np.linalg.norm(np.array(vectors[i], float)) for i in good}
    for a in good:
        for b in good:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a].append(b)
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_id = ids[i] if i not in good else min(ids[j] for j in seen)
        out.append((ids[i], len(links[i]), least_id, ids[i] == least_id))
    return sorted(out, key=str)


def rows_of(spark, ids, vectors):
    table = spark.createDataFrame([(i, v, 1, 9, 9) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    return sorted(map(tuple, embeddings.near_duplicates(table).collect()), key=str)


def test_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.01]
    vectors = [a, a, b, None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0],
               [float("inf"), 1.0, 1.0, 1.0], [2.0, 4.0, 6.0], a, [4.0, -3.0, 2.0, -1.0], a]
    ids = [5, 3, 9, 11, 12, 13, 14, 15, 16, 17, 3, 18, None]
    assert rows_of(spark, ids, vectors) == brute(ids, vectors)
    empty = spark.createDataFrame([], SCHEMA)
    assert embeddings.near_duplicates(empty).count() == 0


def test_recall_and_precision_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    near = [c + rng.standard_normal(32) * rng.uniform(0.05, 0.3) for c in centres for _ in range(8)]
    vectors = [np.float32(v).tolist() for v in [*near, *rng.standard_normal((400, 32))]]
    ids = list(range(len(vectors)))
    got, expected = rows_of(spark, ids, vectors), brute(ids, vectors)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in expected)
    by_id = {r[0]: r for r in expected}
    assert all(r[1] <= by_id[r[0]][1] for r in got)


def test_blocks_of_a_large_filter(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(2)
    vectors = [np.float32(v).tolist() for v in np.ones(16) + rng.standard_normal((120, 16)) * 0.03]
    ids = list(range(120))
    assert rows_of(spark, ids, vectors) == brute(ids, vectors)


def test_decoding_lists_exactly_the_caps_that_hold_a_vector():
    code = embeddings.Code(12, 3, 7, 0.4)
    books = code.books()
    unit = np.random.default_rng(3).standard_normal((20, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for x, found in zip(unit, code.decode(unit, books), strict=True):
        every = [
            (i * 7 + j) * 7 + k for i in range(7) for j in range(7) for k in range(7)
            if sum(x[at] @ w[c] for (w, at), c in zip(books, (i, j, k), strict=True)) > 0.4
        ]
        assert found.tolist() == every


def test_recall_stays_as_the_table_grows():
    rng = np.random.default_rng(4)
    for dim, vectors in ((64, 20_000), (64, 2_000_000), (64, 20_000_000), (16, 100_000), (4, 100_000), (2, 100_000)):
        code = embeddings.plan(vectors, dim)
        x, z = rng.standard_normal((2, 500, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.955 * x + np.sqrt(1 - 0.955**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        books = code.books()
        lists = list(zip(code.decode(x, books), code.decode(y, books), strict=True))
        assert all(len(a) and len(b) for a, b in lists)
        assert sum(bool(np.intersect1d(a, b).size) for a, b in lists) >= 0.99 * len(lists)


def test_few_dimensions_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [np.float32(v).tolist() for dim in (1, 2, 3, 5, 16) for v in rng.standard_normal((60, dim))]
    ids = list(range(len(vectors)))
    assert rows_of(spark, ids, vectors) == brute(ids, vectors)
