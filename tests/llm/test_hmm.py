from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from stepwell.llm import hmm

from .conftest import ODD


def model(rng, k=3):
    def shares(*shape):
        x = rng.random(shape) + 0.01
        return x / x.sum(axis=-1, keepdims=True)

    return hmm.Hmm(shares(k), shares(k, k), shares(k, hmm.SYMBOLS))


def forward(m, symbols):
    state, total = m.start * m.emit[:, symbols[0]], 0.0
    for s in symbols[1:]:
        total += math.log10(state.sum())
        state = (state / state.sum()) @ m.move * m.emit[:, s]
    return total + math.log10(state.sum())


def test_pieces_give_the_exact_likelihood():
    rng = np.random.default_rng(1)
    m = model(rng)
    texts = [rng.integers(0, hmm.SYMBOLS, n) for n in (1, 2, 7, 8, 9, 30, 300)]
    got = hmm.log_likelihoods(m, texts, length=8)
    assert got == pytest.approx([forward(m, t) for t in texts], rel=1e-10)


def test_expected_counts_by_enumeration(monkeypatch):
    rng = np.random.default_rng(2)
    m = model(rng)
    symbols = np.array([5, 9, 5, 1])
    paths = np.array(np.meshgrid(*[range(3)] * 4)).reshape(4, -1).T
    weights = np.array([
        m.start[p[0]] * np.prod([m.emit[p[i], symbols[i]] for i in range(4)])
        * np.prod([m.move[p[i], p[i + 1]] for i in range(3)]) for p in paths
    ])
    weights /= weights.sum()
    move, emit = np.zeros((3, 3)), np.zeros((3, hmm.SYMBOLS))
    for p, w in zip(paths, weights, strict=True):
        for i in range(4):
            emit[p[i], symbols[i]] += w
            if i:
                move[p[i - 1], p[i]] += w
    got = hmm._expected(m, *hmm._pieces([symbols], 6))
    assert got[0] == pytest.approx(emit[:, symbols[0]] * 0 + [weights[paths[:, 0] == k].sum() for k in range(3)])
    assert got[1] == pytest.approx(move) and got[2] == pytest.approx(emit)


def brute(rows):
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [4, 1 << 16])
def test_counts_and_base_scores(spark, docs, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    rows = [*ODD, *((i, "held out words " * (i % 5)) for i in range(20, 50))]
    got = hmm.score(docs(*rows), rounds=1).collect()
    assert sorted((tuple(r)[:5] + (round(r.base_score, 6),) for r in got), key=str) == brute(rows)
    assert all(r.score < 0 for r in got)


def test_empty_and_held_out_only(spark, docs):
    assert hmm.score(docs(*ODD).limit(0), rounds=1).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.score(docs((held, "a b")), rounds=1).head()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0


def test_states_help_on_held_out_texts(spark, docs):
    rng = random.Random(4)
    lists = [[f"{p}{i}{p}" for i in range(40)] for p in ("en", "fr", "de")]
    rows = [(i, " ".join(rng.choice(lists[i % 3]) for _ in range(60))) for i in range(300)]
    got = [r for r in hmm.score(docs(*rows)).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert len(got) > 20 and gain > 0.2
