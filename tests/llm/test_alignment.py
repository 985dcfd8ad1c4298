from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from stepwell.llm import alignment

from .conftest import ODD

TEXT = st.text(alphabet="ab1 '.\n\té!s<|>\U0001f600\u00a0\u2581\u4e2d", max_size=60)


def brute_groups(text):
    """Groups of (A ids, B ids) of a whole text, cut at the offsets where both end a token."""
    own = alignment.tokenizers()
    if not text:
        return []
    ids = own.encode(" " + text)
    if ids is None:
        return []
    a, b = (x.tolist() for x in ids)
    ends = [np.cumsum([len(names[i]) for i in ids]).tolist() for names, ids in ((own.a_bytes, a), (own.b_bytes, b))]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def brute(texts):
    groups = [brute_groups(t) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for g, own in zip(groups, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append(
            (
                sum(len(x) for x, _ in g),
                sum(len(y) for _, y in g),
                len(g),
                sum(own.values()),
                sum(n for p, n in own.items() if count[p] == most[p[0]]),
                sum(n * count[p] for p, n in own.items()),
                hashlib.sha256(shown.encode()).hexdigest() if g else "",
            )
        )
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT.filter(bool), min_size=1, max_size=4), st.sampled_from([1, 20, 1 << 15]))
def test_stretches_encode_like_the_whole(texts, joined):
    own = alignment.tokenizers()
    usual, alignment.JOINED_CHARS = alignment.JOINED_CHARS, joined
    try:
        cut = [own.cut(t) for t in texts]
        parts = own.encode_all([x for t in cut for x in t])
    finally:
        alignment.JOINED_CHARS = usual
    a, b, n_a, n_b = map(np.concatenate, zip(*parts, strict=True))
    whole = [own.encode(" " + t) for t in texts]
    at = np.cumsum([0, *map(len, cut)])
    ends_a, ends_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
    for ids, i, j in zip(whole, at[:-1], at[1:], strict=True):
        if ids is None:
            assert (n_a[i:j] == 0).any()
            continue
        assert a[ends_a[i] : ends_a[j]].tolist() == ids[0].tolist()
        assert b[ends_b[i] : ends_b[j]].tolist() == ids[1].tolist()
        assert (n_a[i:j] > 0).all() and (n_b[i:j] > 0).all()


def test_ids_are_the_libraries(spark):
    own = alignment.tokenizers()
    text = "Some text,  with\nlines and <|endoftext|> 12 caf\u00e9"
    a, b = own.encode(" " + text)
    assert a.tolist() == own.a.encode(" " + text, add_special_tokens=False).ids
    assert b.tolist() == own.b.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_a_block_against_brute_force(texts):
    figures, pairs, in_docs = alignment.align_block(alignment.tokenizers(), texts)
    expected = brute(texts)
    assert [tuple(x) for x in figures[["n_a", "n_b", "n_groups", "n_links"]].values] == [x[:4] for x in expected]
    assert figures["groups_sha256"].tolist() == [x[-1] for x in expected]
    counts = Counter(
        a << 32 | b for t in texts for a, b in {(a, b) for x, y in brute_groups(t) for a in x for b in y}
    )
    assert {p: n for p, n in zip(pairs.tolist(), in_docs.tolist(), strict=True) if p >= 0} == counts


SOME = [
    *ODD,
    (20, "a\u2581b"),
    (21, "<|endoftext|> <s> </s> <unk>"),
    (22, "trailing blank "),
    (23, "  two blanks  and   three"),
    (24, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 " * 50),
    (25, "0" * 5000),
    (2**60 + 1, "the cat sat on another mat"),
    (27, "cr\r\nlf\ttab \x00 nul"),
]


@pytest.mark.parametrize("block_docs", [2048, 3])
def test_against_brute_force(spark, docs, monkeypatch, block_docs):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(alignment, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = alignment.alignment_scores(docs(*SOME).repartition(3)).select(columns).collect()
    expected = [(i, *x) for (i, _), x in zip(SOME, brute([t for _, t in SOME]), strict=True)]
    assert sorted((tuple(r) for r in rows), key=str) == sorted(expected, key=str)
    assert alignment.alignment_scores(docs(*SOME).limit(0)).count() == 0


def test_many_links_in_one_group(monkeypatch):
    texts = ["0" * 700 + " x", "a" * 300, "0" * 700]
    usual = alignment.align_block(alignment.tokenizers(), texts)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 1)
    counted = alignment.align_block(alignment.tokenizers(), texts)
    assert usual[0].equals(counted[0]) and all(map(np.array_equal, usual[1:], counted[1:]))


def test_ranked_pairs(spark, docs):
    table = docs("the cat", "the cat", "the dog", "<|x")
    found = {(r.a_id, r.b_id): (r["count"], r.is_best) for r in alignment.ranked(alignment.linked(table)).collect()}
    own = alignment.tokenizers()
    the = tuple(int(x[0]) for x in own.encode(" the"))
    assert found[the] == (3, True)
