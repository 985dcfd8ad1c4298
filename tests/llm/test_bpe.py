from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from stepwell.llm import bpe

from .conftest import ODD


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 '\n\té!s\U0001f600\u00a0", max_size=60), st.integers(1, 9))
def test_pieces_encode_like_the_whole(text, size):
    own = bpe.encoder()
    ids = [i for p in bpe.pieces(text, size) for i in own.encode_ordinary(p)]
    assert ids == own.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 200_000, " " * 100_000 + "x", "ab 12 " * 60_000, "\n" * 70_000])
def test_round_trip(text):
    ids = bpe.encode(text)
    assert bpe.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 300_000, " \n" * 150_000 + "x", "^" * 300_000, "\u00a0" * 300_000 + "1"])
def test_long_stretches_encode_like_the_library(text):
    assert bpe.encode(text).tolist() == bpe.encoder().encode_ordinary(text)


def test_stretches_beyond_the_librarys_stack():
    text = "ab" + " " * 1_500_000 + "x"
    assert bpe.decode(bpe.encode(text)).decode() == text


def test_digests(spark, docs):
    table = docs(*ODD)
    rows = bpe.token_digests(table).collect()
    own = bpe.encoder()
    expected = []
    for i, text in ODD:
        ids = own.encode_ordinary(text or "")
        expected.append(
            (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((text or "").encode()).hexdigest())
        )
    assert [tuple(r) for r in rows] == expected
    back = bpe.decoded(bpe.encoded(table)).select("text", "decoded").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.token_digests(table.limit(0)).count() == 0
