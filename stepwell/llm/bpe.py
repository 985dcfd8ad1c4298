"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

tiktoken splits a text with a pattern and merges the bytes of every match separately. Long texts
are first cut at safe boundaries, where a match of the pattern ends whatever surrounds it: between
a character that is not white space and white space (no match holds white space after anything
else), and between a letter and a digit in either order. So the ids are those of the whole text.
Decoding joins the raw bytes of the ids; they are turned into text only where asked for.

Defined cases: a null text counts as empty and has no ids; strings that look like special tokens
are ordinary text; rows, ids and extra columns are taken as they are, ties do not arise, an empty
table gives an empty result. A stretch without a safe boundary is merged whole, however long; over
``STRETCH_CHARS`` its matches are found by the regex module, as the library's own matcher runs out of
stack on them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

RANKS = "byte_bpe_50k.tiktoken"
SAFE_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
PIECE_CHARS, STRETCH_CHARS = 1 << 16, 1 << 18


@lru_cache(maxsize=4)
def encoder(ranks_path: str | None = None):
    """The encoding of a rank file, loaded once per Python worker. ``None``: the installed one."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def pieces(text: str, at_least: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after every ``at_least`` characters."""
    start = 0
    while len(text) - start > at_least:
        cut = SAFE_BOUNDARY.search(text, start + at_least)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _encode_piece(piece: str, ranks_path: str | None) -> list[int]:
    own = encoder(ranks_path)
    if len(piece) <= STRETCH_CHARS:
        return own.encode_ordinary(piece)
    matches = regex.finditer(own._pat_str, piece)
    return [token for match in matches for token in own._encode_single_piece(match.group())]


def encode(text: str, ranks_path: str | None = None) -> np.ndarray:
    """Token ids as little-endian unsigned 32-bit integers."""
    parts = [np.array(_encode_piece(piece, ranks_path), "<u4") for piece in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, ranks_path: str | None = None) -> bytes:
    return encoder(ranks_path).decode_bytes(ids.tolist())


def encoded(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids``: binary, little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def to_ids(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(text, ranks_path).tobytes() for text in texts], dtype=object)

    return docs.withColumn("token_ids", to_ids(text_or_empty()))


def decoded(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``: the raw bytes of ``token_ids``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def to_bytes(ids: pd.Series) -> pd.Series:
        return pd.Series([decode(np.frombuffer(x, "<u4"), ranks_path) for x in ids], dtype=object)

    return docs.withColumn("decoded", to_bytes("token_ids"))


def token_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row, from the ids and decoded bytes.

    Encoding and decoding run in one pass, so neither ids nor bytes travel between steps.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            ids = encode(text, ranks_path)
            back = decode(ids, ranks_path)
            rows.append(
                (ids.size, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest())
            )
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select("doc_id", digests(text_or_empty()).alias("_d"))
    return found.select("doc_id", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")
