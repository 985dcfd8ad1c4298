"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which of another.

A text's tokens under two tokenizers, A and B, are intervals of its bytes. All intervals are sorted
by start (``lexsort``); a running maximum of their ends tells where groups break: at every start
that reaches it. Inside a group every A token is linked with every B token. The number of documents
that hold an id pair linked, over the whole corpus, then ranks the links.

Texts are cut where both tokenizers end a token whatever stands around: at a blank that follows a
letter, digit or ASCII mark. A's pattern never holds white space after anything else, and no piece
of B holds a blank after anything else (checked when B is loaded; if one does, texts stay whole).
Words repeat, so each distinct stretch is encoded and aligned once per block and a document adds up
its stretches.

Documents are read in blocks of bounded size. A block lists its distinct id pairs once with the
number of its documents that hold each, so what is shuffled to count pairs and to bring the counts
back is one row per block and pair, not one per document and pair. Counts are grouped with partial
sums, so frequent pairs do not gather in one task. The highest count of each A id is at most one row
per entry of A's vocabulary and is broadcast.

Defined cases: a null or empty text, and one that B's bytes do not give back (it holds U+2581), has
no tokens: zeros and ''. Strings that look like special tokens are ordinary text. Rows count
once each, equal ones and those without id too. Extra columns are ignored; an empty table gives an
empty result. Texts are encoded whole; a stretch without a cut may be as long as its text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import ranges, small_batches, text_or_empty

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A block ends with the batch that reaches one of these.
BLOCK_DOCS, BLOCK_CHARS = 2048, 1 << 23
JOINED_CHARS = 1 << 15
#: Groups with more links count their equal ids before pairing them.
LINKS_AT_ONCE = 4096
MARK = r"[\w!-/:-@\[-`{-~]"
CUT_AFTER = re.compile(MARK)
CUT = re.compile(rf"(?<={MARK})(?= .)", re.DOTALL)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others are numbered on from 256 in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Two tokenizers; a text's token ids under each, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_of()
        a_names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        # an added token is not written in byte characters; its text never becomes that token
        self.a_bytes = [
            bytes(byte_of[c] for c in x) if all(c in byte_of for c in x) else x.encode() for x in a_names
        ]
        b_names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
            for i, x in enumerate(b_names)
        ]
        self.can_cut = not any("▁" in x.lstrip("▁") for x in b_names)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # an id's digits with what follows it: in the same list, or at the list's end
        self.shown = np.array(
            [f"{i}{end}" for n, ends in ((len(a_names), ",|"), (len(b_names), ",;")) for end in ends for i in range(n)],
            dtype=object,
        )

    def cut(self, text: str) -> list[str]:
        """A blank and ``text``, in stretches that can be encoded on their own."""
        return CUT.split(" " + text) if self.can_cut else [" " + text]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B for a text that begins with the blank; None if their bytes differ from it."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:])  # B adds the blank itself
        data = text.encode()
        if data == b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]):
            return np.array(a, np.int64), np.array(b, np.int64)
        return None

    def encode_all(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per run of stretches the ids of A and B, and for each stretch its number of either.

        Stretches are joined while one ends where texts may be cut, so a tokenizer is called once per
        ``JOINED_CHARS``. A stretch whose bytes do not come back has no ids.
        """
        found = []

        def add(run: list[str]) -> None:
            ids = self.encode("".join(run))
            if ids is None and len(run) > 1:
                for x in run:
                    add([x])
                return
            if ids is None:
                ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
            ends = np.cumsum([len(x.encode()) for x in run])
            counts = [
                np.diff(np.searchsorted(np.cumsum(size[x]), ends, "right"), prepend=0)
                for x, size in zip(ids, (self.a_size, self.b_size), strict=True)
            ]
            found.append((*ids, *counts))

        run: list[str] = []
        chars = 0
        for x in stretches:
            run.append(x)
            chars += len(x)
            if chars >= JOINED_CHARS or not self.can_cut or not CUT_AFTER.match(x[-1]):
                add(run)
                run, chars = [], 0
        if run:
            add(run)
        return found


@lru_cache(maxsize=2)
def tokenizers(a_path: str | None = None, b_path: str | None = None) -> Pair:
    """Both tokenizers, loaded once per Python worker. ``None``: the installed files."""
    import public_tokenizers as files

    return Pair(a_path or files.path(A_FILE), b_path or files.path(B_FILE))


class Aligned:
    """Groups of many stretches at once, and what follows from them per stretch."""

    def __init__(self, own: Pair, stretches: list[str]):
        n = len(stretches)
        none = [np.zeros(0, np.int64)] * 4
        a, b, self.n_a, self.n_b = map(np.concatenate, zip(none, *own.encode_all(stretches), strict=True))
        self.good = self.n_a > 0
        group, kind, ids, of = self._coalesce(own, a, b)
        ends = np.r_[np.flatnonzero(np.diff(group)) + 1, group.size] if group.size else np.zeros(0, np.int64)
        firsts = np.r_[0, ends[:-1]] if ends.size else ends
        a_in = np.add.reduceat((kind == 0).astype(np.int64), firsts) if ends.size else ends  # tokens of A in each group
        b_in = ends - firsts - a_in
        group_of = of[firsts] if ends.size else ends
        self.n_groups = np.bincount(group_of, minlength=n)
        self.n_links = np.bincount(group_of, a_in * b_in, n).astype(np.int64)
        self.texts = self._written(own, group, kind, ids, of, n)
        self._expand(ids, firsts, a_in, b_in, group_of, n)

    def _coalesce(self, own: Pair, a: np.ndarray, b: np.ndarray):
        """All tokens in the order of their groups, A's before B's in each."""
        n = len(self.n_a)
        of = np.r_[np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)]
        ends = np.r_[np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])]  # both cover the same bytes
        starts = ends - np.r_[own.a_size[a], own.b_size[b]]
        kind = np.r_[np.zeros(a.size, np.int8), np.ones(b.size, np.int8)]
        ids = np.r_[a, b]
        order = np.lexsort((kind, starts))
        reach = np.maximum.accumulate(ends[order])
        breaks = np.r_[False, starts[order][1:] >= reach[:-1]] if order.size else np.zeros(0, bool)
        group = np.empty(order.size, np.int64)
        group[order] = np.cumsum(breaks)
        order = np.lexsort((starts, kind, group))
        return group[order], kind[order], ids[order], of[order]

    def _written(self, own: Pair, group, kind, ids, of, n: int) -> list[str]:
        """``a1,a2|b1;a3|b2`` per stretch."""
        if not group.size:
            return [""] * n
        last = np.r_[(np.diff(group) != 0) | (np.diff(kind) != 0), True]
        n_a, n_b = len(own.a_size), len(own.b_size)
        parts = own.shown[ids + np.where(kind == 0, last * n_a, 2 * n_a + last * n_b)]
        at = np.r_[0, np.cumsum(np.bincount(of, minlength=n))]
        return ["".join(parts[i:j])[:-1] for i, j in zip(at[:-1], at[1:], strict=True)]

    def _expand(self, ids, firsts, a_in, b_in, group_of, n: int) -> None:
        """The distinct id pairs of every stretch and how many links each has there.

        In groups of many links equal ids are counted before they are paired, so that a long run of
        one token is one pair.
        """
        codes, links, of = [], [], []
        plain = a_in * b_in <= LINKS_AT_ONCE
        first, left, right = firsts[plain], a_in[plain], b_in[plain]
        size = left * right
        at = np.repeat(np.arange(size.size), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a = ids[first[at] + place // right[at]]
        b = ids[first[at] + left[at] + place % right[at]]
        codes.append(a << 32 | b)
        links.append(np.ones(a.size, np.int64))
        of.append(group_of[plain][at])
        for g in np.flatnonzero(~plain):
            a, m = np.unique(ids[firsts[g] : firsts[g] + a_in[g]], return_counts=True)
            b, k = np.unique(ids[firsts[g] + a_in[g] : firsts[g] + a_in[g] + b_in[g]], return_counts=True)
            codes.append((a[:, None] << 32 | b).ravel())
            links.append((m[:, None] * k).ravel())
            of.append(np.full(codes[-1].size, group_of[g]))
        code, link, stretch = map(np.concatenate, (codes, links, of))
        order = np.lexsort((code, stretch))
        code, link, stretch = code[order], link[order], stretch[order]
        new = np.r_[True, (np.diff(code) != 0) | (np.diff(stretch) != 0)][: code.size]
        starts = np.flatnonzero(new)
        self.code = code[starts]
        self.link = np.add.reduceat(link, starts) if starts.size else link
        self.pairs_at = np.r_[0, np.cumsum(np.bincount(stretch[starts], minlength=n))]


def align_block(own: Pair, texts: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Per text its figures with ``at`` and ``links`` (its distinct pairs, by their place in the
    block's list, and their links); the block's distinct pairs, and in how many texts each stands."""
    number: dict[str, int] = defaultdict(lambda: len(number))
    parts = [[number[x] for x in own.cut(text)] if text else [] for text in texts]
    aligned = Aligned(own, list(number))
    n = len(texts)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    stretch = np.fromiter((i for x in parts for i in x), np.int64, sizes.sum())
    doc = np.repeat(np.arange(n), sizes)
    ok = np.bincount(doc, ~aligned.good[stretch], n) == 0
    keep = ok[doc]
    stretch, doc = stretch[keep], doc[keep]
    totals = {
        name: np.bincount(doc, getattr(aligned, name)[stretch], n).astype(np.int64)
        for name in ("n_a", "n_b", "n_groups", "n_links")
    }
    digests = [
        hashlib.sha256(";".join([aligned.texts[i] for i in x]).encode()).hexdigest() if fine and x else ""
        for x, fine in zip(parts, ok, strict=True)
    ]
    # a document's distinct stretches with their times, then the pairs of these
    base = max(len(number), 1)
    held, times = np.unique(doc * base + stretch, return_counts=True)
    doc, stretch = held // base, held % base
    index, size = ranges(aligned.pairs_at, stretch)
    pairs, place = np.unique(aligned.code, return_inverse=True)
    base = max(pairs.size, 1)
    key = np.repeat(doc, size) * base + place[index]
    held, back = np.unique(key, return_inverse=True)
    links = np.bincount(back, aligned.link[index] * np.repeat(times, size), held.size).astype(np.int64)
    at = held % base
    bounds = np.searchsorted(held // base, np.arange(n + 1))
    in_docs = np.bincount(at, minlength=pairs.size)
    cut = lambda values: [values[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    figures = pd.DataFrame(
        {
            **totals,
            "groups_sha256": digests,
            "at": cut(at.astype("<i4")),
            "links": cut(links),
        }
    )
    held = in_docs > 0  # a pair that only texts without tokens hold
    return figures, np.where(held, pairs, -1), in_docs


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The aligned documents by block, written: rows of documents (``pairs`` null) with their id as
    text (pandas would make floats of ids beside a null) and their figures, and one row per block whose ``pairs`` lists its id pairs (A id * 2^32 + B id; -1: none) and
    whose ``in_docs`` tells in how many of its documents each is linked."""
    small_batches(docs.sparkSession)
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "links"]

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizers(a_path, b_path)

        def block(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(held, ignore_index=True)
            name = rows["row"].iloc[0]
            figures, pairs, in_docs = align_block(own, rows["text"].tolist())
            figures.insert(0, "block", name)
            figures.insert(1, "doc_id", rows["doc_id"])
            figures = figures.assign(pairs=None, in_docs=None)
            for i in range(0, len(figures), 256):
                yield figures.iloc[i : i + 256]
            one = {"block": name, "doc_id": None} | dict.fromkeys(columns) | {"pairs": pairs, "in_docs": in_docs}
            yield pd.DataFrame([one])[figures.columns]

        held: list[pd.DataFrame] = []
        n_docs = n_chars = 0
        for batch in batches:
            held.append(batch)
            n_docs += len(batch)
            n_chars += int(batch["text"].str.len().sum())
            if n_docs >= BLOCK_DOCS or n_chars >= BLOCK_CHARS:
                yield from block(held)
                held, n_docs, n_chars = [], 0, 0
        if held:
            yield from block(held)

    doc_id = F.col("doc_id").cast("string").alias("doc_id")
    texts = docs.select(doc_id, text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    return materialize(
        texts.mapInPandas(
            align,
            "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
            " at binary, links binary, pairs array<long>, in_docs array<long>",
        )
    )


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, count``: in how many documents of ``linked`` each id pair is linked."""
    return _listed(rows).groupBy("pair").agg(F.sum("in_docs").alias("count"))


def _listed(rows: DataFrame) -> DataFrame:
    """One row per block and pair, with the pair's ``place`` in its block's list."""
    lists = rows.filter(F.col("pairs").isNotNull())
    return (
        lists.select("block", F.posexplode(F.arrays_zip("pairs", "in_docs")).alias("place", "x"))
        .select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.in_docs").alias("in_docs"))
        .filter("pair >= 0")
    )


def ranked(rows: DataFrame) -> DataFrame:
    """``a_id, b_id, count, is_best`` for every id pair; best: no other pair of the A id counts more."""
    counts = materialize(pair_counts(rows)).withColumn("a_id", F.shiftright("pair", 32))
    best = counts.groupBy("a_id").agg(F.max("count").alias("most"))  # as many rows as A has entries
    found = counts.join(F.broadcast(best), "a_id")
    return found.select(
        "pair",
        "a_id",
        F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"),
        "count",
        (F.col("count") == F.col("most")).alias("is_best"),
    )


def alignment_scores(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    rows = linked(docs, a_path, b_path)
    known = _listed(rows).join(ranked(rows).select("pair", "count", "is_best"), "pair")
    known = known.select(F.col("block").alias("of_block"), "place", "count", "is_best")

    def add_up(of_docs: pd.DataFrame, of_pairs: pd.DataFrame) -> pd.DataFrame:
        size = int(of_pairs["place"].max()) + 1 if len(of_pairs) else 0
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = of_pairs["place"].to_numpy()
        count[place], best[place] = of_pairs["count"], of_pairs["is_best"]
        sums = []
        for at, links in zip(of_docs["at"], of_docs["links"], strict=True):
            at, links = np.frombuffer(at, "<i4"), np.frombuffer(links, "<i8")
            sums.append((int(best[at] @ links), int(count[at] @ links)))
        found = pd.DataFrame(sums, columns=["n_best", "count_sum"], dtype="int64")
        own = of_docs[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].reset_index(drop=True)
        return pd.concat([own, found], axis=1)

    of_docs = rows.filter(F.col("pairs").isNull()).drop("pairs", "in_docs")
    found = (
        of_docs.groupBy("block")
        .cogroup(known.groupBy("of_block"))
        .applyInPandas(
            add_up,
            "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
            " n_best long, count_sum long",
        )
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
