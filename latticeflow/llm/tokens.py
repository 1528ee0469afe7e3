"""Encoding of texts with a public byte-level BPE, by a monoid tree reduction, and decoding up the same tree.

A leaf of the tree is a piece of the text, encoded on its own. Two neighbours are joined by encoding a window
around the seam anew: it begins where a word of the left piece begins that can't have seen the seam, and grows to
the right until one of its words ends where a word of the right piece begins; from there on both agree, because
the splitter looks only ahead, so what follows a word's end doesn't depend on what comes before it. The BPE never
merges across words; hence the joined ids are those of the whole text, and only the words at a seam are encoded twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Characters (when decoding, ids) of a leaf, and characters of the first window at a seam. Half of the test documents have several leaves (`p7_leaves`).
LEAF, WINDOW = 512, 64
#: The splitter reads at most this many characters beyond the end of a word: contractions and the space before a word.
LOOKAHEAD = 4


@lru_cache(maxsize=4)
def _encoder(name: str, folder: str | None):
    import tiktoken

    import public_tokenizers as public

    path = f"{folder}/{name}.tiktoken" if folder else public.path(f"{name}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(public.PATTERN)


class Piece:
    """Encoded text: its ids, and its words as (start, end)."""

    __slots__ = ("ids", "text", "words")

    def __init__(self, text: str, ids: np.ndarray, words: np.ndarray):
        self.text, self.ids, self.words = text, ids, words


class TreeEncoder:
    """encode(text) gives the ids of the whole text, decode(ids) the text; strings that look like special tokens are ordinary text."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None, leaf: int = LEAF):
        self.bpe, self.words = _encoder(name, folder)
        self.leaf = max(2, leaf)

    def encode(self, text: str | None) -> list[int]:
        return self._tree(text, 0, len(text)).ids.tolist() if text else []

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids; none for null. Bytes that are no UTF-8, as single ids may give, become replacement characters."""
        return self._bytes(ids, 0, len(ids)).decode("utf-8", "replace") if ids is not None and len(ids) else ""

    def _bytes(self, ids: list[int], a: int, b: int) -> bytes:
        if b - a <= self.leaf:
            return self.bpe.decode_bytes(ids[a:b])
        mid = (a + b) // 2
        return self._bytes(ids, a, mid) + self._bytes(ids, mid, b)

    def _piece(self, text: str) -> Piece:
        return Piece(text, np.array(self.bpe.encode_ordinary(text), np.int32), np.array([m.span() for m in self.words.finditer(text)], np.int64).reshape(-1, 2))

    def _tree(self, text: str, a: int, b: int) -> Piece:
        if b - a <= self.leaf:
            return self._piece(text[a:b])
        mid = (a + b) // 2
        return self.join(self._tree(text, a, mid), self._tree(text, mid, b))

    def _sizes(self, text: str, words: np.ndarray) -> int:
        """Ids of some words."""
        return sum(len(self.bpe.encode_ordinary(text[x:y])) for x, y in words.tolist())

    def join(self, left: Piece, right: Piece) -> Piece:
        if not len(left.words) or not len(right.words):
            return right if not len(left.words) else left
        text, seam = left.text + right.text, len(left.text)
        # words that end well before the seam were split without seeing it
        keep = int(np.searchsorted(left.words[:, 1], seam - LOOKAHEAD, side="right"))
        keep = max(0, keep - 1)
        begin = int(left.words[keep, 0])
        right_starts = right.words[:, 0] + seam
        size = WINDOW
        while True:
            end = min(len(text), seam + size)
            window, met = text[begin:end], -1
            spans: list[tuple[int, int]] = []
            for m in self.words.finditer(window):
                stop = begin + m.end()
                if end < len(text) and stop > end - LOOKAHEAD:
                    break  # it may have seen the end of the window
                spans.append((begin + m.start(), stop))
                if stop >= seam:
                    k = int(np.searchsorted(right_starts, stop))
                    if k < len(right_starts) and right_starts[k] == stop:
                        met = k
                        break
            if met >= 0 or end == len(text):
                break
            size *= 4
        if met < 0:
            met = len(right_starts)
        middle = np.array([i for x, y in spans for i in self.bpe.encode_ordinary(text[x:y])], np.int32)
        head = len(left.ids) - self._sizes(left.text, left.words[keep:])
        tail = self._sizes(right.text, right.words[:met])
        words = np.concatenate([left.words[:keep], np.array(spans, np.int64).reshape(-1, 2), right.words[met:] + seam])
        return Piece(text, np.concatenate([left.ids[:head], middle, right.ids[tail:]]), words)


def encode_column(df: DataFrame, key: str, text: str, out: str = "ids", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, out): the ids of each row's text, without special tokens, in the row's own task; nothing is shuffled.

    Null and empty texts have an empty list; every row of `df` gives one row. `folder` holds the vocabulary files,
    by default those of the installed package.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = TreeEncoder(name, folder)
        for b in batches:
            yield pd.DataFrame({key: b[key], out: [coder.encode(t) for t in b[text]]})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, `{out}` array<int>")


def decode_column(df: DataFrame, key: str, ids: str = "ids", out: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, out): the text of each row's ids; null and empty lists give an empty text. Nothing is shuffled."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = TreeEncoder(name, folder)
        for b in batches:
            yield pd.DataFrame({key: b[key], out: [coder.decode(None if x is None else list(x)) for x in b[ids]]})

    return df.select(key, ids).mapInPandas(run, f"`{key}` {kind}, `{out}` string")
